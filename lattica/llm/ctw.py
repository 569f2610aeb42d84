"""Context-tree weighting of bytes, trained over a whole corpus.

Every byte is coded as eight binary decisions. A decision's context is the bits of the byte
coded so far and the last 0..``depth`` bytes; each (context, bits) node holds a
Krichevsky-Trofimov estimator, and the tree mixes all depths with the weights of the
context-tree method, fixed after training. A document is preceded by 0xFF bytes and ended by
one 0xFF, which UTF-8 never uses; the end is coded, so scores are probabilities of texts.

Nothing is gathered by document or on one machine: documents are dealt into chunks, a chunk
sends the distinct byte strings of ``depth + 1`` bytes it holds (with training counts) to
buckets keyed by the last two context bytes, or by the last three where the two are so frequent
that one task would get too many strings; a bucket builds the part of the tree below its contexts
and answers with log-probabilities, and the chunk adds them up. Only the 65,536 possible nodes of
depths 0 and 1, and the depth-2 nodes of at most ``HOT`` divided pairs, go through the driver.

``bits_per_byte`` is a text's code length over its coded bytes (those of the text and its end).

Defined cases: null text is empty and still codes its end; a node without training data
predicts what its parent's own estimator predicts; with no training data at all every bit
has probability 1/2. Repeated rows are scored each for itself and counted each, and are dealt
into chunks like any others; null doc_ids are kept; extra columns are not read; a text of any
length is in one chunk, whole; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U

END = 0xFF
END_WORD = b" "  # no word holds white space
LN2 = math.log(2.0)
HOT = 1024  # pairs of bytes that are divided by a third, at most


# ---------------------------------------------------------------- numeric kernels

def lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    z = x + 8
    r = 1 / z
    r2 = r * r
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 / 1680))) - np.log(shift)


def kt_log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the KT probability of a block with n0 zeros and n1 ones, in any order."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - math.log(math.pi) - lgamma(n0 + n1 + 1.0)


def stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array after ``depth`` bytes of padding, and each document's number of coded bytes."""
    gap = bytes([END]) * max(depth, 1)
    data = np.frombuffer(bytes([END]) * depth + gap.join([*texts, b""]), np.uint8)
    return data, np.fromiter(map(len, texts), np.int64, len(texts)) + 1


def keys_of(data: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """One key per coded byte: the context from its latest byte to its oldest, then the byte."""
    m = len(data) - depth
    key = np.zeros(m, np.uint64)
    for j in range(1, depth + 1):
        key = (key << np.uint64(8)) | data[depth - j : depth - j + m]
    key = (key << np.uint64(8)) | data[depth:]
    pads = max(depth, 1) - 1
    if pads and len(lengths):
        keep = np.ones(m, bool)
        ends = np.cumsum(lengths + pads)
        for j in range(1, pads + 1):
            at = ends - j
            keep[at[at < m]] = False
        key = key[keep]
    return key


def slices(texts: list[bytes], most: int = 1 << 21, docs: int = 65536):
    """Ranges of at most ``docs`` texts of about ``most`` bytes, at least one text each."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and j - i < docs and (j == i or n + len(texts[j]) <= most):
            n += len(texts[j]) + 1
            j += 1
        yield i, j
        i = j


def batches(texts: list[bytes], depth: int, most: int = 1 << 21):
    """(first document, document number of each key, keys), over at most 65,536 documents each."""
    for i, j in slices(texts, most):
        data, lengths = stream(texts[i:j], depth)
        yield i, lengths, keys_of(data, lengths, depth)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(counts or [np.zeros(0, np.int64)])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = runs(k)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def gram_counts(texts: list[bytes], train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often training documents hold each (0 for the others' own)."""
    ks, cs = [], []
    for i, lengths, key in batches(texts, depth):
        flag = np.repeat(train[i : i + len(lengths)].astype(np.uint64), lengths)
        both = (key << np.uint64(1)) | flag
        both.sort()
        key = both >> np.uint64(1)
        at = runs(key)
        ks.append(key[at])
        cs.append(np.add.reduceat((both & np.uint64(1)).astype(np.int64), at))
    return merge_counts(ks, cs)


class Tree:
    """The nodes of depths ``low``..``depth`` over (key, count) pairs in key order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, low: int):
        self.depth, self.low, self.levels = depth, low, {}
        seen = counts > 0
        # (context, byte) pairs of each depth, the deepest first
        pair, cnt = keys[seen], counts[seen].astype(np.float64)
        below = None
        for d in range(depth, low - 1, -1):
            if d < depth:
                pair = ((pair >> np.uint64(16)) << np.uint64(8)) | (pair & np.uint64(255))
                order = np.argsort(pair, kind="stable")
                pair, cnt = pair[order], cnt[order]
                at = runs(pair)
                pair, cnt = pair[at], np.add.reduceat(cnt, at) if len(at) else cnt
            nodes = []
            ctx, byte = pair >> np.uint64(8), pair & np.uint64(255)
            for j in range(8):
                node = (ctx << np.uint64(8)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))
                bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.float64)
                at = runs(node)
                key = node[at]
                n = np.add.reduceat(cnt, at) if len(at) else cnt
                n1 = np.add.reduceat(cnt * bit, at) if len(at) else cnt
                own = kt_log_block(n - n1, n1)
                if below is None:
                    mixed, gate = own, np.ones_like(own)
                else:
                    k2, w2 = below[j]
                    up = ((k2 >> np.uint64(16)) << np.uint64(8)) | (k2 & np.uint64(255))
                    inner = np.bincount(np.searchsorted(key, up), weights=w2, minlength=len(key)) if len(key) else own
                    mixed = np.logaddexp(own, inner) - LN2
                    gate = 1 / (1 + np.exp(np.clip(inner - own, -700, 700)))
                nodes.append((key, (n1 + 0.5) / (n + 1), gate, mixed, n, n1))
            below = [(x[0], x[3]) for x in nodes]
            self.levels[d] = nodes

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the parents of depth ``low`` need: node (parent context, bits), sum of log weights, counts."""
        ks, ws, ns, n1s = [], [], [], []
        for key, _, _, mixed, n, n1 in self.levels[self.low]:
            ks.append(((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255)))
            ws.append(mixed)
            ns.append(n)
            n1s.append(n1)
        k = np.concatenate(ks)
        u, inv = np.unique(k, return_inverse=True)
        return u, *(np.bincount(inv, weights=np.concatenate(x), minlength=len(u)) for x in (ws, ns, n1s))


def upper(k: np.ndarray, w: np.ndarray, n: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Depths 1 and 0 as an array (257, 256, 3): for each (one-byte context, bits) and, last,
    for the empty context: probability of a one, own weight, seen."""
    out = np.zeros((257, 256, 3))
    root = np.zeros((3, 256))

    def fill(rows, cols, inner, n, n1):
        own = kt_log_block(n - n1, n1)
        out[rows, cols, 0] = (n1 + 0.5) / (n + 1)
        out[rows, cols, 1] = 1 / (1 + np.exp(np.clip(inner - own, -700, 700)))
        out[rows, cols, 2] = 1
        return np.logaddexp(own, inner) - LN2

    if len(k):
        ctx, bits = (k >> np.uint64(8)).astype(int), (k & np.uint64(255)).astype(int)
        mixed = fill(ctx, bits, w, n, n1)
        for row, x in zip(root, (mixed, n, n1), strict=True):
            np.add.at(row, bits, x)
        at = np.flatnonzero(root[1] > 0)
        fill(np.full(len(at), 256), at, *root[:, at])
    return out


def log10_probability(keys: np.ndarray, tree: Tree, top: np.ndarray) -> np.ndarray:
    """log10 of each key's byte in its context; keys in order."""
    total = np.zeros(len(keys))
    byte = keys & np.uint64(255)
    deep = {d: (keys >> np.uint64(8 * (tree.depth - d + 1))) << np.uint64(8) for d in tree.levels}
    last = (keys >> np.uint64(8 * tree.depth)).astype(int)
    for j in range(8):
        bits = np.uint64(1 << j) | (byte >> np.uint64(8 - j))
        one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        p = np.full(len(keys), np.nan)
        for d in range(tree.depth, -1, -1):
            if d >= tree.low:
                node, p1, gate = tree.levels[d][j][:3]
                if not len(node):
                    continue
                want = deep[d] | bits
                at = np.minimum(np.searchsorted(node, want), len(node) - 1)
                seen, p1, gate = node[at] == want, p1[at], gate[at]
            else:
                p1, gate, seen = top[last if d else 256, bits.astype(int)].T
                seen = seen > 0
            own = np.where(one, p1, 1 - p1)
            mixed = np.where(np.isnan(p), own, gate * own + (1 - gate) * p)
            p = np.where(seen, mixed, p)
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total


# ---------------------------------------------------------------- exchange between chunks and buckets

def squeeze(a: np.ndarray, ordered: bool = False) -> bytes:
    """An unsigned array as compressed byte planes; of differences where it is in order."""
    if ordered:
        a = np.diff(a, prepend=a.dtype.type(0))
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, kind, ordered: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    a = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if ordered else a


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b"\n") if raw else []


def hot_keys(keys: np.ndarray, depth: int, hot: np.ndarray) -> np.ndarray:
    """Which keys' last two context bytes are in ``hot``, an ascending array."""
    pair = keys >> np.uint64(8 * (depth - 1))
    return hot[np.minimum(np.searchsorted(hot, pair), len(hot) - 1)] == pair if len(hot) else np.zeros(len(keys), bool)


def gram_bucket(keys: np.ndarray, depth: int, buckets: int, hot: np.ndarray) -> np.ndarray:
    suffix = keys >> np.uint64(8 * (depth - 1))
    if len(hot):
        suffix = np.where(hot_keys(keys, depth, hot), (keys >> np.uint64(8 * (depth - 2))) | np.uint64(1 << 24), suffix)
    return ((suffix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def frequent(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs (latest byte, the one before) with more than a quarter of a bucket's mean share, the most frequent first."""
    order = np.argsort(-counts, kind="stable")[:HOT]
    return np.sort(order[counts[order] * 4 * buckets > counts.sum()]).astype(np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes.lower() changes A-Z only


def word_counts(texts: list[bytes], train: np.ndarray) -> tuple[Counter, set]:
    counts, others = Counter(), set()
    for text, learn in zip(texts, train, strict=True):
        if learn:
            counts.update(words_of(text))
            counts[END_WORD] += 1
        else:
            others.update(words_of(text))
            others.add(END_WORD)
    return counts, others


def by_bucket(words: list[bytes], buckets: int) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in sorted(words):
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return out


PART = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("salt", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PART_DDL = "chunk int, bucket int, kind int, salt int, keys binary, counts binary"
MODEL_DDL = "bucket int, kind int, keys binary, counts binary, n double, v double"
ANSWER_DDL = "chunk int, bucket int, kind int, vals binary"
SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _pairs(batches_):
    """Counts of pairs of bytes, the later one high, in 16 parts."""
    total = np.zeros(1 << 16, np.int64)
    for b in batches_:
        for texts in U.text_slices(b.column("text")):
            data = np.frombuffer(bytes([END]).join([b"", *texts, b""]), np.uint8).astype(np.uint16)
            total += np.bincount((data[1:] << np.uint16(8)) | data[:-1], minlength=1 << 16)
    yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([total[i << 12 : (i + 1) << 12].tolist() for i in range(16)], pa.list_(pa.int64()))], names=["part", "n"])


def pair_counts(docs: DataFrame) -> np.ndarray:
    rows = docs.select("text").mapInArrow(_pairs, "part int, n array<long>").select("part", F.posexplode("n").alias("pos", "n"))
    out = np.zeros(1 << 16, np.int64)
    for part, pos, n in rows.where("n > 0").groupBy("part", "pos").agg(F.sum("n")).collect():  # at most 65,536 rows
        out[(part << 12) + pos] = n
    return out


def _split(keys, depth, buckets, hot):
    b = gram_bucket(keys, depth, buckets, hot)
    order = np.argsort(b, kind="stable")
    edges = np.searchsorted(b[order], np.arange(buckets + 1, dtype=np.uint64))
    return [(i, order[edges[i] : edges[i + 1]]) for i in range(buckets) if edges[i] < edges[i + 1]]


def _send(depth: int, buckets: int, per_salt: int, hot: np.ndarray):
    def send(key, table):
        chunk = key[0].as_py()
        texts, train = U.utf8(table["text"]), np.array(table["train"].to_pylist(), bool)
        rows = []
        keys, counts = gram_counts(texts, train, depth)
        for b, at in _split(keys, depth, buckets, hot):
            rows.append((chunk, b, 0, chunk // per_salt, squeeze(keys[at], True), squeeze(counts[at].astype(np.uint64))))
        known, others = word_counts(texts, train)
        for b, words in by_bucket(list(known.keys() | others), buckets).items():
            rows.append((chunk, b, 1, chunk // per_salt, pack_words(words), squeeze(np.array([known.get(w, 0) for w in words], np.uint64))))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), PART, strict=True)], schema=PART)

    return send


def _sum_parts(kind: int, keys: list[bytes], counts: list[bytes]) -> tuple[bytes, bytes, float, float]:
    if kind == 0:
        k, c = merge_counts([expand(x, np.uint64, True) for x in keys], [expand(x, np.uint64).astype(np.int64) for x in counts])
        return squeeze(k[c > 0], True), squeeze(c[c > 0].astype(np.uint64)), 0.0, 0.0
    total: Counter = Counter()
    for ks, cs in zip(keys, counts, strict=True):
        for w, c in zip(unpack_words(ks), expand(cs, np.uint64).tolist(), strict=True):
            if c:
                total[w] += c
    words = sorted(total)
    return pack_words(words), squeeze(np.array([total[w] for w in words], np.uint64)), float(sum(total.values())), float(len(words))


def _stream_sum(kind: int, batches_) -> tuple[bytes, bytes, float, float]:
    """Sums the parts of one bucket batch by batch, so that memory holds distinct keys only."""
    held: tuple | None = None
    for b in batches_:
        ks, cs = b.column("keys").to_pylist(), b.column("counts").to_pylist()
        if held:
            ks.append(held[0])
            cs.append(held[1])
        held = _sum_parts(kind, ks, cs)
    return held or _sum_parts(kind, [], [])


def _trees(k: np.ndarray, c: np.ndarray, depth: int, hot: np.ndarray) -> list[tuple[np.ndarray, Tree]]:
    """The trees of a bucket's keys: below two context bytes, and below three for hot pairs; with their keys as a mask."""
    warm = hot_keys(k, depth, hot)
    return [(at, Tree(k[at], c[at], depth, low)) for low, at in ((2, ~warm), (3, warm)) if at.any()]


def _model(depth: int, hot: np.ndarray):
    def model(key, it):
        bucket, kind = key[0].as_py(), key[1].as_py()
        k, c, n, v = _stream_sum(kind, it)
        rows = [(bucket, kind, k, c, n, v)]
        if kind == 0:
            for _, tree in _trees(expand(k, np.uint64, True), expand(c, np.uint64), depth, hot):
                node, w, m, m1 = tree.top()
                for part in range(16):  # by the low half of the bits, to be summed over buckets
                    at = (node & np.uint64(15)) == part
                    if at.any():
                        rows.append((part, tree.low, U.blob(node[at]), U.blob(np.stack([w[at], m[at], m1[at]])), 0.0, 0.0))
        names = ["bucket", "kind", "keys", "counts", "n", "v"]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return model


def merge_stats(nodes: list[np.ndarray], stats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes in order, and the sums of their three rows of statistics."""
    k, inv = np.unique(np.concatenate([np.zeros(0, np.uint64), *nodes]), return_inverse=True)
    s = np.concatenate([np.zeros((3, 0)), *stats], axis=1)
    return k, np.stack([np.bincount(inv, weights=x, minlength=len(k)) for x in s])


def _sum_top(key, it):
    node, total = merge_stats([], [])
    for b in it:
        keys, counts = b.column("keys").to_pylist(), b.column("counts").to_pylist()
        node, total = merge_stats([node, *(np.frombuffer(k, np.uint64) for k in keys)], [total, *(np.frombuffer(c, np.float64).reshape(3, -1) for c in counts)])
    yield pa.RecordBatch.from_arrays([pa.array([key[1].as_py()], pa.int32()), pa.array([U.blob(node)], pa.binary()), pa.array([U.blob(total)], pa.binary())], names=["kind", "keys", "counts"])


def middle(node: np.ndarray, stats: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Depth 2 of hot pairs: its level of a tree, and what depth 1 needs of it (nodes, statistics)."""
    w, n, n1 = stats
    own = kt_log_block(n - n1, n1)
    gate = 1 / (1 + np.exp(np.clip(w - own, -700, 700)))
    mixed = np.logaddexp(own, w) - LN2
    bits = node & np.uint64(255)
    level = []
    for j in range(8):
        at = (bits >> np.uint64(j)) == 1
        level.append((node[at], ((n1 + 0.5) / (n + 1))[at], gate[at]))
    up = ((node >> np.uint64(16)) << np.uint64(8)) | bits
    return level, *merge_stats([up], [np.stack([mixed, n, n1])])


def _answer(depth: int, top: np.ndarray, hot: np.ndarray, mid: list):
    def answer(key, asked, model):
        kind = key[1].as_py()
        if not asked.num_rows:  # a bucket of the model that no chunk of this salt asks for
            return pa.table({"chunk": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "vals": pa.array([], pa.binary())})
        keys = asked["keys"].to_pylist()
        mk, mc = (model["keys"][0].as_py(), model["counts"][0].as_py()) if model.num_rows else (squeeze(np.zeros(0, np.uint64)) if kind == 0 else pack_words([]), squeeze(np.zeros(0, np.uint64)))
        if kind == 0:
            k, c = expand(mk, np.uint64, True), expand(mc, np.uint64)
            every = np.unique(np.concatenate([expand(x, np.uint64, True) for x in keys]))
            logp = np.zeros(len(every))
            known, asked_hot = hot_keys(k, depth, hot), hot_keys(every, depth, hot)
            for low, own, at in ((2, ~known, ~asked_hot), (3, known, asked_hot)):
                if at.any():
                    tree = Tree(k[own], c[own], depth, low)
                    if low == 3:
                        tree.levels[2], tree.low = mid, 2
                    logp[at] = log10_probability(every[at], tree, top)
            vals = [U.blob(logp[np.searchsorted(every, expand(x, np.uint64, True))]) for x in keys]
        else:
            known = dict(zip(unpack_words(mk), expand(mc, np.uint64).tolist(), strict=True))
            vals = [squeeze(np.array([known.get(w, 0) for w in unpack_words(x)], np.uint64)) for x in keys]
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "kind": asked["kind"], "vals": pa.array(vals, pa.binary())})

    return answer


def _score(depth: int, buckets: int, n_train: float, vocabulary: float, hot: np.ndarray):
    denominator = n_train + 0.1 * (vocabulary + 1)

    def score(key, docs, answers):
        texts, train = U.utf8(docs["text"]), np.array(docs["train"].to_pylist(), bool)
        got = {(k, b): v for k, b, v in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["vals"].to_pylist(), strict=True)}
        keys, _ = gram_counts(texts, train, depth)
        logp = np.zeros(len(keys))
        for b, at in _split(keys, depth, buckets, hot):
            logp[at] = np.frombuffer(got[0, b], np.float64)
        total = np.zeros(len(texts))
        for i, lengths, k in batches(texts, depth):
            both = (k << np.uint64(16)) | np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
            both.sort()
            gram = both >> np.uint64(16)
            at = runs(gram)
            p = np.repeat(logp[np.searchsorted(keys, gram[at])], np.diff(np.append(at, len(gram))))
            total[i : i + len(lengths)] = np.bincount((both & np.uint64(65535)).astype(np.int64), weights=p, minlength=len(lengths))
        words = {END_WORD}
        for text in texts:
            words.update(words_of(text))
        at, counts = {}, []
        for b, ws in by_bucket(list(words), buckets).items():
            at.update(zip(ws, range(len(counts), len(counts) + len(ws))))
            counts += expand(got[1, b], np.uint64).tolist()
        counts = np.array(counts, np.float64)
        part, seen = np.log10((counts + 0.1) / denominator), (counts > 0).astype(np.int64)
        end = at[END_WORD]
        n_tokens, n_known, base = np.ones(len(texts), np.int64), np.full(len(texts), seen[end]), np.full(len(texts), part[end])
        for i, j in slices(texts):
            split = [words_of(t) for t in texts[i:j]]
            n = np.fromiter(map(len, split), np.int64, j - i)
            place = np.fromiter(map(at.__getitem__, itertools.chain.from_iterable(split)), np.int64, n.sum())
            some = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[some]
            n_tokens[i:j] += n
            if len(some):
                n_known[i + some] += np.add.reduceat(seen[place], first)
                base[i + some] += np.add.reduceat(part[place], first)
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": pa.array(~train), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([int(n_train)] * len(texts), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64()),
            "bits_per_byte": pa.array(-total * math.log2(10) / (np.fromiter(map(len, texts), np.int64, len(texts)) + 1)),
        })

    return score


def score_documents(docs: DataFrame, *, depth: int = 5, chunk_bytes: int = 16 << 20, least_chunks: int = 40, buckets: int = 96, chunks_per_salt: int = 64, hot_share: int | None = None) -> DataFrame:
    """Scores ``docs(doc_id, text, train)``: base (word counts) and context-tree log10 probabilities.

    ``depth`` is at most 5 (a key must fit beside a document number in 64 bits). ``chunks_per_salt``
    bounds how many chunks' strings one task sums or answers. A pair of bytes with more than a
    quarter of one part in ``hot_share`` (the number of buckets) of all pairs is divided by a third byte.
    """
    if not 2 <= depth <= 5:
        raise ValueError("depth must be 2 to 5")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = U.pieces(size, chunk_bytes, least_chunks)
    buckets = max(buckets, chunks)
    # rows are dealt by their place, so that repeated ones part; written once, as they are read twice
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    dealt = U.materialize(docs.select("doc_id", "text", "train", chunk.alias("chunk")), "ctw-texts", "zstd")
    hot = frequent(pair_counts(docs), buckets if hot_share is None else hot_share) if depth > 2 else np.zeros(0, np.uint64)
    parts = U.materialize(dealt.groupBy("chunk").applyInArrow(_send(depth, buckets, chunks_per_salt, hot), PART_DDL), "ctw-parts", "zstd")
    summed = parts.select("bucket", "kind", "salt", "keys", "counts")
    if chunks > chunks_per_salt:
        def pre(key, it):
            k, c, _, _ = _stream_sum(key[1].as_py(), it)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([k], pa.binary()), pa.array([c], pa.binary())], names=["bucket", "kind", "salt", "keys", "counts"])

        summed = summed.groupBy("bucket", "kind", "salt").applyInArrow(U.by_batches(pre), "bucket int, kind int, salt int, keys binary, counts binary")
    model = U.materialize(summed.select("bucket", "kind", "keys", "counts").groupBy("bucket", "kind").applyInArrow(U.by_batches(_model(depth, hot)), MODEL_DDL), "ctw-model", "zstd")
    n, v = model.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("v"), F.lit(0.0))).first()
    tops = model.where("kind > 1").select("bucket", "kind", "keys", "counts").groupBy("bucket", "kind").applyInArrow(U.by_batches(_sum_top), "kind int, keys binary, counts binary").collect()
    held = {kind: merge_stats([np.frombuffer(r[1], np.uint64) for r in tops if r[0] == kind], [np.frombuffer(r[2], np.float64).reshape(3, -1) for r in tops if r[0] == kind]) for kind in (2, 3)}
    mid, node, stats = middle(*held[3])
    node, stats = merge_stats([held[2][0], node], [held[2][1], stats])
    top = upper(node, *stats)
    salts = -(-chunks // chunks_per_salt)
    spread = model.where("kind < 2").select("bucket", "kind", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "keys", "counts")
    on = ("bucket", "kind", "salt")
    answers = parts.select("chunk", *on, "keys").groupBy(*on).cogroup(spread.groupBy(*on)).applyInArrow(_answer(depth, top, hot, mid), ANSWER_DDL)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(depth, buckets, n, v, hot), SCORE_DDL)


def op1_ctw_score(spark, sf_dir: str) -> DataFrame:
    """All documents; learns from those whose crc32(doc_id) mod 10 is not 0."""
    docs = U.read(spark, sf_dir, "documents").select("doc_id", "text", U.train_flag(10, 0).alias("train"))
    return score_documents(docs)
