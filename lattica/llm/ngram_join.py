"""Jaccard self-join on word n-grams with count-vector R-trees.

A document's set holds its distinct shingles of ``width`` words (64-bit hashes; A-Z
lower-cased, words parted by ASCII white space). A set's point counts its members by the low
bits of their hash, so the overlap of two sets is at most the sum of the coordinate-wise
minima of their points; an R-tree over points bounds that sum by its nodes' upper corners and
finds the pairs that can reach the threshold. Those are verified on the sets.

So that no tree needs the whole corpus, trees are built in blocks that lose no pair. Under any
one order of shingles, two sets of sufficient similarity share one of the first
``n - ceil(t * n) + 1`` (the prefix filter); shingles are ordered by rarity in a sketch of
fixed size over all documents. The sets that share a prefix shingle meet in a block; a tree
over their points leaves the candidate graph, whose connected components are small and
contain every link. The sets of a shingle that more than ``most`` have meet in pairs of blocks,
so that every two are in one tree. Each component's sets then meet once, or, where they are more
than ``block`` or take more than ``block_bytes``, in pairs of up to 16 blocks, or of more where
16 would hold more than 16 * ``block`` sets or ``block_bytes`` each; there trees over finer points
and exact overlaps decide. A text is sent once for each of its component's other blocks.

Equal sets are one class throughout, so copies never multiply. Results are classes of linked
documents; pairs are not listed, and pairs within a class are only examined until it hangs together.

Defined cases: null texts and texts without words have the empty set, no links and their own
doc_id as component; texts of fewer words than ``width`` have one shingle, the whole; a row
without doc_id has no component and no links; repeated rows are equal sets; rows of one doc_id
with different texts are sets of their own; extra columns are not read; a text of any length is one
set; an empty table gives an empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util as U

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SKETCH_BITS, SLICES = 18, 16
CACHE_WORDS = 200_000
FAN = 16


# ---------------------------------------------------------------- sets and points

def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * M2
    return h ^ (h >> np.uint64(29))


class Words:
    """64-bit word hashes, kept for a task; the cache only saves work."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        held = self.codes
        try:
            return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(held) > CACHE_WORDS:
                held.clear()
            for w in set(words):
                if w not in held:
                    held[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes, width: int, codes: Words) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    c = codes(words)
    n = min(width, len(words))
    h = np.full(len(c) - n + 1, np.uint64(n))
    for j in range(n):
        h = h * M1 + c[j : j + len(h)]
        h ^= h >> np.uint64(32)
    return np.unique(mix(h))


def set_id(s: np.ndarray) -> int:
    return struct.unpack("<q", xxhash.xxh64_digest(s.tobytes()))[0]


def point(s: np.ndarray, each: int, least: int, most: int) -> np.ndarray:
    """Counts by the low bits of the hash: about ``each`` members a coordinate, a power of two of them."""
    g = least
    while g < most and g * each < len(s):
        g *= 2
    return np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g).astype(np.int32)


def fold(p: np.ndarray, g: int) -> np.ndarray:
    while len(p) > g:
        p = p[: len(p) // 2] + p[len(p) // 2 :]
    return p


def pack_point(p: np.ndarray) -> bytes:
    return b"\1" + p.astype(np.uint8).tobytes() if p.max(initial=0) < 256 else b"\4" + p.astype("<u4").tobytes()


def unpack_point(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8 if b[0] == 1 else "<u4", offset=1).astype(np.int32)


class CountTree:
    """An R-tree, packed in order of size, over the count points of sets; entries can be taken out."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        g = min(map(len, points))
        flat = np.stack([fold(p, g) for p in points])
        self.order = np.lexsort((flat[:, 0], sizes))
        self.sizes = np.asarray(sizes)[self.order].astype(np.int64)
        self.flat = flat[self.order]
        self.place = np.empty(len(points), np.int64)
        self.place[self.order] = np.arange(len(points))
        self.live = np.ones(len(points), bool)
        self.levels = []  # upper corners, least and greatest size, live entries below
        hi, lo_n, hi_n, n = self.flat, self.sizes, self.sizes, np.ones(len(points), np.int64)
        while len(hi) > FAN:
            at = np.arange(0, len(hi), FAN)
            hi, lo_n, hi_n, n = np.maximum.reduceat(hi, at), np.minimum.reduceat(lo_n, at), np.maximum.reduceat(hi_n, at), np.add.reduceat(n, at)
            self.levels.append((hi, lo_n, hi_n, n))

    def remove(self, i: int) -> None:
        k = self.place[i]
        self.live[k] = False
        for _, _, _, n in self.levels:
            k //= FAN
            n[k] -= 1

    def may(self, q: np.ndarray, size: int, at: np.ndarray, hi: np.ndarray, lo_n: np.ndarray, hi_n: np.ndarray) -> np.ndarray:
        """Of nodes or entries ``at``, those that may hold a set similar enough to one of point ``q``."""
        at = at[(self.den * lo_n[at] * 1 <= self.den * self.den * size // self.num) & (self.den * hi_n[at] >= self.num * size)]
        if not len(at):
            return at
        most = np.minimum(hi[at], q).sum(axis=1)
        return at[(self.num + self.den) * most >= self.num * (size + lo_n[at])]

    def query(self, i: int) -> np.ndarray:
        """Live entries that may be similar enough to entry i, by their own numbers."""
        k = self.place[i]
        q, size = self.flat[k], int(self.sizes[k])
        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.flat))
        for hi, lo_n, hi_n, n in reversed(self.levels):
            at = self.may(q, size, at[n[at] > 0], hi, lo_n, hi_n)
            at = (at[:, None] * FAN + np.arange(FAN)).ravel()
            below = len(self.flat) if hi is self.levels[0][0] else len(self.levels[next(j for j, x in enumerate(self.levels) if x[0] is hi) - 1][0])
            at = at[at < below]
        at = self.may(q, size, at[self.live[at]], self.flat, self.sizes, self.sizes)
        return self.order[at]


def flood(points: list[np.ndarray], sizes: np.ndarray, num: int, den: int, verify=None) -> list[list[int]]:
    """Connected components, of at least two entries, of the graph that the tree's bound and
    ``verify(entry, candidates) -> mask`` leave. Entries already reached are not searched for again."""
    tree = CountTree(points, sizes, num, den)
    out = []
    for start in range(len(points)):
        if not tree.live[tree.place[start]]:
            continue
        tree.remove(start)
        group, k = [start], 0
        while k < len(group):
            found = tree.query(group[k])
            if verify is not None and len(found):
                found = found[verify(group[k], found)]
            for j in found.tolist():
                tree.remove(j)
            group += found.tolist()
            k += 1
        if len(group) > 1:
            out.append(group)
    return out


def linked(points: list[np.ndarray], sizes: np.ndarray, num: int, den: int, verify=None) -> list[list[int]]:
    """``flood`` over entries of all sizes. Only sets of similar size can link, so there is a tree
    for each number of coordinates, with the sets of twice as many that are small enough to link there."""
    wide = np.fromiter(map(len, points), np.int64, len(points))
    kinds = np.unique(wide)
    if len(kinds) == 1:
        return flood(points, sizes, num, den, verify)
    forest = Forest(len(points))
    for g in kinds.tolist():
        own = wide == g
        at = np.flatnonzero(own | (wide > g) & (num * sizes <= den * sizes[own].max()))
        test = None if verify is None else lambda i, found, at=at: verify(int(at[i]), at[found])
        for group in flood([points[i] for i in at.tolist()], sizes[at], num, den, test) if len(at) > 1 else ():
            for i in group[1:]:
                forest.join(int(at[group[0]]), int(at[i]))
    out: dict[int, list[int]] = {}
    for i in range(len(points)):
        out.setdefault(forest.find(i), []).append(i)
    return [g for g in out.values() if len(g) > 1]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


# ---------------------------------------------------------------- passes over documents

FACTS = "doc_id long, h long, n_shingles long, sid long, point binary, slice int, sketch binary"


def _facts(width: int):
    def facts(batches):
        sketch, codes = np.zeros(1 << SKETCH_BITS, np.int64), Words()
        mask = np.uint64(len(sketch) - 1)
        for b in batches:
            n, sid, points = [], [], []
            for texts in U.text_slices(b.column("text")):
                held = [shingles(t, width, codes) for t in texts]
                n += [len(s) for s in held]
                sid += [set_id(s) if len(s) else None for s in held]
                points += [pack_point(point(s, 16, 32, 512)) if len(s) else None for s in held]
                sketch += np.bincount((np.concatenate(held) >> np.uint64(20) & mask).astype(np.int64), minlength=len(sketch))
            none = [None] * len(n)
            yield _facts_batch(b.column("doc_id"), b.column("h"), n, sid, points, none, none)
        step = len(sketch) // SLICES
        parts = [sketch[i * step : (i + 1) * step].astype("<u4").tobytes() for i in range(SLICES)]
        none = [None] * SLICES
        yield _facts_batch(pa.array(none, pa.int64()), pa.array(none, pa.int64()), none, none, none, list(range(SLICES)), parts)
        codes = sketch = parts = None
        U.release()

    return facts


def _facts_batch(doc_id, h, n, sid, points, slices, sketches):
    return pa.RecordBatch.from_arrays([doc_id, h, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(points, pa.binary()), pa.array(slices, pa.int32()), pa.array(sketches, pa.binary())], names=["doc_id", "h", "n_shingles", "sid", "point", "slice", "sketch"])


def _sum_sketch(key, batches):
    total = None
    for b in batches:
        for x in b.column("sketch").to_pylist():
            x = np.frombuffer(x, "<u4").astype(np.int64)
            total = x if total is None else total + x
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "sketch"])


def prefix(s: np.ndarray, sketch: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest members of a set, by sketch and then hash, that the prefix filter needs."""
    k = len(s) + (-num * len(s)) // den + 1
    rare = sketch[(s >> np.uint64(20) & np.uint64(len(sketch) - 1)).astype(np.int64)]
    return s[np.lexsort((s, rare))[:k]]


def _prefixes(sketch, width: int, num: int, den: int, buckets: int, flush: int = 1 << 20):
    def run(batches):
        weights = sketch.value
        seen: set[int] = set()
        codes = Words()
        tokens, sids, n = [], [], 0

        def send():
            t, s = np.concatenate(tokens), np.concatenate(sids)
            b = (t >> np.uint64(3)) % np.uint64(buckets)
            order = np.argsort(b, kind="stable")
            edges = np.searchsorted(b[order], np.arange(buckets + 1, dtype=np.uint64))
            rows = [(i, t[order[x:y]].tobytes(), s[order[x:y]].tobytes()) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y]
            b_, t_, s_ = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(b_, pa.int32()), pa.array(t_, pa.binary()), pa.array(s_, pa.binary())], names=["bucket", "tokens", "sids"])

        for b in batches:
            for t in (t for texts in U.text_slices(b.column("text")) for t in texts):
                s = shingles(t, width, codes)
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                p = prefix(s, weights, num, den)
                tokens.append(p)
                sids.append(np.full(len(p), sid, np.int64))
                n += len(p)
                if n >= flush:
                    yield send()
                    tokens, sids, n = [], [], 0
        if n:
            yield send()
        tokens = sids = seen = codes = None
        U.release()

    return run


def _shared(most: int):
    """(token, set) of prefix shingles that more than one set has, and the number of blocks that a
    shingle's sets are dealt into: more than one where more than ``most`` have it, two of which hold
    about ``most``."""

    def run(key, batches):
        ts, ss = [], []
        for b in batches:
            ts += [np.frombuffer(x, np.uint64) for x in b.column("tokens").to_pylist()]
            ss += [np.frombuffer(x, np.int64) for x in b.column("sids").to_pylist()]
        t, s = np.concatenate(ts), np.concatenate(ss)
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        keep = np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])))
        t, s = t[keep], s[keep]
        same = t[1:] == t[:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        t, s = t[many].view(np.int64), s[many]
        ends = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, len(t)) if len(t) else np.zeros(0, np.int64)
        n = np.diff(ends, prepend=0)
        parts = np.repeat(np.where(n > most, -(-2 * n // most), 1), n).astype(np.int32)
        for i in range(0, len(t), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (t, s, parts)], names=["token", "sid", "parts"])

    return run


def _stars(groups: list[list[int]], sids: list[int]):
    a, b = [], []
    for g in groups:
        ids = [sids[i] for i in g]
        low = min(ids)
        for x in ids:
            if x != low:
                a.append(x)
                b.append(low)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _candidates(num: int, den: int):
    """Links by the bound among the sets of each prefix shingle of a bucket or pair of blocks, as stars."""

    def run(table):
        token, sid = table["token"].to_numpy(), table["sid"].to_numpy()
        ids, first, node = np.unique(sid, return_index=True, return_inverse=True)
        size = table["n"].to_numpy()[first]
        packed = table["point"]
        points: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in points:
                points[i] = unpack_point(packed[int(first[i])].as_py())
            return points[i]

        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        at = np.append(np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))), len(token))
        forest = Forest(len(ids))
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            members = node[i:j].tolist()
            if j - i > 2:
                roots = {forest.find(m) for m in members}
                if len(roots) == 1:
                    continue
            if len(members) == 2:
                a, b = members
                if forest.find(a) != forest.find(b) and (num + den) * int(np.minimum(fold(of(a), g := min(len(of(a)), len(of(b)))), fold(of(b), g)).sum()) >= num * int(size[a] + size[b]):
                    forest.join(a, b)
            elif len(members) > 2:
                for g in linked([of(m) for m in members], size[members], num, den):
                    for m in g[1:]:
                        forest.join(members[g[0]], members[m])
        groups: dict[int, list[int]] = {}
        for m in range(len(ids)):
            groups.setdefault(forest.find(m), []).append(m)
        out = _stars([g for g in groups.values() if len(g) > 1], ids.tolist())
        del points, groups, forest, packed
        U.release()
        return out

    return run


def _verified(width: int, num: int, den: int):
    """Links between the sets of each component in a block, as stars."""

    def run(table):
        sets: dict[int, dict[int, np.ndarray]] = {}
        codes = Words()
        for comp, sid, text in zip(table["comp"].to_pylist(), table["sid"].to_pylist(), U.utf8(table["text"]), strict=True):
            held = sets.setdefault(comp, {})
            if sid not in held:
                s = shingles(text, width, codes)
                held[sid] = s
        out = []
        for held in sets.values():
            if len(held) < 2:
                continue
            ids = sorted(held)
            arrays = [held[i] for i in ids]

            def verify(i, found, arrays=arrays):
                cand = [arrays[j] for j in found.tolist()]
                flat, own = np.concatenate(cand), arrays[i]
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                lens = np.array([len(c) for c in cand])
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(lens) - lens)
                return den * both >= num * (len(own) + lens - both)

            sizes = np.array([len(a) for a in arrays])
            out.append(_stars(linked([point(a, 8, 32, 4096) for a in arrays], sizes, num, den, verify), ids))
        sets = codes = held = arrays = None
        U.release()
        return pa.concat_tables(out) if out else _stars([], [])

    return run


# ---------------------------------------------------------------- the join

def rows_of_classes(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, least_buckets: int = 96, block: int = 512, block_bytes: int = 32 << 20, most: int = 8192) -> DataFrame:
    """``docs(doc_id, text)``: doc_id, h (hash of the text), sid (its set, null where empty), class (the least
    set that links reach), n_shingles, component_id (the smallest doc_id that links reach)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    facts = U.materialize(docs.mapInArrow(_facts(width), FACTS), "shingle-facts")
    sums = facts.where("slice is not null").select("slice", "sketch").groupBy("slice").applyInArrow(U.by_batches(_sum_sketch), "slice int, sketch binary").collect()
    step = (1 << SKETCH_BITS) // SLICES
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for k, x in sums:
        sketch[k * step : (k + 1) * step] = np.frombuffer(x, np.int64)
    rows = facts.where("slice is null").select("doc_id", "h", "n_shingles", "sid", "point")
    linked = rows.where("sid is not null and doc_id is not null")
    sets = U.materialize(linked.groupBy("sid").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.first("n_shingles").alias("n"), F.first("point").alias("point")), "sets")
    sets = sets.select("sid", F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"), "n", "point")
    n_tokens = (sketch.sum() * (den - num)) // den
    buckets = U.pieces(int(n_tokens), 250_000, least_buckets)
    held = spark.sparkContext.broadcast(sketch)
    source = docs.where("doc_id is not null").select("text")
    tokens = source.mapInArrow(_prefixes(held, width, num, den, buckets), "bucket int, tokens binary, sids binary")
    shared = tokens.groupBy("bucket").applyInArrow(U.by_batches(_shared(most)), "token long, sid long, parts int")
    met = shared.join(sets.select("sid", "n", "point"), "sid")
    # a shingle of many sets is split into pairs of blocks, the others share buckets by hash
    own = F.pmod(F.xxhash64("sid", F.lit(5)), F.col("parts")).cast("int")
    pairs = F.transform(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), own), lambda k: F.struct(F.col("token").alias("g"), F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    bucket = F.array(F.struct(F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    met = met.select("token", "sid", "n", "point", F.explode(F.when(F.col("parts") > 1, pairs).otherwise(bucket)).alias("p"))
    links = met.select("token", "sid", "n", "point", "p.*").groupBy("g", "i", "j").applyInArrow(_candidates(num, den), "a long, b long")
    comps = U.materialize(U.components(links), "candidates")
    # sets of small components share blocks by hash, large components are split into pairs of blocks
    held_bytes = (8 * F.col("n") + 4096).alias("bytes")
    member = comps.join(sets.select(F.col("sid").alias("node"), "first_id", "first_h", held_bytes), "node")
    total, size = member.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bins = max(U.pieces(total, block, 1), U.pieces(size, block_bytes, 1))
    member = U.with_total(U.with_total(member, "root", "node", F.count("*"), F.sum("_p"), "size"), "root", "node", F.sum("bytes"), F.sum("_p"), "all_bytes")
    parts = F.greatest(F.least(F.ceil(F.col("size") / block), F.lit(16)), F.ceil(F.col("size") / (16 * block)), F.ceil(F.col("all_bytes") / block_bytes)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    pairs = F.when(parts > 1, F.transform(F.array_remove(F.sequence(F.lit(0), parts - 1), own), lambda k: F.struct(F.col("root").alias("g"), F.least(k, own).alias("i"), F.greatest(k, own).alias("j"))))
    pairs = F.coalesce(pairs, F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))))
    texts = docs.join(member.select(F.col("first_id").alias("doc_id"), F.col("first_h").alias("h"), F.col("node").alias("sid"), F.col("root").alias("comp"), pairs.alias("pairs")), ["doc_id", "h"])
    blocks = texts.select("sid", "comp", "text", F.explode("pairs").alias("p")).select("sid", "comp", "text", "p.*")
    true_links = blocks.groupBy("g", "i", "j").applyInArrow(_verified(width, num, den), "a long, b long")
    roots = U.components(true_links)
    firsts = roots.join(sets.select(F.col("sid").alias("node"), "first_id"), "node")
    named = U.with_total(firsts, "root", "node", F.min("first_id"), F.min("_p"), "component")
    of_set = sets.select("sid", "first_id").join(named.select(F.col("node").alias("sid"), "component", "root"), "sid", "left")
    of_set = U.materialize(of_set.select("sid", F.coalesce("component", "first_id").alias("component"), F.coalesce("root", "sid").alias("class")), "classes")
    out = rows.join(of_set, "sid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "h", "sid", "class", "n_shingles", component.alias("component_id"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """``docs(doc_id, text)``: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    return rows_of_classes(docs, **options).select("doc_id", "n_shingles", "component_id")


def dedupe(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: of its smallest doc_id, the text of the least set.

    A row goes only when a row with a text of its class stays: rows of one doc_id with texts of
    different classes all stay, and so do rows without doc_id, and one of each repeated row without
    words. Further columns are kept, whatever their names; of rows with equal doc_id and text one stays.
    """

    def first(docs):
        found = rows_of_classes(docs, **options).where("doc_id is not null")
        per = found.groupBy("doc_id", "h").agg(F.first("sid").alias("sid"), F.first("class").alias("c"), F.count("*").alias("n"))
        best = per.where("sid is not null").groupBy("c").agg(F.min(F.struct("doc_id", "sid", "h", "n")).alias("b"))
        keep = best.select("b.doc_id", "b.h", "b.n").union(per.where("sid is null").select("doc_id", "h", "n"))
        keep = U.materialize(keep.select("doc_id", F.col("h").alias("_h"), F.col("n").alias("_n")), "kept")
        held = docs.withColumn("_h", F.xxhash64("text")).join(keep, ["doc_id", "_h"], "left").where("_n is not null or doc_id is null")
        names = [F.col(f"`{c}`") for c in docs.columns]
        if keep.where("_n > 1").isEmpty():
            return held.select(*names)
        order = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)))
        one = held.where("_n > 1").groupBy("doc_id", "_h").agg(F.max_by(F.struct(*names), order).alias("_r"))
        return held.where("_n = 1 or doc_id is null").select(*names).union(one.select(*(F.col("_r")[c].alias(c) for c in docs.columns)))

    return U.sheltered(docs, first)


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(U.read(spark, sf_dir, "documents"), width=4, num=85, den=100)
