"""Token ids in fixed-width bit packing, with block offsets and random access.

A packed file (``.ltbp``)::

    8 bytes   magic "LTBP0002"
    6 uint32  bits an id, ids a block, documents, blocks, low and high half of the ids
    int64     a document: its id (0 where it is null)
    uint8     a document: 1 where its id is null; then zeros to a multiple of 8 bytes
    uint64    a document + 1: where its ids start in the file, and the total
    uint64    a block + 1: where its bytes start after the header, and the end
    bytes     blocks; each holds its ids at ``bits`` bits, least significant first, padded to a byte

A block unpacks with a handful of numpy operations; ids i..j need only the blocks that hold
them, which ``Packed`` reads from a file by their byte range. ``encode`` writes the files, in
ascending (doc_id, hash of text) order, to the shared folder through Arrow's file systems
(local, HDFS, S3, GCS), and returns their manifest, a table of a row a file, written last: files
of a task that was lost or run twice have names of their own and are in no manifest.
``decode`` reads the files of a manifest back and gives each document's global start.

Defined cases: null text is empty and yields the end id alone; null doc_ids come first;
repeated rows are encoded each for itself, in any order among themselves; extra columns are not
read; an empty table yields an empty manifest and table. A document never crosses files, so
memory is bounded by a file's ids or the longest document.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U

MAGIC = b"LTBP0002"


# ---------------------------------------------------------------- format

def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    raw = bytes(data) + bytes(8)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the 64 bits that begin at each byte
    at = np.arange(n, dtype=np.int64) * bits
    return (words[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.uint32) & np.uint32((1 << bits) - 1)


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = 4096) -> bytes:
    starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.uint64))).astype("<u8")
    parts = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.uint64))).astype("<u8")
    head = np.array([bits, block, len(doc_ids), len(parts), len(ids) & 0xFFFFFFFF, len(ids) >> 32], "<u4")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = bytes(d is None for d in doc_ids) + bytes(-len(doc_ids) % 8)
    return b"".join([MAGIC, head.tobytes(), keys.tobytes(), nulls, starts.tobytes(), offsets.tobytes(), *parts])


class Packed:
    """Reads a packed file by byte ranges, from ``read(start, length)``."""

    def __init__(self, read):
        self.read = read
        if read(0, 8) != MAGIC:
            raise ValueError("not a packed file")
        self.bits, self.block, docs, blocks, low, high = map(int, np.frombuffer(read(8, 24), "<u4"))
        self.n = low | high << 32
        self.docs, flags, at = docs, docs + -docs % 8, 32
        keys, nulls = np.frombuffer(read(at, 8 * docs), "<i8"), read(at + 8 * docs, flags)
        self.doc_ids = [None if z else k for k, z in zip(keys.tolist(), nulls, strict=False)]
        at += 8 * docs + flags
        self.starts = np.frombuffer(read(at, 8 * (docs + 1)), "<u8")
        at += 8 * (docs + 1)
        self.offsets = np.frombuffer(read(at, 8 * (blocks + 1)), "<u8")
        self.body = at + 8 * (blocks + 1)

    @classmethod
    def of(cls, data: bytes) -> Packed:
        return cls(lambda at, n: data[at : at + n])

    @classmethod
    def open(cls, path: str) -> Packed:
        fs, name = file_system(path)
        f = fs.open_input_file(name)
        return cls(lambda at, n: f.read_at(n, at))

    def ids(self, i: int = 0, j: int | None = None) -> np.ndarray:
        """Ids i..j, from the bytes of their blocks alone."""
        j = self.n if j is None else j
        if i >= j:
            return np.zeros(0, np.uint32)
        first, last = i // self.block, (j - 1) // self.block
        begin = first * self.block
        low = int(self.offsets[first])
        data = memoryview(self.read(self.body + low, int(self.offsets[last + 1]) - low))
        if self.block * self.bits % 8 == 0:  # whole blocks follow each other without gaps
            out = unpack_bits(data, self.bits, min((last + 1) * self.block, self.n) - begin)
        else:
            out = np.concatenate([unpack_bits(data[int(self.offsets[b]) - low : int(self.offsets[b + 1]) - low], self.bits, min(self.block, self.n - b * self.block)) for b in range(first, last + 1)])
        return out[i - begin : j - begin]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system of a Hadoop path (``file:/a`` is ``file:///a``) and the name in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pa.fs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- tokens

_TOKENIZERS: dict[str, object] = {}
CACHE_WORDS = 800_000  # about 40 bytes each, held by a worker from task to task


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def parts_at_blanks(t) -> bool:
    """Whether a tokenizer lower-cases, drops white space and never joins across it, as its parts say:
    only normal forms, replaced white space and lower case before, and a first split that keeps what
    is found of a pattern without white space, with a suffix that ends words."""
    d = json.loads(t.to_str())
    norm, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
    norms, pres = norm.get("normalizers", [norm]), pre.get("pretokenizers", [pre])
    plain = all(x.get("type") in ("NFC", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for x in norms)
    lower = any(x.get("type") == "Lowercase" for x in norms)
    first = pres[0]
    splits = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "\\s" in first.get("pattern", {}).get("Regex", "")
    later = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in pres[1:])
    return bool(plain and lower and splits and later and d["model"].get("type") == "BPE" and d["model"].get("end_of_word_suffix"))


class Known:
    """Ids of words by two 64-bit hashes: a sorted table, and a smaller one of what came last."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        none = lambda t: np.zeros(0, t)
        self.tables = [(none(np.uint64), none(np.uint64), none(np.int64), none(np.int32))] * 2
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: whether it is known, where its ids begin, how many they are."""
        seen, at, n = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int32)
        for k1, k2, begin, many in self.tables:
            if len(k1):
                k = np.minimum(np.searchsorted(k1, h1), len(k1) - 1)
                hit = np.flatnonzero((k1[k] == h1) & (k2[k] == h2))
                seen[hit], at[hit], n[hit] = True, begin[k[hit]], many[k[hit]]
        return seen, at, n

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: list[np.ndarray], begin: np.ndarray, many: np.ndarray) -> None:
        """Words whose ids begin at ``begin`` in the arrays ``ids`` put together."""
        size = sum(map(len, ids))
        if self.used + size > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(self.used, size), np.uint32)))
        at = self.used
        for x in ids:
            self.ids[at : at + len(x)] = x
            at += len(x)
        new = (h1, h2, begin + self.used, many.astype(np.int32))
        self.used = at
        self.tables[1] = self._merged(self.tables[1], new)
        if len(self.tables[1][0]) > 1 << 16:
            self.tables = [self._merged(*self.tables), tuple(x[:0] for x in new)]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)


_KNOWN: dict[str, Known] = {}
BLANKS = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
STOPS = np.isin(np.arange(256), list(b".,"))
LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
PIECE = 1 << 19
OLD = "\u0530"  # letters before it (Latin, Greek, Cyrillic) are the same in all versions of Unicode


@functools.cache
def _powers() -> tuple[np.ndarray, ...]:
    """For each of two hashes: a random number a byte, and the powers of an odd number and of its inverse."""
    rng = np.random.Generator(np.random.PCG64(20))
    out = []
    for _ in range(2):
        odd = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
        values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        run = lambda x: np.cumprod(np.append(np.uint64(1), np.full(2 * PIECE, x, np.uint64)), dtype=np.uint64)
        out.append((values, run(odd), run(pow(odd, -1, 1 << 64))))
    return tuple(out)


class Words:
    """Token ids of texts. ``by_words`` needs a tokenizer that lower-cases, drops white space and never
    joins across it, which is read from its parts; None takes that form where it holds.

    Then the ids of a text are those of its ASCII-space separated words in turn, where stops and
    commas that end a word after an ASCII letter count as a word (such a tokenizer parts letters
    from other signs). Words are found and looked up by hashes, many at a time, and each is
    encoded once and kept; a full table is emptied, which only costs work. New words are encoded
    many at a time: lower-case ASCII words and composed words of letters by the same model without
    the parts that change nothing in them, their ids told apart by the tokens that end a word; others parted by a sign that is one token of its own. What doesn't come out even, or
    holds that sign, is encoded singly.
    """

    def __init__(self, path: str, by_words: bool | None = None):
        self.tokenizer = tokenizer(path)
        apt = parts_at_blanks(self.tokenizer)
        if by_words and not apt:
            raise ValueError("this tokenizer's ids are not those of its words in turn")
        self.by_words = apt if by_words is None else by_words
        if self.by_words:
            self.ends, self.ascii, self.composed, self.sign = _parts(path)
            self.known = _KNOWN.setdefault(path, Known())

    # ---- new words

    def single(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def grouped(self, words: list[bytes], coder, sign: bytes = b"", each: int = 512) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of all words in arrays, and where each word's begin in them and how many they are."""
        groups = [words[i : i + each] for i in range(0, len(words), each)]
        between = b" %s " % sign if sign else b" "
        ids, begins, many, base = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for i in range(0, len(groups), 16):
            part = groups[i : i + 16]
            for ws, e in zip(part, coder.encode_batch_fast([between.join(ws).decode() for ws in part], add_special_tokens=False), strict=True):
                got = np.array(e.ids, np.uint32)
                if sign:
                    end = np.append(np.flatnonzero(got == self.sign[1]), len(got))
                    begin = np.append(0, end[:-1] + 1)
                else:
                    end = np.flatnonzero(self.ends[got]) + 1
                    begin = np.append(0, end[:-1])
                if len(end) != len(ws) or end[-1] != len(got):
                    one = self.single(ws)
                    got = np.concatenate(one)
                    end = np.cumsum([len(x) for x in one])
                    begin = np.append(0, end[:-1])
                ids.append(got)
                begins.append(begin + base)
                many.append(end - begin)
                base += len(got)
        return ids, np.concatenate(begins), np.concatenate(many)

    def learn(self, words: list[bytes], h1: np.ndarray, h2: np.ndarray) -> None:
        plain, other, rest, alone, got = [], [], [], [], []
        for i, w in enumerate(words):
            if w.isalpha():
                plain.append(i)
            elif not w.isascii() and (u := w.decode()).isalpha() and max(u) < OLD and u.lower().isalpha():
                other.append(i)
            else:
                (alone if self.sign[0] in w else rest).append(i)
        texts = lambda at: [words[i] for i in at]
        composed = unicodedata.is_normalized("NFC", b" ".join(texts(other)).decode())
        for at, coder, sign in ((plain, self.ascii, b""), (other, self.composed if composed else self.tokenizer, b""), (rest, self.tokenizer, self.sign[0])):
            if at:
                got.append((at, *self.grouped([w.lower() for w in texts(at)] if at is plain else texts(at), coder, sign)))
        if alone:
            one = self.single(texts(alone))
            many = np.array([len(x) for x in one])
            got.append((alone, one, np.cumsum(many) - many, many))
        order = np.concatenate([at for at, *_ in got])
        base = np.cumsum([0, *(sum(map(len, ids)) for _, ids, _, _ in got)])
        begin = np.concatenate([b + at for (_, _, b, _), at in zip(got, base)])
        self.known.add(h1[order], h2[order], [x for _, ids, _, _ in got for x in ids], begin, np.concatenate([m for *_, m in got]))

    # ---- texts

    def piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words in ``data``, which begins and ends outside of words: ids, where each word begins
        and how many ids it has."""
        b = np.frombuffer(data, np.uint8)
        space = np.concatenate(([True], SPACES[b], [True]))
        start, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        if not len(start):
            return np.zeros(0, np.uint32), start, start
        body = np.maximum.accumulate(np.where(STOPS[b], -1, np.arange(len(b))))[end - 1]  # the last that is no stop
        stops = (body >= start) & (body < end - 1) & LETTERS[b[np.maximum(body, 0)]]
        cut = body[stops] + 1
        start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
        hashes = []
        for values, power, back in _powers():
            run = np.append(np.uint64(0), np.cumsum(values[b] * power[: len(b)], dtype=np.uint64))
            hashes.append((run[end] - run[start]) * back[start])
        h1, first, of = np.unique(hashes[0], return_index=True, return_inverse=True)
        h2 = hashes[1][first]
        seen, at, n = self.known.find(h1, h2)
        if not seen.all():
            if len(self.known) + np.count_nonzero(~seen) > CACHE_WORDS:
                self.known.clear()
                seen[:] = False
            new = np.flatnonzero(~seen)
            own = first[new]
            self.learn([data[i:j] for i, j in zip(start[own].tolist(), end[own].tolist())], h1[new], h2[new])
            seen, at, n = self.known.find(h1, h2)
        if not seen.all() or (h2[of] != hashes[1]).any():  # two words of one hash
            each = self.single([data[i:j] for i, j in zip(start.tolist(), end.tolist())])
            return np.concatenate(each), start, np.array([len(x) for x in each])
        at, n = at[of], n[of].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.known.ids[np.repeat(at - ends + n, n) + np.arange(ends[-1])]
        return ids, start, n

    def pieces(self, texts: list[bytes]):
        """Texts put together, parted at blanks into strings of about ``PIECE`` bytes; longer words alone."""
        data = b" ".join(texts)
        i = 0
        while i < len(data):
            j = min(len(data), i + PIECE)
            if j < len(data):
                last = max(data.rfind(x, i + 1, j) for x in BLANKS)
                j = last if last > 0 else min((k for x in BLANKS if (k := data.find(x, j)) >= 0), default=len(data))
            yield i, data[i:j]
            i = j

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian uint32 bytes."""
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        ids, starts, many = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, data in self.pieces(texts):
            if len(data) > 2 * PIECE:  # one word, as no piece else is as long
                got = self.single([data])[0]
                start, n = np.array([len(data) - len(data.lstrip())]), np.array([len(got)])
            else:
                got, start, n = self.piece(data)
            ids.append(got)
            starts.append(start + i)
            many.append(n)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at = np.concatenate(([0], np.cumsum(np.concatenate(many))))[np.searchsorted(np.concatenate(starts), begin)]
        raw = memoryview(b"".join(x.astype("<u4").tobytes() for x in ids))
        return [bytes(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


@functools.cache
def _parts(path: str):
    """Of a tokenizer that parts words at blanks: which tokens end a word, its model (not a copy) without the
    parts that change nothing in lower-case ASCII words and in composed words of letters, and a sign
    that is one token with its id."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    t = tokenizer(path)
    d = json.loads(t.to_str())
    vocabulary = t.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for w, i in vocabulary.items() if w.endswith(d["model"]["end_of_word_suffix"])]] = True
    ascii_, composed = Tokenizer(t.model), Tokenizer(t.model)
    blanks = pre_tokenizers.WhitespaceSplit()
    level = any(x["type"] == "ByteLevel" for x in d["pre_tokenizer"].get("pretokenizers", []))
    ascii_.pre_tokenizer = blanks
    composed.normalizer = normalizers.Lowercase()
    composed.pre_tokenizer = pre_tokenizers.Sequence([blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]) if level else blanks
    one = ((c.encode(), t.encode(c, add_special_tokens=False).ids) for c in "^~|`\\")
    sign = next((c, ids[0]) for c, ids in one if len(ids) == 1)
    return ends, ascii_, composed, sign


FILE_DDL = "part int, seq int, n_docs long, n_ids long, n_bytes long, path string"


def _pack(path: str, folder: str, bits: int, end_id: int, file_ids: int, by_words: bool | None):
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches):
        task = TaskContext.get()
        part, seq = task.partitionId(), 0
        words = Words(path, by_words)
        fs, name = file_system(folder)
        docs: list = []
        held: list[bytes] = []
        n = 0

        def write():
            nonlocal docs, held, n, seq
            data = pack_file(docs, [len(h) // 4 for h in held], np.frombuffer(b"".join(held), "<u4"), bits)
            leaf = f"part-{part:06d}-{seq:06d}-{task.taskAttemptId()}.ltbp"
            with fs.open_output_stream(f"{name}/{leaf}") as f:
                f.write(data)
            row = [part, seq, len(docs), n, len(data), f"{folder}/{leaf}"]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[x.split()[0] for x in FILE_DDL.split(", ")])
            docs, held, n, seq = [], [], 0, seq + 1
            return out

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            at = 0
            for texts in U.text_slices(b.column("text"), 4 << 20):
                for d, e in zip(ids[at : at + len(texts)], words.encode(texts), strict=True):
                    docs.append(d)
                    held.append(e + end)
                    n += len(e) // 4 + 1
                    if n >= file_ids:
                        yield write()
                at += len(texts)
        if docs:
            yield write()
        b = ids = None
        U.release()

    return pack


def encode(docs: DataFrame, path: str, *, bits: int | None = None, end_id: int = 1, file_ids: int = 4 << 20, by_words: bool | None = None) -> DataFrame:
    """Writes ``docs(doc_id, text)`` as packed files of about ``file_ids`` ids; their manifest.

    ``bits`` defaults to the fewest that hold the vocabulary's ids.
    """
    spark = docs.sparkSession
    bits = bits or max(1, (tokenizer(path).get_vocab_size() - 1).bit_length())
    folder = U.new_path(spark, "packed")
    fs, name = file_system(folder)
    fs.create_dir(name, recursive=True)
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    return U.materialize(rows.select("doc_id", "text").mapInArrow(_pack(path, folder, bits, end_id, file_ids, by_words), FILE_DDL), "manifest")


def _unpack(batches):
    for b in batches:
        for base, path in zip(b.column("base").to_pylist(), b.column("path").to_pylist(), strict=True):
            s = Packed.open(path)
            at = s.starts.astype(np.int64)
            crc, i = [], 0
            while i < s.docs:  # about a million ids at a time, or one document
                j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1)
                raw = memoryview(s.ids(int(at[i]), int(at[j])).astype("<u4").tobytes())
                cuts = (4 * (at[i : j + 1] - at[i])).tolist()
                crc += [zlib.crc32(raw[x:y]) for x, y in zip(cuts, cuts[1:])]
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def with_base(files: DataFrame) -> DataFrame:
    """(path, base): each file and the ids in all files before it, from the manifest alone."""
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before("part")), F.lit(0)).alias("_p"))
    own = files.withColumn("_s", F.coalesce(F.sum("n_ids").over(before("part", "seq")), F.lit(0)))
    return own.join(parts, "part").select("path", (F.col("_p") + F.col("_s")).alias("base"))


def decode(files: DataFrame, most_tasks: int = 20_000) -> DataFrame:
    """Reads packed files: doc_id, start, n_tokens, ids_crc32 (over little-endian uint32)."""
    tasks = min(most_tasks, max(1, files.count()))
    return with_base(files).repartition(tasks).mapInArrow(_unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_bitpacked_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = U.read(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(docs, public_tokenizers.path("word_bpe_49k.json")))
