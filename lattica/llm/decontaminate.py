"""Benchmark decontamination: a broadcast hash set of test n-grams against training windows.

Words are maximal runs of ASCII letters and digits and of all non-ASCII characters, A-Z
lower-cased. Every run of ``width`` words of an item is a window; an item with fewer words is
one window of its own length. Document words are mapped to the benchmark's vocabulary, runs
of known words are looked up by a 64-bit hash, and each hit is verified word by word.

The set is broadcast in blocks of at most ``block_bytes`` of benchmark text (its size is
measured first), one pass over the documents for each block; results of all passes are united
by word position. Nothing is shuffled. A block is held as arrays, about 25 bytes a word, and a
dictionary of its distinct words, some 150 bytes each.

Defined cases: null and empty texts have no words and no hits; an item without words has no
window; repeated items and rows count each for itself; item_ids are of any type that sorts, null
last; columns of any name are kept; a text of any length is scanned whole; with an empty benchmark
nothing is hit, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import _util as U

#: Bytes that part words become spaces; A-Z become a-z.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
MARK = b"|"  # parts documents in a batch; no word holds it
WORD = re.compile(rb"[^ ]+")


class WindowSet:
    """Windows of benchmark items, by length: where each begins in the words of all items, in order of hashes."""

    def __init__(self, items: list[tuple], width: int = 13):
        self.items = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {MARK: -1}
        self.factor = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)
        number = self.vocabulary.setdefault
        words = [np.fromiter((number(w, len(self.vocabulary)) for w in text.translate(TABLE).split()), np.int32) for _, text in items]
        n = np.fromiter(map(len, words), np.int64, len(words))
        self.words = np.concatenate([*words, np.zeros(0, np.int32)])
        first = np.cumsum(n) - n
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        size = np.minimum(n, width)
        for k in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == k)
            many = n[own] - k + 1
            owner = np.repeat(own, many)
            at = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
            code = self.hashes(self.words, at, k)
            order = np.argsort(code, kind="stable")
            self.groups.append((k, code[order], at[order].astype(np.int32), owner[order].astype(np.int32)))

    def hashes(self, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(len(at), np.uint64)
        for j in range(n):
            total += words[at + j].astype(np.uint64) * self.factor[j]
        return total

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit words as a mask; positions of found windows and their items."""
        hit = np.zeros(len(ids) + 1, np.int64)
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for n, code, begin, owner in self.groups:
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            h = self.hashes(ids, at, n)
            left = np.searchsorted(code, h, "left")
            seen = np.flatnonzero(code[np.minimum(left, len(code) - 1)] == h)
            at, left = at[seen], left[seen]
            many = np.searchsorted(code, h[seen], "right") - left
            for i, j in _spans(many, 1 << 18):  # every window of equal hash, verified word by word
                m = many[i:j]
                k = np.repeat(left[i:j] - np.cumsum(m) + m, m) + np.arange(m.sum())
                a = np.repeat(at[i:j], m)
                same = np.ones(len(k), bool)
                for w in range(n):
                    same &= self.words[begin[k] + w] == ids[a + w]
                a, k = a[same], k[same]
                np.add.at(hit, a, 1)
                np.add.at(hit, a + n, -1)
                where.append(a)
                which.append(owner[k].astype(np.int64))
        return np.cumsum(hit)[:-1] > 0, np.concatenate(where), np.concatenate(which)


def _spans(many: np.ndarray, most: int):
    """Ranges of ``many`` that sum to about ``most``, at least one each."""
    ends = np.cumsum(many)
    i = 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def cut(text: bytes, hits: set[int]) -> bytes:
    """``text`` without each run of hit words, from its first word's start to its last word's end."""
    out, at, begin, end = [], 0, None, 0
    for i, m in enumerate(WORD.finditer(text.translate(TABLE))):
        if i in hits:
            begin = m.start() if begin is None else begin
            end = m.end()
        elif begin is not None:
            out.append(text[at:begin])
            at, begin = end, None
    if begin is not None:
        out.append(text[at:begin])
        at = end
    return b"".join([*out, text[at:]])


HITS = pa.list_(pa.int64())


def _scan(windows, keep: list[str], item_type: pa.DataType):
    def scan(batches):
        w: WindowSet = windows.value
        get = w.vocabulary.get
        for b in batches:
            texts = U.utf8(b.column("text"))
            n_words, hits, items = [], [], []
            for i, j in _slices(texts):
                words = b" | ".join([t.translate(TABLE) for t in texts[i:j]] + [b""]).split()
                ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
                ends = np.flatnonzero(ids == -1)
                starts = np.concatenate(([0], ends[:-1] + 1))
                mask, where, which = w.search(ids)
                n_words += (ends - starts).tolist()
                at = np.flatnonzero(mask)
                lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
                doc = np.searchsorted(ends, where)
                found: dict[int, set] = {}
                for d, k in zip(doc.tolist(), which.tolist(), strict=True):
                    found.setdefault(d, set()).add(w.items[k])
                for k in range(j - i):
                    hits.append((at[lo[k] : hi[k]] - starts[k]).tolist())
                    items.append(found.get(k, ()))
            old_hits, old_items = b.column("_hits").to_pylist(), b.column("_items").to_pylist()
            hits = [sorted({*o, *h}) if o else h for o, h in zip(old_hits, hits, strict=True)]
            items = [sorted({*o, *n}, key=lambda x: (x is None, x)) for o, n in zip(old_items, items, strict=True)]
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(hits, HITS), pa.array(items, pa.list_(item_type))], names=[*keep, "_n_words", "_hits", "_items"])
        b = texts = words = cols = hits = items = old_hits = old_items = None
        U.release()

    return scan


def _slices(texts: list[bytes], most: int = 2 << 20):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= most):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def blocks_of(benchmark: DataFrame, block_bytes: int):
    """The benchmark in lists of (item_id, text) of about ``block_bytes`` each."""
    size = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], (r[1] or "").encode()) for r in part.select("item_id", "text").collect()]


def scan(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with _n_words, _hits (positions of hit words) and _items (item_ids found)."""
    return _passes(docs, benchmark, width, block_bytes, None)


def _passes(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, last) -> DataFrame:
    """A pass over ``docs`` for each block of the benchmark; ``last`` is done with the batches of the last one."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("_n_words", "_hits", "_items")]
    kind = benchmark.schema["item_id"].dataType
    out = docs.select(*(f"`{c}`" for c in keep), F.array().cast("array<long>").alias("_hits"), F.array().cast(T.ArrayType(kind)).alias("_items"))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("_n_words", T.LongType()), T.StructField("_hits", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(kind))])
    blocks = blocks_of(benchmark, block_bytes)
    items = next(blocks)
    while items is not None:
        held, items = spark.sparkContext.broadcast(WindowSet(items, width)), next(blocks, None)
        one = _scan(held, keep, to_arrow_type(kind))
        if items is None and last is not None:
            return out.mapInArrow(lambda batches, one=one: last(one(batches)), docs.select(*keep).schema)
        out = out.mapInArrow(one, schema)
        if items is not None:
            out = U.materialize(out, "scan")
    return out


def contaminated() -> F.Column:
    """At least one word in twenty is hit."""
    n = F.size("_hits").cast("long")
    return (n > 0) & (20 * n >= F.col("_n_words"))


def report(found: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.size("_hits").cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def _cleaned(columns: list[str]):
    """Batches of scanned documents without contaminated ones, with hit words cut out of the others' texts."""

    def run(batches):
        for b in batches:
            hits, n_words = b.column("_hits").to_pylist(), b.column("_n_words").to_pylist()
            stay = [i for i, (h, n) in enumerate(zip(hits, n_words, strict=True)) if not h or 20 * len(h) < n]
            b = b.take(pa.array(stay, pa.int64()))
            touched = [i for i, k in enumerate(stay) if hits[k]]
            if touched:
                at = b.schema.get_field_index("text")
                texts = b.column(at).to_pylist()
                for i in touched:
                    texts[i] = cut(texts[i].encode(), set(hits[stay[i]])).decode()
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.column(at).type))
                if "n_chars" in columns:
                    at = b.schema.get_field_index("n_chars")
                    counts = b.column(at).to_pylist()
                    for i in touched:
                        counts[i] = len(texts[i])
                    b = b.set_column(at, b.schema.field(at), pa.array(counts, b.column(at).type))
            yield b.select(columns)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without contaminated documents, and without hit spans in the others.

    ``n_chars`` is counted anew where the text was cut; a document without hits stays as it is.
    Further columns are kept, whatever their names. A document is read and cut in one pass.
    """
    return U.sheltered(docs, lambda d: _passes(d, benchmark, width, block_bytes, _cleaned(d.columns)))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = U.read(spark, sf_dir, "documents").select("doc_id", "text")
    return report(scan(docs, U.read(spark, sf_dir, "benchmark")))
