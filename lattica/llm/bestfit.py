"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted. Items are taken from the longest to the shortest, and
each goes to the open bin with the least room that still holds it; where none does, the bin
size is opened that costs least for each token it can be expected to hold, counting the
shorter items that are left. At the end every bin is downsized to the smallest permitted
length that holds its contents.

``pack`` encodes documents with a tokenizer, ends each with an end id, cuts what is longer than
the largest length into pieces of it, and packs the pieces of ``buffer_tokens`` tokens at a time
where they were read: the texts and ids of a corpus are never exchanged, a task's memory is
bounded by the buffer or the longest document, and a lost task is done again alone. A buffer
fills hundreds of bins, so that all but its last few are as full as those of one plan for all;
the last ones are downsized. Equal lengths are interchangeable and bins of the same contents
are one group of the plan.

A row of the result is a bin: bin_id, capacity, n_tokens, ids (its tokens, one piece after the
other), doc_ids, and pieces: for each its number in its document, the start in the document's
ids, offset and length in ``ids``, and all columns of its document but the text.

Defined cases: null and empty texts have the end token only; repeated rows are packed each for
itself; columns of any name are kept, in ``pieces.doc``; null doc_ids are null in ``doc_ids``; an
empty table gives an empty result. Which documents share a bin depends on how the table is read
in splits; contents, bounds and the lengths of bins of a split do not.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _util as U
from . import bitpack

SIZES = (512, 1024, 2048, 4096, 8192)
#: Tokens that opening any bin costs besides its length.
OVERHEAD = 32


class Group:
    """``bins`` equal bins: items as (length, how many in a bin), and the first bin's id."""

    __slots__ = ("bins", "items", "used", "size", "spans")

    def __init__(self, bins: int, size: int):
        self.bins, self.size, self.used = bins, size, 0
        self.items: list[tuple[int, int, int]] = []  # length, first rank, offset in the bin

    def split(self, k: int) -> Group:
        """Takes the first k bins away into a group of their own."""
        g = Group(k, self.size)
        g.used, g.items = self.used, list(self.items)
        self.items = [(n, rank + k, at) for n, rank, at in self.items]
        self.bins -= k
        return g

    def add(self, n: int, rank: int) -> None:
        self.items.append((n, rank, self.used))
        self.used += n


def choose_size(n: int, lengths: list[int], counts: list[int], last: int, sizes: tuple[int, ...], overhead: int) -> int:
    """The permitted length that costs least a token for a bin opened by an item of ``n`` tokens.

    ``lengths`` in ascending order up to the place ``last``, with the ``counts`` that are left. What
    a bin of size c will hold is estimated by filling it from them, the longest first.
    """
    best = None
    for c in sizes:
        if c < n:
            continue
        room, at = c - n, last
        while room and (at := min(at, bisect_right(lengths, room, 0, at + 1) - 1)) >= 0:
            m = lengths[at]
            room -= max(0, min(counts[at] - (m == n), room // m)) * m
            at -= 1
        cost = (c + overhead) / (c - room)
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> list[Group]:
    """Groups of equal bins that hold every item of ``histogram`` (length: count)."""
    sizes = tuple(sorted(sizes))
    lengths = sorted(n for n, c in histogram.items() if c)
    counts = [histogram[n] for n in lengths]
    rooms: list[int] = []  # distinct free room of open groups, in order
    open_: dict[int, list[Group]] = {}
    done: list[Group] = []

    def put(g: Group) -> None:
        room = g.size - g.used
        if room == 0:
            done.append(g)
        else:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append(g)

    for i in range(len(lengths) - 1, -1, -1):
        n, count, rank = lengths[i], counts[i], 0
        while count:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                g = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                if g.bins > count:
                    part = g.split(count)
                    put(g)
                    g = part
            else:
                counts[i] = count
                size = choose_size(n, lengths, counts, i, sizes, overhead)
                g = Group(max(1, count // max(1, size // n)), size)
            g.add(n, rank)
            rank += g.bins
            count -= g.bins
            put(g)
    for gs in open_.values():
        done += gs
    for g in done:
        g.size = next(c for c in sizes if c >= g.used)
    return done


class Lookup:
    """Bin, capacity, tokens in the bin and offset of (length, rank), by binary search."""

    def __init__(self, groups: list[Group]):
        rows = []
        self.bins = 0
        for g in sorted(groups, key=lambda g: (g.size, g.items)):
            rows += [(n, rank, self.bins, g.size, g.used, at) for n, rank, at in g.items]
            self.bins += g.bins
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 6)
        self.key = self.rows[:, 0] * (1 << 40) + self.rows[:, 1]

    def find(self, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        r = self.rows[np.searchsorted(self.key, n * (1 << 40) + rank, "right") - 1]
        return r[:, 2] + rank - r[:, 1], r[:, 3], r[:, 4], r[:, 5]


def ranks(n: np.ndarray) -> np.ndarray:
    """Each item's number, from 0, among the items of its length."""
    order = np.argsort(n, kind="stable")
    first = np.flatnonzero(np.diff(n[order], prepend=-1))
    out = np.empty(len(n), np.int64)
    out[order] = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
    return out


# ---------------------------------------------------------------- over documents

BIN = [("bin_id", pa.int64()), ("capacity", pa.int32()), ("n_tokens", pa.int32())]
PIECE = [("piece", pa.int32()), ("start", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())]


def cut(ids: list[bytes], top: int) -> tuple[list[int], list[int], list[bytes]]:
    """The pieces of each document's ids (4 bytes each): document, number in it, ids."""
    docs, nth, out = [], [], []
    for k, x in enumerate(ids):
        for j in range(0, len(x), 4 * top):
            docs.append(k)
            nth.append(j // (4 * top))
            out.append(x[j : j + 4 * top])
    return docs, nth, out


def bins(docs: list[pa.Array], nth: list[int], ids: list[bytes], first: int, sizes: tuple[int, ...], overhead: int) -> pa.RecordBatch:
    """One batch of bins of the pieces ``ids``; ``docs`` has the columns of each piece's document, doc_id first."""
    n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    lengths, counts = np.unique(n, return_counts=True)
    look = Lookup(plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), sizes, overhead))
    at, capacity, used, offset = look.find(n, ranks(n))
    order = np.lexsort((offset, at))
    head = np.flatnonzero(np.diff(at[order], prepend=-1))
    ends = np.append(head, len(order)).astype(np.int32)
    top, nth_ = max(sizes), np.array(nth, np.int64)
    flat = np.frombuffer(b"".join([ids[i] for i in order.tolist()]), "<u4").astype(np.int32)
    spans = np.concatenate(([0], np.cumsum(used[order][head]))).astype(np.int32)
    take = pa.array(order)
    own = pa.StructArray.from_arrays([c.take(take) for _, c in docs], names=[k for k, _ in docs])
    columns = [x[order] for x in (nth_, nth_ * top, offset, n)]
    piece = pa.StructArray.from_arrays([*(pa.array(x.astype(t.to_pandas_dtype()), t) for x, (_, t) in zip(columns, PIECE, strict=True)), own], names=[*(c for c, _ in PIECE), "doc"])
    rows = [first + np.arange(look.bins), capacity[order][head], used[order][head]]
    doc_ids = next(c for k, c in docs if k == "doc_id").take(take)
    return pa.RecordBatch.from_arrays([
        *(pa.array(x.astype(t.to_pandas_dtype()), t) for x, (_, t) in zip(rows, BIN, strict=True)),
        pa.ListArray.from_arrays(spans, pa.array(flat)), pa.ListArray.from_arrays(ends, doc_ids), pa.ListArray.from_arrays(ends, piece),
    ], names=[*(c for c, _ in BIN), "ids", "doc_ids", "pieces"])


def _pack(path: str, end_id: int, sizes: tuple[int, ...], overhead: int, buffer_tokens: int, keep: list[str]):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = bitpack.Words(path)
        part, made = TaskContext.get().partitionId() << 33, 0
        docs: list[list[pa.Array]] = []
        nth: list[int] = []
        ids: list[bytes] = []
        size = 0

        def send():
            nonlocal docs, nth, ids, size, made
            columns = [(c, pa.concat_arrays([d[i] for d in docs])) for i, c in enumerate(keep)]
            out = bins(columns, nth, ids, part + made, sizes, overhead)
            made += out.num_rows
            docs, nth, ids, size = [], [], [], 0
            return out

        for b in batches:
            at = 0
            for texts in U.text_slices(b.column("text")):
                rows, number, cuts = cut([x + end for x in words.encode(texts)], max(sizes))
                take = pa.array(np.array(rows, np.int64) + at)
                docs.append([b.column(c).take(take) for c in keep])
                at += len(texts)
                nth += number
                ids += cuts
                size += sum(map(len, cuts)) // 4
                if size >= buffer_tokens:
                    yield send()
        if ids:
            yield send()
        b = texts = cuts = None
        U.release()

    return run


def pack(docs: DataFrame, path: str, *, end_id: int = 1, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, buffer_tokens: int = 2 << 20) -> DataFrame:
    """``docs(doc_id, text, ...)`` as bins of token ids by the tokenizer at ``path``; see the module."""
    keep = [c for c in docs.columns if c != "text"]
    own = T.StructType([docs.schema[c] for c in keep])
    schema = T.StructType([
        T.StructField("bin_id", T.LongType()), T.StructField("capacity", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        T.StructField("pieces", T.ArrayType(T.StructType([
            T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("offset", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("doc", own),
        ]))),
    ])
    return docs.select(*(f"`{c}`" for c in [*keep, "text"])).mapInArrow(_pack(path, end_id, tuple(sorted(sizes)), overhead, buffer_tokens, keep), schema)


def op10_bestfit_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = U.read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
