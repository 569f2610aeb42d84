"""Shared helpers: reliable materialisation, Arrow access, global ranks and components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a session without executors of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = held.get()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which is removed when the driver ends."""
    folder = f"{shared_dir(spark)}/lattica/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path through Hadoop, if it can still be reached."""
    with contextlib.suppress(Exception):
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and the
    result survives the loss of any executor. ``discard`` removes it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lattica_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``materialize`` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.lattica_path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(col: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The bytes of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def text_slices(col: pa.Array, most: int = 2 << 20) -> Iterator[list[bytes]]:
    """The bytes of a string column in lists of about ``most`` bytes, at least one text each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64))
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield utf8(col.slice(i, j - i))
        i = j


def train_flag(remainders: int, left_out: int):
    """True for rows to learn from: crc32 of doc_id as text, null counted as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % remainders != left_out


def sheltered(docs: DataFrame, f) -> DataFrame:
    """``f(docs)``, while columns whose names begin with ``_`` have others, so that none meets a
    helper column of ours; ``f`` returns the columns it was given."""
    other = {c: f"extra{i} {c}" for i, c in enumerate(docs.columns) if c.startswith("_")}
    out = f(docs.withColumnsRenamed(other) if other else docs)
    return out.withColumnsRenamed({v: k for k, v in other.items()}) if other else out


def with_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Dense positions 0.. in the order of ``order``, without a single-task sort.

    Rows are range-partitioned, counted by partition, and each position is the partition's
    offset plus the row's number in it. The offsets are one row per partition. The ranged
    rows are written out first, so the partition ids used twice are the same.
    """
    part = Window.partitionBy("_part").orderBy("_pos")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())
    ranged = materialize(ranged, "rank")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = ranged.withColumn("_row", F.row_number().over(part) - 1)
    joined = numbered.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_pos", "_start", "_row")


def with_total(df: DataFrame, key: str, by: str, partial, final, name: str, parts: int = 64) -> DataFrame:
    """``df`` with ``name``, an aggregate over the rows of each ``key``, without a task that gets all
    rows of a frequent key: a key's rows are dealt into ``parts`` by a hash of ``by``, aggregated there
    (``partial``, named _p), then together (``final`` over _p), and joined by key and part. Null keys
    get no row. ``df`` is read twice, so it must give the same rows each time."""
    dealt = df.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(parts)))
    part = dealt.groupBy(key, "_s").agg(partial.alias("_p"))
    total = part.groupBy(key).agg(final.alias(name))
    return dealt.join(part.select(key, "_s").join(total, key), [key, "_s"]).drop("_s")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), root the smallest node reached.

    Alternates large-star and small-star steps until no edge changes; every step is written to the
    shared folder. A node at the centre of a large component meets its edges in parts.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    low = (F.min("b"), F.min("_p"), "m")
    seen = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_total(both, "a", "b", *low).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "edges")
        small = with_total(large, "a", "b", *low).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, e = e, materialize(small.where("a <> b").distinct(), "edges")
        discard(before, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def release() -> None:
    """Gives a worker's freed memory back to the system, so that the next stage finds it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def by_batches(f):
    """``f(key, batches)`` with the annotations that make Spark pass a group batch by batch."""

    def g(key, batches):
        return f(key, batches)

    g.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return g


def attempt() -> int:
    """The number of the running task attempt, which no other has."""
    return TaskContext.get().taskAttemptId()


def pieces(total: int, each: int, least: int) -> int:
    return max(least, math.ceil(total / each))


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()
