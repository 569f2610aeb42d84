"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group, which stays in one shard. Groups are placed from the
largest to the smallest, each in the shard where the dot product of its size vector with the
shard's residual capacity is highest.

Groups that hold a noticeable part of a shard are placed singly; there are few of them by
definition. All others are first gathered, by a hash of the text, into a fixed number of
bundles that are placed as one, so the driver handles a bounded number of vectors whatever the
input. Only a group with more bytes than a shard's share, which the law ``bytes`` can't hold
whole, is divided, into the fewest equal parts that fit. Tokens are counted as the pieces that
tokenizers part texts into before they merge. Positions in a shard come from counts of sub-units of
bounded size, without a sort of a whole shard.

Defined cases: null text counts no bytes and no tokens and its rows form one group; repeated
rows each get a slot; rows with equal doc_id are in any order among themselves; extra columns are
not read; a text of any length is one row; an empty table gives an empty result. A group is told by
96 bits of hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U
from .chat import pieces

DIMENSIONS = ("size", "tokens", "rows")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each vector (row), the largest first, by the highest dot product with what is left
    of the capacity, among shards with room in the first dimension, which is the law's; where none has,
    the shard with the most room there. Shares of other dimensions may be exceeded, and then count as used up."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    share = vectors / np.maximum(vectors.sum(axis=0), 1e-9)
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-share.sum(axis=1), kind="stable"):
        v = share[i]
        fits = residual[:, 0] >= v[0]
        gain = np.where(fits, np.maximum(residual, 0) @ v, -np.inf) if fits.any() else residual[:, 0]
        out[i] = k = int(np.argmax(gain))
        residual[k] -= v
    return out


def measure(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``: size vector, checksum and group hashes of each row, written once."""
    text = F.coalesce("text", F.lit(""))
    cols = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        pieces(text).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_h"),
        F.hash("text").alias("_g"),
        F.monotonically_increasing_id().alias("_uid"),
    )
    return U.materialize(cols, "sizes")


def shard(docs: DataFrame, shards: int = 24, *, bundles: int = 24_576, single: int = 64) -> DataFrame:
    """``docs(doc_id, text)`` with shard and slot.

    ``bundles``: how many bundles small groups are gathered into. ``single``: a group with at
    least this fraction (one in ``single``) of a shard's share in some dimension is placed singly.
    """
    spark = docs.sparkSession
    rows = measure(docs)
    total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "tokens")), F.count("*").alias("rows")).first()
    share = [max(1.0, total[c] / shards) for c in DIMENSIONS]
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    large = F.lit(False)
    for c, x in zip(DIMENSIONS, share, strict=True):
        large = large | (F.col(c) >= max(2.0, x / single))
    big = rows.groupBy("_h", "_g").agg(*sums).where(large & (F.col("rows") > 1)).collect()  # at most 3 * shards * single groups
    parts = {(r["_h"], r["_g"]): max(1, int(np.ceil(r["size"] / share[0] - 1e-9))) for r in big}
    # sub-units: bounded in rows; a part of a big group consists of whole sub-units
    each = max(1, total["rows"] // bundles)
    mean = max(each, 64)
    listed, unit = [], bundles
    for r in sorted(big, key=lambda r: (r["_h"], r["_g"])):
        p = parts[r["_h"], r["_g"]]
        per_part = max(1, -(-r["rows"] // (p * mean)))
        listed.append((r["_h"], r["_g"], unit, p * per_part))
        unit += p * per_part
    table = spark.createDataFrame(listed, "_h long, _g int, _first int, _many int")
    marked = rows.join(F.broadcast(table), ["_h", "_g"], "left")
    sub = F.when(F.col("_first").isNull(), F.pmod("_h", F.lit(bundles)).cast("int")).otherwise(F.col("_first") + F.pmod(F.xxhash64("_uid"), F.col("_many")).cast("int"))
    marked = marked.withColumn("_sub", sub)
    units = {r["_sub"]: r for r in marked.groupBy("_sub").agg(*sums).collect()}  # at most bundles and the big groups' sub-units
    # items to place: bundles, and parts of big groups
    items: list[list[int]] = [[s] for s in sorted(units) if s < bundles]
    for h, g, first, many in listed:
        per_part = many // parts[h, g]
        items += [[s for s in range(first + i, first + i + per_part) if s in units] for i in range(0, many, per_part)]
    items = [x for x in items if x]
    vectors = np.array([[sum(units[s][c] for s in x) for c in DIMENSIONS] for x in items], float).reshape(-1, 3)
    at = place(vectors, shards)
    used, where = [0] * shards, []
    for k, x in zip(at.tolist(), items, strict=True):
        for s in x:
            where.append((s, k, used[k]))
            used[k] += units[s]["rows"]
    table = spark.createDataFrame(where, "_sub int, shard int, _start long")
    row = F.row_number().over(Window.partitionBy("_sub").orderBy("doc_id", "_uid")) - 1
    return marked.withColumn("_row", row).join(F.broadcast(table), "_sub").select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("_start") + F.col("_row")).alias("slot"))


def op3_vector_shards(spark, sf_dir: str) -> DataFrame:
    out = shard(U.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
