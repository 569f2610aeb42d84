"""Vectors, matrices and rows rearranged; clusters of neurons carried over to samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .assign import small
from .graph import cut

#: Column names that mean coordinates (fixed values).
X_NAMES = ("x", "X", "lon", "LON", "Lon", "longitude")
Y_NAMES = ("y", "Y", "lat", "LAT", "Lat", "latitude")


def coordinate_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """The first column named like an x coordinate and the first like a y coordinate."""
    pick = lambda names: next((c for c in columns if c in names), None)
    return pick(X_NAMES), pick(Y_NAMES)


def add_constant(df: DataFrame, value: float, x: str = "x") -> DataFrame:
    return df.withColumn(x, F.concat(F.col(x), F.array(F.lit(float(value)))))


def concatenate(df: DataFrame, columns: list[str], name: str = "x") -> DataFrame:
    return df.withColumn(name, F.concat(*columns))


def design(df: DataFrame, target: int, features: list[int], intercept: bool = True) -> DataFrame:
    """(sample_id, y, x): a target component and chosen components, with a leading 1 if asked. Positions from 0."""
    one = [F.lit(1.0)] if intercept else []
    return df.select("sample_id", F.col("x")[target].alias("y"), F.array(*one, *(F.col("x")[i] for i in features)).alias("x"))


def entries(df: DataFrame, key: str, x: str) -> DataFrame:
    """Vectors as a matrix (i, j, v), i the key and j from 0."""
    return df.select(F.col(key).cast("long").alias("i"), F.posexplode(x).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def pick_rows(df: DataFrame, key: str, wanted: list[int]) -> DataFrame:
    """Rows by key in the order of ``wanted``, repeats allowed: ``at`` is the place in the list."""
    rows = df.sparkSession.createDataFrame(list(enumerate(wanted)), f"at long, {key} long")
    return df.join(F.broadcast(rows), key)


def random_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the first by a seeded hash of the key; a top-k, so no full sort."""
    return df.orderBy(F.md5(F.concat_ws(":", key, F.lit(seed))), key).limit(n)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Dense numbers 0.. in the order of ``order`` without a task that holds all rows: ranges are
    counted, and a row's number is its range's offset plus its place in the range."""
    part = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return part.join(F.broadcast(starts), "_p").withColumn(name, (place + F.col("_s")).cast("long")).drop("_p", "_s")


def cluster_index(df: DataFrame, cluster: str) -> DataFrame:
    """``cluster_id`` 0.. in the order of the cluster's name; the distinct names are numbered, not the rows."""
    names = numbered(df.select(cluster).distinct(), [cluster], "cluster_id")
    return df.join(names, cluster)


def to_samples(best: DataFrame, clusters: DataFrame) -> DataFrame:
    """``best(sample_id, neuron_id)`` and ``clusters(neuron_id, cluster_id)`` to samples with the
    cluster of their neuron; neurons without a cluster and clusters without samples vanish."""
    return best.join(small(clusters), "neuron_id").select("sample_id", "cluster_id")


def insert_units(codebook: DataFrame, column: str, at: int) -> DataFrame:
    """A new row or column of units at ``at`` of ``column`` (gx or gy): later units shift by one and
    the new ones are the mean of both neighbours. Result (gx, gy, w)."""
    other = "gy" if column == "gx" else "gx"
    shifted = codebook.select(F.when(F.col(column) >= at, F.col(column) + 1).otherwise(F.col(column)).alias(column), other, "w")
    low = codebook.where(F.col(column) == at - 1).select(other, F.col("w").alias("a"))
    high = codebook.where(F.col(column) == at).select(other, F.col("w").alias("b"))
    new = low.join(high, other).select(F.lit(at).alias(column), other, F.zip_with("a", "b", lambda p, q: (p + q) / 2).alias("w"))
    return shifted.select("gx", "gy", "w").union(new.select("gx", "gy", "w"))
