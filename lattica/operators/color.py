"""Classing of values for maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def equal_classes(values: DataFrame, n: int) -> DataFrame:
    """``values(id, v)`` to (id, class_idx) by equal intervals; the top value is in the last class."""
    s = values.agg(F.min("v").alias("lo"), ((F.max("v") - F.min("v")) / n).alias("step"))
    k = F.when(F.col("step") == 0, 0).otherwise(F.floor((F.col("v") - F.col("lo")) / F.col("step")))
    return values.join(F.broadcast(s)).select("id", F.least(k, F.lit(n - 1)).cast("int").alias("class_idx"))


def quantile_classes(values: DataFrame, n: int) -> DataFrame:
    """Classes of equal counts in the order of (v, id): class c ends at rank round(N / n * (c + 1)).

    Ranks come from value ranges counted first, so no task orders all rows.
    """
    total = values.count()
    ends = [int(total / n * (c + 1) + 0.5) for c in range(n)]
    part = values.repartitionByRange("v", "id").withColumn("_p", F.spark_partition_id())
    from .graph import cut

    part = cut(part)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("v", "id")) + F.col("_s")
    k = sum(((rank > e).cast("int") for e in ends[:-1]), F.lit(0))
    return part.join(F.broadcast(starts), "_p").withColumn("class_idx", k).select("id", "class_idx")
