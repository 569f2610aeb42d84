"""Learning from a stream: each micro-batch moves a model table by one batch epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.train import som_epoch


def learner(model_path: str, hop: Column, width: float, rate: float):
    """A function for ``writeStream.foreachBatch``: moves the codebook at ``model_path`` (versions in
    folders v=0, 1, ...) towards the batch's epoch by ``rate``. Versions already written are kept,
    so a batch that is run again writes the same version."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{model_path}/v={number}")
        new = som_epoch(batch, old, hop, width).withColumnRenamed("w", "n")
        moved = F.when(F.col("n").isNull(), F.col("w")).otherwise(F.zip_with("w", "n", lambda a, b: a + rate * (b - a)))
        old.join(new, "neuron_id", "left").withColumn("w", moved).drop("n").write.mode("overwrite").parquet(f"{model_path}/v={number + 1}")

    return step
