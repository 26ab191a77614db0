"""Incremental comparison: a stream of new versions of keyed rows against the version kept so far.

An extension: each micro-batch is joined to the kept version by key and classified like a keyed diff; the kept version is written anew under the batch's number, so that a batch run twice gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.operators.keyed_diff import keyed_diff, with_magnitude


def latest(batch: DataFrame, key: list[str], time: str) -> DataFrame:
    """The last row of each key in a batch."""
    rest = [c for c in batch.columns if c not in key]
    return batch.groupBy(*key).agg(F.max_by(F.struct(*rest), time).alias("x")).select(*key, "x.*")


def compare_stream(stream: DataFrame, base: str, out: str, checkpoint: str, *, key: list[str], name: str, values: list[str], time: str, trigger: dict | None = None):
    """Start the query. base: folder of kept versions (0 is the first); out: folder of changes by batch."""
    spark: SparkSession = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        own = latest(batch, key, time).select(*key, name, *values)
        kept = spark.read.parquet(f"{base}/{number}")
        touched = kept.join(own.select(*key), key, "left_semi")
        changes = with_magnitude(keyed_diff(touched, own, key, name, values)).where(F.col("change_type") != "same")
        changes.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        kept.join(own.select(*key), key, "left_anti").unionByName(own).write.mode("overwrite").parquet(f"{base}/{number + 1}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_changes(changes: DataFrame, time: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Change counts by kind in windows of event time, late rows within the watermark."""
    return changes.withWatermark(time, late).groupBy(F.window(time, width), "change_type").agg(F.count("*").alias("n"))
