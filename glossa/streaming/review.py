"""Segments as a bounded stream: two-phase results, latest drafts, and a circuit breaker with state.

Event-time windows at the end are an extension; the catalogue of operators has none.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def segment_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of segments as they arrive, so many files a micro-batch: the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def publish(stream: DataFrame, local: Callable[[DataFrame], DataFrame], final: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch's local results, then its final ones, under the same ids; a batch that is repeated replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        for phase, f in (("local", local), ("final", final)):
            f(batch).withColumn("phase", F.lit(phase)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}/step={phase}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The result of each id: the final one if it came, else the local one, of the last epoch."""
    rows = spark.read.option("basePath", out).parquet(out)
    order = F.struct("epoch", F.when(F.col("phase") == "final", 1).otherwise(0))
    columns = [c for c in rows.columns if c not in (key, "epoch", "step")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def save_latest(stream: DataFrame, key: str, version: str, out: str, checkpoint: str) -> StreamingQuery:
    """Only the latest draft of each key in a batch is saved."""

    def write(batch: DataFrame, epoch: int) -> None:
        columns = [c for c in batch.columns if c != key]
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("r")).select(key, "r.*")
        latest.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaker(stream: DataFrame, key: str, order: str, failed: str, after: int = 4, most: int = 3) -> DataFrame:
    """(key, order, deterministic): once `most` of a key's first `after` items failed, later ones go the plain way.

    State is the two counters of a key.
    """

    def step(k, frames, state):
        seen, bad = state.get if state.exists else (0, 0)
        for rows in frames:
            rows = rows.sort_values(order)
            plain = []
            for f in rows[failed]:
                plain.append(bool(seen >= after and bad >= most))
                if seen < after:
                    bad += int(bool(f))
                seen += 1
            yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "deterministic": plain})
        state.update((seen, bad))

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, deterministic boolean", "seen long, bad long", "append", "NoTimeout")


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Extension: counts by event-time window with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
