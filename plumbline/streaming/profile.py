"""Incremental profiling of event streams with Structured Streaming (an extension).

Batch and stream share window_stats(); on a stream a watermark bounds the state.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_stats(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """window_start, key, n, null_values, mean, min, max per tumbling (or sliding) window."""
    x = events.withColumn(time, F.col(time).cast("timestamp"))
    if x.isStreaming and late:
        x = x.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = x.groupBy(w.alias("w"), F.col(key)).agg(
        F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("null_values"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return out.select(F.col("w.start").alias("window_start"), key, "n", "null_values", "mean", "min", "max")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """user, session_start, session_end, n."""
    x = events.withColumn(time, F.col(time).cast("timestamp"))
    if x.isStreaming and late:
        x = x.withWatermark(time, late)
    out = x.groupBy(F.session_window(time, gap).alias("w"), F.col(user)).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, as in tests, a folder of this machine where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="plumbline-")


def updates(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows that each micro-batch changes to a folder of its own, so a repeated batch replaces itself; nothing passes through the driver."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return result.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(written: DataFrame, key: list[str]) -> DataFrame:
    """Of what updates() wrote, each key's row of the last batch that changed it."""
    rest = [c for c in written.columns if c not in (*key, "batch")]
    return written.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*key, "_x.*")


def profile_stream(events: DataFrame, path: str, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Appends to `path`, per micro-batch, each column's row, null and approximate distinct counts; each batch writes its own folder, so a repeated batch replaces itself."""
    from plumbline.functions.cells import q

    columns = columns or events.columns

    def each(batch: DataFrame, number: int) -> None:
        wide = batch.agg(F.count("*").alias("rows"), *[x for c in columns for x in (F.count_if(q(c).isNull()).alias(f"{c}__n"), F.approx_count_distinct(q(c)).alias(f"{c}__d"))])
        long = wide.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(f"{c}__n").alias("nulls"), q(f"{c}__d").alias("distinct")) for c in columns])).alias("x"))
        long.select(F.lit(number).alias("batch"), "x.column", "rows", "x.nulls", "x.distinct").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
