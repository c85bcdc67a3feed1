"""Late rows, and changes of a stream's profile from batch to batch (an extension).

Each micro-batch writes folders of its own number, and reads what the batch before it
left: the latest event time so far, the columns' profile. A batch that runs again after a
failure replaces its folders; a query that starts again from its checkpoint goes on from
the last of them. Only windows and columns are written, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.cells import q


def _run(events: DataFrame, each, checkpoint: str) -> StreamingQuery:
    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_windows(events: DataFrame, path: str, checkpoint: str, time: str = "ts", key: str = "event_type", width: str = "1 hour", delay: str = "1 hour") -> StreamingQuery:
    """Writes, per batch, the rows on time and late of each window and key: late is what lies more than `delay` behind the latest time of all batches before.

    A row without time is in no window. Equal to the watermark is on time.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        x = batch.select(F.col(time).cast("timestamp").alias("t"), q(key).alias(key)).where("t is not null")
        own = x.agg(F.max("t").alias("latest"))
        if number:
            before = spark.read.schema("latest timestamp").parquet(f"{path}/clock/batch={number - 1}")
            mark = before.agg(F.max("latest").alias("mark"))
            own = own.unionByName(before).agg(F.max("latest").alias("latest"))
            x = x.join(F.broadcast(mark))  # one row
        else:
            x = x.withColumn("mark", F.lit(None).cast("timestamp"))
        late = F.coalesce(F.col("t") < F.col("mark") - F.expr(f"interval {delay}"), F.lit(False))
        windows = x.groupBy(F.window("t", width).alias("w"), key).agg(F.count_if(~late).alias("on_time"), F.count_if(late).alias("late"))
        windows.select(F.col("w.start").alias("window_start"), key, "on_time", "late").write.mode("overwrite").parquet(f"{path}/windows/batch={number}")
        own.write.mode("overwrite").parquet(f"{path}/clock/batch={number}")

    return _run(events, each, checkpoint)


def late_totals(spark, path: str, key: str = "event_type") -> DataFrame:
    """window_start, key, on_time, late of all batches."""
    return spark.read.parquet(f"{path}/windows").groupBy("window_start", key).agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))


_PROFILE = "column string, type string, rows long, nulls long, null_pct double, distinct long"


def watch(events: DataFrame, path: str, checkpoint: str, shift: float = 5.0) -> StreamingQuery:
    """Writes each batch's profile, and what changed against that of the last batch with rows: added, removed, type_changed, null_shift of `shift` points or more."""

    def each(batch: DataFrame, number: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        wide = batch.agg(F.count("*").alias("rows"), *[a for i, c in enumerate(columns) for a in (F.count_if(q(c).isNull()).alias(f"n{i}"), F.approx_count_distinct(q(c)).alias(f"d{i}"))])
        cells = [F.struct(F.lit(c).alias("column"), F.lit(batch.schema[c].dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)]
        now = wide.where("rows > 0").select("rows", F.explode(F.array(*cells)).alias("x"))
        now = now.select("x.column", "x.type", "rows", "x.nulls", (F.col("x.nulls") * 100.0 / F.col("rows")).cast("double").alias("null_pct"), "x.distinct")
        now.write.mode("overwrite").parquet(f"{path}/own/batch={number}")
        now = spark.read.schema(_PROFILE).parquet(f"{path}/own/batch={number}")
        before = spark.read.schema(_PROFILE).parquet(f"{path}/last/batch={number - 1}") if number else now.limit(0)
        changes(before, now, shift).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        (now if now.take(1) else before).write.mode("overwrite").parquet(f"{path}/last/batch={number}")

    return _run(events, each, checkpoint)


def changes(before: DataFrame, now: DataFrame, shift: float = 5.0) -> DataFrame:
    """change, column, before, after of two profiles (column, type, null_pct); none against an empty one."""
    a, b = before.select("column", F.col("type").alias("t0"), F.col("null_pct").alias("n0")), now.select("column", F.col("type").alias("t1"), F.col("null_pct").alias("n1"))
    both = a.join(b, "column", "full")
    text = lambda c: F.format_string("%.2f", c)
    found = F.array_compact(
        F.array(
            F.when(F.col("t0").isNull(), F.struct(F.lit("added").alias("change"), F.lit(None).cast("string").alias("before"), F.col("t1").alias("after"))),
            F.when(F.col("t1").isNull(), F.struct(F.lit("removed").alias("change"), F.col("t0").alias("before"), F.lit(None).cast("string").alias("after"))),
            F.when(F.col("t0") != F.col("t1"), F.struct(F.lit("type_changed").alias("change"), F.col("t0").alias("before"), F.col("t1").alias("after"))),
            F.when(F.abs(F.col("n1") - F.col("n0")) >= shift, F.struct(F.lit("null_shift").alias("change"), text(F.col("n0")).alias("before"), text(F.col("n1")).alias("after"))),
        )
    )
    known = a.groupBy().agg(F.count("*").alias("k"))  # one row
    return both.join(F.broadcast(known)).where("k > 0").select("column", F.explode(found).alias("x")).select("x.change", "column", "x.before", "x.after")
