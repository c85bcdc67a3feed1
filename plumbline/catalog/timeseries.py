"""Time-series and window queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog.base import query, table
from plumbline.catalog.statistics import rounded
from plumbline.operators import series
from plumbline.plans.shared import shared_folder
from plumbline.streaming import profile as streams
from plumbline.streaming import watch

_S = "(select row_number() over (order by ts, event_id) - 1 as i, value as y from events)"


@query("positions", f"select i, y from {_S}")
def positions(spark, d):
    return series.positions(table(spark, d, "events"), "ts", "value", "event_id")


@query(
    "trend",
    f"select case when abs(s) < 1e-10 then 'flat' when s > 0 then 'upward' else 'downward' end as direction, round(s, 6) as slope, round(case when yy = 0 then 0 else r end, 4) as r_squared, n as data_points "
    f"from (select regr_slope(y, i) as s, regr_r2(y, i) as r, regr_syy(y, i) as yy, count(*) as n from {_S})",
)
def trend(spark, d):
    r = series.trend(table(spark, d, "events"), "ts", "value", "event_id")
    return spark.createDataFrame([(r["direction"], r["slope"], r["r_squared"], r["data_points"])], "direction string, slope double, r_squared double, data_points long")


@query("seasonality", " union all ".join(f"select {k} as lag, round(corr(a.y, b.y), 6) as r from {_S} a join {_S} b on b.i = a.i + {k}" for k in (7, 30, 90, 365)))
def seasonality(spark, d):
    got = series.autocorrelations(series.positions(table(spark, d, "events"), "ts", "value", "event_id"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in got.items()], "lag int, r double")


_DAILY = "(select row_number() over (order by day) - 1 as i, y from (select date_trunc('day', ts) as day, sum(value) as y from events group by 1))"


def _daily(spark, d):
    daily = table(spark, d, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.sum("value").alias("y"))
    return series.positions(daily, "day", "y")


@query(
    "decompose_residual",
    f"""with s as {_DAILY}, t as (select i, y, sum(y) over (order by i rows between 3 preceding and 3 following) / 7 as trend from s), p as (select i % 7 as phase, median(y - trend) as seasonal from t group by 1)
    select i, round(y, 4) as y, round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(y - trend - seasonal, 4) as residual from t join p on i % 7 = phase""",
)
def decompose_residual(spark, d):
    return rounded(series.decompose(_daily(spark, d)), 4)


@query(
    "residual_outliers",
    f"""with s as {_DAILY}, t as (select i, y, sum(y) over (order by i rows between 3 preceding and 3 following) / 7 as trend from s), p as (select i % 7 as phase, median(y - trend) as seasonal from t group by 1),
    r as (select i, y, trend, seasonal, y - trend - seasonal as residual from t join p on i % 7 = phase), c as (select median(residual) as mid, count(*) as n, avg(residual) as mean, stddev_pop(residual) as sd from r),
    m as (select median(abs(residual - mid)) as mad from r, c)
    select i, round(y, 4) as y, round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(residual, 4) as residual from r, c, m
    where n >= 14 and case when mad > 0 then 0.6745 * abs(residual - mid) / mad > 3 else abs(residual - mean) > 2 * sd end""",
)
def residual_outliers(spark, d):
    return rounded(series.residual_outliers(_daily(spark, d)), 4)


@query("stl_decompose")
def stl_decompose(spark, d):
    """Hourly totals, decomposed over a day."""
    hourly = table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.sum("value").alias("y"))
    return series.stl(series.positions(hourly, "hour", "y"), series.Spans(24, 13))


@query("stl_outliers")
def stl_outliers(spark, d):
    return series.stl_outliers(_daily(spark, d), robust=True)


_STATS = "count(*) as n, count(*) - count(value) as null_values, round(avg(value), 6) as mean, min(value) as min, max(value) as max"


@query("windows_tumbling", f"select date_trunc('hour', ts) as window_start, event_type, {_STATS} from events group by 1, 2")
def windows_tumbling(spark, d):
    x = streams.window_stats(table(spark, d, "events"))
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "null_values", F.round("mean", 6).alias("mean"), "min", "max")


@query("windows_sliding", f"select w as window_start, event_type, {_STATS} from (select *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as w from events) group by 1, 2")
def windows_sliding(spark, d):
    x = streams.window_stats(table(spark, d, "events"), width="2 hours", slide="1 hour")
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "null_values", F.round("mean", 6).alias("mean"), "min", "max")


@query(
    "windows_session",
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g)
    select user_id, min(ts) as session_start, max(ts) + interval 6 hour as session_end, count(*) as n from s group by user_id, k""",
)
def windows_session(spark, d):
    x = streams.sessions(table(spark, d, "events"), gap="6 hours")
    return x.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("stream_windows", f"select date_trunc('hour', ts) as window_start, event_type, {_STATS} from events group by 1, 2")
def stream_windows(spark, d):
    """The tumbling windows from a stream over the same files. Updates go to Parquet, batch by batch; the last of each window, open ones too, is its result."""
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    base = f"{streams.shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    run = streams.updates(streams.window_stats(source), f"{base}/out", f"{base}/checkpoint")
    run.awaitTermination()
    x = streams.latest(spark.read.parquet(f"{base}/out"), ["window_start", "event_type"])
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "null_values", F.round("mean", 6).alias("mean"), "min", "max")


# Events arrive in four parts by time, every tenth of them one part late.
_PART = "least(3, cast((us - lo) * 4 {div} greatest(1, hi - lo) as int) + case when event_id % 10 = 0 then 1 else 0 end)"
_LATE = f"""with e as (select *, {_PART.format(div='//')} as part from (select *, epoch_us(ts) as us, min(epoch_us(ts)) over () as lo, max(epoch_us(ts)) over () as hi from events)),
  clock as (select part, max(max(ts)) over (order by part rows between unbounded preceding and 1 preceding) as mark from e group by part)
  select date_trunc('hour', ts) as window_start, event_type, count(*) filter (where ts >= mark - interval 1 hour or mark is null) as on_time, count(*) filter (where ts < mark - interval 1 hour) as late
  from e join clock using (part) group by 1, 2"""


@query("stream_late", _LATE)
def stream_late(spark, d):
    """Rows on time and late of each window: the stream is stopped after each part, and starts again from its checkpoint."""
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    ends = e.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))  # one row
    dealt = e.select("*", us).join(F.broadcast(ends)).withColumn("part", F.expr(_PART.format(div="div")))
    base = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    dealt.select(*e.columns, "part").write.partitionBy("part").parquet(f"{base}/dealt")
    for part in range(4):
        spark.read.schema(e.schema).parquet(f"{base}/dealt/part={part}").write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(e.schema).parquet(f"{base}/in")
        watch.late_windows(source, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    x = watch.late_totals(spark, f"{base}/out")
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "on_time", "late")


_WATCHED = ("value", "event_type")
_BLANK = "case when part = 2 and event_id % 3 = 0 then null else value end"
_WATCH = f"""with e as (select *, {_PART.format(div='//')} as part from (select *, epoch_us(ts) as us, min(epoch_us(ts)) over () as lo, max(epoch_us(ts)) over () as hi from events)),
  p as (select part, count(*) filter (where {_BLANK} is null) * 100.0 / count(*) as pct from e group by part)
  select a.part, 'null_shift' as change, 'value' as "column", printf('%.2f', b.pct) as before, printf('%.2f', a.pct) as after from p a join p b on a.part = b.part + 1 where abs(a.pct - b.pct) >= 5"""


@query("stream_drift", _WATCH)
def stream_drift(spark, d):
    """What changes from batch to batch of a stream whose third part lacks a third of its values."""
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    ends = e.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    dealt = e.select("*", us).join(F.broadcast(ends)).withColumn("part", F.expr(_PART.format(div="div")))
    dealt = dealt.select("event_id", "event_type", F.expr(_BLANK).alias("value"), "part")
    base = f"{shared_folder(spark)}/drift-{uuid.uuid4().hex}"
    dealt.write.partitionBy("part").parquet(f"{base}/dealt")
    schema = dealt.drop("part").schema
    for part in range(4):
        spark.read.schema(schema).parquet(f"{base}/dealt/part={part}").write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(schema).parquet(f"{base}/in")
        watch.watch(source, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{base}/out/changes")
    return found.select(F.col("batch").cast("int").alias("part"), "change", "column", "before", "after")
