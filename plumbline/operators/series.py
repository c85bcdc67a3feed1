"""Time series on the row position (TS-*, WN-03..06).

Positions 0, 1, 2, ... need a global order. It is made without a single-task sort, range by range of the time. Lags then are
equi-joins on the position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.loess import Spans, stl
from plumbline.plans.aggplan import median
from plumbline.plans.grouped import group_medians
from plumbline.plans.shared import settled
from plumbline.functions.cells import DATES, numeric, of_type, q

LAGS = {7: "weekly", 30: "monthly", 90: "quarterly", 365: "yearly"}


def positions(df: DataFrame, time: str, value: str, tie: str | None = None, ranges: int | None = None) -> DataFrame:
    """WN-03: i, y in time order, nulls dropped first; ties by `tie`, else by value.

    The rows fall into ranges of time at approximate quantiles, are numbered within each, and shifted by the counts of the
    ranges before. The range is a function of the time alone, so a task that runs again numbers its rows alike.
    """
    t = F.unix_micros(q(time).cast("timestamp"))
    x = df.where(q(time).isNotNull() & q(value).isNotNull()).select(t.alias("t"), q(tie or value).alias("b"), q(value).cast("double").alias("y"))
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = x.agg(F.percentile_approx("t", [k / n for k in range(1, n)], 1000)).first()[0] if n > 1 else None
    x = x.withColumn("p", sum(((F.col("t") > c).cast("int") for c in sorted(set(cuts or ()))), F.lit(0)))
    first, at = {}, 0
    for r in x.groupBy("p").count().orderBy("p").collect():  # a row a range
        first[r["p"]] = at
        at += r["count"]
    own = F.expr("row_number() over (partition by p order by t, b, y) - 1")
    starts = F.create_map(*[F.lit(v) for kv in (first or {0: 0}).items() for v in kv])
    return x.select((starts[F.col("p")] + own).cast("long").alias("i"), "y")


def _sums(s: DataFrame) -> DataFrame:
    return s.agg(F.count("*").alias("n"), F.regr_slope("y", "i").alias("slope"), F.regr_sxx("y", "i").alias("sxx"), F.regr_syy("y", "i").alias("syy"), F.regr_sxy("y", "i").alias("sxy"))


def trend(df: DataFrame, time: str, value: str, tie: str | None = None) -> dict:
    """TS-02, TS-03: a line through the positions, its fit and a two-sided normal p-value."""
    return _trend(positions(df, time, value, tie))


def _trend(s: DataFrame) -> dict:
    r = _sums(s).first()
    n = r["n"]
    if n < 10:
        return {"detected": False, "reason": "fewer than 10 rows"}
    slope, sxx, syy = r["slope"], r["sxx"], r["syy"]
    residual = max(0.0, syy - r["sxy"] ** 2 / sxx)
    r2 = 1 - residual / syy if syy > 0 else 0.0
    error = math.sqrt(residual / (n - 2) / sxx)
    p = math.erfc(abs(slope / error) / math.sqrt(2)) if error > 0 else 0.0
    return {
        "detected": True,
        "direction": "flat" if abs(slope) < 1e-10 else "upward" if slope > 0 else "downward",
        "slope": round(slope, 6),
        "r_squared": round(r2, 4),
        "p_value": round(p, 4),
        "statistically_significant": p < 0.05,
        "strength": "strong" if r2 >= 0.7 else "moderate" if r2 >= 0.3 else "weak",
        "data_points": n,
    }


def autocorrelations(s: DataFrame, lags=tuple(LAGS)) -> dict[int, float]:
    """WN-04 on (i, y): correlation of y with itself `lag` positions on, if there are 2 * lag rows; one job for all lags."""
    n = s.count()
    lags = [k for k in lags if n >= 2 * k]
    if not lags:
        return {}
    ahead = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("i") - k).alias("i")) for k in lags])).alias("x"), F.col("y").alias("z")).select("x.lag", "x.i", "z")
    got = s.join(ahead, "i").groupBy("lag").agg(F.try_divide(F.covar_pop("y", "z"), F.stddev_pop("y") * F.stddev_pop("z")).alias("r")).collect()
    return {r["lag"]: r["r"] for r in got if r["r"] is not None}


def seasonality(df: DataFrame, time: str, value: str, tie: str | None = None) -> dict:
    """TS-04."""
    return _seasonality(positions(df, time, value, tie))


def _seasonality(s: DataFrame) -> dict:
    if len(s.take(60)) < 60:
        return {"detected": False, "reason": "fewer than 60 rows"}
    got = autocorrelations(s)
    found = [{"period": LAGS[k], "lag": k, "autocorrelation": round(r, 4), "strength": "strong" if abs(r) >= 0.6 else "moderate"} for k, r in sorted(got.items()) if abs(r) >= 0.3]
    return {"detected": True, "patterns": found, "primary_pattern": found[0]["period"]} if found else {"detected": False, "reason": "no seasonal pattern"}


def analyse(df: DataFrame, columns: list[str] | None = None, tie: str | None = None, first: int = 5, seasons: bool = True) -> dict:
    """TS-01, TS-05: trend and, unless told not to, seasonality of the first numeric columns over the first date column. Positions are worked out once a column."""
    times = of_type(df, DATES)
    if not times:
        return {"has_time_series": False, "reason": "no date column"}
    columns = (numeric(df) if columns is None else columns)[:first]
    analyses = {}
    for c in columns:
        s = positions(df, times[0], c, tie)
        s = settled(s, "positions") if seasons else s
        analyses[c] = {"trend": _trend(s)} | ({"seasonality": _seasonality(s)} if seasons else {})
    return {"has_time_series": True, "time_column": times[0], "analyses": analyses}


def decompose(s: DataFrame, period: int = 7) -> DataFrame:
    """TS-06, WN-05, WN-06 on (i, y): i, y, trend, seasonal, residual.

    The trend is a centred mean of `period` points that counts missing neighbours as 0; the seasonal part the median of the
    detrended values at each position of the period. Neighbours meet by an equi-join, not by one global window.
    """
    half = period // 2
    near = s.select(F.explode(F.sequence(F.col("i") - half, F.col("i") + half)).alias("i"), F.col("y").alias("z")).groupBy("i").agg((F.sum("z") / period).alias("trend"))
    x = s.join(near, "i").withColumn("d", F.col("y") - F.col("trend"))
    seasonal = group_medians(x, [F.col("i") % period], {"d": F.col("d")}).select(F.col("g.k0").alias("phase"), F.col("median").alias("seasonal"))
    return x.join(F.broadcast(seasonal), F.col("i") % period == F.col("phase")).select("i", "y", "trend", "seasonal", (F.col("d") - F.col("seasonal")).alias("residual"))  # `period` rows


def _standing_out(x: DataFrame, limit: float) -> tuple[Column, float, int]:
    """Which residuals stand out by MAD, or by 2 standard deviations where that is 0; the MAD and the number of rows."""
    n, mean, sd = x.agg(F.count("*"), F.mean("residual"), F.stddev_pop("residual")).first()
    center = median(x, F.col("residual"))
    spread = median(x, F.abs(F.col("residual") - center)) if n else None
    if spread:
        return 0.6745 * F.abs(F.col("residual") - center) / spread > limit, spread, n
    return F.abs(F.col("residual") - mean) > 2 * sd if sd else F.lit(False), 0.0, n


def residual_outliers(s: DataFrame, period: int = 7, limit: float = 3.0) -> DataFrame:
    """TS-06: rows of decompose() whose residual stands out; fewer than 14 rows: none."""
    x = decompose(s, period)
    far, _, n = _standing_out(x, limit)
    return x.where(far) if n >= 14 else x.limit(0)


def _above_noise(x: DataFrame) -> Column:
    """Residuals that are more than rounding of the values they were left over from."""
    largest = x.agg(F.max(F.abs("y"))).first()[0] or 0.0
    return F.abs(F.col("residual")) > 1e-9 * largest


def stl_outliers(s: DataFrame, spans: Spans = Spans(), robust: bool = False, limit: float = 3.0) -> DataFrame:
    """TS-06 by local regression, on (i, y): rows of stl() whose residual stands out; fewer than 14 rows: none."""
    x = stl(s, spans, robust)
    far, _, n = _standing_out(x, limit)
    return x.where(far & _above_noise(x)) if n >= 14 else x.limit(0)


def stl_report(s: DataFrame, spans: Spans = Spans(), robust: bool = False, limit: float = 3.0) -> dict:
    """TS-06: what stl_outliers() found, and the decomposition in a few numbers."""
    x = stl(s, spans, robust)
    far, spread, n = _standing_out(x, limit)
    if n < 14:
        return {"has_stl_outliers": False, "reason": "fewer than 14 observations"}
    row = x.agg(F.count_if(far & _above_noise(x)), F.min("trend"), F.max("trend"), F.max("seasonal") - F.min("seasonal")).first()
    return {
        "has_stl_outliers": row[0] > 0,
        "stl_outlier_count": row[0],
        "total_observations": n,
        "pct_stl_outliers": round(row[0] / n * 100, 2),
        "trend_summary": {"min": row[1], "max": row[2]},
        "seasonal_summary": {"amplitude": row[3]},
        "residual_mad": spread,
    }
