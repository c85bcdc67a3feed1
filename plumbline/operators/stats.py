"""Descriptive statistics (AG-*, CF-04, CF-05, AG-11..14, AG-24..29)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import numeric, q
from plumbline.plans.aggplan import Distinct, Median, Plan, nearest_quantiles
from plumbline.plans.grouped import group_medians
from plumbline.plans.shared import made


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return made(df.sparkSession, rows, schema)


def summary(df: DataFrame, columns: list[str] | None = None, prof=None) -> DataFrame:
    """CF-04: column, mean, std, min, max, median, q1, q3, skewness, kurtosis, count. Few passes, whatever the number of columns.

    prof: a Profile with medians; then only what it lacks is worked out.
    """
    columns = numeric(df) if columns is None else columns
    plan = Plan(df)
    for c in columns:
        x = q(c).cast("double")
        if prof is None:
            for name, a in (("n", F.count(x)), ("mean", F.mean(x)), ("std", F.stddev_samp(x)), ("min", F.min(x)), ("max", F.max(x)), ("median", Median(x)), ("skew", F.skewness(x))):
                plan.add((c, name), a)
        plan.add((c, "kurt"), F.kurtosis(x))
    got = plan.run() if columns else {}
    if prof is None:
        quart = nearest_quantiles(df, columns, (0.25, 0.75), {c: got[c, "n"] for c in columns})
    else:
        got |= {(c, name): v for c in columns for name, v in (prof.moments[c] | {"median": prof.medians.get(c)}).items()}
        quart = {(c, x): prof.quartiles[c][i] for c in columns if c in prof.quartiles for i, x in enumerate((0.25, 0.75))}
    f = lambda x: None if x is None else float(x)
    rows = [
        (c, got[c, "n"], got[c, "mean"], got[c, "std"], got[c, "min"], got[c, "max"], got[c, "median"], f(quart.get((c, 0.25))), f(quart.get((c, 0.75))), got[c, "skew"], got[c, "kurt"])
        for c in columns
    ]
    return _rows(df, rows, "column string, count long, mean double, std double, min double, max double, median double, q1 double, q3 double, skewness double, kurtosis double")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """AG-27: count, null_count, mean, std, min, quartiles, max of numeric columns."""
    columns = numeric(df) if columns is None else columns
    plan = Plan(df)
    for c in columns:
        x = q(c).cast("double")
        for name, a in (("n", F.count(x)), ("null", F.count_if(x.isNull())), ("mean", F.mean(x)), ("std", F.stddev_samp(x)), ("min", F.min(x)), ("max", F.max(x))):
            plan.add((c, name), a)
    got = plan.run()
    quart = nearest_quantiles(df, columns, (0.25, 0.5, 0.75), {c: got[c, "n"] for c in columns})
    f = lambda x: None if x is None else float(x)
    rows = [(c, got[c, "n"], got[c, "null"], got[c, "mean"], got[c, "std"], got[c, "min"], *[f(quart.get((c, x))) for x in (0.25, 0.5, 0.75)], got[c, "max"]) for c in columns]
    return _rows(df, rows, "column string, count long, null_count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def quantile_table(df: DataFrame, columns: list[str], qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """AG-04 as rows."""
    got = nearest_quantiles(df, columns, qs)
    return _rows(df, [(c, x, float(v)) for (c, x), v in got.items()], "column string, q double, value double")


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """AG-18: value, count; null is a value; most frequent first, ties by value."""
    out = df.groupBy(q(column).cast("string").alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_first("value"))
    return out if k is None else out.limit(k)


def categorical(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """CF-05: column, value, count, pct of all rows, total_unique (of non-nulls), missing_pct; one job for all columns.

    Rows are unpivoted and counted by (column, value); partial counts keep the shuffle to distinct values.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("count"))
    totals = counts.groupBy("column").agg(
        F.sum("count").alias("rows"), F.count("value").alias("total_unique"), F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("missing")
    )
    ranked = counts.withColumn("r", F.expr("row_number() over (partition by column order by count desc, value nulls first)")).where(f"r <= {k}")
    return ranked.join(totals, "column").select(
        "column",
        F.coalesce("value", F.lit("None")).alias("value"),
        "count",
        F.round(F.col("count") * 100.0 / F.col("rows"), 2).alias("pct"),
        "total_unique",
        F.round(F.col("missing") * 100.0 / F.col("rows"), 2).alias("missing_pct"),
    )


def mode(df: DataFrame, column: str):
    """AG-19: the most frequent value, null included; ties to the smallest, null first."""
    row = df.groupBy(q(column).alias("v")).count().orderBy(F.desc("count"), F.asc_nulls_first("v")).first()
    return row["v"] if row else None


def distinct_counts(df: DataFrame, columns: list[str] | None = None, null_counts: bool = True, approximate: bool = False) -> dict[str, int]:
    """AG-15: distinct values per column; null is one of them if null_counts."""
    plan = Plan(df)
    for c in columns or df.columns:
        plan.add(c, F.approx_count_distinct(q(c)) if approximate else Distinct(q(c)))
        if null_counts:
            plan.add((c, "null"), F.coalesce(F.max(q(c).isNull().cast("int")), F.lit(0)))
    got = plan.run()
    return {c: got[c] + got.get((c, "null"), 0) for c in columns or df.columns}


def duplicate_members(df: DataFrame, columns: list[str] | None = None) -> int:
    """AG-17: rows in groups of more than one, all members."""
    got = df.groupBy(*[q(c) for c in columns or df.columns]).count().where("count > 1").agg(F.sum("count")).first()
    return got[0] or 0


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> int:
    """AG-16."""
    return df.select(*[q(c) for c in columns or df.columns]).distinct().count()


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are known; null where one is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """AG-11: column_a, column_b, r for a < b in column order, over complete rows; with fewer than two of those, nulls are filled with medians. A constant column gives 0."""
    columns = numeric(df) if columns is None else columns
    if len(columns) < 2:
        return _rows(df, [], "column_a string, column_b string, r double")
    x = df.select(*[q(c).cast("double").alias(c) for c in columns])
    complete = x.dropna()
    if len(complete.take(2)) < 2:
        plan = Plan(x)
        for c in columns:
            plan.add(c, Median(q(c)))
        complete = x.fillna({c: v for c, v in plan.run().items() if v is not None}).dropna()
    plan, pairs = Plan(complete), [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    for a, b in pairs:
        plan.add((a, b), F.covar_pop(q(a), q(b)))
    for c in columns:
        plan.add(c, F.stddev_pop(q(c)))
    got = plan.run()
    r = lambda a, b: got[a, b] / (got[a] * got[b]) if got[a, b] is not None and got[a] and got[b] else 0.0
    return _rows(df, [(a, b, r(a, b)) for a, b in pairs], "column_a string, column_b string, r double")


def strong(correlations: DataFrame, threshold: float = 0.7) -> DataFrame:
    """AG-12."""
    r = F.col("r")
    return correlations.where(F.abs(r) >= threshold).select(
        "column_a",
        "column_b",
        F.round(r, 4).alias("r_value"),
        F.when(r > 0, "positive").otherwise("negative").alias("direction"),
        F.when(F.abs(r) >= 0.9, "very strong").otherwise("strong").alias("strength"),
    )


def target_correlation(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """AG-14, FE-04 with a target: column, r; null where a side is constant."""
    columns = [c for c in (numeric(df) if columns is None else columns) if c != target]
    plan = Plan(df)
    for c in columns:
        plan.add(c, pearson(q(c), q(target)))
    return _rows(df, list(plan.run().items()), "column string, r double")


def _bins(df: DataFrame, columns: list[str], bins: int) -> dict[str, tuple]:
    plan = Plan(df)
    for c in columns:
        plan.add((c, 0), F.min(q(c).cast("double")))
        plan.add((c, 1), F.max(q(c).cast("double")))
    got, out = plan.run(), {}
    for c in columns:
        low, high = got[c, 0], got[c, 1]
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        out[c] = (low, high, (high - low) / bins)
    return out


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 15, first: int = 15) -> DataFrame:
    """AG-24, AG-25: column, bin, low, high, label, count; equal widths, the last bin closed on both sides, empty bins too. Two passes."""
    columns = (numeric(df) if columns is None else columns)[:first]
    edges = _bins(df, columns, bins)
    if not edges:
        return _rows(df, [], "column string, bin int, low double, high double, label string, count long")
    which = lambda c, e: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((q(c).cast("double") - e[0]) / e[2]).cast("int")))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(q(c).isNotNull(), which(c, e)).alias("bin")) for c, e in edges.items()])).alias("x")).select("x.*")
    counts = long.where("bin is not null").groupBy("column", "bin").agg(F.count("*").alias("count"))
    grid = [(c, i, e[0] + i * e[2], e[0] + (i + 1) * e[2], f"{e[0] + i * e[2]:.1f}-{e[0] + (i + 1) * e[2]:.1f}") for c, e in edges.items() for i in range(bins)]
    every = _rows(df, grid, "column string, bin int, low double, high double, label string")
    return every.join(counts, ["column", "bin"], "left").select("column", "bin", "low", "high", "label", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def group_stats(df: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """AG-28: category, column, median, std (population), n; nulls left out. Medians by ranks narrowed within groups: no group is gathered."""
    known = df.where(q(category).isNotNull())
    aggs = [x for c in columns for x in (F.stddev_pop(q(c).cast("double")).alias(f"{c}__s"), F.count(q(c)).alias(f"{c}__n"))]
    wide = known.groupBy(q(category).alias("category")).agg(*aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("column"), q(f"{c}__s").alias("std"), q(f"{c}__n").alias("n")) for c in columns])
    rest = wide.select("category", F.explode(parts).alias("x")).select("category", "x.*")
    middle = group_medians(known, [q(category)], {c: q(c) for c in columns}).select(F.col("g.k0").alias("category"), F.col("name").alias("column"), "median")
    return rest.join(middle, ["category", "column"], "left").select("category", "column", "median", "std", "n")


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """AG-29: slope and intercept of y on x by least squares."""
    a, b = q(y).cast("double"), q(x).cast("double")
    return df.agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.regr_count(a, b).alias("n"))


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """SO-07: n rows, the same each time, by hash of the row."""
    return df.orderBy(F.xxhash64(*[q(c) for c in df.columns]), *[q(c) for c in df.columns]).limit(n)


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def estimated_bytes(df: DataFrame) -> int:
    """AG-31: Spark's own estimate of the table's size, without reading it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
