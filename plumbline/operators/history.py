"""Profiles of versions from mergeable states (CL-16).

Each version, or each part of one such as a day, is read once; what is kept of a
column merges with others of its kind: counts, moments, extremes, a HyperLogLog sketch of its
distinct values, a KLL sketch of its quantiles, its most frequent values with a bound on those
left out. So the profile of any union, and how it moves from version to version, comes from the
states alone. Counts, moments and extremes are exact; a sketch's distinct count is off by about
2 % (one standard deviation), a quantile's rank by about 1.5 % of the rows, a frequent value's count by the stated bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import q, strings

HLL_BITS, KLL_SIZE, VALUES = 12, 400, 256
_WIDE = 60  # columns an aggregate


class History:
    """The states in a folder, by version (a number that orders them) and part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, df: DataFrame, version: int, part: str = "all") -> History:
        """Keep the states of df; the same version and part are replaced."""
        at = f"version={int(version)}/part={part}"
        out = None
        for k in range(0, len(df.columns), _WIDE):
            some = _states(df, df.columns[k : k + _WIDE])
            out = some if out is None else out.unionByName(some)
        out.write.mode("overwrite").parquet(f"{self.path}/columns/{at}")
        _values(df).write.mode("overwrite").parquet(f"{self.path}/values/{at}")
        return self

    def states(self, versions: list[int] | None = None) -> DataFrame:
        x = self.spark.read.parquet(f"{self.path}/columns")
        return x if versions is None else x.where(F.col("version").isin(list(versions)))

    def profile(self, versions: list[int] | None = None, by: tuple[str, ...] = (), qs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
        """by..., column, type, rows, nulls, null_pct, mean, std, min, max, distinct, quantiles of the versions together, or of each group of `by`."""
        x = self.states(versions)
        n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
        # Sums of squares about a common centre, then about the common mean.
        squares = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum("n") * mean * mean
        out = x.groupBy(*by, "column").agg(
            F.max_by("type", "version").alias("type"),
            F.sum("rows").alias("rows"),
            F.sum("nulls").alias("nulls"),
            mean.alias("mean"),
            F.when(n > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1))).alias("std"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"),
            F.kll_merge_agg_double("kll").alias("kll"),
        )
        marks = F.when(F.kll_sketch_get_n_double("kll") > 0, F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit(x) for x in qs])))
        return out.select(*by, "column", "type", "rows", "nulls", F.when(F.col("rows") > 0, F.col("nulls") * 100.0 / F.col("rows")).cast("double").alias("null_pct"), "mean", "std", "min", "max", "distinct", marks.alias("quantiles"))

    def frequent(self, versions: list[int] | None = None, k: int = 10) -> DataFrame:
        """column, value, count, off: the most frequent texts; a count may be too small by `off` at most, and no other value has more than `off` besides."""
        x = self.spark.read.parquet(f"{self.path}/values")
        x = x if versions is None else x.where(F.col("version").isin(list(versions)))
        off = x.where("value is null").groupBy("column").agg(F.sum("count").alias("off"))
        counts = x.where("value is not null").groupBy("column", "value").agg(F.sum("count").alias("count"))
        ranked = counts.withColumn("r", F.expr("row_number() over (partition by column order by count desc, value)")).where(f"r <= {k}")
        return ranked.join(off, "column", "left").select("column", "value", "count", F.coalesce("off", F.lit(0)).alias("off"))

    def trend(self, shift: float = 5.0) -> DataFrame:
        """version, column, change, before, after from each version to the next: rows, added, removed, type_changed, null_shift of `shift` points or more."""
        x = self.profile(by=("version",)).select("version", "column", "type", "rows", "null_pct")
        order = x.select("version").distinct().withColumn("next", F.expr("lead(version) over (order by version)"))  # a row a version
        a = x.join(order, "version").where("next is not null").select(F.col("next").alias("version"), "column", F.col("type").alias("t0"), F.col("null_pct").alias("n0"), F.col("rows").alias("r0"))
        b = x.join(order.select(F.col("next").alias("version")).where("version is not null"), "version").select("version", "column", F.col("type").alias("t1"), F.col("null_pct").alias("n1"), F.col("rows").alias("r1"))
        both = a.join(b, ["version", "column"], "full")
        one = lambda name, x, y: F.struct(F.lit(name).alias("change"), x.cast("string").alias("before"), y.cast("string").alias("after"))
        none = F.lit(None)
        found = F.array_compact(
            F.array(
                F.when(F.col("t0").isNull(), one("added", none, F.col("t1"))),
                F.when(F.col("t1").isNull(), one("removed", F.col("t0"), none)),
                F.when(F.col("t0") != F.col("t1"), one("type_changed", F.col("t0"), F.col("t1"))),
                F.when(F.abs(F.round(F.col("n1") - F.col("n0"), 2)) >= shift, one("null_shift", F.format_string("%.2f", "n0"), F.format_string("%.2f", "n1"))),
            )
        )
        drifted = both.select("version", "column", F.explode(found).alias("x")).select("version", "column", "x.*")
        rows = both.groupBy("version").agg(F.max("r0").alias("r0"), F.max("r1").alias("r1")).select("version", F.lit(None).cast("string").alias("column"), F.lit("rows").alias("change"), F.col("r0").cast("string").alias("before"), F.col("r1").cast("string").alias("after"))
        return drifted.unionByName(rows)


def _states(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs, cells = [F.count("*").alias("rows")], []
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        number = isinstance(kind, T.NumericType)
        x = q(c).cast("double") if number else F.lit(None).cast("double")
        known = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)  # moments of finite values
        text = F.hex(q(c)) if isinstance(kind, T.BinaryType) else F.to_json(F.struct(q(c))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else q(c).cast("string")
        aggs += [
            F.count_if(q(c).isNull()).alias(f"z{i}"), F.count(known).alias(f"n{i}"), F.avg(known).alias(f"a{i}"), (F.var_pop(known) * F.count(known)).alias(f"s{i}"),
            F.min(known).alias(f"l{i}"), F.max(known).alias(f"h{i}"), F.hll_sketch_agg(F.when(q(c).isNotNull(), text), HLL_BITS).alias(f"d{i}"), F.kll_sketch_agg_double(known, KLL_SIZE).alias(f"k{i}"),
        ]
        cells.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(kind.simpleString()).alias("type"), F.col(f"z{i}").alias("nulls"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("m2"),
                F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"), F.col(f"d{i}").alias("hll"), F.col(f"k{i}").alias("kll"),
            )
        )
    return df.agg(*aggs).select("rows", F.explode(F.array(*cells)).alias("x")).select("rows", "x.*")


def _values(df: DataFrame) -> DataFrame:
    """column, value, count of the VALUES most frequent texts of each column; with value null the count of the most frequent one left out."""
    text = strings(df)
    if not text:
        return df.sparkSession.createDataFrame([], "column string, value string, count long")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).alias("value")) for c in text])).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("count"))
    ranked = counts.withColumn("r", F.expr("row_number() over (partition by column order by count desc, value)")).where(f"r <= {VALUES + 1}")
    return ranked.select("column", F.when(F.col("r") <= VALUES, F.col("value")).alias("value"), "count")
