"""Tables that charts are drawn from (VZ-01, AG-25): each has a size that is set by the chart, not by the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import q
from plumbline.plans.grouped import group_quantiles


def _slot(v: Column, low: Column, high: Column, bins: int) -> Column:
    """0 to bins - 1 by equal widths, the last closed; everything in 0 where all values are equal; null for null."""
    share = F.when(high > low, (v - low) / (high - low)).otherwise(0.0)
    return F.when(v.isNotNull(), F.least(F.lit(bins - 1), F.floor(share * bins).cast("int")))


def _ends(x: DataFrame, columns: list[str]) -> DataFrame:
    return x.agg(*[a for c in columns for a in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))])  # one row


def density(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """Scatter plots of any number of points: x_bin, y_bin, n, and the cell's corner x_low, y_low; rows without both values are left out, so are cells without rows."""
    rows = df.select(q(x).cast("double").alias("x"), q(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    both = rows.join(F.broadcast(_ends(rows, ["x", "y"])))
    at = both.select(_slot(F.col("x"), F.col("x_low"), F.col("x_high"), bins).alias("x_bin"), _slot(F.col("y"), F.col("y_low"), F.col("y_high"), bins).alias("y_bin"), "x_low", "x_high", "y_low", "y_high")
    cells = at.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("x_low", "x_high", "y_low", "y_high")])
    corner = lambda c: F.col(f"{c}_low") + F.col(f"{c}_bin") * (F.col(f"{c}_high") - F.col(f"{c}_low")) / bins
    return cells.select("x_bin", "y_bin", "n", corner("x").alias("x_low"), corner("y").alias("y_low"))


def _mean(v: str) -> Column:
    """The mean of doubles whatever the order of the rows: whole parts and fractions (to 18 places) are summed as decimals; as usual where a value is beyond 1e18, infinite or NaN."""
    fits = F.coalesce(F.max(F.abs(v)) < 1e18, F.lit(False))
    small = F.when(F.abs(v) < 1e18, F.col(v))
    whole, rest = F.sum(F.floor(small).cast("decimal(19,0)")), F.sum((small - F.floor(small)).cast("decimal(20,18)"))
    return F.when(fits, (whole.cast("double") + rest.cast("double")) / F.count(v)).otherwise(F.mean(v))


def line(df: DataFrame, time: str, value: str, pixels: int = 800) -> DataFrame:
    """A series of any length for a line of so many pixels: pixel, n, min, max, mean, first, last; a line from min to max in each pixel draws what all points would."""
    rows = df.select(F.unix_micros(q(time).cast("timestamp")).alias("t"), q(value).cast("double").alias("v")).where("t is not null and v is not null")
    both = rows.join(F.broadcast(_ends(rows, ["t"])))
    # In whole numbers: a quotient of decimals is rounded to 6 places, which moves a point just before a pixel into it.
    at = F.when(F.col("t_high") > F.col("t_low"), F.expr(f"(t - t_low) * cast({pixels} as decimal(20,0)) div (t_high - t_low)")).otherwise(0)
    placed = both.select("t", "v", F.least(F.lit(pixels - 1), at.cast("int")).alias("pixel"))
    edge = lambda f, order: f(F.col("v"), order)
    return placed.groupBy("pixel").agg(
        F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), _mean("v").alias("mean"),
        edge(F.min_by, F.struct("t", "v")).alias("first"), edge(F.max_by, F.struct("t", "v")).alias("last"),
    )


def boxes(df: DataFrame, category: str, value: str, k: int = 10) -> DataFrame:
    """Box plots of the k largest categories: category, n, min, q1, median, q3, max (nearest ranks), low and high whisker, and the number of values beyond."""
    known = df.select(q(category).cast("string").alias("category"), q(value).cast("double").alias("v")).where("category is not null and v is not null")
    top = known.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k).select("category")
    rows = known.join(F.broadcast(top), "category", "left_semi")  # k rows
    five = group_quantiles(rows, [F.col("category")], {"v": F.col("v")}, (0.0, 0.25, 0.5, 0.75, 1.0))
    five = five.select(F.col("g.k0").alias("category"), "n", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("min", "q1", "median", "q3", "max"))])
    width = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - width, F.col("q3") + width
    fenced = rows.join(F.broadcast(five.select("category", low.alias("f0"), high.alias("f1"))), "category")
    inside = F.when(F.col("v").between(F.col("f0"), F.col("f1")), F.col("v"))
    whiskers = fenced.groupBy("category").agg(F.min(inside).alias("low"), F.max(inside).alias("high"), F.count_if(inside.isNull()).alias("beyond"))
    return five.join(whiskers, "category")


def missing_map(df: DataFrame, order: str, columns: list[str] | None = None, blocks: int = 50) -> DataFrame:
    """Where in the table values are missing: block, column, n, nulls; blocks are equal ranges of the ordering column (a number or a time). Rows without it are block -1."""
    columns = [c for c in (columns or df.columns) if c != order]
    kind = df.schema[order].dataType.simpleString()
    at = F.unix_micros(q(order).cast("timestamp")) if kind.startswith(("timestamp", "date")) else q(order).cast("double")
    rows = df.select(at.cast("double").alias("t"), *[q(c).isNull().cast("int").alias(f"c{i}") for i, c in enumerate(columns)])
    both = rows.join(F.broadcast(_ends(rows.select("t"), ["t"])))
    placed = both.withColumn("block", F.coalesce(_slot(F.col("t"), F.col("t_low"), F.col("t_high"), blocks), F.lit(-1)))
    counts = placed.groupBy("block").agg(F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(columns))])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(columns)])
    return counts.select("block", "n", F.explode(cells).alias("x")).select("block", "x.column", "n", "x.nulls")


def shape(mean: float | None, median: float | None) -> str | None:
    """AG-25: the word for a distribution, by its mean and median."""
    if mean is None or median is None:
        return None
    if abs(mean - median) < 0.01 * abs(mean + 1e-9):
        return "roughly symmetric"
    return "right-skewed (tail toward high values)" if mean > median else "left-skewed (tail toward low values)"
