"""Order statistics within groups, exactly, without a buffer that grows with a group.

Groups of at most SMALL values are sorted in their aggregate. In larger ones a rank
is narrowed down: the values between its bounds are counted in BINS bins, all groups
and ranks in one partial aggregate, and the bin that holds the rank gives the next bounds, until
they hold at most SMALL values (which are then sorted) or equal ones. Bounds come
back to the rows by a join on the group; only the number of open ranks reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import q
from plumbline.plans.shared import settled

SMALL, BINS = 1024, 256
_INFINITE = float("inf")


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """-1 and `bins` for the infinities, bins + 1 for NaN, which are single values; else 0 to bins - 1."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)  # halves: the width itself may overflow
    inner = F.when(high > low, F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(share * bins).cast("int")))).otherwise(F.lit(0))
    return F.when(F.isnan(v), bins + 1).when(v == _INFINITE, bins).when(v == -_INFINITE, -1).otherwise(inner)


def _bounded(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < _INFINITE), v)


def group_ranks(df: DataFrame, by: list[Column], columns: dict[str, Column], ranks, small: int = SMALL, bins: int = BINS) -> DataFrame:
    """g (struct of `by`), name, n, rank, value of each named column's non-null values within each group, ascending from rank 0, NaN last.

    ranks: from the Column n, the number of values, to an array of ranks below n. Null groups are groups. A column without values has no row.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("name"), c.cast("double").alias("v")) for name, c in columns.items()])
    keys = [f"k{i}" for i in range(len(by))]
    long = df.select(*[b.alias(k) for k, b in zip(keys, by)], F.explode(cells).alias("x")).select(F.struct(*keys).alias("g"), "x.name", "x.v").where("v is not null")
    key = ["g", "name"]
    wanted = lambda n: F.array_distinct(ranks(n).cast("array<long>"))

    def at_once(rows):
        held = _sorted(rows, key).select("g", "name", "values", F.size("values").cast("long").alias("n"))
        each = held.select("g", "name", "n", "values", F.explode(wanted(F.col("n"))).alias("rank"))
        return each.select("g", "name", "n", "rank", F.get("values", F.col("rank").cast("int")).alias("value"))

    if not long.groupBy(*key).count().where(f"count > {small}").take(1):
        return at_once(long)
    long = settled(long, "groups")
    sizes = settled(long.groupBy(*key).agg(F.count("*").alias("n")), "sizes")
    larger = sizes.where(f"n > {small}")
    few = long.join(sizes.where(f"n <= {small}").select(*key), key, "left_semi")
    rows = long.join(larger.select(*key), key, "left_semi")
    found = ranked(rows, larger.select(*key, "n", F.explode(wanted(F.col("n"))).alias("rank")), key, small, bins)
    return at_once(few).unionByName(found)


def group_medians(df: DataFrame, by: list[Column], columns: dict[str, Column], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """g, name, n, median: the mean of the two middle values."""
    found = group_ranks(df, by, columns, _middle, small, bins)
    return found.groupBy("g", "name").agg(F.first("n").alias("n"), (F.min("value") / 2 + F.max("value") / 2).alias("median"))


def group_quantiles(df: DataFrame, by: list[Column], columns: dict[str, Column], qs: tuple[float, ...], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """g, name, n, quantiles: for each of qs the value of nearest rank, halves away from zero (AG-04)."""
    place = lambda n, x: F.floor((n - 1) * x + 0.5)
    found = group_ranks(df, by, columns, lambda n: F.array(*[place(n, x) for x in qs]), small, bins)
    held = found.groupBy("g", "name").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # a few ranks a group
    return held.select("g", "name", "n", F.array(*[F.col("at")[place(F.col("n"), x)] for x in qs]).alias("quantiles"))


def _middle(n: Column) -> Column:
    return F.array(F.floor((n - 1) / 2), F.floor(n / 2))


def _sorted(rows: DataFrame, key: list[str]) -> DataFrame:
    """values: the sorted values of groups that are known to be small."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list("v")).alias("values"))


def ranked(rows: DataFrame, targets: DataFrame, key: list[str], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """targets (key, n, rank from 0) with value: that of the rank among the group's v in rows (key, v)."""
    ends = rows.groupBy(*key).agg(F.min(_bounded(F.col("v"))).alias("low"), F.max(_bounded(F.col("v"))).alias("high"))
    # place: of the rank among the values from low to high; infinities and NaN count with the first pass only.
    open_ = settled(targets.join(ends, key).select(*key, "n", "rank", F.col("rank").alias("place"), "low", "high", F.lit(True).alias("ends"), F.col("n").alias("inside")), "open")
    done = []
    while open_.take(1):
        spans = open_.select(*key, "low", "high", "ends").distinct()
        within = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")) | F.col("ends")
        held = rows.join(spans, key).where(within)
        counts = held.groupBy(*key, "low", "high", "ends", _bin(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.expr(f"sum(m) over (partition by {', '.join(key)}, low, high, ends order by bin rows between unbounded preceding and current row) - m")
        counts = counts.withColumn("before", before)  # at most bins + 3 rows a span
        same = [open_[c].eqNullSafe(counts[c]) for c in (*key, "low", "high", "ends")]
        hit = open_.join(counts, same).where((open_["place"] >= counts["before"]) & (open_["place"] < counts["before"] + counts["m"]))
        after = settled(hit.select(*[open_[c] for c in key], "n", "rank", (F.col("place") - F.col("before")).alias("place"), F.col("lo").alias("low"), F.col("hi").alias("high"), F.lit(False).alias("ends"), F.col("m").alias("inside")), "open")
        single = F.col("low").eqNullSafe(F.col("high"))
        done.append(after.where(single).select(*key, "n", "rank", F.col("low").alias("value")))
        near = after.where(~single & (F.col("inside") <= small))
        some = rows.join(near.select(*key, "low", "high").distinct(), key).where("v >= low and v <= high").groupBy(*key, "low", "high").agg(F.array_sort(F.collect_list("v")).alias("values"))
        picked = near.join(some, [*key, "low", "high"]).select(*key, "n", "rank", F.get("values", F.col("place").cast("int")).alias("value"))
        done.append(picked)
        open_ = after.where(~single & (F.col("inside") > small))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
