"""Aggregate planner: operators name the aggregates they need, few jobs compute them all.

Plain aggregates go into one job (more than MAX_WIDTH of them are split).
Distinct counts are taken of all columns together, from one unpivoted table of
(column, value), so no row is expanded once per column with all its others.
Medians and quantiles are exact and need no buffer that grows with the data: a
sketch brackets each rank, then the counts of bins within the brackets, of all
columns and ranks in one job, narrow them down to a value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import q

MAX_WIDTH = 400
ACCURACY = 10_000  # of the sketch: a rank is off by a ten-thousandth of the rows at most
BINS = 4096  # per bracket and pass


@dataclass(frozen=True, eq=False)
class Distinct:
    """The number of distinct values, nulls left out."""

    value: Column


@dataclass(frozen=True, eq=False)
class Median:
    """The mean of the two middle values, nulls left out; None without any."""

    value: Column


class Plan:
    """Collects named aggregates of one table, plain ones, Distinct and Median; run() gives their values."""

    def __init__(self, df: DataFrame):
        self.df, self.wanted = df, {}

    def add(self, name, aggregate: Column | Distinct | Median) -> None:
        self.wanted.setdefault(name, aggregate)

    def run(self) -> dict:
        wanted, self.wanted = self.wanted, {}
        plain = {n: a for n, a in wanted.items() if isinstance(a, Column)}
        names, out = list(plain), dict.fromkeys(wanted)
        for at in range(0, len(names), MAX_WIDTH):
            some = names[at : at + MAX_WIDTH]
            row = self.df.agg(*[plain[n].alias(f"a{i}") for i, n in enumerate(some)]).first()
            out |= dict(zip(some, row))
        if distinct := {n: a.value for n, a in wanted.items() if isinstance(a, Distinct)}:
            out |= distinct_counts(self.df, distinct)
        if middle := {n: a.value for n, a in wanted.items() if isinstance(a, Median)}:
            got = order_statistics(self.df, {n: (c, lambda k: {0.5: ((k - 1) // 2, k // 2)}) for n, c in middle.items()})
            out |= {n: 0.5 * got[n, (k - 1) // 2] + 0.5 * got[n, k // 2] for n, k in got.counts.items() if k}
        return out


def median(df: DataFrame, value: Column) -> float | None:
    plan = Plan(df)
    plan.add("m", Median(value))
    return plan.run()["m"]


def _as_text(c: Column, kind: T.DataType) -> Column:
    """A text that is the same for equal values only."""
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return F.when(c == 0, "0.0").otherwise(c.cast("string"))  # both zeros are equal
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
    return c.cast("string")


def distinct_counts(df: DataFrame, values: dict) -> dict:
    """The number of distinct non-null values of each named column, in one job of two partial aggregates."""
    names = list(values)
    base = df.select(*[c.alias(f"_{i}") for i, c in enumerate(values.values())])
    # Numbers and dates stay what they are, to be compared by eight bytes instead of their digits.
    none = {"v": "string", "n": "bigint", "d": "double"}

    def cell(i, f):
        c, kind = F.col(f.name), f.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            at, value = "d", c.cast("double")  # grouping takes both zeros, and all NaN, as equal
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            at, value = "n", c.cast("bigint")
        elif isinstance(kind, T.DateType):
            at, value = "n", F.unix_date(c).cast("bigint")
        elif isinstance(kind, T.TimestampType):
            at, value = "n", F.unix_micros(c)
        else:
            at, value = "v", _as_text(c, kind)
        return F.struct(F.lit(i).alias("i"), *[(value if k == at else F.lit(None).cast(t)).alias(k) for k, t in none.items()])

    cells = [cell(i, f) for i, f in enumerate(base.schema.fields)]
    long = base.select(F.explode(F.array(*cells)).alias("x")).select("x.i", "x.v", "x.n", "x.d").where("v is not null or n is not null or d is not null")
    got = {r["i"]: r["count"] for r in long.distinct().groupBy("i").count().collect()}
    return {n: got.get(i, 0) for i, n in enumerate(names)}


def ranks(n: int, qs) -> dict[float, int]:
    """AG-04: the 0-based nearest rank of each quantile, halves away from zero."""
    return {x: math.floor((n - 1) * x + 0.5) for x in qs}


def nearest_quantiles(df: DataFrame, columns: list[str], qs, counts: dict[str, int] | None = None) -> dict[tuple[str, float], float]:
    """(column, q) -> the value of nearest rank among the non-nulls; absent if there are none."""
    got = order_statistics(df, {c: (q(c), lambda n: {x: (r,) for x, r in ranks(n, qs).items()}) for c in columns if counts is None or counts[c]})
    return {(c, x): got[c, r] for c, n in got.counts.items() if n for x, r in ranks(n, qs).items()}


class Ranked(dict):
    """(name, rank) -> value, and counts: name -> number of values."""

    def __init__(self):
        super().__init__()
        self.counts: dict = {}


@dataclass
class _Bracket:
    name: object
    at: int  # number of the column
    rank: int
    low: float
    high: float


def order_statistics(df: DataFrame, wanted: dict, weight: Column | None = None) -> Ranked:
    """Values by rank among the non-nulls, exactly. wanted: name -> (column, function from their number to {quantile: ranks}).

    weight: of so many equal rows each row is; then the counts are theirs, and brackets begin at the ends, without a sketch.
    Jobs: one for counts, ends and sketches; then two a pass (rows below each bracket;
    bins within), about two passes. What comes back is bin counts.
    """
    names, out = list(wanted), Ranked()
    base = df.select(*[c.cast("double").alias(f"_{i}") for i, (c, _) in enumerate(wanted.values())], *([] if weight is None else [weight.cast("long").alias("_w")]))
    guess = sorted({x for _, of in wanted.values() for x in of(1)})
    slack = 3 / ACCURACY
    near = [min(1.0, max(0.0, x + d)) for x in guess for d in (-slack, slack)]
    ends: dict = {}
    for a in range(0, len(names), MAX_WIDTH // 4):
        some = range(a, min(len(names), a + MAX_WIDTH // 4))
        sketch = lambda i: F.percentile_approx(f"_{i}", near, ACCURACY) if weight is None else F.lit(None)
        aggs = [x for i in some for x in (_number(base, F.col(f"_{i}").isNotNull()), F.min(f"_{i}"), F.max(f"_{i}"), sketch(i))]
        row = base.agg(*[x.alias(f"a{k}") for k, x in enumerate(aggs)]).first()
        for k, i in enumerate(some):
            ends[i] = row[4 * k : 4 * k + 4]
    open_, odd = [], []
    for i, name in enumerate(names):
        n, low, high, marks = ends[i]
        out.counts[name] = n
        if not n:
            continue
        if any(math.isnan(x) or math.isinf(x) for x in (low, high)):
            odd.append((i, name, n))
            continue
        for x, rs in wanted[name][1](n).items():
            k = 2 * guess.index(x) if x in guess and marks else None
            open_ += [_Bracket(name, i, r, marks[k] if k is not None else low, marks[k + 1] if k is not None else high) for r in dict.fromkeys(rs)]
    while open_:
        open_ = _narrowed(base, open_, ends, out)
    if odd:  # infinities and NaN have no bins
        for i, name, n in odd:
            rs = sorted({r for group in wanted[name][1](n).values() for r in group})
            every = base if weight is None else base.select(F.expr(f"explode(array_repeat(_{i}, cast(_w as int))) as _{i}"))
            row = every.agg(*[F.expr(f"percentile_disc({(r + 0.5) / n!r}D) within group (order by _{i})").alias(f"a{r}") for r in rs]).first()
            out.update({(name, r): row[k] for k, r in enumerate(rs)})
    return out


def _number(base: DataFrame, which: Column) -> Column:
    """How many rows the condition holds for, by their weights if there are any."""
    return F.coalesce(F.sum(F.when(which, F.col("_w"))), F.lit(0)) if "_w" in base.columns else F.count_if(which)


def _narrowed(base: DataFrame, brackets: list[_Bracket], ends: dict, out: Ranked) -> list[_Bracket]:
    """One pass: brackets found to hold one value go to out, the others come back narrower."""
    spans = list(dict.fromkeys((b.at, b.low, b.high) for b in brackets))
    below = base.agg(*[_number(base, F.col(f"_{i}") < F.lit(low)).alias(f"b{k}") for k, (i, low, _) in enumerate(spans)]).first()
    cells = []
    for k, (i, low, high) in enumerate(spans):
        v, width = F.col(f"_{i}"), (high - low) / BINS
        which = F.least(F.lit(BINS - 1), F.floor((v - F.lit(low)) / F.lit(width)).cast("int")) if width > 0 and low + width > low else F.lit(0)
        cells.append(F.struct(F.lit(k).alias("k"), F.when(v.between(low, high), which).alias("bin"), v.alias("v")))
    own = [c for c in base.columns if c == "_w"]
    long = base.select(*own, F.explode(F.array(*cells)).alias("x")).select(*own, "x.*").where("bin is not null")
    tight = {k for k, (_, low, high) in enumerate(spans) if not ((high - low) / BINS > 0 and low + (high - low) / BINS > low)}
    # Ends that no bin can part: their values themselves, which are few neighbouring doubles.
    key = F.when(F.col("k").isin(list(tight)), F.col("v")) if tight else F.lit(None).cast("double")
    bins: dict = {}
    for r in long.groupBy("k", "bin", key.alias("at")).agg((F.sum("_w") if own else F.count("*")).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "bin", "at").collect():
        bins.setdefault(r["k"], []).append(r)
    left = []
    for b in brackets:
        k = spans.index((b.at, b.low, b.high))
        under = below[k]
        inside = sum(r["n"] for r in bins.get(k, ()))
        if not under <= b.rank < under + inside:
            if (b.low, b.high) == (ends[b.at][1], ends[b.at][2]):
                raise RuntimeError("the rows changed between two reads")
            left.append(_Bracket(b.name, b.at, b.rank, ends[b.at][1], ends[b.at][2]))
            continue
        for r in bins[k]:
            if b.rank < under + r["n"]:
                if r["lo"] == r["hi"]:
                    out[b.name, b.rank] = r["lo"]
                else:
                    left.append(_Bracket(b.name, b.at, b.rank, r["lo"], r["hi"]))
                break
            under += r["n"]
    return left
