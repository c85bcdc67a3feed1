"""Table profile and first inspection (INS-*, CL-16, CF-06)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import DATES, FOUR, of_type, q, total
from plumbline.operators import stats
from plumbline.plans.aggplan import Distinct, Plan, order_statistics, ranks
from plumbline.plans.shared import made


@dataclass
class Profile:
    """Counts and moments of a table, distinct values and quartiles, as the planner takes them."""

    rows: int
    types: dict[str, T.DataType]
    nulls: dict[str, int]
    distinct: dict[str, int]  # null counts as a value
    moments: dict[str, dict] = field(default_factory=dict)  # of numeric columns: n, mean, std, min, max, skew
    quartiles: dict[str, tuple] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return list(self.types)

    def null_pct(self, c: str) -> float:
        return self.nulls[c] / self.rows * 100 if self.rows else 0.0

    def of(self, kinds) -> list[str]:
        return [c for c, t in self.types.items() if isinstance(t, kinds)]


def profile(df: DataFrame, quartiles: bool = True, approximate: bool = False, medians: bool = False) -> Profile:
    """medians: with the quartiles, by the same passes."""
    plan = Plan(df)
    plan.add("rows", F.count("*"))
    for f in df.schema.fields:
        c = q(f.name)
        plan.add((f.name, "nulls"), F.count_if(c.isNull()))
        if isinstance(f.dataType, T.AtomicType):
            plan.add((f.name, "distinct"), F.approx_count_distinct(c) if approximate else Distinct(c))
        if isinstance(f.dataType, T.NumericType):
            x = c.cast("double")
            for name, a in (("n", F.count(x)), ("mean", F.mean(x)), ("std", F.stddev_samp(x)), ("min", F.min(x)), ("max", F.max(x)), ("skew", F.skewness(x))):
                plan.add((f.name, name), a)
    got = plan.run()
    types = {f.name: f.dataType for f in df.schema.fields}
    nums = [c for c, t in types.items() if isinstance(t, T.NumericType)]
    out = Profile(
        got["rows"],
        types,
        {c: got[c, "nulls"] for c in types},
        {c: (got.get((c, "distinct")) or 0) + (got[c, "nulls"] > 0) for c in types},
        {c: {k: got[c, k] for k in ("n", "mean", "std", "min", "max", "skew")} for c in nums},
    )
    if quartiles and nums:
        near = lambda n: ranks(n, (0.25, 0.75))
        middle = lambda n: ((n - 1) // 2, n // 2)
        at = lambda n: {x: (r,) for x, r in near(n).items()} | ({0.5: middle(n)} if medians else {})
        held = order_statistics(df, {c: (q(c), at) for c in nums if got[c, "n"]})
        for c, n in held.counts.items():
            out.quartiles[c] = tuple(float(held[c, r]) for r in near(n).values())
            if medians:
                low, high = middle(n)
                out.medians[c] = 0.5 * held[c, low] + 0.5 * held[c, high]
    return out


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return made(df.sparkSession, rows, schema)


def schema_profile(df: DataFrame) -> DataFrame:
    """CL-16: column, dtype, null_count, null_percentage, unique_count, row_count."""
    p = profile(df, quartiles=False)
    return _rows(
        df,
        [(c, p.types[c].simpleString(), p.nulls[c], round(p.null_pct(c), 2), p.distinct[c], p.rows) for c in p.columns],
        "column string, dtype string, null_count long, null_percentage double, unique_count long, row_count long",
    )


def null_profile(df: DataFrame) -> DataFrame:
    """AG-02, one pass: column, null_count, null_pct."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(q(c).isNull()).alias(c) for c in df.columns])
    long = counts.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).alias("null_count")) for c in df.columns])).alias("x"))
    return long.select("x.column", "x.null_count", F.round(F.try_divide(F.col("x.null_count") * 100.0, F.col("_n")), 2).alias("null_pct"))


def inspect(df: DataFrame) -> DataFrame:
    """INS-01: column, dtype, inferred, missing, missing_pct."""
    p = profile(df, quartiles=False)
    kind = lambda t: "numeric" if isinstance(t, FOUR) else "datetime" if isinstance(t, DATES) else "string"
    return _rows(
        df,
        [(c, p.types[c].simpleString(), kind(p.types[c]), p.nulls[c], round(p.null_pct(c), 1)) for c in p.columns],
        "column string, dtype string, inferred string, missing long, missing_pct double",
    )


def inspection_issues(df: DataFrame) -> DataFrame:
    """INS-02..04: type, column, count, severity, suggestion."""
    p = profile(df)
    out = [
        ("missing_values", c, p.nulls[c], "high", "fill_median" if isinstance(p.types[c], FOUR) else "fill_unknown") for c in p.columns if p.nulls[c]
    ]
    if p.rows > 10:
        plan = Plan(df)
        for c in p.of(FOUR):
            if c in p.quartiles:
                q1, q3 = p.quartiles[c]
                plan.add(c, F.count_if(~q(c).between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))))
        if plan.wanted:
            out += [("outliers", c, n, "medium", "replace_outliers_median") for c, n in plan.run().items() if n]
    ids = [c for c in df.columns if any(w in c.lower() for w in ("id", "code", "sku", "uuid", "pk"))]
    if 0 < len(ids) < len(df.columns):
        n = stats.duplicate_members(df, [c for c in df.columns if c not in ids])
        if n:
            out.append(("partial_duplicates", None, n, "medium", "review"))
    return _rows(df, out, "type string, column string, count long, severity string, suggestion string")


def dataset_info(df: DataFrame) -> dict:
    """INS-06."""
    p = profile(df, quartiles=False)
    return {
        "rows": p.rows,
        "columns": len(p.columns),
        "dtypes": {c: t.simpleString() for c, t in p.types.items()},
        "describe": [r.asDict() for r in stats.describe(df).collect()],
        "missing": {c: round(p.null_pct(c), 2) for c in p.columns if p.nulls[c]},
        "numeric_columns": p.of(T.NumericType),
        "categorical_columns": [c for c in p.columns if not isinstance(p.types[c], T.NumericType)],
        "duplicate_rows": 0,
    }


def row_patterns(df: DataFrame) -> DataFrame:
    """AG-26: complete, partial and fully missing rows over the columns that have nulls; one pass after the null counts."""
    with_nulls = [r["column"] for r in null_profile(df).where("null_count > 0").collect()]
    k = total([q(c).isNull() for c in with_nulls])
    return df.select(k.alias("k")).agg(
        F.count_if(F.col("k") == 0).alias("complete_rows"),
        F.count_if((F.col("k") > 0) & (F.col("k") < len(with_nulls))).alias("partial_rows"),
        F.count_if((F.col("k") == len(with_nulls)) & (F.col("k") > 0)).alias("fully_missing_rows"),
    )


def missing_correlation(df: DataFrame, first: int = 5, threshold: float = 0.2) -> DataFrame:
    """AG-13: missing_column, related_column, r between "a is null" and b, |r| >= threshold; first columns only, as the cost grows with pairs."""
    with_nulls = [r["column"] for r in null_profile(df).where("null_count > 0").collect()][:first]
    others = of_type(df, FOUR)
    plan = Plan(df)
    for a in with_nulls:
        for b in [x for x in others if x != a][:first]:
            plan.add((a, b), stats.pearson(q(a).isNull().cast("double"), q(b)))
    got = plan.run() if plan.wanted else {}
    return _rows(df, [(a, b, r) for (a, b), r in got.items() if r is not None and abs(r) >= threshold], "missing_column string, related_column string, r double")


def missing_patterns(df: DataFrame, prof: Profile | None = None) -> dict:
    """CF-06: severity per column, correlated columns, row patterns, the inferred mechanism."""
    if prof and not any(prof.nulls.values()):  # known without a look at the rows
        return {"has_missing": False, "column_details": {}, "missing_correlations": [], "row_patterns": {"complete_rows": prof.rows, "partial_rows": 0, "fully_missing_rows": 0}, "inferred_pattern": None}
    nulls = {r["column"]: (r["null_count"], r["null_pct"]) for r in null_profile(df).where("null_count > 0").collect()}
    severity = lambda p: "critical" if p > 50 else "high" if p > 20 else "medium" if p > 5 else "low"
    related = [r.asDict() for r in missing_correlation(df).collect()]
    rows = row_patterns(df).first().asDict()
    n = sum(rows.values()) or 1
    inferred = "MAR" if related else "Systematic" if rows["fully_missing_rows"] / n > 0.1 else "MCAR"
    return {
        "has_missing": bool(nulls),
        "column_details": {c: {"count": k, "percentage": p, "severity": severity(p)} for c, (k, p) in nulls.items()},
        "missing_correlations": related,
        "row_patterns": rows,
        "inferred_pattern": inferred if nulls else None,
    }


def drift(before: DataFrame, after: DataFrame, shift: float = 5.0) -> DataFrame:
    """CL-16: change, column, before, after for added and removed columns, type changes and null shifts of `shift` points or more."""
    a, b = profile(before, quartiles=False), profile(after, quartiles=False)
    out = [("added", c, None, b.types[c].simpleString()) for c in b.columns if c not in a.types]
    out += [("removed", c, a.types[c].simpleString(), None) for c in a.columns if c not in b.types]
    for c in a.columns:
        if c in b.types:
            if a.types[c] != b.types[c]:
                out.append(("type_changed", c, a.types[c].simpleString(), b.types[c].simpleString()))
            if abs(b.null_pct(c) - a.null_pct(c)) >= shift:
                out.append(("null_shift", c, f"{a.null_pct(c):.2f}", f"{b.null_pct(c):.2f}"))
    return _rows(before, out, "change string, column string, before string, after string")
