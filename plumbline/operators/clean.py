"""Cleaning rules, automatic cleaning, lineage and comparison (SAN-*, CL-*)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import FOUR, PLACEHOLDERS, TWO, finite, null_tokens, numeric, q, strings, strip, to_number, undress
from plumbline.functions.cells import NUMBER
from plumbline.functions.names import rename_all, unique_names
from plumbline.operators import stats
from plumbline.plans.aggplan import Distinct, Median, Plan, median, nearest_quantiles


def sanitise(df: DataFrame, share: float = 0.7, sample: int | None = 100, order: str | None = None) -> DataFrame:
    """SAN-01..06: names, null tokens, text that is mostly numbers to double, NaN and infinities to null.

    A text column becomes numeric if `share` of its first `sample` non-nulls (of all, with None) parse; the decision is one
    aggregate per column set. `order` names the column that says which rows are first; without it they are the reader's.
    """
    df = rename_all(df)
    text = strings(df)
    if text:
        seen = df
        numbers = []
        if sample is None:
            plan = Plan(df)
            for c in text:
                plan.add((c, 0), F.count(q(c)))
                plan.add((c, 1), F.count_if(undress(q(c)).rlike(NUMBER)))
            got = plan.run()
            numbers = [c for c in text if got[c, 0] and got[c, 1] / got[c, 0] >= share]
        else:
            for c in text:
                head = seen.where(q(c).isNotNull())
                head = head.orderBy(q(order)).limit(sample) if order else head.limit(sample)
                n, k = head.select(undress(q(c)).rlike(NUMBER).alias("ok")).agg(F.count("ok"), F.count_if("ok")).first()
                if n and k / n >= share:
                    numbers.append(c)
        df = df.select(*[(to_number(null_tokens(q(c))) if c in numbers else null_tokens(q(c)) if c in text else q(c)).alias(c) for c in df.columns])
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.select(*[(finite(q(c)) if c in floats else q(c)).alias(c) for c in df.columns])


# ---- lineage ----------------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """CL-13: one effective step."""

    operation: str
    column: str | None
    parameters: dict
    rows_before: int
    rows_after: int
    columns_before: int
    columns_after: int
    values_changed: int
    reversibility: str
    hash_before: str = ""
    hash_after: str = ""
    parent: int | None = None
    child: int | None = None


REVERSIBLE = {"rename_columns": "full", "drop_duplicates": "none", "drop_rows": "none"}


@dataclass
class Lineage:
    """CL-13, CL-14: the chain of steps."""

    nodes: list[Node] = field(default_factory=list)
    locked: bool = False

    def add(self, node: Node) -> None:
        if self.locked:
            raise RuntimeError("the lineage is locked")
        if self.nodes:
            node.parent = len(self.nodes) - 1
            self.nodes[-1].child = len(self.nodes)
        self.nodes.append(node)

    def chain(self) -> list[dict]:
        return [asdict(n) for n in self.nodes]

    def summary(self) -> dict:
        return {
            "steps": len(self.nodes),
            "rows_removed": sum(n.rows_before - n.rows_after for n in self.nodes),
            "values_changed": sum(n.values_changed for n in self.nodes),
            "fully_reversible": all(n.reversibility == "full" for n in self.nodes),
            "locked": self.locked,
        }

    def lock(self) -> None:
        self.locked = True

    def to_json(self) -> str:
        return json.dumps({"nodes": self.chain(), "locked": self.locked})

    @classmethod
    def from_json(cls, text: str) -> Lineage:
        d = json.loads(text)
        return cls([Node(**n) for n in d["nodes"]], d["locked"])

    def audit(self, spark) -> DataFrame:
        """SNK-05: the chain as rows, to be written as CSV or JSON."""
        rows = [(i, n.operation, n.column, json.dumps(n.parameters), n.rows_before, n.rows_after, n.values_changed, n.reversibility) for i, n in enumerate(self.nodes)]
        return spark.createDataFrame(rows, "step int, operation string, column string, parameters string, rows_before long, rows_after long, values_changed long, reversibility string")


def head_hash(df: DataFrame, order: list[str], rows: int = 100) -> str:
    """16 hex digits over the first rows as CSV, in the given order."""
    head = df.orderBy(*[q(c) for c in order]).limit(rows).select(F.concat_ws(",", *[F.coalesce(q(c).cast("string"), F.lit("")) for c in df.columns])).collect()
    return hashlib.sha256("\n".join([",".join(df.columns), *[r[0] for r in head]]).encode()).hexdigest()[:16]


# ---- rules ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """CL-02..07: action is drop_rows, fill_mean, fill_median, fill_mode, fill_value or replace_outliers_median; others do nothing."""

    column: str
    action: str
    value: object = None


@dataclass
class Report:
    """CL-11."""

    duplicates_removed: int = 0
    rows_dropped: int = 0
    numeric_filled: int = 0
    categorical_filled: int = 0
    outliers_capped: int = 0
    renamed: dict = field(default_factory=dict)

    def total_changes(self) -> int:
        return self.duplicates_removed + self.rows_dropped + self.numeric_filled + self.categorical_filled + self.outliers_capped + len(self.renamed)


def winsorize(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """CL-07: values beyond the quartiles by more than k interquartile ranges move to that bound; the type stays."""
    got = nearest_quantiles(df, [column], (0.25, 0.75))
    if (column, 0.25) not in got:
        return df
    return _capped(df, column, *bounds(got[column, 0.25], got[column, 0.75], k))


def bounds(q1, q3, k: float = 1.5) -> tuple[float, float]:
    q1, q3 = float(q1), float(q3)
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def _capped(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    kind = df.schema[column].dataType
    lit = lambda x: F.lit(x).cast(kind)
    c = q(column)
    return df.withColumn(column, F.when(c > high, lit(high)).when(c < low, lit(low)).otherwise(c))


def fill(df: DataFrame, column: str, how: str, value=None) -> DataFrame:
    """CL-03..06. Means and medians need a numeric column (of the narrow sets), else nothing changes."""
    kind = df.schema[column].dataType
    if how == "fill_value":
        return df if value is None else df.withColumn(column, F.coalesce(q(column), F.lit(value).cast(kind)))
    if how == "fill_mean" and isinstance(kind, TWO):
        value = df.agg(F.mean(q(column))).first()[0]
    elif how == "fill_median" and isinstance(kind, FOUR):
        value = median(df, q(column))
    elif how == "fill_mode":
        row = df.where(q(column).isNotNull()).groupBy(q(column).alias("v")).count().orderBy(F.desc("count"), "v").first()
        value = row["v"] if row else None
        return df if value is None else df.withColumn(column, F.coalesce(q(column), F.lit(value).cast(kind)))
    else:
        return df
    return df if value is None else df.withColumn(column, F.coalesce(q(column).cast("double"), F.lit(float(value))))


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules in order. Unknown actions and columns are passed over (CL-12)."""
    for r in rules:
        if r.column not in df.columns:
            continue
        if r.action == "drop_rows":
            df = df.where(q(r.column).isNotNull())
        elif r.action == "replace_outliers_median":
            if isinstance(df.schema[r.column].dataType, T.NumericType):
                df = winsorize(df, r.column)
        else:
            df = fill(df, r.column, r.action, r.value)
    return df


def looks_like_id(name: str) -> bool:
    """The automatic cleaner's rule: a part of the name, so "width" counts too."""
    return any(w in name.lower() for w in ("id", "code", "sku", "zip", "phone"))


def auto_clean(df: DataFrame) -> DataFrame:
    """CL-09, CL-10: placeholders to null, then "Unknown" in text and the median in numbers, id-like columns aside. One aggregate, one select."""
    plan = Plan(df)
    for c in numeric(df):
        if not looks_like_id(c):
            plan.add(c, Median(q(c)))
    medians = plan.run() if plan.wanted else {}
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(F.lower(strip(c)).isin(*PLACEHOLDERS), None).otherwise(c)
            c = c if looks_like_id(f.name) else F.coalesce(c, F.lit("Unknown"))
        elif medians.get(f.name) is not None:
            c = F.coalesce(c.cast("double"), F.lit(float(medians[f.name])))
        out.append(c.alias(f.name))
    return df.select(*out)


def clean(df: DataFrame, rules: list[Rule] = (), order: list[str] | None = None) -> tuple[DataFrame, Report, Lineage]:
    """CL-01..14: rename, rules, whole-row dedup, automatic filling. Counts of all steps come from one aggregate per step.

    With `order`, lineage nodes carry hashes of the first rows in that order.
    """
    report, line = Report(), Lineage()
    now = rename_all(df)
    report.renamed = dict(zip(df.columns, now.columns))
    state = [None]

    def shape(x: DataFrame) -> tuple[int, dict]:
        got = x.agg(F.count("*").alias("n"), *[F.count_if(q(c).isNull()).alias(f"_{i}") for i, c in enumerate(x.columns)]).first()
        return got["n"], {c: got[f"_{i}"] for i, c in enumerate(x.columns)}

    def note(operation: str, column: str | None, parameters: dict, before: DataFrame, after: DataFrame, changed: int | None = None) -> None:
        a = state[0] or shape(before)
        b = state[0] = shape(after)
        filled = sum(max(0, a[1].get(c, 0) - b[1].get(c, 0)) for c in b[1]) if a[0] == b[0] else 0
        changed = filled if changed is None else changed
        if a[0] == b[0] and not changed and operation != "rename_columns":
            return
        hashes = (head_hash(before, order), head_hash(after, order)) if order and set(order) <= set(after.columns) & set(before.columns) else ("", "")
        line.add(Node(operation, column, parameters, a[0], b[0], len(before.columns), len(after.columns), changed, REVERSIBLE.get(operation, "partial"), *hashes))
        if operation == "drop_duplicates":
            report.duplicates_removed += a[0] - b[0]
        elif operation == "drop_rows":
            report.rows_dropped += a[0] - b[0]

    if df.columns != now.columns:
        note("rename_columns", None, report.renamed, df, now)
    for r in rules:
        if r.column not in now.columns or r.action in (None, "none", "default"):
            continue
        after = apply_rules(now, [r])
        if after is now:
            continue
        changed = None
        if r.action == "replace_outliers_median":
            got = nearest_quantiles(now, [r.column], (0.25, 0.75))
            if (r.column, 0.25) in got:
                low, high = bounds(got[r.column, 0.25], got[r.column, 0.75])
                changed = now.agg(F.count_if((q(r.column) < low) | (q(r.column) > high))).first()[0]
                report.outliers_capped += changed
        note(r.action, r.column, {"value": r.value}, now, after, changed)
        if r.action in ("fill_mean", "fill_median"):
            report.numeric_filled += line.nodes[-1].values_changed if line.nodes and line.nodes[-1].column == r.column else 0
        elif r.action == "fill_mode":
            report.categorical_filled += line.nodes[-1].values_changed if line.nodes and line.nodes[-1].column == r.column else 0
        now = after
    after = now.dropDuplicates()
    note("drop_duplicates", None, {}, now, after)
    now = after
    after = auto_clean(now)
    text = set(strings(now))
    masked = now.select(*[(F.when(F.lower(strip(q(c))).isin(*PLACEHOLDERS), None).otherwise(q(c)) if c in text else q(c)).alias(c) for c in now.columns])
    n0, nulls0 = shape(masked)
    _, nulls1 = shape(after)
    for c in now.columns:
        done = nulls0[c] - nulls1[c]
        if done > 0:
            if c in text:
                report.categorical_filled += done
            else:
                report.numeric_filled += done
            line.add(Node("fill_null_value", c, {"fill_value": "Unknown" if c in text else "median", "nulls_filled": done}, n0, n0, len(now.columns), len(now.columns), done, "partial"))
    return after, report, line


# ---- comparison -------------------------------------------------------------------------------------------------------


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """CL-15: scope, metric, before, after, delta, pct_change, improved: completeness and uniqueness of the tables, then per column missing, unique, mean, std. Two aggregates and two distinct counts.

    The names of `before` are made snake case first, so that a raw table meets its cleaned one; a name that two columns would share goes to the first.
    """
    before = before.toDF(*unique_names(before.columns))

    def facts(df: DataFrame) -> dict:
        plan = Plan(df)
        plan.add("rows", F.count("*"))
        for f in df.schema.fields:
            c = q(f.name)
            plan.add((f.name, "missing_count"), F.count_if(c.isNull()))
            plan.add((f.name, "unique_count"), Distinct(c))
            if isinstance(f.dataType, T.NumericType):
                plan.add((f.name, "mean"), F.mean(c.cast("double")))
                plan.add((f.name, "std"), F.stddev_samp(c.cast("double")))
        got = plan.run()
        for c in df.columns:
            got[c, "unique_count"] += got[c, "missing_count"] > 0  # null is a value
        cells = got["rows"] * len(df.columns)
        got["*", "completeness"] = (1 - sum(got[c, "missing_count"] for c in df.columns) / cells) * 100 if cells else 100.0
        got["*", "uniqueness"] = stats.distinct_rows(df) / got["rows"] * 100 if got["rows"] else 100.0
        return got

    a, b = facts(before), facts(after)
    better = {"missing_count": -1, "completeness": 1, "uniqueness": 1}
    rows = []
    for k in a:
        if k == "rows" or k not in b or a[k] is None or b[k] is None:
            continue
        x, y = float(a[k]), float(b[k])
        pct = 0.0 if x == y else 100.0 if x == 0 else (y - x) / abs(x) * 100
        rows.append((k[0], k[1], x, y, y - x, pct, (y - x) * better[k[1]] > 0 if k[1] in better else None))
    return before.sparkSession.createDataFrame(rows, "scope string, metric string, before double, after double, delta double, pct_change double, improved boolean")
