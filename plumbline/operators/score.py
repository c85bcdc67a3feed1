"""Confidence and readiness scores (CF-01, CF-02, CF-07..14, AG-20, AG-21, AG-32, AG-33)."""

from __future__ import annotations

from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import DATES, FOUR, INTEGERS, is_lower, is_title, is_upper, numeric, of_type, q, strings, strip
from plumbline.functions.names import humanise
from plumbline.operators.profile import Profile, profile
from plumbline.plans.aggplan import Plan
from plumbline.plans.shared import made

# Parts of names that mark identifiers and dates, and the range of spreadsheet day numbers.
ID_NAMES = (
    "_id", "uuid", "guid", "pk", "primary_key", "row_id", "record_id", "retailer_id", "store_id", "customer_id", "user_id", "account_id", "product_id",
    "order_id", "invoice_id", "item_id", "vendor_id", "client_id", "zip_code", "postal_code", "code",
)
DATE_NAMES = ("date", "time", "timestamp", "created_at", "updated_at", "modified_at")
DAY_NUMBERS = (25569, 73050)


def classify(df: DataFrame, prof: Profile | None = None, id_share: float = 0.98) -> DataFrame:
    """CF-01: column, analytical, reasons."""
    p = prof or profile(df, quartiles=False)
    columns, plan = numeric(df), Plan(df)
    for c in columns:
        plan.add(c, F.avg((q(c).cast("double") == F.rint(q(c).cast("double"))).cast("int")))
    whole = plan.run() if columns else {}
    rows = []
    for c in columns:
        m, why = p.moments[c], []
        named = []
        if any(w in c.lower() for w in ID_NAMES):
            named.append("name_suggests_id")
        if any(w in c.lower() for w in DATE_NAMES):
            named.append("name_suggests_date")
        why += named
        unique = p.distinct[c] / p.rows if p.rows else 0
        if unique >= id_share and isinstance(p.types[c], INTEGERS):
            why.append(f"high_uniqueness_{round(unique * 100)}%")
        if m["n"] and DAY_NUMBERS[0] <= m["min"] and m["max"] <= DAY_NUMBERS[1] and whole[c] > 0.9:
            why.append("excel_serial_date_range")
        if m["std"] is not None and m["mean"] and abs(m["std"] / m["mean"]) < 0.01:
            why.append("low_variance")
        rows.append((c, not why, why))
    return made(df.sparkSession, rows, "column string, analytical boolean, reasons array<string>")


def eligible_categories(df: DataFrame, prof: Profile | None = None) -> list[str]:
    """CF-02: neither numeric nor a date by name or type, and not too many values."""
    p = prof or profile(df, quartiles=False)
    return [
        c for c in p.columns
        if not isinstance(p.types[c], (T.NumericType, *DATES)) and not any(w in c.lower() for w in DATE_NAMES) and not (p.rows > 20 and p.distinct[c] / p.rows > 0.85)
    ]


def confidence(df: DataFrame, order: list[str] | None = None, sample: int | None = None, prof: Profile | None = None) -> DataFrame:
    """CF-07..11: column, completeness, consistency, validity, stability, overall, grade, issues.

    Text consistency is judged on all values, in the same single aggregate as the rest, or on each text column's first `sample` in the given order.
    """
    p = prof or profile(df)
    text, four, plan = strings(df), of_type(df, FOUR), Plan(df)
    casing = lambda c: (F.count(c), F.count_if(is_upper(c) | is_lower(c) | is_title(c)), F.count_if((c != "") & (c != strip(c))), F.count_if(c.rlike(r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}")))
    for c in four:
        plan.add((c, "neg"), F.count_if(q(c) < 0))
        plan.add((c, "pos"), F.count_if(q(c) > 0))
        if c in p.quartiles:
            q1, q3 = p.quartiles[c]
            plan.add((c, "far"), F.count_if((q(c) < q1 - 3 * (q3 - q1)) | (q(c) > q3 + 3 * (q3 - q1))))
    if sample is None:
        for c in text:
            for i, a in enumerate(casing(q(c))):
                plan.add((c, i), a)
    got = plan.run() if plan.wanted else {}
    if sample is not None:
        for c in text:
            known = df.where(q(c).isNotNull())
            known = known.orderBy(*[q(o) for o in order]) if order else known
            got |= {(c, i): v for i, v in enumerate(known.select(q(c)).limit(sample).agg(*casing(q(c))).first())}
    top = _top_counts(df, text)
    rows = []
    for c in p.columns:
        kind, n = p.types[c], p.rows - p.nulls[c]
        unique = p.distinct[c] - (p.nulls[c] > 0)
        full = n / p.rows * 100 if p.rows else 0.0
        issues = ["High missing rate"] if full < 50 else ["Moderate missing rate"] if full < 80 else []
        consistency, validity, stability = 100.0, 100.0, 100.0
        if c in text and n:
            k, uniform, spaced, dated = (got[c, i] for i in range(4))
            for bad, minus, what in ((k - uniform > 0.3 * k, 15, "Inconsistent casing"), (spaced > 0.05 * k, 10, "White space"), (0 < dated < 0.9 * k, 20, "Mixed dates")):
                if bad:
                    consistency -= minus
                    issues.append(what)
        elif c in four and n:
            neg, pos = got[c, "neg"], got[c, "pos"]
            if neg and pos and neg / (neg + pos) < 0.05:
                consistency -= 10
                issues.append("Sparse negative values")
        if not n:
            validity = 50.0
            issues.append("No values")
        elif c in four:
            m = p.moments[c]
            q1, q3 = p.quartiles[c]
            far = got[c, "far"] / n if q3 > q1 else 0
            validity -= 25 if far > 0.05 else 10 if far > 0.01 else 0
            validity -= 40 if m["min"] == m["max"] else 0
            if far > 0.01:
                issues.append("Outliers")
            if m["min"] == m["max"]:
                issues.append("All values are identical")
        elif c in text:
            validity -= 30 if unique == 1 else 10 if unique == n and n > 100 else 0
            if unique == 1:
                issues.append("Only one value")
            elif unique == n and n > 100:
                issues.append("All values unique")
        if n < 2:
            stability = 50.0
        elif c in four:
            m = p.moments[c]
            if m["mean"]:
                cv = abs(m["std"] / m["mean"])
                stability = 20.0 if cv < 0.001 else 50.0 if cv < 0.01 else 70.0 if cv > 10 else 100.0
            elif m["std"] == 0:
                stability = 10.0
        elif c in text:
            share = top[c] / n
            stability = 30.0 if share > 0.95 else 60.0 if share > 0.8 else 100.0
        overall = 0.35 * full + 0.25 * consistency + 0.25 * validity + 0.15 * stability
        grade = "A" if overall >= 90 else "B" if overall >= 75 else "C" if overall >= 60 else "D" if overall >= 40 else "F"
        rows.append((c, full, consistency, validity, stability, overall, grade, issues))
    return made(df.sparkSession, rows, "column string, completeness double, consistency double, validity double, stability double, overall double, grade string, issues array<string>")


def _top_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Count of each text column's most frequent known value, one job."""
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), q(c).alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    got = {r[0]: r[1] for r in long.groupBy("c", "v").count().groupBy("c").agg(F.max("count")).collect()}
    return {c: got.get(c, 0) for c in columns}


def dataset_confidence(scores: DataFrame) -> DataFrame:
    """AG-32."""
    return scores.agg(
        F.round(F.avg("overall"), 6).alias("dataset_confidence"), F.count_if(F.col("overall") >= 75).alias("high_confidence"), F.count_if(F.col("overall") < 50).alias("low_confidence")
    )


def class_imbalance(df: DataFrame, prof: Profile | None = None) -> DataFrame:
    """AG-20: column, classes, share of the largest, penalty, for text columns of 2 to 10 known values."""
    p = prof or profile(df, quartiles=False)
    columns = [c for c in strings(df) if 2 <= p.distinct[c] - (p.nulls[c] > 0) <= 10]
    top = _top_counts(df, columns)
    rows = []
    for c in columns:
        share = top[c] / (p.rows - p.nulls[c])
        rows.append((c, p.distinct[c] - (p.nulls[c] > 0), share, 20.0 if share > 0.95 else 10.0 if share > 0.85 else 0.0))
    return made(df.sparkSession, rows, "column string, classes long, share double, penalty double")


def readiness(df: DataFrame, scores: DataFrame | None = None, prof: Profile | None = None) -> dict:
    """CF-12: score, status, reasons, column_context."""
    p = prof or profile(df)
    columns = p.columns
    if not columns or not p.rows:
        return {"score": 0.0, "status": "Not Ready", "reasons": ["Empty dataset"], "column_context": "0 of 0 columns have issues"}
    worst = [c for c in columns if p.null_pct(c) > 70]
    if worst:
        return {
            "score": 0.0, "status": "Not Ready", "reasons": [f"Column '{c}' has {p.null_pct(c):.1f}% missing values" for c in worst],
            "column_context": f"{len(worst)} of {len(columns)} columns have issues",
        }
    found = {r["column"]: r for r in (scores if scores is not None else confidence(df, prof=p)).collect()}
    plan = Plan(df)
    for c in numeric(df):
        plan.add(c, F.var_samp(q(c).cast("double")))
    var = plan.run() if plan.wanted else {}
    reasons, flagged = [], set()

    def flag(some: list[str], what: str) -> int:
        reasons.extend(f"Column '{c}' {what}" for c in some)
        flagged.update(some)
        return len(some)

    base = median(100.0 - p.null_pct(c) for c in columns)
    base = max(0.0, base - 15 * flag([c for c in columns if 50 < p.null_pct(c) <= 70], "has a high missing rate"))
    known = lambda c: p.rows - p.nulls[c]
    dull = [c for c in columns if known(c) < 2 or p.distinct[c] - (p.nulls[c] > 0) == 1 or (var.get(c) is not None and var[c] < 1e-5)]
    k = len(columns)
    score = base - min(25.0, k * 0.4 * 5, 5.0 * flag(dull, "is constant or nearly so"))
    score -= min(15.0, k * 0.3 * 3, 3.0 * flag([c for c in columns if c in found and found[c]["consistency"] < 80], "has format issues"))
    score -= min(15.0, k * 0.3 * 3, 3.0 * flag([c for c in columns if c in found and found[c]["validity"] < 80], "has invalid values"))
    skewed = class_imbalance(df, p).collect()
    flag([r["column"] for r in skewed if r["penalty"]], "is imbalanced")
    score -= min(30.0, len(skewed) * 0.5 * 10, sum(r["penalty"] for r in skewed))
    score = round(max(0.0, min(100.0, score)), 1)
    status = "Ready" if score >= 90 else "Needs Cleaning" if score >= 65 else "Not Ready"
    return {"score": score, "status": status, "reasons": reasons, "column_context": f"{len(flagged)} of {k} columns have issues"}


def decisions(df: DataFrame, prof: Profile | None = None) -> DataFrame:
    """CF-13: analysis, decision (ran, skipped, partial), reason."""
    p = prof or profile(df, quartiles=False)
    nums, dates = of_type(df, FOUR), of_type(df, DATES)
    cats = [c for c in df.columns if c not in nums]
    small = [c for c in cats if p.distinct[c] <= 50]
    nulls = [c for c in df.columns if p.nulls[c]]
    pick = lambda ok, yes, no: ("ran", yes) if ok else ("skipped", no)
    rows = [
        ("correlation", *pick(len(nums) >= 2, f"{len(nums)} numeric columns", "needs 2 numeric columns")),
        ("distribution", *pick(nums, f"{min(len(nums), 10)} numeric columns", "no numeric columns")),
        ("categorical", *(("ran", f"{len(small)} columns") if small else ("partial", "high cardinality") if cats else ("skipped", "no categorical columns"))),
        ("time_series", *pick(dates, f"{len(dates)} date columns", "no date columns")),
        ("outliers", *pick(nums, f"{len(nums)} numeric columns", "no numeric columns")),
        ("multicollinearity", *pick(len(nums) >= 3 and p.rows >= 10, f"{len(nums)} numeric columns", "needs 3 numeric columns and 10 rows")),
        ("shape", *pick(nums and p.rows >= 20, f"{p.rows} rows", "needs numeric columns and 20 rows")),
        ("missing_patterns", *pick(nulls, f"{len(nulls)} columns with nulls", "no nulls")),
    ]
    if df.columns:
        rows.append(("feature_engineering", "ran", f"{len(nums)} numeric and {len(cats)} other columns"))
    rows.append(("smart_schema", "ran", f"{len(df.columns)} columns"))
    return made(df.sparkSession, rows, "analysis string, decision string, reason string")


def rank_insights(result: dict) -> list[dict]:
    """CF-14: findings by score, highest first. A trend's score uses its r squared as strength; flat trends are left out."""
    out = []
    for r in result.get("strong_correlations", []):
        a, b = humanise(r["column_a"]), humanise(r["column_b"])
        out.append({"type": "correlation", "variable": f"{r['column_a']} & {r['column_b']}", "score": abs(r["r_value"]), "title": f"{a} & {b} move together" if r["r_value"] > 0 else f"{a} vs {b} trade-off"})
    missing = result.get("missing_patterns") or {}
    if missing.get("has_missing"):
        for c, d in missing["column_details"].items():
            x = d["percentage"]
            out.append({"type": "data_quality", "variable": c, "score": 0.95 if x > 99 else 0.85 if x > 50 else 0.7 if x > 20 else 0.4, "title": f"Missing data in {humanise(c)}"})
        if missing.get("inferred_pattern") == "MAR":
            out.append({"type": "missing_pattern", "variable": "Dataset", "score": 0.88, "title": "Values are missing systematically"})
    for c, d in (result.get("outliers") or {}).items():
        x = d["percentage"]
        out.append({"type": "outlier", "variable": c, "score": 0.8 if 0.1 < x < 5 else 0.6 if x >= 5 else 0.5, "title": f"Unusual values in {humanise(c)}"})
    for c, d in (result.get("trends") or {}).items():
        if d.get("detected") and d["direction"] != "flat":
            out.append({"type": "trend", "variable": c, "score": 0.75 + 0.2 * d["r_squared"], "title": f"{humanise(c)} goes {d['direction']}"})
    return sorted(out, key=lambda x: -x["score"])
