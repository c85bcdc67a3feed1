"""Quality queries: detectors, scores, outliers."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from plumbline.catalog.base import DIRTY_SQL, REPEATED_SQL, dirty, near, query, repeated, table
from plumbline.catalog.statistics import rounded
from plumbline.functions.cells import MASKED_NUMBERS, MASKED_TEXT, q, strings, strip
from plumbline.operators import history, issues, neighbours, outliers, profile, score, stats
from plumbline.plans.shared import shared_folder
from plumbline.plans.shared import settled

_MASKED = ", ".join(f"'{x}'" for x in MASKED_TEXT)
_S = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query(
    "masked_nulls",
    "select * from ("
    + " union all ".join(f"select '{c}' as \"column\", count(*) filter (where lower({_S.format(c=c)}) in ({_MASKED})) as masked from {DIRTY_SQL}" for c in ("status", "amount", "email", "flag"))
    + " union all "
    + " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {c} in ({', '.join(map(str, MASKED_NUMBERS))})) as masked from {DIRTY_SQL}" for c in ("order_id", "line_no", "age", "quantity", "price", "discount_rate"))
    + ") where masked > 0",
)
def masked_nulls(spark, d):
    return issues.detect(dirty(spark, d)).rows(spark).where("fix = 'null_out'").select("column", F.col("affected_rows").alias("masked"))


_CASED = ("status", "flag")


@query(
    "whitespace_case",
    "select * from ("
    + " union all ".join(f"select '{c}' as \"column\", 'strip' as fix, count(*) filter (where {c} <> {_S.format(c=c)}) as affected_rows from {DIRTY_SQL}" for c in _CASED)
    + " union all "
    + " union all ".join(f"select '{c}' as \"column\", 'title_case' as fix, case when count(distinct {c}) > count(distinct lower({c})) and count(distinct {c}) <= 100 then count(*) else 0 end as affected_rows from {DIRTY_SQL}" for c in _CASED)
    + ") where affected_rows > 0",
)
def whitespace_case(spark, d):
    x = dirty(spark, d).select("order_id", *_CASED)
    return issues.detect(x).rows(spark).where("fix in ('strip', 'title_case')").select("column", "fix", "affected_rows")


def _ledger_of(df, kind: str, **options):
    return issues.detect(df, **options).rows(df.sparkSession).where(F.col("issue_type") == kind).select("column", "affected_rows", "severity")


@query("email_rule", f"select 'email' as \"column\", count(*) filter (where not regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) as affected_rows, 'high' as severity from {DIRTY_SQL}")
def email_rule(spark, d):
    return _ledger_of(dirty(spark, d).select("order_id", "email"), "format_issue").where("column = 'email'")


@query("age_rule", f"select 'age' as \"column\", count(*) filter (where age < 0 or age > 120) as affected_rows, 'high' as severity from {DIRTY_SQL}")
def age_rule(spark, d):
    x = dirty(spark, d).select("order_id", "age")
    return issues.detect(x).rows(spark).where("description like '%ages outside%'").select("column", "affected_rows", "severity")


_NOW = datetime(1999, 1, 1)


@query("future_dates", "select 'o_orderdate' as \"column\", count(*) filter (where o_orderdate > timestamp '1999-01-01') as affected_rows, 'high' as severity from orders")
def future_dates(spark, d):
    return _ledger_of(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "format_issue", now=_NOW)


@query("chronology", "select 'l_shipdate' as \"column\", count(*) filter (where l_shipdate < o_orderdate) as affected_rows, 'high' as severity from orders join lineitem on o_orderkey = l_orderkey")
def chronology(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderdate", "l_shipdate", "l_quantity")
    x = settled(x, "joined")  # the rules read it a dozen times, the join runs once
    return _ledger_of(x, "format_issue", now=datetime(2100, 1, 1))


_HEADERS = "(select case when o_orderkey % 50 = 0 then 'Status' when o_orderkey % 50 = 1 then ' Total' else o_orderstatus end as status, o_totalprice from orders)"


@query(
    "mid_headers",
    f"select 'drop_headers' as fix, count(*) filter (where lower({_S.format(c='status')}) = 'status') as affected_rows from {_HEADERS} union all "
    f"select 'drop_summaries' as fix, count(*) filter (where lower({_S.format(c='status')}) in ({', '.join(repr(w) for w in issues.SUMMARY_WORDS)})) as affected_rows from {_HEADERS}",
)
def mid_headers(spark, d):
    x = spark.sql("select case when o_orderkey % 50 = 0 then 'Status' when o_orderkey % 50 = 1 then ' Total' else o_orderstatus end as status, o_totalprice from {t}", t=table(spark, d, "orders"))
    return issues.detect(x).rows(spark).where("fix in ('drop_headers', 'drop_summaries')").select("fix", "affected_rows")


@query("dup_rows", f"select (select count(*) from {REPEATED_SQL}) - (select count(*) from (select distinct * from {REPEATED_SQL})) as affected_rows")
def dup_rows(spark, d):
    return issues.detect(repeated(spark, d)).rows(spark).where("fix = 'distinct'").select("affected_rows")


_BANDS = "o_custkey % 20 as customer, o_orderstatus as status, o_orderpriority as priority, cast(floor(o_totalprice / 100000) as int) as band, year(o_orderdate) as ordered, o_orderkey as number"


@query("near_dup", f"select count(*) - (select count(*) from (select distinct customer, status, priority, band, ordered from (select {_BANDS} from orders))) as affected_rows from orders")
def near_dup(spark, d):
    """Rows that repeat but for the column with the most values: the five with the fewest are looked at."""
    x = spark.sql(f"select {_BANDS} from {{t}}", t=table(spark, d, "orders"))
    return issues.detect(x).rows(spark).where("description like '%near-duplicate rows%'").select("affected_rows")


@query(
    "pk_collision",
    f"select (select coalesce(sum(n), 0)::bigint from (select count(*) as n from {REPEATED_SQL} group by o_orderkey having count(*) > 1)) - (select count(*) from {REPEATED_SQL}) + (select count(*) from (select distinct o_orderkey, o_custkey from {REPEATED_SQL})) as conflicts",
)
def pk_collision(spark, d):
    """Members of groups with one key, less the exact duplicate rows."""
    x = repeated(spark, d).select(F.col("o_orderkey").alias("order_id"), "o_custkey")
    return issues.detect(x).rows(spark).where("fix = 'keep_first'").select(F.col("affected_rows").alias("conflicts"))


@query("missing_issues", "select * from (" + " union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as affected_rows, case when (count(*) - count({c})) * 100.0 / count(*) >= 30 then 'critical' when (count(*) - count({c})) * 100.0 / count(*) >= 15 then 'high' when (count(*) - count({c})) * 100.0 / count(*) >= 5 then 'medium' else 'low' end as severity, (count(*) - count({c})) * 100.0 / count(*) as pct from {DIRTY_SQL}"
    for c in ("quantity", "price", "status")) + ") where pct >= 1")
def missing_issues(spark, d):
    x = dirty(spark, d).select("order_id", "quantity", "price", "status")
    n = x.count()
    out = issues.detect(x).rows(spark).where("issue_type = 'missing_values' and fix in ('fill_median', 'fill_mode')")
    return out.select("column", "affected_rows", "severity", (F.col("affected_rows") * 100.0 / n).cast("double").alias("pct"))


_NAMED = "concat('c', cast(o_custkey as string)) as buyer, concat('o', cast(o_orderkey as string)) as label, o_orderstatus as status"


@query("high_cardinality", " union all ".join(f"select '{c}' as \"column\", count(*) as affected_rows, count(distinct {c}) || ' distinct values' as description from (select {_NAMED} from orders) having count(distinct {c}) > 100 and count(distinct {c}) > 0.5 * count(*)" for c in ("buyer", "label", "status")))
def high_cardinality(spark, d):
    x = spark.sql(f"select {_NAMED} from {{t}}", t=table(spark, d, "orders"))
    return issues.detect(x).rows(spark).where("issue_type = 'high_cardinality'").select("column", "affected_rows", "description")


@query("issue_ledger")
def issue_ledger(spark, d):
    return issues.detect(dirty(spark, d), order=["order_id", "line_no", "quantity"], now=datetime(2100, 1, 1)).rows(spark)


@query("remediated", None)
def remediated(spark, d):
    x = dirty(spark, d)
    ledger = issues.detect(x)
    ledger.approve_all()
    return ledger.remediate(x, ["order_id", "line_no"])


@query("inspection_issues")
def inspection_issues(spark, d):
    return profile.inspection_issues(dirty(spark, d))


@query(
    "inspect_columns",
    " union all ".join(
        f"select '{c}' as \"column\", '{t}' as dtype, '{i}' as inferred, count(*) - count({c}) as missing, round((count(*) - count({c})) * 100.0::double / count(*), 1) as missing_pct from {DIRTY_SQL}"
        for c, t, i in (("order_id", "bigint", "numeric"), ("quantity", "double", "numeric"), ("price", "double", "numeric"), ("status", "string", "string"), ("flag", "string", "string"))
    ),
)
def inspect_columns(spark, d):
    return profile.inspect(dirty(spark, d).select("order_id", "quantity", "price", "status", "flag"))


@query(
    "schema_drift",
    f"""with x as (select order_id, quantity, discount_rate from {DIRTY_SQL}), p as (select 100.0 * (count(*) - count(quantity)) / count(*) as a, 100.0 * count(*) filter (where order_id % 2 = 0 or quantity is null) / count(*) as b from x)
    select 'added' as change, 'region' as "column", null as before, 'string' as after union all select 'removed', 'discount_rate', 'double', null union all select 'type_changed', 'order_id', 'bigint', 'string'
    union all select 'null_shift', 'quantity', printf('%.2f', a), printf('%.2f', b) from p where abs(b - a) >= 5""",
)
def schema_drift(spark, d):
    x = dirty(spark, d).select("order_id", "quantity", "discount_rate")
    y = x.selectExpr("cast(order_id as string) as order_id", "if(order_id % 2 = 0, null, quantity) as quantity", "'x' as region")
    return profile.drift(x, y)


# ---- scores -----------------------------------------------------------------------------------------------------------


def _confidence_sql() -> str:
    def one(c: str) -> str:
        return f"""select '{c}' as "column", count({c}) * 100.0::double / count(*) as completeness,
          case when count(*) filter (where {c} < 0) > 0 and count(*) filter (where {c} > 0) > 0 and count(*) filter (where {c} < 0) < 0.05 * count(*) filter (where {c} <> 0) then 90.0 else 100.0 end::double as consistency,
          (100 - case when max(q3) > max(q1) and count(*) filter (where {c} < q1 - 3 * (q3 - q1) or {c} > q3 + 3 * (q3 - q1)) > 0.05 * count({c}) then 25 when max(q3) > max(q1) and count(*) filter (where {c} < q1 - 3 * (q3 - q1) or {c} > q3 + 3 * (q3 - q1)) > 0.01 * count({c}) then 10 else 0 end
             - case when min({c}) = max({c}) then 40 else 0 end)::double as validity,
          case when avg({c}) <> 0 then case when abs(stddev_samp({c}) / avg({c})) < 0.001 then 20 when abs(stddev_samp({c}) / avg({c})) < 0.01 then 50 when abs(stddev_samp({c}) / avg({c})) > 10 then 70 else 100 end when stddev_samp({c}) = 0 then 10 else 100 end::double as stability,
          case when max(q3) > max(q1) and count(*) filter (where {c} < q1 - 3 * (q3 - q1) or {c} > q3 + 3 * (q3 - q1)) > 0.01 * count({c}) then 1 else 0 end as far, count(*) filter (where {c} < 0) as neg, count(*) filter (where {c} > 0) as pos, min({c}) = max({c}) as same
          from (select {c} from {DIRTY_SQL}), (select {near(c, 0.25)} as q1, {near(c, 0.75)} as q3 from {DIRTY_SQL})"""

    rows = " union all ".join(one(c) for c in ("quantity", "price", "discount_rate", "age"))
    overall = "0.35 * completeness + 0.25 * consistency + 0.25 * validity + 0.15 * stability"
    found = """concat_ws(', ', case when completeness < 50 then 'High missing rate' when completeness < 80 then 'Moderate missing rate' end, case when neg > 0 and pos > 0 and neg < 0.05 * (neg + pos) then 'Sparse negative values' end,
      case when far = 1 then 'Outliers' end, case when same then 'All values are identical' end)"""
    return f"""select "column", round(completeness, 6) as completeness, consistency, validity, stability, round({overall}, 6) as overall,
      case when {overall} >= 90 then 'A' when {overall} >= 75 then 'B' when {overall} >= 60 then 'C' when {overall} >= 40 then 'D' else 'F' end as grade, {found} as issues from ({rows})"""


@query("confidence", _confidence_sql())
def confidence(spark, d):
    x = score.confidence(dirty(spark, d).select("quantity", "price", "discount_rate", "age"))
    return rounded(x.withColumn("issues", F.array_join("issues", ", ")))


@query("dataset_confidence")
def dataset_confidence(spark, d):
    return score.dataset_confidence(score.confidence(dirty(spark, d), sample=None))


@query("readiness")
def readiness(spark, d):
    r = score.readiness(dirty(spark, d))
    return spark.createDataFrame([(r["score"], r["status"], r["column_context"])], "score double, status string, column_context string")


@query(
    "class_imbalance",
    f"""select c as "column", count(*) as classes, round(max(n)::double / sum(n), 6) as share, case when max(n)::double / sum(n) > 0.95 then 20.0 when max(n)::double / sum(n) > 0.85 then 10.0 else 0.0 end::double as penalty
    from (select 'status' as c, status as v, count(*) as n from {DIRTY_SQL} where status is not null group by 2 union all select 'flag', flag, count(*) from {DIRTY_SQL} where flag is not null group by 2) group by c having count(*) between 2 and 10""",
)
def class_imbalance(spark, d):
    return rounded(score.class_imbalance(dirty(spark, d).select("status", "flag")))


@query("classify_numeric", "select 'l_orderkey' as \"column\", true as analytical union all select 'l_quantity', true union all select 'l_extendedprice', true union all select 'l_discount', true union all select 'vendor_id', false union all select 'constant', false union all select 'serial', false")
def classify_numeric(spark, d):
    x = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_suppkey as vendor_id", "cast(7 as double) as constant", "cast(30000 + l_linenumber as int) as serial")
    return score.classify(x).select("column", "analytical")


@query("decisions")
def decisions(spark, d):
    return score.decisions(dirty(spark, d))


# ---- outliers ---------------------------------------------------------------------------------------------------------


def _outside_sql(c: str, src: str, k: float) -> str:
    return f"""select '{c}' as "column", round(lo, 6) as lower, round(hi, 6) as upper, count(*) filter (where {c} < lo or {c} > hi) as count, round(count(*) filter (where {c} < lo or {c} > hi) * 100.0::double / count(*), 2) as pct,
      round(min({c}) filter (where {c} < lo or {c} > hi), 6) as min_outlier, round(max({c}) filter (where {c} < lo or {c} > hi), 6) as max_outlier
      from {src}, (select q1 - {k} * (q3 - q1) as lo, q3 + {k} * (q3 - q1) as hi from (select {near(c, 0.25)} as q1, {near(c, 0.75)} as q3 from {src})) group by lo, hi"""


@query("iqr_outliers", _outside_sql("value", "events", 1.5))
def iqr_outliers(spark, d):
    return rounded(outliers.count_outside(table(spark, d, "events"), ["value"]))


@query("severe_outliers", _outside_sql("value", "events", 3.0))
def severe_outliers(spark, d):
    return rounded(outliers.count_outside(table(spark, d, "events"), ["value"], 3.0))


@query("mad_outliers", "with m as (select median(value) as md from events), s as (select median(abs(value - md)) as mad from events, m) select round(md, 6) as median, round(mad, 6) as mad, count(*) filter (where 0.6745 * abs(value - md) / mad > 3.5) as count from events, m, s group by md, mad")
def mad_outliers(spark, d):
    return rounded(outliers.mad(table(spark, d, "events"), "value"))


@query("log_iqr", f"with l as (select ln(value + 1) as x from events), b as (select q3 + 1.5 * (q3 - q1) as hi from (select {near('x', 0.25)} as q1, {near('x', 0.75)} as q3 from l)) select round(hi, 6) as upper, count(*) filter (where x > hi) as count from l, b group by hi")
def log_iqr(spark, d):
    return rounded(outliers.log_bound(table(spark, d, "events"), "value"))


@query("max_z", "select round(greatest(max(value) - avg(value), avg(value) - min(value)) / stddev_samp(value), 6) as max_z from events")
def max_z(spark, d):
    return rounded(outliers.max_z(table(spark, d, "events"), "value"))


@query("domain_anomalies", "select 'amount' as \"column\", count(*) filter (where c_acctbal < 0) as negative from customer")
def domain_anomalies(spark, d):
    x = outliers.report(table(spark, d, "customer").select(F.col("c_acctbal").alias("amount")))
    n = F.regexp_extract(F.element_at("domain_anomalies", 1), r"^(\d+)", 1).cast("long")
    return x.select("column", n.alias("negative")).union(spark.createDataFrame([("amount", 0)], "column string, negative long")).groupBy("column").agg(F.max("negative").alias("negative"))


@query("outlier_report")
def outlier_report(spark, d):
    return outliers.report(table(spark, d, "events"), ["value"])


_LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _numbered_lines(spark, d):
    return table(spark, d, "lineitem").withColumn("row", F.expr("l_orderkey * 10 + l_linenumber"))


@query("multivariate")
def multivariate(spark, d):
    return outliers.multivariate(_numbered_lines(spark, d), "row", _LINE_MEASURES)


_LOF = """with x as materialized (select c_custkey as id, coalesce(cast(c_acctbal as double), 0) as a, coalesce(cast(c_nationkey as double), 0) as b from customer),
  near as materialized (select * from (select x.id, y.id as o, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) as d, row_number() over (partition by x.id order by sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)), y.a, y.b, y.id) as r from x join x y on x.id <> y.id) where r <= 15),
  reach as (select id as o, max(d) as kd from near group by 1), density as materialized (select id, 1 / (avg(greatest(kd, d)) + 1e-10) as dens from near join reach using (o) group by 1)"""


@query("local_outliers", f"{_LOF} select near.id, round(avg(o.dens) / any_value(i.dens), 4) as lof from near join density o on o.id = near.o join density i on i.id = near.id group by near.id")
def local_outliers(spark, d):
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey")
    columns = ["c_acctbal", "c_nationkey"]
    found = neighbours.local_outlier_factors(x, columns)
    return x.withColumn("p", neighbours.point(columns)).join(found, "p").select("id", F.round("lof", 4).alias("lof"))


@query("multivariate_summary")
def multivariate_summary(spark, d):
    return outliers.multivariate_summary(outliers.multivariate_points(_numbered_lines(spark, d), "row", _LINE_MEASURES), _LINE_MEASURES, "w")


@query("text_columns", " union all ".join(f"select '{c}' as \"column\", count({c}) as known from {DIRTY_SQL}" for c in ("status", "amount", "email", "flag")))
def text_columns(spark, d):
    x = dirty(spark, d)
    counts = x.agg(*[F.count(q(c)).alias(c) for c in strings(x)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("known")) for c in strings(x)])).alias("x")).select("x.*")


@query("dataset_fingerprint")
def dataset_fingerprint(spark, d):
    return spark.createDataFrame([(issues.fingerprint(table(spark, d, "orders")),)], "fingerprint string")


# ---- versions ---------------------------------------------------------------------------------------------------------

_KEPT = ("order_id", "quantity", "price", "discount_rate")


def _history(spark, d):
    """The dirty rows by line number, a version each."""
    x = dirty(spark, d)
    base = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    x.select(*_KEPT, "flag", "line_no").write.partitionBy("line_no").parquet(f"{base}/rows")
    kept = history.History(spark, f"{base}/states")
    for r in spark.read.parquet(f"{base}/rows").select("line_no").distinct().orderBy("line_no").collect():
        # Each version is read by itself, as a day that is appended would be.
        kept.add(spark.read.parquet(f"{base}/rows/line_no={r[0]}"), r[0])
    return kept


@query(
    "profile_history",
    " union all ".join(
        f"""select '{c}' as "column", count(*) as "rows", count(*) - count({c}) as nulls, round(avg({c}), 4) as mean, round(stddev_samp({c}), 3) as std, min(cast({c} as double)) as min, max(cast({c} as double)) as max, true as near from {DIRTY_SQL}"""
        for c in _KEPT
    ),
)
def profile_history(spark, d):
    """The profile of all versions together, from their states; near: whether the distinct count lies within a tenth of the exact one."""
    x = _history(spark, d).profile().where(F.col("column").isin(*_KEPT))
    rows = dirty(spark, d)
    exact = stats.distinct_counts(rows, list(_KEPT), null_counts=False)
    close = F.lit(False)
    for c in _KEPT:
        close = close | ((F.col("column") == c) & (F.abs(F.col("distinct") - exact[c]) <= F.lit(1 + 0.1 * exact[c])))
    return x.select("column", "rows", "nulls", F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std"), "min", "max", close.alias("near"))


@query(
    "version_trend",
    f"""with v as (select line_no as version, count(*) as n, {', '.join(f'(count(*) - count({c})) * 100.0 / count(*) as {c}' for c in (*_KEPT, 'flag'))} from {DIRTY_SQL} group by 1)
    select a.version, 'rows' as change, null as "column", b.n::varchar as before, a.n::varchar as after from v a join v b on a.version = b.version + 1 union all """
    + " union all ".join(f"select a.version, 'null_shift', '{c}', printf('%.2f', b.{c}), printf('%.2f', a.{c}) from v a join v b on a.version = b.version + 1 where abs(round(a.{c} - b.{c}, 2)) >= 5" for c in (*_KEPT, "flag")),
)
def version_trend(spark, d):
    return _history(spark, d).trend().select("version", "change", "column", "before", "after")
