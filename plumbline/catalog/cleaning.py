"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import DIRTY_SQL, REPEATED_SQL, dirty, near, query, repeated, table
from plumbline.catalog.statistics import rounded
from plumbline.functions.cells import NULL_TOKENS, PLACEHOLDERS, clip, json_path, metadata, null_tokens, q, to_number, vector
from plumbline.operators import clean, features
from plumbline.operators.issues import Fix

KEY = ["order_id", "line_no"]
_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)
_PLACES = ", ".join(f"'{t}'" for t in PLACEHOLDERS)


def _token_sql(c: str) -> str:
    t = _STRIP.format(c=c)
    return f"case when lower({t}) in ({_TOKENS}) or {t} = '' then null else {t} end"


@query("null_tokens", f"select order_id, line_no, {_token_sql('status')} as status, {_token_sql('flag')} as flag from {DIRTY_SQL}")
def null_token_query(spark, d):
    return dirty(spark, d).select(*KEY, null_tokens(q("status")).alias("status"), null_tokens(q("flag")).alias("flag"))


@query(
    "currency_coerce",
    rf"""select order_id, line_no, case when regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then cast(t as double) end as amount
    from (select order_id, line_no, regexp_replace(regexp_replace(regexp_replace(amount, '[$,€£₹¥\s]', '', 'g'), '%', '', 'g'), '^\((.*)\)$', '-\1') as t from {DIRTY_SQL})""",
)
def currency_coerce(spark, d):
    return dirty(spark, d).select(*KEY, to_number(q("amount")).alias("amount"))


@query(
    "sanitise_table",
    rf"""select order_id, line_no, quantity, price, {_token_sql('status')} as status,
    case when regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then cast(t as double) end as amount
    from (select *, regexp_replace(regexp_replace(regexp_replace({_token_sql('amount')}, '[$,€£₹¥\s]', '', 'g'), '%', '', 'g'), '^\((.*)\)$', '-\1') as t from {DIRTY_SQL})""",
)
def sanitise_table(spark, d):
    x = dirty(spark, d).selectExpr("order_id as OrderId", "line_no as `Line No`", "quantity", "price", "status", "amount")
    return clean.sanitise(x, sample=None)


@query("clip_values", f"select order_id, line_no, case when age > 120 then 120 when age < 0 then 0 else age end as age from {DIRTY_SQL}")
def clip_values(spark, d):
    return dirty(spark, d).select(*KEY, clip(q("age"), 0, 120).alias("age"))


@query("missing_flag", f"select order_id, line_no, case when quantity is null then 1 else 0 end as quantity_is_missing from {DIRTY_SQL}")
def missing_flag(spark, d):
    return Fix("flag_missing", "quantity").apply(dirty(spark, d)).select(*KEY, q("quantity_is_missing").cast("int").alias("quantity_is_missing"))


@query("drop_null_rows", f"select order_id, line_no, quantity, price from {DIRTY_SQL} where quantity is not null")
def drop_null_rows(spark, d):
    return clean.apply_rules(dirty(spark, d), [clean.Rule("quantity", "drop_rows")]).select(*KEY, "quantity", "price")


for _how, _sql in (("fill_mean", "round(coalesce(quantity, (select avg(quantity) from s)), 6)"), ("fill_median", "coalesce(quantity, (select median(quantity) from s))")):

    def _fill(spark, d, how=_how):
        return rounded(clean.fill(dirty(spark, d), "quantity", how).select(*KEY, "quantity"))

    query(_how, f"with s as {DIRTY_SQL} select order_id, line_no, {_sql} as quantity from s")(_fill)


@query("fill_mode", f"with s as {DIRTY_SQL} select order_id, line_no, coalesce(status, (select status from s where status is not null group by 1 order by count(*) desc, status limit 1)) as status from s")
def fill_mode(spark, d):
    return clean.fill(dirty(spark, d), "status", "fill_mode").select(*KEY, "status")


@query("fill_value", f"select order_id, line_no, coalesce(status, 'none') as status from {DIRTY_SQL}")
def fill_value(spark, d):
    return clean.fill(dirty(spark, d), "status", "fill_value", "none").select(*KEY, "status")


_EVENT_BOUNDS = f"(select {near('value', 0.25)} as q1, {near('value', 0.75)} as q3 from events)"


@query(
    "winsorize",
    f"select event_id, round(case when value > q3 + 1.5 * (q3 - q1) then q3 + 1.5 * (q3 - q1) when value < q1 - 1.5 * (q3 - q1) then q1 - 1.5 * (q3 - q1) else value end, 6) as value from events, {_EVENT_BOUNDS}",
)
def winsorize(spark, d):
    return rounded(clean.winsorize(table(spark, d, "events"), "value").select("event_id", "value"))


@query("dedup_rows", f"select distinct o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from {REPEATED_SQL}")
def dedup_rows(spark, d):
    return Fix("distinct").apply(repeated(spark, d)).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _auto(c: str) -> str:
    return f"case when lower({_STRIP.format(c=c)}) in ({_PLACES}) then null else {c} end"


@query(
    "auto_clean",
    f"""with s as {DIRTY_SQL} select order_id, line_no, coalesce(quantity, (select median(quantity) from s)) as quantity, coalesce(price, (select median(price) from s)) as price,
    coalesce({_auto('status')}, 'Unknown') as status, coalesce({_auto('flag')}, 'Unknown') as flag from s""",
)
def auto_clean(spark, d):
    return clean.auto_clean(dirty(spark, d).select(*KEY, "quantity", "price", "status", "flag")).select(
        q("order_id").cast("long").alias("order_id"), q("line_no").cast("int").alias("line_no"), "quantity", "price", "status", "flag"
    )


@query(
    "clean_pipeline",
    f"""with s as (select distinct order_id, line_no, quantity, status from {DIRTY_SQL} where quantity is not null)
    select order_id, line_no, quantity, coalesce({_auto('status')}, 'Unknown') as status from s""",
)
def clean_pipeline(spark, d):
    x = dirty(spark, d).select("order_id", "line_no", "quantity", "status")
    done, _, _ = clean.clean(x, [clean.Rule("quantity", "drop_rows"), clean.Rule("status", "none")])
    return done.select(q("order_id").cast("long").alias("order_id"), q("line_no").cast("int").alias("line_no"), "quantity", "status")


@query(
    "clean_report",
    f"""with a as {DIRTY_SQL}, b as (select * from a where quantity is not null), c as (select distinct * from b)
    select (select count(*) from b) - (select count(*) from c) as duplicates_removed, (select count(*) from a) - (select count(*) from b) as rows_dropped,
      (select count(*) - count(price) from c) as numeric_filled,
      (select sum(case when {_auto('status')} is null then 1 else 0 end + case when {_auto('flag')} is null then 1 else 0 end + case when {_auto('amount')} is null then 1 else 0 end)::bigint from c) as categorical_filled""",
)
def clean_report(spark, d):
    _, r, _ = clean.clean(dirty(spark, d).drop("email"), [clean.Rule("quantity", "drop_rows")])
    return spark.createDataFrame([(r.duplicates_removed, r.rows_dropped, r.numeric_filled, r.categorical_filled)], "duplicates_removed long, rows_dropped long, numeric_filled long, categorical_filled long")


@query("lineage_audit")
def lineage_audit(spark, d):
    _, _, line = clean.clean(dirty(spark, d), [clean.Rule("quantity", "fill_median"), clean.Rule("price", "replace_outliers_median")])
    return line.audit(spark)


def _compare_sql() -> str:
    before, after = DIRTY_SQL, f"(with s as {DIRTY_SQL} select order_id, line_no, coalesce(quantity, (select median(quantity) from s)) as quantity, price from s)"
    cols = ("order_id", "line_no", "quantity", "price")
    long = lambda src: " union all ".join(
        f"select '{c}' as scope, '{m}' as metric, {e.format(c=c)}::double as v from {src}"
        for c in cols
        for m, e in (("missing_count", "count(*) - count({c})"), ("unique_count", "count(distinct {c}) + max(case when {c} is null then 1 else 0 end)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"))
    )
    pct = "case when a.v = b.v then 0.0 when b.v = 0 then 100.0 else (a.v - b.v) / abs(b.v) * 100 end"
    return f"""with b as ({long(before)}), a as ({long(after)}) select scope, metric, round(b.v, 4) as before, round(a.v, 4) as after, round(a.v - b.v, 4) + 0.0 as delta, round({pct}::double, 4) + 0.0 as pct_change,
      case when metric = 'missing_count' then a.v < b.v end as improved from b join a using (scope, metric)"""


@query("compare_before_after", _compare_sql())
def compare_before_after(spark, d):
    x = dirty(spark, d).select("order_id", "line_no", "quantity", "price")
    raw = x.toDF("Order ID", "Line No", " quantity", "Price ")
    return rounded(clean.compare(raw, clean.fill(x, "quantity", "fill_median")).where("scope <> '*'"), 4)


@query(
    "date_features",
    "select o_orderkey, year(o_orderdate)::int as o_orderdate_year, month(o_orderdate)::int as o_orderdate_month, day(o_orderdate)::int as o_orderdate_day, (isodow(o_orderdate) - 1)::int as o_orderdate_dayofweek, "
    "isodow(o_orderdate) >= 6 as o_orderdate_is_weekend, quarter(o_orderdate)::int as o_orderdate_quarter, hour(o_orderdate)::int as o_orderdate_hour from orders",
)
def date_features(spark, d):
    return features.date_parts(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "text_features",
    f"select order_id, line_no, length(email)::int as email_length, len(string_split(email, ' '))::int as email_word_count, regexp_matches(email, '\\d') as email_has_number, case when contains(email, '@') then regexp_extract(email, '@(.+)', 1) end as email_domain from {DIRTY_SQL}",
)
def text_features(spark, d):
    return features.text_parts(dirty(spark, d).select(*KEY, "email"), "email").drop("email")


@query("number_features", "select o_orderkey, round(ln(o_totalprice + 1), 6) as o_totalprice_log, round(sqrt(o_totalprice), 6) as o_totalprice_sqrt from orders")
def number_features(spark, d):
    return rounded(features.number_parts(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").drop("o_totalprice", "o_totalprice_binned"))


@query("typed_fixes", f"select order_id, line_no, regexp_replace(status, '^\\s+|\\s+$', '', 'g') as status, case when age > 120 then 120 when age < 0 then 0 else age end as age, try_cast(flag as bigint) as flag from {DIRTY_SQL} where regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') or email is null")
def typed_fixes(spark, d):
    x = dirty(spark, d).select(*KEY, "status", "age", "email", "flag")
    for f in (Fix("keep_email", "email"), Fix("strip", "status"), Fix("clip", "age", (0, 120)), Fix("cast", "flag", ("bigint",))):
        x = f.apply(x)
    return x.drop("email")


@query(
    "scaled",
    f"""select l_orderkey, l_linenumber, round((l_quantity - (select avg(l_quantity) from lineitem)) / (select stddev_samp(l_quantity) from lineitem), 6) as l_quantity,
      round((l_extendedprice - (select median(l_extendedprice) from lineitem)) / (select {near('l_extendedprice', 0.75)} - {near('l_extendedprice', 0.25)} from lineitem), 6) as l_extendedprice,
      round((l_discount - (select min(l_discount) from lineitem)) / (select max(l_discount) - min(l_discount) from lineitem), 6) as l_discount from lineitem""",
)
def scaled(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    y = features.scale(x, {"l_quantity": "standard", "l_extendedprice": "robust", "l_discount": "minmax"})
    return y.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice", "l_discount")})


@query(
    "encoded",
    """select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 when 'P' then 2 end as o_orderstatus,
      (select count(distinct p.o_orderpriority) from orders p where p.o_orderpriority < o.o_orderpriority)::int as o_orderpriority from orders o""",
)
def encoded(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return features.encode(x, {"o_orderstatus": "label_or_target", "o_orderpriority": "label_or_target"})


@query("one_hot", "select o_orderkey, (o_orderstatus = 'F')::int as \"o_orderstatus_F\", (o_orderstatus = 'O')::int as \"o_orderstatus_O\", (o_orderstatus = 'P')::int as \"o_orderstatus_P\" from orders")
def one_hot(spark, d):
    return features.encode(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": "one_hot"})


@query("json_cells", "select event_id, json_extract_string(props, '$.k') as value, json_extract_string(props, '$.k') as member from events")
def json_cells(spark, d):
    return table(spark, d, "events").select("event_id", json_path(F.col("props"), "k").alias("value"), metadata(F.col("props"))["k"].alias("member"))


@query("vector_cells", "select l_orderkey, l_linenumber, l_quantity + l_discount as total from lineitem")
def vector_cells(spark, d):
    text = F.concat(F.lit("["), F.col("l_quantity").cast("string"), F.lit(", "), F.col("l_discount").cast("string"), F.lit("]"))
    v = vector(text)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (v[0] + v[1]).alias("total"))
