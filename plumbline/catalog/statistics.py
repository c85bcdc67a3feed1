"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalog.base import DIRTY_SQL, dirty, near, query, table
from plumbline.operators import charts, profile, stats
from plumbline.plans.aggplan import Plan
from plumbline.functions.cells import q

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(q(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else q(f.name) for f in df.schema.fields])


def _summary_sql(c: str, src: str) -> str:
    return f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min, round(max({c}), 4) as max,
      round(median({c}), 4) as median, round({near(c, 0.25)}, 4) as q1, round({near(c, 0.75)}, 4) as q3,
      round(avg(pow({c} - mu, 3)) / pow(var_pop({c}), 1.5), 4) as skewness, round(kurtosis_pop({c}), 4) as kurtosis
      from (select cast({c} as double) as {c}, avg({c}) over () as mu from {src})"""


@query("summary_stats", " union all ".join(_summary_sql(c, "lineitem") for c in MEASURES))
def summary_stats(spark, d):
    return rounded(stats.summary(table(spark, d, "lineitem"), MEASURES), 4)


@query(
    "describe_table",
    " union all ".join(
        f"""select '{c}' as "column", count({c}) as count, count(*) - count({c}) as null_count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min,
        round({near(c, 0.25)}, 6) as p25, round({near(c, 0.5)}, 6) as p50, round({near(c, 0.75)}, 6) as p75, round(max({c}), 6) as max from {DIRTY_SQL}"""
        for c in ("quantity", "price")
    ),
)
def describe_table(spark, d):
    return rounded(stats.describe(dirty(spark, d), ["quantity", "price"]))


@query(
    "nearest_quantiles",
    " union all ".join(f"select 'o_totalprice' as \"column\", cast({x} as double) as q, {near('o_totalprice', x)} as value from orders" for x in (0.05, 0.25, 0.5, 0.75, 0.95)),
)
def nearest_quantiles(spark, d):
    return stats.quantile_table(table(spark, d, "orders"), ["o_totalprice"], (0.05, 0.25, 0.5, 0.75, 0.95))


DIRTY_COLUMNS = ["order_id", "line_no", "quantity", "price", "discount_rate", "status", "amount", "email", "age", "flag"]


@query(
    "null_profile",
    " union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as null_count, round((count(*) - count({c})) * 100.0 / count(*), 2)::double as null_pct from {DIRTY_SQL}" for c in DIRTY_COLUMNS),
)
def null_profile(spark, d):
    df = profile.null_profile(dirty(spark, d))
    return df.withColumn("null_pct", F.col("null_pct").cast("double"))


@query(
    "schema_profile",
    " union all ".join(
        f"select '{c}' as \"column\", '{t}' as dtype, count(*) - count({c}) as null_count, round((count(*) - count({c})) * 100.0::double / count(*), 2) as null_percentage, "
        f"count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as unique_count, count(*) as row_count from {DIRTY_SQL}"
        for c, t in zip(DIRTY_COLUMNS, ["bigint", "int", "double", "double", "double", "string", "string", "string", "int", "string"])
    ),
)
def schema_profile(spark, d):
    return profile.schema_profile(dirty(spark, d))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("distinct_profile", " union all ".join(f"select '{c}' as \"column\", count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as n_unique from orders" for c in ORDER_COLUMNS))
def distinct_profile(spark, d):
    return spark.createDataFrame(list(stats.distinct_counts(table(spark, d, "orders")).items()), "column string, n_unique long")


@query("value_counts_topk", "select event_type as value, count(*) as count from events group by 1 order by count desc, value limit 10")
def value_counts_topk(spark, d):
    return stats.value_counts(table(spark, d, "events"), "event_type", 10)


@query(
    "categorical_distribution",
    " union all ".join(
        f"""(select '{c}' as "column", coalesce({c}, 'None') as value, count(*) as count, round(count(*) * 100.0 / (select count(*) from {s}), 2)::double as pct,
        (select count(distinct {c}) from {s}) as total_unique, round((select count(*) - count({c}) from {s}) * 100.0 / (select count(*) from {s}), 2)::double as missing_pct
        from {s} group by {c} order by count(*) desc, {c} nulls first limit 5)"""
        for c, s in (("status", DIRTY_SQL), ("flag", DIRTY_SQL))
    ),
)
def categorical_distribution(spark, d):
    out = stats.categorical(dirty(spark, d), ["status", "flag"], 5)
    return out.withColumns({c: F.col(c).cast("double") for c in ("pct", "missing_pct")})


def _histogram_sql(c: str, src: str, bins: int) -> str:
    return f"""with r as (select min({c})::double as lo, max({c})::double as hi from {src}), w as (select lo, (hi - lo) / {bins} as width from r),
      b as (select least({bins - 1}, cast(floor(({c} - lo) / width) as int)) as bin, count(*) as n from {src}, w where {c} is not null group by 1)
      select '{c}' as "column", g.bin::int as bin, round(lo + g.bin * width, 6) as low, round(lo + (g.bin + 1) * width, 6) as high, coalesce(n, 0) as count
      from (select unnest(range({bins})) as bin) g cross join w left join b on b.bin = g.bin"""


@query("histogram_15", _histogram_sql("value", "events", 15))
def histogram_15(spark, d):
    return rounded(stats.histogram(table(spark, d, "events"), ["value"])).drop("label")


@query("histogram_25", _histogram_sql("o_totalprice", "orders", 25))
def histogram_25(spark, d):
    return rounded(stats.histogram(table(spark, d, "orders"), ["o_totalprice"], bins=25)).drop("label")


PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]


@query("corr_matrix", " union all ".join(f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as r from lineitem" for a, b in PAIRS))
def corr_matrix(spark, d):
    return rounded(stats.correlation(table(spark, d, "lineitem"), MEASURES))


_STRONG = "select quantity, quantity * 2 + line_no as doubled, -price as negated, price from {s} where quantity is not null and price is not null"


@query(
    "strong_corr",
    " union all ".join(
        f"""select '{a}' as column_a, '{b}' as column_b, round(r, 4) as r_value, case when r > 0 then 'positive' else 'negative' end as direction, case when abs(r) >= 0.9 then 'very strong' else 'strong' end as strength
        from (select corr({a}, {b}) as r from ({_STRONG.format(s=DIRTY_SQL)})) where abs(r) >= 0.7"""
        for a, b in [("quantity", "doubled"), ("quantity", "negated"), ("quantity", "price"), ("doubled", "negated"), ("doubled", "price"), ("negated", "price")]
    ),
)
def strong_corr(spark, d):
    x = spark.sql(_STRONG.format(s="{s}"), s=dirty(spark, d))
    return stats.strong(stats.correlation(x))


@query("target_corr", " union all ".join(f"select '{c}' as \"column\", round(corr({c}, l_extendedprice), 6) as r from lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def target_corr(spark, d):
    return rounded(stats.target_correlation(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


@query(
    "missing_corr",
    "select * from ("
    + " union all ".join(
        f"select '{a}' as missing_column, '{b}' as related_column, round(corr(case when {a} is null then 1.0::double else 0.0 end, {b}), 6) as r from {DIRTY_SQL}"
        for a, bs in (("quantity", ["order_id", "line_no", "price", "discount_rate", "age"]), ("price", ["order_id", "line_no", "quantity", "discount_rate", "age"]), ("status", ["order_id", "line_no", "quantity", "price", "discount_rate"]))
        for b in bs
    )
    + ") where abs(r) >= 0.2",
)
def missing_corr(spark, d):
    return rounded(profile.missing_correlation(dirty(spark, d)))


@query(
    "row_patterns",
    f"""select count(*) filter (where k = 0) as complete_rows, count(*) filter (where k between 1 and 2) as partial_rows, count(*) filter (where k = 3) as fully_missing_rows
    from (select (quantity is null)::int + (price is null)::int + (status is null)::int as k from {DIRTY_SQL})""",
)
def row_patterns(spark, d):
    return profile.row_patterns(dirty(spark, d))


@query("group_stats", "select o_orderstatus as category, 'o_totalprice' as \"column\", round(median(o_totalprice), 6) as median, round(stddev_pop(o_totalprice), 6) as std, count(*) as n from orders group by 1")
def group_stats(spark, d):
    return rounded(stats.group_stats(table(spark, d, "orders"), "o_orderstatus", ["o_totalprice"]))


@query(
    "line_fit",
    "select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, regr_count(l_extendedprice, l_quantity)::bigint as n from lineitem",
)
def line_fit(spark, d):
    x = stats.line_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return x.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query(
    "duplicate_counts",
    "select (select count(*) from (select o_custkey from orders group by 1 having count(*) > 1)) as groups, (select coalesce(sum(n), 0)::bigint from (select count(*) as n from orders group by o_custkey having count(*) > 1)) as members",
)
def duplicate_counts(spark, d):
    orders = table(spark, d, "orders")
    groups = orders.groupBy("o_custkey").count().where("count > 1").count()
    return spark.createDataFrame([(groups, stats.duplicate_members(orders, ["o_custkey"]))], "groups long, members long")


@query("mode_value", "select status as value from " + DIRTY_SQL + " group by 1 order by count(*) desc, status nulls first limit 1")
def mode_value(spark, d):
    return spark.createDataFrame([(stats.mode(dirty(spark, d), "status"),)], "value string")


@query("moments_mixed_skew", "select round(avg(pow(value - mu, 3)) / pow(stddev_samp(value), 3), 6) as mixed_skew from (select value, avg(value) over () as mu from events)")
def moments_mixed_skew(spark, d):
    plan = Plan(table(spark, d, "events"))
    plan.add("n", F.count("value"))
    plan.add("s", F.skewness("value"))
    got = plan.run()
    return spark.createDataFrame([(round(got["s"] * ((got["n"] - 1) / got["n"]) ** 1.5, 6),)], "mixed_skew double")


@query("sample_rows")
def sample_rows(spark, d):
    return stats.sample_rows(table(spark, d, "orders"), 100)


# ---- chart tables -----------------------------------------------------------------------------------------------------


@query(
    "chart_density",
    """with e as (select min(l_quantity) as xl, max(l_quantity) as xh, min(l_extendedprice) as yl, max(l_extendedprice) as yh from lineitem),
    b as (select cast(least(39, floor((l_quantity - xl) / (xh - xl) * 40)) as integer) as x_bin, cast(least(39, floor((l_extendedprice - yl) / (yh - yl) * 40)) as integer) as y_bin, e.* from lineitem, e)
    select x_bin, y_bin, count(*) as n, round(any_value(xl + x_bin * (xh - xl) / 40), 6) as x_low, round(any_value(yl + y_bin * (yh - yl) / 40), 6) as y_low from b group by 1, 2""",
)
def chart_density(spark, d):
    return rounded(charts.density(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query(
    "chart_line",
    """with e as (select epoch_us(ts) as t, value as v, event_id from events where ts is not null and value is not null), r as (select min(t) as lo, max(t) as hi from e),
    p as (select least(199, cast((t - lo)::hugeint * 200 // (hi - lo) as integer)) as pixel, t, v from e, r)
    select pixel, count(*) as n, min(v) as min, max(v) as max, round(avg(v), 6) as mean, arg_min(v, (t, v)) as first, arg_max(v, (t, v)) as last from p group by 1""",
)
def chart_line(spark, d):
    return charts.line(table(spark, d, "events"), "ts", "value", 200).withColumn("mean", F.round("mean", 6))


def _box(x: str) -> str:
    return f"list_sort(list(o_totalprice))[cast(floor((count(*) - 1) * {x} + 0.5) as bigint) + 1]"


@query(
    "chart_boxes",
    f"""with f as (select o_orderpriority as category, count(*) as n, min(o_totalprice) as min, {_box('0.25')} as q1, {_box('0.5')} as median, {_box('0.75')} as q3, max(o_totalprice) as max from orders group by 1 order by n desc, category limit 10)
    select category, any_value(n) as n, any_value(f.min) as min, any_value(q1) as q1, any_value(f.median) as median, any_value(q3) as q3, any_value(f.max) as max,
      min(o_totalprice) filter (where o_totalprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as low, max(o_totalprice) filter (where o_totalprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as high,
      count(*) filter (where o_totalprice not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as beyond
    from orders join f on o_orderpriority = category group by category""",
)
def chart_boxes(spark, d):
    return charts.boxes(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@query(
    "chart_missing",
    f"""with x as (select *, min(order_id) over () as lo, max(order_id) over () as hi from {DIRTY_SQL}), b as (select *, cast(least(49, floor((order_id - lo) / (hi - lo)::double * 50)) as integer) as block from x)
    select block, 'quantity' as "column", count(*) as n, count(*) - count(quantity) as nulls from b group by 1 union all select block, 'price', count(*), count(*) - count(price) from b group by 1 union all select block, 'status', count(*), count(*) - count(status) from b group by 1""",
)
def chart_missing(spark, d):
    return charts.missing_map(dirty(spark, d), "order_id", ["quantity", "price", "status"])
