"""Exact cases for the operators, edge frames, and properties on generated tables."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.cells import finite, is_title, null_tokens, to_number
from plumbline.functions.names import humanise, matches, rename, snake_case, unique_names
from plumbline.operators import clean, features, infer, issues, outliers, profile, relate, report, retrieve, score, series, stats
from plumbline.plans.aggplan import median, nearest_quantiles
from plumbline.plans.analysis import Config, EmptyDataset, analyse, run_steps


def col(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_names():
    assert unique_names(["  Age  ", "Age", ""]) == ["age", "age_1", "column_3"]
    assert unique_names(["!!", "ok"]) == ["column_1", "ok"]
    assert snake_case("Screen Time(h)") == "screen_time_h"
    assert not matches("gender", ["end"]) and matches("period_end", ["end"])
    assert humanise("net_sales") == "Net Sales"


def test_rename_clash(spark):
    with pytest.raises(ValueError):
        rename(spark.createDataFrame([(1, 2)], "a int, b int"), {"a": "b"})


def test_cells(spark):
    df = spark.createDataFrame([("\tN/A ",), (" x ",), ("",), (None,)], "s string")
    assert col(df.select(null_tokens(F.col("s")).alias("s")), "s") == [None, "x", None, None]
    df = spark.createDataFrame([("$1,250.50",), ("(75)",), ("10%",), ("1d",), ("1_0",), (" € 2 ",)], "s string")
    assert col(df.select(to_number(F.col("s")).alias("s")), "s") == [1250.5, -75.0, 10.0, None, None, 2.0]
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (4.5,)], "v double")
    assert col(df.select(finite(F.col("v")).alias("v")), "v") == [1.0, None, None, None, 4.5]
    df = spark.createDataFrame([("New York",), ("new York",), ("NEW",)], "s string")
    assert col(df.select(is_title(F.col("s")).alias("s")), "s") == [True, False, False]


def test_winsorize(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, 12.0, 11.0, 10.0, 12.0, 110.0)], "val double")
    assert sorted(col(clean.winsorize(df, "val"), "val")) == [10.0, 10.0, 11.0, 12.0, 12.0, 15.0]


def test_quantiles_by_narrowing(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003 / 7.0).alias("v"), F.lit(3.0).alias("same"))
    qs = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    values = sorted(col(df, "v"))
    want = {("v", x): values[int((len(values) - 1) * x + 0.5)] for x in qs} | {("same", x): 3.0 for x in qs}
    assert nearest_quantiles(df, ["v", "same"], qs) == want
    assert median(df, F.col("v")) == (values[2499] + values[2500]) / 2
    odd = spark.createDataFrame([(float(v),) for v in (1, 2, "inf", "-inf", 5)] + [(None,)], "v double")
    assert nearest_quantiles(odd, ["v"], (0.0, 0.5, 1.0)) == {("v", 0.0): float("-inf"), ("v", 0.5): 2.0, ("v", 1.0): float("inf")}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.floats(-1e9, 1e9), st.floats(-1, 1), st.sampled_from([0.0, -0.0, 1e300, 5e-324])), max_size=40), extra=st.integers(0, 3))
def test_order_statistics_against_sorting(spark, values, extra):
    rows = values + [1.5] * extra
    df = spark.createDataFrame([(v,) for v in rows] or [(None,)], "v double")
    known = sorted(v for v in rows if v is not None)
    got = nearest_quantiles(df, ["v"], (0.1, 0.25, 0.75, 0.99))
    assert got == {("v", x): known[int((len(known) - 1) * x + 0.5)] for x in (0.1, 0.25, 0.75, 0.99) if known}
    middle = median(df, F.col("v"))
    assert middle == (0.5 * known[(len(known) - 1) // 2] + 0.5 * known[len(known) // 2] if known else None)
    assert stats.distinct_counts(df) == {"v": len(set(known)) + (len(known) < max(1, len(rows)))}


def test_casts_convert(spark):
    """Numeric text, serial days and dates of several patterns keep their values; a cast that would empty some is for review."""
    from datetime import date

    df = spark.createDataFrame([("$1,150.50", 45000, "11/02/2024"), ("(3.5)", 1, "25/12/2023"), ("7.0%", 0, "01/01/2020")] * 2, "amount string, day long, text string")
    fixed = issues.Fix("cast", "text", ("date",)).apply(issues.Fix("cast", "day", ("date",)).apply(issues.Fix("cast", "amount", ("double",)).apply(df)))
    assert [tuple(r) for r in fixed.limit(3).collect()] == [(1150.5, date(2023, 3, 15), date(2024, 2, 11)), (-3.5, date(1899, 12, 31), date(2023, 12, 25)), (7.0, date(1899, 12, 30), date(2020, 1, 1))]
    half = issues.Fix("cast", "day", ("timestamp",)).apply(spark.createDataFrame([(1.5,)], "day double"))
    assert half.first()[0] == datetime(1899, 12, 31, 12)
    found = issues.detect(spark.createDataFrame([(f"${i},150.50",) for i in range(9)], "v string"))
    assert [(i.fix.action, i.fix.params) for i in found.issues if i.issue_type == "type_mismatch"] == [("cast", ("double",))]
    found = issues.detect(spark.createDataFrame([(f"{i}.5",) for i in range(9)] + [("many",)], "v string"))
    assert [i.fix.action for i in found.issues if i.issue_type == "type_mismatch"] == ["review"]


def test_joins(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (None, "d", 4.0)], "id long, name string, score double")
    b = spark.createDataFrame([(1, "x", 9.0), (2, "y", 8.0), (4, "z", 7.0), (None, "n", 1.0)], "ID long, city string, score double")
    assert relate.join_tables({"a": a, "b": b}, "id").count() == 2
    left = relate.join_tables({"a": a, "b": b}, "Id", "left")
    assert left.count() == 4 and left.columns == ["id", "name", "score", "city", "score_2"]
    assert relate.join_tables({"a": a, "b": b}, "id", "full").count() == 6
    assert relate.join_tables({"a": a, "b": b}, "id", "anti").count() == 2
    assert relate.join_tables({"a": a, "b": b}, None, "cross").count() == 16
    assert relate.join_tables({"a": a}, "id") is a
    for bad, error in (({}, ValueError), ({"a": a, "b": b.drop("ID")}, KeyError)):
        with pytest.raises(error):
            relate.join_tables(bad, "id")


def test_integrity(spark):
    parent = spark.createDataFrame([(k,) for k in (101, 102, 103, 104)], "customer_id long")
    child = spark.createDataFrame([(i, k) for i, k in enumerate((101, 102, 109, 110, 103))], "order_id long, cust_id long")
    r = relate.integrity(child, "cust_id", parent, "customer_id").first()
    assert (r.orphan_count, float(r.completeness_pct), "109" in r.sample) == (2, 60.0, True)
    r = relate.integrity(child.where("cust_id < 105"), "cust_id", parent, "customer_id").first()
    assert (r.orphan_count, float(r.completeness_pct)) == (0, 100.0)


def test_issue_rules(spark):
    def kinds(df, **o):
        return {(r.issue_type, r.column, r.fix): r.affected_rows for r in issues.detect(df, **o).rows(spark).collect()}

    df = spark.createDataFrame([("a@b.org", 1), ("bad", 2), ("x@y.z", 3), ("also bad@", 4)], "user_email string, user_id long")
    assert kinds(df)["format_issue", "user_email", "keep_email"] == 2
    df = spark.createDataFrame([(a,) for a in (-5, 20, 30, 214, 40, 50, 60)], "customer_age long")
    assert kinds(df)["outliers", "customer_age", "clip"] == 2
    day = datetime(2024, 1, 1)
    df = spark.createDataFrame([(day, day + timedelta(2)), (day, day - timedelta(1)), (day, day)], "order_date timestamp, ship_date timestamp")
    assert kinds(df)["format_issue", "ship_date", "keep_ordered"] == 1
    df = spark.createDataFrame([(day,), (datetime(2999, 1, 1),), (day,)], "created_at timestamp")
    assert kinds(df)["format_issue", "created_at", "keep_until"] == 1
    df = spark.createDataFrame([("N/A", 1.0), ("null", -999.0), ("?", 2.0), ("missing", 9999.0), ("ok", 3.0), ("unknown", 4.0)], "status string, score double")
    got = kinds(df)
    assert got["missing_values", "status", "null_out"] == 5 and got["missing_values", "score", "null_out"] == 2
    df = spark.createDataFrame([("A", "1"), ("category", "sales"), ("B", "2"), ("Total", "3"), ("Grand Total", "3")], "category string, sales string")
    got = kinds(df)
    assert got["format_issue", "category", "drop_headers"] == 1 and got["format_issue", "category", "drop_summaries"] == 2
    df = spark.createDataFrame([(None if i % 2 else float(i),) for i in range(20)], "customer_income double")
    assert kinds(df)["missing_values", "customer_income", "flag_missing"] == 10
    firms = ["Acme Corporation", "Acme Corporatoin", "Globex Limited", "Globex Limitd", "Initech", "Umbrella", "Hooli", "Stark"]
    df = spark.createDataFrame([(f,) for f in firms], "company_name string")
    assert kinds(df)["duplicates", "company_name", "replace"] == 4
    df = spark.createDataFrame([(i, "x") for i in range(50)] + [(i, "x") for i in range(10)], "order_id long, v string")
    got = kinds(df)
    assert got["duplicates", None, "distinct"] == 10 and got["duplicates", "order_id", "keep_first"] == 10


def test_ledger_flow(spark):
    df = spark.createDataFrame([(" a ",), ("b",), ("c",), ("c",)], "s string")
    ledger = issues.detect(df)
    with pytest.raises(RuntimeError):
        ledger.lock()
    first = ledger.issues[0].id
    assert ledger.reject(first) and ledger.approve_all() == len(ledger.issues) - 1
    ledger.lock()
    with pytest.raises(RuntimeError):
        ledger.approve(first)
    assert ledger.summary()["locked"] and ledger.remediate(df).count() <= 4
    assert issues.fingerprint(df) == issues.fingerprint(df.repartition(3))


def test_head_and_tail_nulls(spark):
    df = spark.createDataFrame([(i, None if i > 150 else 1.0) for i in range(300)], "i long, v double")
    found = [i for i in issues.detect(df, order=["i"]).issues if i.column == "v" and i.issue_type == "missing_values"]
    assert "MAR(tail)" in found[0].description


def test_clean(spark):
    df = spark.createDataFrame([("N/A", 100.0), ("unknown", None), ("?", None), ("ok", 300.0), ("fine", 500.0), ("fine", 500.0)], "status string, sales double")
    done, r, line = clean.clean(df)
    assert r.duplicates_removed == 1 and r.numeric_filled == 2 and r.categorical_filled == 3
    assert done.where("sales = 300").count() == 3 and done.where("status = 'Unknown'").count() == 3
    again, r2, _ = clean.clean(done.dropDuplicates())
    assert r2.numeric_filled == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, done.dropDuplicates().collect()))
    copy = clean.Lineage.from_json(line.to_json())
    assert copy.chain() == line.chain() and line.audit(spark).count() == len(line.nodes)
    line.lock()
    with pytest.raises(RuntimeError):
        line.add(line.nodes[0])
    assert clean.apply_rules(df, [clean.Rule("nope", "drop_rows"), clean.Rule("status", "other")]) is df


def test_drift(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "id long, amount long")
    b = spark.createDataFrame([("1", 10, "x"), ("2", None, "y")], "id string, amount long, region string")
    assert {(r.change, r.column) for r in profile.drift(a, b).collect()} == {("added", "region"), ("type_changed", "id"), ("null_shift", "amount")}


def test_summary_and_outliers(spark):
    df = spark.createDataFrame([(i, i * 10, float(c)) for i, c in zip(range(1, 6), (1, 2, 3, 4, 100))], "a long, b long, c double")
    got = {r.column: r for r in stats.summary(df).collect()}
    assert (got["a"].mean, got["b"].mean, got["c"].max) == (3.0, 30.0, 100.0)
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 100)], "val long")
    r = outliers.report(df).first()
    assert (r["count"], r.max_outlier) == (1, 100.0)
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 3, 3, 4, 4, 5, 6, 8, 5000)], "revenue double")
    r = outliers.report(df).first()
    assert r.heavy_skew and r.log_count >= 1


def test_correlation_with_staggered_nulls(spark):
    rows = [(None if i == 0 else float(i), None if i == 1 else float(i * 2), None if i == 2 else float(9 - i)) for i in range(8)]
    got = {(r.column_a, r.column_b): r.r for r in stats.correlation(spark.createDataFrame(rows, "a double, b double, c double")).collect()}
    assert len(got) == 3 and got["a", "b"] == pytest.approx(1) and got["a", "c"] == pytest.approx(-1)


def test_correlation_without_complete_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None), (3.0, None), (None, 5.0)], "a double, b double")
    assert stats.correlation(df).count() == 1


def test_classification(spark):
    df = spark.createDataFrame([(i % 3, i % 2, 10.0 * i, "2024-01-01") for i in range(10)], "retailer_id long, store_id long, sales_amount double, invoice_date string")
    got = {r.column: r.analytical for r in score.classify(df).collect()}
    assert got == {"retailer_id": False, "store_id": False, "sales_amount": True}
    df = spark.createDataFrame([(1.0, "2024-01-01", "n")] * 5, "sales double, invoice_date string, region string")
    assert score.eligible_categories(df) == ["region"]


def test_roles(spark):
    df = spark.createDataFrame([("f", 20, 1.5, 0), ("m", 30, 2.5, 1), ("f", 40, 3.5, 0), ("m", 50, 4.5, 1)], "gender string, age long, screen_time_before_sleep double, depression_label long")
    got = {r.column: r.role for r in infer.roles(df).collect()}
    assert got["gender"] == "dimension" and got["screen_time_before_sleep"] == "predictor_metric" and got["depression_label"] == "target_metric"
    assert infer.domain(["student_id", "marks", "attendance"])["primary"] == "education"
    assert infer.domain(["zzz"])["primary"] == "generic"


def test_readiness(spark):
    good = spark.createDataFrame([(i, float(i % 17), "ab"[i % 2]) for i in range(60)], "a long, b double, c string")
    assert score.readiness(good)["score"] == 100.0
    gate = spark.createDataFrame([(i, None if i < 8 else 1.0) for i in range(10)], "a long, b double")
    assert score.readiness(gate)["score"] == 0.0
    flat = spark.createDataFrame([(i, 7.0) for i in range(20)], "a long, b double")
    assert score.readiness(flat)["column_context"].startswith("1 of 2")


def test_series(spark):
    start = datetime(2024, 1, 1)
    y = [100.0 + 10 * (i % 7) for i in range(30)]
    y[15] = 950.0
    df = spark.createDataFrame([(start + timedelta(i), v) for i, v in enumerate(y)], "transaction_date timestamp, revenue double")
    s = series.positions(df, "transaction_date", "revenue")
    assert [r.y for r in s.orderBy("i").collect()] == y
    assert series.residual_outliers(s).count() >= 1
    assert series.residual_outliers(s.where("i < 5")).count() == 0
    assert series.trend(df.limit(5), "transaction_date", "revenue")["detected"] is False
    line = spark.createDataFrame([(start + timedelta(i), 2.0 * i) for i in range(20)], "t timestamp, y double")
    r = series.trend(line, "t", "y")
    assert (r["direction"], r["slope"], r["r_squared"], r["statistically_significant"]) == ("upward", 2.0, 1.0, True)
    weekly = spark.createDataFrame([(start + timedelta(i), float(i % 7)) for i in range(90)], "t timestamp, y double")
    assert series.seasonality(weekly, "t", "y")["primary_pattern"] == "weekly"


def test_multivariate(spark):
    df = spark.createDataFrame([(i, 30 + i % 5, 100.0 + i) for i in range(25)] + [(99, 30, 2_000_000.0)], "id long, age long, transaction_amount double")
    assert 99 in col(outliers.multivariate(df, "id", share=0.05).where("outlier"), "id")
    assert outliers.multivariate(df.limit(5), "id").count() == 0


def test_retrieval(spark):
    text = "\n\n".join(f"Section {i}. " + "word " * 60 for i in range(6))
    pieces = retrieve.split(text)
    assert all(len(p) <= 750 for p in pieces) and pieces[0].startswith("Section 0")
    assert retrieve.split("  ") == [] and retrieve.split("x" * 2000)[0] == "x" * 500
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [1.0])], "vec_id long, embedding array<float>")
    assert col(retrieve.vector_search(v, [1.0, 0.0]), "vec_id") == [1, 2]
    d = spark.createDataFrame([(1, "net sales by region"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    assert col(retrieve.keyword_search(d, "sales region", 1), "doc_id") == [1]
    assert retrieve.keyword_search(d, "").first().score == 0.5
    assert len(retrieve.expand_query("average and missing values")) == 3
    s = stats.summary(spark.createDataFrame([(1.0,), (3.0,)], "net_sales double"))
    assert retrieve.fact("what is the average net sales?", s)["value"] == 2.0


def test_hidden_types(spark):
    df = spark.createDataFrame([(str(i), f"2024-01-{i % 28 + 1:02d}", f"u{i}@a.org") for i in range(30)], "n string, d string, e string")
    got = {r.column: r.suggested_type for r in infer.hidden_types(df).collect()}
    assert got == {"n": "integer", "d": "date", "e": "email"}


def test_features(spark):
    df = spark.createDataFrame([(float(i), float(2**i), float(i) / 20, "ab"[i % 2], f"k{i}") for i in range(20)], "flat double, wide double, unit double, two string, many string")
    assert {r.column: r.encoding for r in features.encodings(df).collect()} == {"two": "binary", "many": "label_or_target"}
    assert {r.column: r.scaler for r in features.scalings(df).collect()} == {"flat": "standard", "wide": "robust", "unit": "none"}
    assert features.number_parts(df, "flat").select("flat_binned").distinct().count() == 5


@pytest.mark.parametrize(
    "rows, schema",
    [([(1, "a")], "x long, s string"), ([(None, None)] * 3, "x double, s string"), ([(float(i),) for i in range(12)], "x double"), ([("a",), ("b",)], "s string"), ([(5.0, 5.0)] * 15, "x double, y double")],
)
def test_edge_frames(spark, rows, schema):
    result = analyse(spark.createDataFrame(rows, schema))
    assert result["rows"] == len(rows)
    assert report.to_html(result).startswith("<!DOCTYPE html>")


def test_empty_frame(spark):
    with pytest.raises(EmptyDataset):
        analyse(spark.createDataFrame([], "x double"))
    assert stats.summary(spark.createDataFrame([], "x double")).first()["count"] == 0
    assert issues.detect(spark.createDataFrame([], "x double")).issues == []


def test_toggles_and_steps(spark):
    df = spark.createDataFrame([(float(i), float(i), 100.0 if i == 5 else float(i % 3), None if i < 3 else float(i * i % 7)) for i in range(12)], "A double, B double, C double, D double")
    kinds = {i["type"] for i in analyse(df)["insights"]}
    assert {"correlation", "outlier"} <= kinds
    kinds = {i["type"] for i in analyse(df, Config(correlation=False, outliers=False))["insights"]}
    assert not kinds & {"correlation", "outlier"}
    assert run_steps(df, {}, {"bad": lambda d, r: d.select("nope").collect()}) == {"bad": None}
    with pytest.raises(NameError):
        run_steps(df, {}, {"bug": lambda d, r: undefined})  # noqa: F821
    assert Config.for_domain("finance").strong_correlation == 0.8


def test_order_and_partitions_do_not_matter(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).cast("double").alias("v"), (F.col("id") % 7).cast("string").alias("s"))
    other = df.orderBy(F.desc("v")).repartition(7)
    for f in (stats.summary, profile.null_profile, lambda d: stats.value_counts(d, "s"), stats.histogram, lambda d: outliers.count_outside(d, ["v"])):
        rounded = lambda d: d.select(*[F.round(F.col(c), 6).alias(c) if k == "double" else F.col(c) for c, k in d.dtypes])
        assert sorted(map(str, rounded(f(df)).collect())) == sorted(map(str, rounded(f(other)).collect()))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=5, max_size=40))
def test_properties(spark, rows):
    df = spark.createDataFrame(rows, "aa double, bb double")
    for r in outliers.count_outside(df, ["aa", "bb"]).collect():
        assert r.lower <= r.upper and 0 <= r.pct <= 100
    for r in stats.correlation(df).collect():
        assert -1 - 1e-6 <= r.r <= 1 + 1e-6
    for r in score.confidence(df).collect():
        assert 0 <= r.overall <= 100


def test_rules_work_each_pattern_out_once(spark):
    """no pattern is tried at every character to strip a text, and none twice in a row."""
    from plumbline.functions.cells import strip, to_number, undress
    from plumbline.operators import infer

    x = spark.createDataFrame([(" a b\t\n",), ("\x0b\f\rx",), ("",), (None,), ("($1,2 3.5%)",), (" € 7 ",), ("(a",), ("(1)b",)], "s string")
    assert [r[0] for r in x.select(strip(F.col("s"))).collect()] == ["a b", "x", "", None, "($1,2 3.5%)", "€ 7", "(a", "(1)b"]
    assert [r[0] for r in x.select(to_number(F.col("s"))).collect()] == [None, None, None, None, -123.5, 7.0, None, None]
    plan = x.select(strip(F.col("s")), undress(F.col("s")))._jdf.queryExecution().toString()
    assert plan.count("regexp_replace") and "\\s+" not in plan
    texts = ["2024-01-02", "2024-01-02 03:04:05", "a@b.org", "https://b.org/c", "+1 555-123456", "1,200", "$1.5", None, "x"]
    seen = spark.createDataFrame([(t,) for t in texts], "v string").select("v", *infer._judged(F.col("v")))
    assert seen.agg(*infer._number_counts(F.col("v")), *infer._pattern_counts(F.col("v"))).first()[:] == (8, 2, 1, 8, 1, 1, 1, 1, 2)


def test_distinct_counts_of_typed_cells(spark):
    """numbers and dates are told apart without their digits."""
    from plumbline.plans.aggplan import Distinct, Plan

    x = spark.sql("""select * from values (1, 0.0D, true, date'2024-01-01', timestamp'2024-01-01 00:00:00', 'a', 1.5BD), (1, -0.0D, false, date'2024-01-02', timestamp'2024-01-01 00:00:00.000001', 'A', 1.50BD),
      (2, double('NaN'), null, null, null, null, null), (null, double('NaN'), null, null, null, 'a', 2BD) as t(i, d, b, day, at, s, m)""")
    plan = Plan(x)
    for c in x.columns:
        plan.add(c, Distinct(F.col(c)))
    assert plan.run() == {"i": 2, "d": 2, "b": 2, "day": 2, "at": 2, "s": 2, "m": 2}
