"""What is told of an analysis: its narrative, the context of a question, questions that follow."""

from datetime import datetime, timedelta

from plumbline.operators import issues, outliers, report, retrieve, score, series, stats
from plumbline.operators.profile import profile
from plumbline.plans import analysis
from plumbline.plans.analysis import analyse
from plumbline.plans.shared import made


def test_answers_from_an_analysis(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(i), float(i), 2.0 * i + (i % 3), None if i % 9 == 0 else "ab"[i % 2], 5000.0 if i == 7 else float(i % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "sold_at timestamp, unit_price double, total_sales double, shop string, returns double")
    result = analyse(df)
    told = report.narrative(result, "the sales table", {"duplicate_rows_removed": 3, "empty_rows_dropped": 0})
    assert told.startswith("The sales table has 80 rows and 5 columns: sold_at, unit_price")
    assert "unit_price and total_sales have a very strong positive correlation" in told
    assert "returns has 1 outliers" in told and "9 values of shop are missing (11.2%" in told
    assert "upward trend over 80 points" in told and "duplicate rows removed: 3" in told and "empty rows" not in told
    assert "Confidence in the data is" in told and len(told.split("\n\n")) >= 6
    assert report.narrative(result, cleaned={}).endswith("Cleaning changed nothing.")
    assert "very strong" in report.to_html(result)

    got = retrieve.context("How is total sales related to the price?", result)
    assert [r["column"] for r in got["summary"]] == ["total_sales"] and got["strong_correlations"] and "outliers" not in got
    assert retrieve.context("Where was this collected?", result) == {}
    assert set(retrieve.context("Any outliers or missing values?", result)) == {"outliers", "missing_patterns"}

    asked = retrieve.followups(result)
    assert len(asked) == 3 and asked[0] == "How are unit_price and total_sales related?" and "returns" in asked[1]
    assert len(retrieve.followups(None)) == 3


def test_insights_work_out_no_more_than_they_need(spark, monkeypatch):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(i), float(i), 2.0 * i + (i % 3), None if i % 9 == 0 else "ab"[i % 2], 5000.0 if i == 7 else float(i % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "sold_at timestamp, unit_price double, total_sales double, shop string, returns double")
    numbered, positions = [], series.positions
    monkeypatch.setattr(series, "positions", lambda df, time, value, *a: numbered.append(value) or positions(df, time, value, *a))
    want = analyse(df)["insights"]
    assert numbered == ["unit_price", "total_sales", "returns"]  # once a column, for its trend and its seasons

    def needless(*_, **__):
        raise AssertionError

    for where, what in ((issues, "detect"), (score, "confidence"), (stats, "summary"), (stats, "categorical"), (series, "autocorrelations")):
        monkeypatch.setattr(where, what, needless)
    assert analysis.insights(df) == want and {i["type"] for i in want} >= {"correlation", "outlier", "trend", "data_quality"}


def test_medians_come_with_the_quartiles(spark):
    df = spark.createDataFrame([(float(i * 37 % 101), None if i % 3 else i) for i in range(100)] + [(float("nan"), None)], "a double, b long")
    p, columns = profile(df, medians=True), ["a", "b"]
    assert repr(stats.summary(df, columns, p).collect()) == repr(stats.summary(df, columns).collect())
    assert repr(outliers.report(df, columns, prof=p).collect()) == repr(outliers.report(df, columns).collect())


def test_made_tables(spark):
    rows, form = [("a", 1.5, 3, True, ["x", "y"], [0.5]), (None, None, None, None, [], None)], "s string, d double, n long, b boolean, t array<string>, v array<double>"
    assert made(spark, rows, form).collect() == spark.createDataFrame(rows, form).collect()
    assert made(spark, rows, form).schema == spark.createDataFrame(rows, form).schema
    assert made(spark, [], form).collect() == [] and made(spark, [], form).dtypes == made(spark, rows, form).dtypes
