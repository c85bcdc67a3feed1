"""Some registered queries against DuckDB (all of them run in the driver's check), and the entry points."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_sql_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["summary_stats", "nearest_quantiles", "histogram_15", "join_full", "auto_clean", "fk_orphans", "confidence", "iqr_outliers", "trend", "windows_sliding", "keyword_topk", "local_outliers", "group_stats", "bm25_topk", "chart_boxes", "version_trend", "derived_columns", "whitespace_case"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_stream(spark, tmp_path):
    from plumbline.streaming.profile import profile_stream

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    run = profile_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("column").sum("rows").collect()
    assert {r[1] for r in got} == {events.count()}
