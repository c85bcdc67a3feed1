"""Profiles from merged states, and what a stream says of late rows and of changes."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators.history import History
from plumbline.streaming import watch


def test_merged_profile_equals_the_recomputed_one(spark, tmp_path):
    rng = np.random.default_rng(1)
    days = []
    h = History(spark, str(tmp_path / "h"))
    for day in range(5):
        n = 400 * (day + 1)
        rows = [(int(i), None if rng.random() < 0.1 else float(rng.lognormal(day / 4, 1)), f"v{min(int(rng.exponential(60)), 900)}") for i in rng.integers(0, 3000, n)]
        rows += [(1, float("nan"), None), (2, float("inf"), "v0")]
        df = spark.createDataFrame(rows, "id long, x double, s string")
        h.add(df, 1 + day // 3, f"day{day}")
        days.append(df)
    h.add(days[0], 1, "day0")  # the same part again replaces itself
    for versions, parts in ((None, days), ([1], days[:3]), ([2], days[3:])):
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        got = {r["column"]: r for r in h.profile(versions).collect()}
        finite = every.select(F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x")).alias("x"))
        want = finite.agg(F.mean("x"), F.stddev_samp("x"), F.min("x"), F.max("x")).first()
        r = got["x"]
        assert (r["rows"], r["nulls"]) == (every.count(), every.where("x is null").count())
        assert np.allclose([r["mean"], r["std"], r["min"], r["max"]], list(want), rtol=1e-9)
        values = np.sort([v[0] for v in finite.dropna().collect()])
        for q, v in zip((0.25, 0.5, 0.75), r["quantiles"]):
            assert abs(np.searchsorted(values, v) / len(values) - q) < 0.03
        for c in ("id", "s"):
            exact = every.select(c).dropna().distinct().count()
            assert abs(got[c]["distinct"] - exact) <= 0.07 * exact + 1
        assert got["s"]["quantiles"] is None and got["s"]["mean"] is None
        counts = {v["s"]: v["count"] for v in every.where("s is not null").groupBy("s").count().collect()}
        for v in h.frequent(versions, 5).collect():
            assert v["count"] <= counts[v["value"]] <= v["count"] + v["off"]


def test_trend_of_versions(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    h.add(spark.createDataFrame([(1, 10, None), (2, 20, "a")], "id long, amount long, gone string"), 1)
    h.add(spark.createDataFrame([("1", 10, "n"), ("2", None, "s")], "id string, amount long, region string"), 2)
    h.add(spark.createDataFrame([("1", 10, "n"), ("2", None, "s"), ("3", 5, None)], "id string, amount long, region string"), 7)
    got = sorted((r["version"], r["change"], r["column"], r["before"], r["after"]) for r in h.trend().collect() if r["column"])
    assert got == [
        (2, "added", "region", None, "string"), (2, "null_shift", "amount", "0.00", "50.00"), (2, "removed", "gone", "string", None), (2, "type_changed", "id", "bigint", "string"),
        (7, "null_shift", "amount", "50.00", "33.33"), (7, "null_shift", "region", "0.00", "33.33"),
    ]
    assert sorted((r["version"], r["before"], r["after"]) for r in h.trend().where("column is null").collect()) == [(2, "2", "2"), (7, "2", "3")]


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def test_late_rows_over_restarts(spark, tmp_path):
    start, schema, path = datetime(2024, 1, 1), "ts timestamp, kind string", str(tmp_path / "in")
    at = lambda minutes, kind="a": (start + timedelta(minutes=minutes), kind)
    out, again = str(tmp_path / "out"), str(tmp_path / "cp")
    go = lambda: watch.late_windows(spark.readStream.schema(schema).parquet(path), out, again, key="kind", delay="1 hour").awaitTermination()
    _write(spark, [at(0), at(200), (None, "a")], schema, path)
    go()
    _write(spark, [at(10), at(140), at(139), at(400, "b")], schema, path)  # 140: exactly an hour behind, on time
    go()
    _write(spark, [at(330), at(345), at(1, "b")], schema, path)  # the latest time is 400 now
    go()
    go()  # nothing new
    got = {(int((r["window_start"] - start).total_seconds() // 3600), r["kind"]): (r["on_time"], r["late"]) for r in watch.late_totals(spark, out, "kind").collect()}
    assert got == {(0, "a"): (1, 1), (3, "a"): (1, 0), (2, "a"): (1, 1), (6, "b"): (1, 0), (5, "a"): (1, 1), (0, "b"): (0, 1)}


def test_changes_between_batches(spark, tmp_path):
    path, out, again = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def go(schema):
        watch.watch(spark.readStream.schema(schema).parquet(path), out, again).awaitTermination()

    _write(spark, [(i, "x") for i in range(20)], "id long, s string", path)
    go("id long, s string")
    _write(spark, [(i, None if i < 4 else "x") for i in range(20)], "id long, s string", path)
    go("id long, s string")
    _write(spark, [(i, None if i < 4 else "x", 1.0) for i in range(20)], "id long, s string, extra double", path)
    go("id long, s string, extra double")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/changes").select("batch", "change", "column", "before", "after").collect())
    assert got == [(1, "null_shift", "s", "0.00", "20.00"), (2, "added", "extra", None, "double")]
