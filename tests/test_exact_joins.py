"""Similarity join, nearest neighbours, grouped medians, LOESS decomposition and the full-text index against plain versions."""

import math
import random
import statistics
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.catalog import QUERIES
from plumbline.operators import fuzzy, issues, neighbours, outliers, series, stats
from plumbline.operators.fulltext import FullText
from plumbline.operators.loess import Spans, stl
from plumbline.plans import aggplan, grouped

SF = "/root/testdata/sf0.01"


# ---- similar texts ------------------------------------------------------------------------------------------------------


def _brute_pairs(values, ratio=0.88, length=5):
    values = sorted({v.strip() for v in values if v is not None})
    out = []
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            x, y = a.lower(), b.lower()
            if x != y and abs(len(x) - len(y)) <= length and SequenceMatcher(None, x, y).ratio() >= ratio:
                out.append((a, b))
    return out


def _names(n, seed=1):
    rng = np.random.default_rng(seed)
    parts = ["ta", "ri", "mo", "en", "lu", "ka", "so", "ber", "dan", "vi", "ost", "qu"]
    out = []
    for _ in range(n):
        name = " ".join("".join(rng.choice(parts, rng.integers(1, 4))).capitalize() for _ in range(rng.integers(1, 4)))
        out.append(name)
        if rng.random() < 0.5:
            at = int(rng.integers(0, len(name) + 1))
            out.append(name[:at] + str(rng.choice(["x", "", " Ltd", "é"])) + name[at + int(rng.integers(0, 2)) :])
        if rng.random() < 0.1:
            out.append(name.upper())
    return out


@pytest.mark.parametrize("frequent", [1, 64])
def test_fuzzy_against_all_pairs(spark, frequent):
    values = _names(350) + ["", None, " ", "a", "ab", "abc", "abcd", "abcde", "Acme Corp", "Acme Corporation", "Tata Motors", "Tata Motors Ltd", "  Infosys Tech ", "Infosys Technologies", "x" * 150, "x" * 149 + "y"]
    df = spark.createDataFrame([(v,) for v in values], "name string").repartition(3)
    got = fuzzy.similar_pairs(df, "name", frequent=frequent).collect()
    want = _brute_pairs(values)
    assert len(want) > 100
    assert sorted((r["a"], r["b"]) for r in got) == want
    for r in got[:20]:
        assert r["ratio"] == SequenceMatcher(None, r["a"].lower(), r["b"].lower()).ratio()


def test_fuzzy_tables(spark):
    for name, column in (("part", "p_name"), ("pages", "title")):
        x = spark.read.parquet(f"{SF}/{name}.parquet")
        x = x if name == "part" else x.select(F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
        got = sorted((r["a"], r["b"]) for r in issues.fuzzy_pairs(x, column).collect())
        assert got == _brute_pairs([r[0] for r in x.select(column).distinct().collect()])
    with pytest.raises(ValueError):
        fuzzy.similar_pairs(x, "title", 0.5)
    assert issues.fuzzy_pairs(x.limit(0), "title").count() == 0


def test_fuzzy_candidates_grow_with_the_rows(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrst"))
    texts = ["".join(rng.choice(letters, 16)) for _ in range(8000)]
    count = lambda n: fuzzy.candidates(spark.createDataFrame([(t,) for t in texts[:n]], "t string")).where("x <> y").count()
    few, many = count(800), count(8000)
    assert many < 8000 * 8000 / 2 / 200  # far from all pairs
    assert many < 15 * few  # ten times the rows


def test_fuzzy_long_texts_meet_in_blocks(spark):
    rng = np.random.default_rng(9)
    parts = np.array([a + b for a in ("th", "r", "s ", "é", "𝒳n", "m") for b in ("e", "ou", "in", "a", "on ", "y")])
    texts = {"".join(rng.choice(parts, 30))[: int(rng.integers(55, 61))].strip() for _ in range(700)}
    texts |= {t[:at] + new + t[at + cut :] for t in sorted(texts)[:150] for at, new, cut in [(int(rng.integers(0, 50)), str(rng.choice(["", "x", "abc"])), int(rng.integers(0, 5)))]}
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "t string").repartition(3)
    some = sorted(texts)[:500]
    want = {(a, b) for a, b in _brute_pairs(some)}
    for block in (40, 4096):
        found = {tuple(sorted(r)) for r in fuzzy.met(df, block=block).collect()}
        assert len(want) > 40 and want <= found
        assert len(found) < len(texts) ** 2 / 50  # the bigrams rule out nearly all pairs
    got = {(r["a"], r["b"]) for r in fuzzy.similar_pairs(df, "t").collect()}
    assert {x for x in got if set(x) <= set(some)} == want


# ---- nearest neighbours and local outlier factors -----------------------------------------------------------------------


def _brute_lof(x, k=15):
    """Rows in ascending order are the order of ties."""
    order = np.lexsort(x.T[::-1])
    x = x[order]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    k = min(k, len(x) - 1)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    reach = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(reach[near, -1], reach).mean(axis=1) + 1e-10)
    out = np.empty(len(x))
    out[order] = density[near].mean(axis=1) / density
    return out


@pytest.mark.parametrize("cell_points", [40, 1000])
def test_lof_against_all_distances(spark, cell_points):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (700, 3)), rng.normal(8, 0.1, (300, 3)), np.round(rng.normal(-5, 1, (150, 3))), [[100, 100, 100], [0, 50, 0]]])
    x = np.concatenate([x, x[:40], np.tile(x[5], (30, 1))])
    df = spark.createDataFrame([(*map(float, r),) for r in x], "a double, b double, c double").repartition(3)
    got = {tuple(r["p"]): (r["w"], r["lof"]) for r in neighbours.local_outlier_factors(df, ["a", "b", "c"], sample=300, cell_points=cell_points).collect()}
    want = _brute_lof(x)
    assert sum(w for w, _ in got.values()) == len(x)
    assert np.allclose([got[tuple(r)][1] for r in x], want, rtol=1e-6)


def test_only_cells_within_reach_are_visited(spark):
    x = np.random.default_rng(10).uniform(0, 100, (2000, 2))
    cells = neighbours.Cells(x[:500], 32)
    radius = np.linspace(0, 20, 2000)
    radius[7] = np.inf
    row, cell = cells.reached(x, radius)
    gap = np.maximum(0, np.maximum(cells.low[None] - x[:, None], x[:, None] - cells.high[None]))
    i, j = np.nonzero(np.sqrt((gap**2).sum(-1)) <= radius[:, None] * (1 + 1e-12))
    assert row.tolist() == i.tolist() and cell.tolist() == j.tolist()
    df = spark.createDataFrame([(list(map(float, r)), 1) for r in x], "p array<double>, w long")
    got = neighbours.nearest(df, 5, cell_points=400).collect()
    home = [r for r in got if r["near"] is None]  # nothing is sent elsewhere or looked up for these
    assert len(got) == 2000 and len(home) > 1000
    assert all(len(r["places"]) == len(r["d"]) == sum(r["times"]) == 5 for r in home)
    assert all(sum(y["w"] for y in r["near"]) == 5 for r in got if r["near"] is not None)


def test_lof_five_thousand_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.gamma(2, 2, (5000, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    got = outliers.multivariate(df, "id", ["a", "b"])
    rows = sorted(got.collect(), key=lambda r: r["id"])
    lof = _brute_lof(x)
    assert np.allclose([r["lof"] for r in rows], lof, rtol=1e-6)
    iso = np.array([r["isolation"] for r in rows])
    # Exact shares: above the quantile between ranks, as a contamination of 2 %.
    isolated = iso > np.quantile(iso, 0.98)
    assert [r["isolated"] for r in rows] == isolated.tolist()
    assert [r["outlier"] for r in rows] == (isolated & (lof > np.quantile(lof, 0.98))).tolist()
    summary = outliers.multivariate_summary(got, ["a", "b"]).first()
    assert summary["isolation_forest_count"] == 100 and summary["count"] == sum(r["outlier"] for r in rows)


def test_lof_odd_rows(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), -0.0), (0.0, 0.0), (float("inf"), 1.0), (2.0, 0.0)], "a double, b double")
    got = {tuple(r["p"]): r["w"] for r in neighbours.local_outlier_factors(df, ["a", "b"]).collect()}
    assert got == {(1.0, 0.0): 1, (0.0, 0.0): 2, (2.0, 0.0): 1}
    assert neighbours.local_outlier_factors(df.limit(0), ["a", "b"]).count() == 0
    same = spark.range(50).selectExpr("id", "1 as a", "2 as b")
    assert outliers.multivariate(same, "id", ["a", "b"]).where("outlier").count() == 0


def test_points_of_many_rows_are_their_own_neighbours(spark, monkeypatch):
    """Neighbours are looked for only of points with k rows or fewer, factors are those of all distances."""
    x = np.concatenate([np.repeat([[0.0, 0.0], [3.0, 1.0]], 40, axis=0), np.random.default_rng(11).normal(0, 2, (60, 2))])
    df = spark.createDataFrame([(*map(float, r),) for r in x], "a double, b double")
    got = {tuple(r["p"]): r["lof"] for r in neighbours.local_outlier_factors(df, ["a", "b"], cell_points=20).collect()}
    assert np.allclose([got[tuple(r)] for r in x], _brute_lof(x), rtol=1e-6)

    def looked(*_):
        raise AssertionError

    monkeypatch.setattr(neighbours, "nearest", looked)
    for heavy in (neighbours.local_outlier_factors(df.limit(80), ["a", "b"]).collect(), neighbours.local_outlier_factors(df.limit(40), ["a", "b"]).collect()):
        assert heavy and {r["lof"] for r in heavy} == {1.0}


@pytest.mark.parametrize("shipped", [1 << 20, 0])
def test_multivariate_by_points(spark, monkeypatch, shipped):
    """Rows of the same point count as often as they occur, with or without scores."""
    monkeypatch.setattr(outliers, "SHIPPED", shipped)
    x = np.round(np.random.default_rng(12).gamma(2, 2, (3000, 2)), 1)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(3000 + i, float("inf"), 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    points = outliers.multivariate_points(df, "id", ["a", "b"], share=0.1)
    every = outliers.multivariate(df, "id", ["a", "b"], share=0.1)
    got = {r["id"]: r for r in every.collect()}
    assert len(got) == 3500 and all(got[i]["isolation"] is None and got[i]["isolated"] is False for i in range(3000, 3500))
    iso, lof = (np.array([got[i][c] for i in range(3000)]) for c in ("isolation", "lof"))
    assert np.allclose(lof, _brute_lof(x), rtol=1e-6)
    assert [got[i]["isolated"] for i in range(3000)] == (iso > np.quantile(iso, 0.9)).tolist()
    assert [got[i]["outlier"] for i in range(3000)] == ((iso > np.quantile(iso, 0.9)) & (lof > np.quantile(lof, 0.9))).tolist()
    held = points.collect()
    assert sum(r["w"] for r in held) == 3500 and len(held) == len(np.unique(x, axis=0)) + 1
    assert outliers.multivariate_summary(points, ["a", "b"], "w").collect() == outliers.multivariate_summary(every, ["a", "b"]).collect() != []


def test_summary_looks_up_no_rows(spark, monkeypatch):
    want = outliers.multivariate_summary(QUERIES["multivariate"](spark, "/root/testdata/sf0.001"), ["l_quantity", "l_extendedprice", "l_discount"]).collect()
    monkeypatch.delattr(outliers, "multivariate")
    assert QUERIES["multivariate_summary"](spark, "/root/testdata/sf0.001").collect() == want


def test_order_statistics_by_weight(spark):
    values = [(3.0, 4, 1.0), (-1.0, 2, 1e300), (1e9, 1, float("inf")), (None, 5, None), (0.5, 3, 0.0)]
    df = spark.createDataFrame(values, "x double, w long, y double").repartition(3)
    want = {c: sorted(v for r in values for v in [r[at]] * r[1] if v is not None) for c, at in (("x", 0), ("y", 2))}
    got = aggplan.order_statistics(df, {c: (F.col(c), lambda n: {0.5: tuple(range(n))}) for c in want}, F.col("w"))
    assert got.counts == {c: len(v) for c, v in want.items()}
    assert {c: [got[c, k] for k in range(len(v))] for c, v in want.items()} == want


# ---- medians within groups ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [3, 1024])
def test_group_medians_against_sorting(spark, small):
    rng = np.random.default_rng(3)
    rows = [(None if i % 50 == 0 else "big" if i % 3 else f"g{i % 7}", float(v), float(round(v)) if i % 11 else None) for i, v in enumerate(rng.standard_cauchy(3000) * 1000)]
    rows += [("inf", float(v), 1.0) for v in ["inf"] * 5 + ["-inf"] * 5 + ["nan"] * 2 + [1, 2, 3]] + [("one", 1e308, -1e308), ("two", -1e308, 0.0), ("two", 1e308, 5e-324), ("none", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(4)
    got = {(r["g"]["k0"], r["name"]): (r["n"], r["median"]) for r in grouped.group_medians(df, [F.col("k")], {"a": F.col("a"), "b": F.col("b")}, small=small, bins=8).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for name, at in (("a", 1), ("b", 2)):
            # Spark's order: NaN comes last.
            v = sorted((r[at] for r in rows if r[0] == k and r[at] is not None), key=lambda x: (math.isnan(x), x))
            if v:
                want[k, name] = (len(v), v[(len(v) - 1) // 2] / 2 + v[len(v) // 2] / 2)
    assert got == want


def test_group_stats_have_no_buffering_median(spark):
    x = spark.range(9000).selectExpr("id % 3 as k", "cast(id as double) as v", "cast(null as double) as nothing")
    got = {(r["category"], r["column"]): r for r in stats.group_stats(x, "k", ["v", "nothing"]).collect()}
    assert got[1, "v"]["median"] == statistics.median(range(1, 9000, 3)) and got[1, "v"]["n"] == 3000
    assert got[1, "nothing"]["median"] is None and got[1, "nothing"]["n"] == 0


# ---- decomposition by local regression ----------------------------------------------------------------------------------


def _line(y, width, at, weights):
    """The plain local regression at one position (from 0; it may lie outside the series)."""
    n = len(y)
    left = min(max(at - width // 2, 0), max(0, n - width))
    right = min(left + width, n) - 1
    h = max(at - left, right - at)
    if width > n:
        h += (width - n) // 2
    w = {}
    for j in range(left, right + 1):
        r = abs(j - at)
        if r <= 0.999 * h:
            w[j] = (1.0 if r <= 0.001 * h else (1 - (r / h) ** 3) ** 3) * weights[j]
    total = sum(w.values())
    if total <= 0:
        return y[min(max(at, 0), n - 1)]
    w = {j: v / total for j, v in w.items()}
    centre = sum(v * j for j, v in w.items())
    spread = sum(v * (j - centre) ** 2 for j, v in w.items())
    if math.sqrt(spread) > 0.001 * (n - 1):
        w = {j: v * (1 + (at - centre) * (j - centre) / spread) for j, v in w.items()}
    return sum(v * y[j] for j, v in w.items())


def _plain_stl(y, robust, period=7, seasonal=13, trend=13, low=9):
    n, t, weights = len(y), [0.0] * len(y), [1.0] * len(y)
    for _ in range(15 if robust else 1):
        for _ in range(2 if robust else 5):
            cycle = [0.0] * (n + 2 * period)
            for p in range(period):
                own, w = [y[i] - t[i] for i in range(p, n, period)], weights[p::period]
                for j in range(-1, len(own) + 1):
                    cycle[p + (j + 1) * period] = _line(own, seasonal, j, w)
            x = cycle
            for width in (period, period, 3):
                x = [sum(x[i : i + width]) / width for i in range(len(x) - width + 1)]
            x = [_line(x, low, i, [1.0] * n) for i in range(n)]
            s = [cycle[i + period] - x[i] for i in range(n)]
            free = [y[i] - s[i] for i in range(n)]
            t = [_line(free, trend, i, weights) for i in range(n)]
        rest = [y[i] - s[i] - t[i] for i in range(n)]
        h = 6 * statistics.median(map(abs, rest))
        weights = [1.0 if abs(r) <= 0.001 * h else (1 - (r / h) ** 2) ** 2 if abs(r) <= 0.999 * h else 0.0 for r in rest]
    return t, s


@pytest.mark.parametrize("robust,n,block", [(False, 20, 50_000), (False, 700, 70), (True, 150, 35)])
def test_stl_against_plain_version(spark, robust, n, block):
    rng = np.random.default_rng(2)
    y = [100 + 0.1 * i + 20 * (i % 7) + float(rng.normal()) + (800 if i == 15 else 0) for i in range(n)]
    assert Spans() == Spans(7, 13, 13, 9)
    s = spark.createDataFrame(list(enumerate(y)), "i long, y double").repartition(3)
    got = sorted(stl(s, robust=robust, block=block).collect())
    trend, seasonal = _plain_stl(y, robust)
    assert np.allclose([r["trend"] for r in got], trend, atol=1e-6) and np.allclose([r["seasonal"] for r in got], seasonal, atol=1e-6)
    assert np.allclose([r["residual"] for r in got], np.array(y) - trend - seasonal, atol=1e-6)


def test_stl_outliers(spark):
    daily = spark.createDataFrame([(i, 100.0 + i % 7 * 20 if i != 15 else 950.0) for i in range(30)], "i long, y double")
    found = series.stl_report(daily)
    assert found["has_stl_outliers"] and found["stl_outlier_count"] >= 1 and found["total_observations"] == 30
    assert 15 in [r["i"] for r in series.stl_outliers(daily).collect()]
    assert series.stl_report(daily.where("i < 5"))["has_stl_outliers"] is False
    flat = daily.selectExpr("i", "5.0D as y")
    assert series.stl_report(flat)["stl_outlier_count"] == 0
    with pytest.raises(ValueError):
        Spans(7, 12)


# ---- full-text index ----------------------------------------------------------------------------------------------------


def test_fulltext(spark, tmp_path):
    docs = [(1, "The cat sat. The CAT ran"), (2, "a dog, a cat"), (3, None), (4, "?!"), (5, "Éte été"), (6, "dog " * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = FullText(spark, str(tmp_path / "index"), buckets=4).add(df.where("doc_id < 3")).add(df.where("doc_id >= 3"))
    assert index.sizes() == (4, 6 + 4 + 2 + 500)
    avg, n = 512 / 4, 4

    def bm25(tf, df_, length):
        return math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))

    got = {r["doc"]: r["score"] for r in index.bm25("Cat DOG").collect()}
    assert got == pytest.approx({1: bm25(2, 2, 6), 2: bm25(1, 2, 4) + bm25(1, 2, 4), 6: bm25(500, 2, 500)})
    batch = index.bm25_batch(spark.createDataFrame([(7, "cat dog dog"), (8, "été"), (9, None)], "q long, t string"), "q", "t", 2).collect()
    assert [(r["q"], r["rank"], r["doc"]) for r in sorted(batch)] == [(7, 1, r) if i == 0 else (7, 2, r) for i, r in enumerate(sorted(got, key=lambda d: -got[d])[:2])] + [(8, 1, 5)]
    assert index.bm25("nothing of it").count() == 0 and index.bm25("").count() == 0
    overlap = {r["doc"]: r["score"] for r in index.overlap("cat dog").collect()}
    assert overlap[1] == pytest.approx(1 / (math.sqrt(2) * math.sqrt(4) + 1e-6))
    plan = index.of(["cat"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "In(term" in plan.replace("EqualTo(term", "In(term")


def test_fulltext_files_follow_the_tasks(spark, tmp_path):
    """F8, F9: a frequent term stands in a file of each task that read some of it, whatever the table's size."""
    docs = spark.range(0, 60, 1, 6).selectExpr("id as doc_id", "concat('the w', id) as text")
    index = FullText(spark, str(tmp_path / "index")).add(docs)
    assert index.of(["the"]).where("term = 'the'").select(F.input_file_name()).distinct().count() == 6
    assert index.of(["the"]).count() == 60 and index.sizes() == (60, 120)
    assert FullText(spark, str(tmp_path / "blank")).add(spark.createDataFrame([(1, "?")], "doc_id long, text string")).sizes() == (0, 0)


def test_bm25_batch_in_blocks(spark, tmp_path, monkeypatch):
    """queries in several blocks, documents over several batches and blocks, equal documents by key; no pair of query and document is shuffled."""
    from plumbline.operators import fulltext

    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(1, 9)))) for i in range(150)]
    docs += [(1000 - i, docs[i][1]) for i in range(40)]
    index = FullText(spark, str(tmp_path / "index")).add(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = [(f"q{i}", " ".join(rng.choices("abcdefghijk", k=3))) for i in range(12)]
    monkeypatch.setattr(fulltext, "PAIRS", 9)
    monkeypatch.setattr(fulltext, "CELLS", 30)
    got = {(r["q"], r["rank"]): (r["doc"], r["score"]) for r in index.bm25_batch(spark.createDataFrame(asked, "q string, t string"), "q", "t", 4).collect()}
    held = [(d, t.split()) for d, t in docs]
    mean = sum(len(w) for _, w in held) / len(held)
    for q, text in asked:
        terms = {t: math.log(1 + (len(held) - n + 0.5) / (n + 0.5)) for t in sorted(set(text.split())) if (n := sum(t in w for _, w in held))}
        score = {d: sum(idf * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, idf in terms.items()) for d, w in held}
        mine = [got[q, i + 1] for i in range(4)]
        assert [s for _, s in mine] == pytest.approx(sorted(score.values())[: -5 : -1]) and [s for _, s in mine] == pytest.approx([score[d] for d, _ in mine])
        first = {}
        for d, s in mine:  # of equal texts, the smaller key goes first
            assert d >= first.setdefault(dict(docs)[d], d) and (d < 900 or 1000 - d in dict(mine))


# ---- fixes keep rows whose value is unknown -----------------------------------------------------------------------------


def test_row_filters_keep_nulls(spark):
    from datetime import datetime

    df = spark.createDataFrame([("Total", datetime(2030, 1, 1)), (None, None), ("a", datetime(2000, 1, 1)), ("kind", datetime(2001, 1, 1))], "kind string, at timestamp")
    kept = lambda fix: sorted(r["kind"] or "" for r in fix.apply(df).collect())
    assert kept(issues.Fix("drop_summaries", "kind")) == ["", "a", "kind"]
    assert kept(issues.Fix("drop_headers", "kind")) == ["", "Total", "a"]
    assert kept(issues.Fix("keep_until", "at", (datetime(2020, 1, 1),))) == ["", "a", "kind"]
