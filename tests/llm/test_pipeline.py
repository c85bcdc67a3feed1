"""The pipeline's stages, each held against what it should keep of its own input."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from plumbline.llm import decontaminate, line_dedup, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34 !!", "en", "s", 8)], docs.schema)
    now = docs.unionByName(extra)
    seen = {}
    for name, stage in pipeline.STAGES:
        before, now = now, stage(spark, now, SF)
        rows = now.collect()
        now = spark.createDataFrame(rows, now.schema)
        seen[name] = (before, now)
        if name != "encode":
            assert now.columns == docs.columns
    before, after = seen["language"]
    assert before.count() - after.count() == 2 and after.where("doc_id >= 1000000").count() == 0
    before, after = seen["lines"]
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0
    assert line_dedup.dedup(after).agg(F.sum("_n_removed")).first()[0] == 0
    before, after = seen["near_duplicates"]
    groups = simhash.near_duplicates(before)
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.component_id for r in groups.select("component_id").distinct().collect())
    before, after = seen["decontaminate"]
    hit = decontaminate.scan(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0")
    assert hit.count() > 0 and after.count() == before.count() - hit.count()
    before, after = seen["encode"]
    assert after.count() == before.count() and after.where("size(ids) <> n_tokens").count() == 0


def test_run_gives_the_stages_rows(spark):
    got = pipeline.run(spark, SF)
    assert got.columns[:2] == ["doc_id", "n_tokens"] and got.count() > 100


def test_near_duplicates_reach_jaccard(spark):
    """Edited copies at 0.8 and more go, those below stay: brute force over all pairs."""
    import random

    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(4, 200))]
        for c in range(5):
            w = list(base)
            for e in range(rng.randint(0, 1 + len(base) // 40)):
                w[rng.randrange(len(w))] = f"x{g}.{c}.{e}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, ""), (901, None), (902, "one two"), (903, "One  two"), (903, "One  two")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if (len(a & sets[j]) >= 0.8 * len(a | sets[j]) if a or sets[j] else True) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    want = sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs.repartition(3), SF).collect())
    assert got == want
