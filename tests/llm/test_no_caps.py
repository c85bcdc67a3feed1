"""Samples that cover the table, words and texts of any length, pages of any depth, columns of any name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, html_text, langid

SF = "/root/testdata/sf0.001"


def test_ann_sample_covers_the_table(spark):
    rows = spark.range(0, 12_000, 1, 12).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    got = np.array([r["id"] for r in ann.draw(rows, 2000, 12_000).collect()])
    assert len(set(got)) == 2000
    per = np.bincount(got // 1000, minlength=12)
    assert per.min() > 100 and per.max() < 240
    same = spark.range(0, 5000, 1, 4).select(F.lit(7).cast("long").alias("id"), F.array(F.lit(1.0)).alias("v"))
    assert ann.draw(same, 100, 5000).count() == 100


def test_langid_words_of_rare_bytes_are_scored_alike():
    pieces = [bytes([b]) for b in range(256)]
    prob = np.full((257, 2), 1e-9)
    prob[:, 1] = 2e-8
    prob[256] = 0
    s = langid.Scorer(pieces, ["a", "b"], prob)
    for n in (30, 45, 48, 49, 200):
        text = "\u0448" * (n // 2)
        total, count = s.totals([text])
        size = len(text.encode())
        assert count[0] == 1
        assert np.allclose(total[0], [size * np.log(1e-9), size * np.log(2e-8)], rtol=1e-5)


def test_langid_counts_drawn_texts_whole(spark):
    df = spark.createDataFrame([(1, "ab " * 3000 + "last", "x")], "doc_id long, text string, lang string")
    got = {bytes(r["word"]): r["n"] for r in langid.language_counts(df, "text", "lang", sample_bytes=100).collect()}
    assert got == {b"ab": 3000, b"last": 1}


def test_html_depth():
    page = "<html><body><div>" + "<span>" * 700 + "<div class=advert>Buy this now, it is cheap and good, buy it now.</div>" + "</span>" * 700
    page += "<article><p>" + "The article has many plain words that go on and on in long sentences. " * 5 + "</p></article></div></body></html>"
    text = html_text.extract(page)
    assert "Buy this" not in text and "The article has" in text


def test_pipeline_with_odd_columns_and_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, docs.first()["text"] + "\nand a line of words " * 5000, "en", "s", 9)], docs.schema)
    every = docs.unionByName(docs.where("doc_id < 20")).unionByName(extra)
    names = ("_lang", "_score", "_n_removed", "_n_lines", "c0", "_id", "k", "node")
    clash = every.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    now, plain = clash, every
    for name, stage in pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), now.schema)
        assert now.columns == clash.columns, name
        plain = spark.createDataFrame(stage(spark, plain, SF).collect(), plain.schema)
        assert now.count() == plain.count() > 0
    assert now.where("doc_id in (1000000, 1000001)").count() == 0
    assert pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
