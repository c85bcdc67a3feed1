"""op1, op2, op3: brute force, held-out accuracy, exact round trips, and odd inputs."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, bpe, langid, queries

SF = "/root/testdata/sf0.001"


# ---- op1 --------------------------------------------------------------------------------------------------------------


def nearest(rows, queries_, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in queries_:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        keep = ids != q
        o = np.lexsort((ids[keep], d[keep]))[:k]
        out[q] = list(zip(ids[keep][o].tolist(), d[keep][o].tolist()))
    return out


def test_ann_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = nearest(rows, [i for i, _ in rows if i % 20 == 0])
    got = {}
    for r in ann.search(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 11)) for g in got.values())
    hits = [len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want]
    assert sum(hits) / (10 * len(hits)) >= 0.9
    for q, g in got.items():
        scores = [g[k][1] for k in range(1, 11)]
        assert scores == sorted(scores)


def test_ann_exact_when_small_and_odd_rows_stay_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (100, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 2), (100, 2, 0), (100, 3, 1)]


def test_ann_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + [(i, [float(i), 1.0, 0.0, 2.0]) for i in range(100, 160)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [v for _, v, _ in sorted(got[40])] == list(range(10))
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 11))
    want = nearest(rows, [120])
    assert [v for _, v, _ in sorted(got[120])] == [v for v, _ in want[120]]


def test_ann_repeated_ids(spark):
    """Two vectors under one id, and many equal rows of one id: a row leaves out itself alone."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(30)]
    rows += [(100, [1.0] * 6), (100, [-1.0] * 6), *[(200, [5.0] * 6)] * 13, *[(7, [5.0] * 6)] * 2]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, probes=99, exact=99).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = {}
    for n, (i, v) in enumerate(rows):
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - w) ** 2).sum())), j) for m, (j, w) in enumerate(rows) if m != n)[:10]
            want.setdefault(i, []).extend((rank + 1, pytest.approx(s), j) for rank, (s, j) in enumerate(near))
    assert got.keys() == want.keys()
    for q in want:
        assert sorted(got[q], key=lambda x: (x[0], x[1], x[2])) == sorted(want[q], key=lambda x: (x[0], x[1].expected, x[2]))


def test_ann_discards_by_its_tables(spark):
    """50,000 vectors in clusters: few cells are probed, and most rows of them are left out by their codes."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(60, 24)) * 4
    x = (centers[rng.integers(60, size=50_000)] + rng.normal(size=(50_000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    model, total = ann.fit(rows)
    own = model.cells(x.astype(np.float64))
    sizes = np.bincount(own, minlength=len(model.centroids))
    assert model.probes < len(model.centroids) / 5
    assert sizes[sizes > model.exact].sum() > 0.5 * len(x) and model.exact < 0.7 * sizes.mean()
    got = {}
    for r in ann.search(df, F.col("vec_id") % 500 == 0, model=(model, total)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 500):
        d = ((x.astype(np.float64) - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 100 and hits / 1000 >= 0.9


@pytest.mark.parametrize("copies", [False, True])
def test_ann_queries_unlike_the_table(spark, copies):
    """Tight clusters, or copies, whose queries lie elsewhere: the sample alone would probe too few cells."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(300, 24))
    x = np.repeat(centers, 40, axis=0) if copies else centers[rng.integers(300, size=12_000)] + 0.05 * rng.normal(size=(12_000, 24))
    x[::100] = rng.normal(size=(120, 24))
    x[1::10] = rng.normal(size=(1200, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest(list(enumerate(x)), range(0, 12_000, 100))
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) / 1200 >= 0.9


def test_ann_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(df, F.col("vec_id") % 100 == 0).count() == 0


# ---- op2 --------------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba"]
    lattice, p = langid.Lattice(pieces), np.array([0.3, 0.2, 0.25, 0.15, 0.1, 0.0])

    def total(w):
        return 1.0 if not w else sum(p[i] * total(w[len(x) :]) for i, x in enumerate(pieces) if w.startswith(x))

    for w in (b"a", b"ab", b"abab", b"baaab", b"abaaba"):
        assert langid.forward(lattice.ids([w]), p)[0, -1] == pytest.approx(total(w), rel=1e-12)


def test_long_words_are_scored_whole():
    """The scaled pass gives what the plain one does, and long runs what exact fractions do."""
    from fractions import Fraction

    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"bc", b"abc", b"ca", "漢字".encode(), "字".encode()})
    rng = np.random.default_rng(4)
    prob = np.vstack([rng.dirichlet(np.full(len(pieces), 0.3), size=2).T + 1e-9, np.zeros((1, 2))])
    lattice = langid.Lattice(pieces)
    short = [b"a", b"abcab", b"cabcabca", "漢字字".encode()]
    got = langid.log_forward(lattice, short, prob)
    assert np.allclose(got, np.log([langid.forward(lattice.ids([w]), prob)[0, -1] for w in short]), rtol=1e-12)
    word = (b"abc" * 40 + "漢字".encode() * 60)[:401]
    exact = [Fraction(0)] * len(word) + [Fraction(1)]
    for s in range(len(word) - 1, -1, -1):
        exact[s] = sum(Fraction(float(prob[i, 0])) * exact[s + len(p)] for i, p in enumerate(pieces) if word.startswith(p, s))
    want = math.log(exact[0].numerator) - math.log(exact[0].denominator)
    assert langid.log_forward(lattice, [word, b"ab"], prob)[0, 0] == pytest.approx(want, rel=1e-9)
    assert [b"".join(langid.cut(w)) for w in (word, b"x" * 200)] == [word, b"x" * 200]
    assert all(len(p) <= langid.MAX_WORD and p.decode() for p in langid.cut("漢".encode() * 50))


def test_predictions_against_all_segmentations(spark):
    """Whole texts, by a plain sum over segmentations written here, from the trained probabilities."""
    import regex

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 10 = 3")
    pieces, langs, prob = langid.train(docs, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    at = {p: i for i, p in enumerate(pieces)}

    def log_sum(word):
        a = [np.ones(len(langs))]
        for end in range(1, len(word) + 1):
            a.append(sum((a[s] * prob[at[word[s:end]]] for s in range(max(0, end - 12), end) if word[s:end] in at), np.zeros(len(langs))))
        return np.log(a[-1])

    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, (pieces, langs, prob)).collect()}
    known = {}
    for r in docs.collect():
        found = [w.encode() for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", r.text.lower())]
        if not found:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        known |= {w: log_sum(w) for w in set(found) - known.keys()}
        total = sum(known[w] for w in found)
        assert got[r.doc_id][0] == langs[int(np.argmax(total))]
        assert got[r.doc_id][1] == pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op2_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and held
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    zlib = __import__("zlib")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_of_odd_texts(spark):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    rows = [(1, None), (2, ""), (3, "12 + 3 = 15 !!"), (4, "the the the and of"), (4, "the the the and of"), (None, "und der die das"), (5, "x" * 5000), (6, "漢字 и русский")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, score string")
    got = langid.predict(df, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.score == 0 for r in got[:3])
    assert got[3] == got[4] and got[3].lang_pred == "en" and got[5].lang_pred == "de"
    assert all(r.lang_pred in model[1] for r in got[3:])
    assert langid.predict(df.limit(0), model).count() == 0
    nothing = langid.train(df.withColumn("lang", F.lit(None).cast("string")), queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


# ---- op3 --------------------------------------------------------------------------------------------------------------


def library(text):
    from tokenizers import Tokenizer

    library.t = getattr(library, "t", None) or Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    ids = library.t.encode(text or "", add_special_tokens=False).ids
    back = library.t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_bpe_against_the_library(spark):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "<|end", "é", "漢", "1", "٣", "²", "\x1c", "\x85", "\u00a0", "!", "…", "ß", "𝒳", "😀", "\r\n", "_"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(1000 + c, f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}") for c in range(0x2100)]
    rows += [(5000, None), (5001, ""), (None, "x y"), (5002, " " * 300), (5003, "word " * 60_000), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    out = bpe.round_trip(df.repartition(5), queries.tokenizer_file("byte_bpe_50k.json"))
    got = sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())))
    assert got == sorted(map(repr, ((i, *library(t)) for i, t in rows)))


def test_bpe_small_blocks_and_decoding(spark, monkeypatch):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    back = bpe.decode(bpe.encode(docs, path), path).select("doc_id", F.col("text").alias("back"))
    assert docs.join(back, "doc_id").where("text = back").count() == docs.count()
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_bpe_deals_blocks_evenly(spark):
    """Eight tasks, a block each, onto four partitions: two blocks each."""
    docs = spark.range(0, 80, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    out = bpe.round_trip(docs, queries.tokenizer_file("byte_bpe_50k.json"))
    assert [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()] == [20] * 4


def test_bpe_block_takes_few_bytes_a_token():
    """The table of a block of 200,000 words of three tokens, and what it takes to build it."""
    import tracemalloc

    import pyarrow as pa

    n, rng = 200_000, np.random.default_rng(5)
    pieces, slots, ids = [b"%05d" % i for i in range(50_000)], rng.permutation(n).astype(np.uint32), rng.integers(0, 50_000, 3 * n).astype(np.uint32)
    body = [bpe._pack(x) for x in (slots, np.full(n, 3, np.uint32), ids)]
    part = bytes(8) + b"".join(len(x).to_bytes(4, "little") + x for x in body)
    asked = np.array([0, n - 1, 0], np.uint32)
    rows = [(0, None, part), (1, None, bytes(8)), (2, 7, bpe._pack(asked)), (2, 8, bpe._pack(asked[:0]))]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * 4), pa.array([k for k, _, _ in rows], pa.int32()), pa.array([k for _, k, _ in rows], pa.int64()), pa.array([a for _, _, a in rows], pa.binary())], ["block", "kind", "key", "a"]
    )
    tracemalloc.start()
    (got,) = bpe._joined(pieces, iter([batch]), True, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [int(i) for s in asked for i in ids.reshape(n, 3)[np.flatnonzero(slots == s)[0]]]
    assert got.column(4).to_pylist() == [want, []] and got.column(5).to_pylist() == ["".join("%05d" % i for i in want), ""]
    assert peak < 150 * n, peak


def test_bpe_notices_a_changed_second_read(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    shaky = docs.withColumn("text", F.concat("text", F.udf(lambda: str(random.random()), "string").asNondeterministic()()))
    with pytest.raises(Exception):
        bpe.round_trip(shaky, queries.tokenizer_file("byte_bpe_50k.json")).collect()


def test_langid_sample_keeps_every_language(spark):
    """Many languages, one unspaced and one of few long documents: none is lost, and none loses words to the others."""
    rows = [(f"a{i:02d}", " ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in range(8000))) for i in range(40)]
    unspaced = ["".join(chr(0x4E00 + (i * 977 + j * j * 31 + j) % 20000) for j in range(400)) for i in range(20)]
    rows += [("zu", t) for t in unspaced] + [("zz", f"lang{chr(97 + i)} " * 400_000) for i in range(3)]
    df = spark.createDataFrame([(i, la, t) for i, (la, t) in enumerate(rows)], "doc_id long, lang string, text string").repartition(4)
    got = langid.sample_counts(df, by=F.xxhash64("doc_id"), sample_bytes=20_000)
    full = langid.sample_counts(df, by=F.xxhash64("doc_id"))
    assert set(got) == set(full) == {la for la, _ in rows}
    assert all(len(full[f"a{i:02d}"]) == 8000 for i in range(40))
    assert set(full["zu"]) == {w for t in unspaced for w in langid.words(t)} and len(got["zz"]) == 3
