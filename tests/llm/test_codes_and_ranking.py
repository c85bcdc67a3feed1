"""Binary codes of vectors, ranked search and compressed vectors against brute force, and on odd inputs."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ranked_search, rotated_codes, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int"


# ---- rotated codes ------------------------------------------------------------------------------------------------------


def _brute_links(rows, least=0.95):
    """{row number: (n_links, component_id)} by all pairs."""
    ok = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = [np.array(v, float) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok)]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]) and float(x[i] @ x[j]) >= least:
                n[i] += 1
                n[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least_id = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least_id[find(i)] = min(key, least_id.get(find(i), key))
    return [(key, n[i], least_id.get(find(i))) for i, (key, _) in enumerate(rows)]


def _groups(seed=3, dim=24):
    """Vectors of which some are near copies in chains and groups, in random order of ids."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((260, dim))
    copies = [base[i % 7] + 0.24 * rng.standard_normal(dim) * (i % 5) / 4 for i in range(150)]
    x = np.concatenate([base, np.array(copies), base[:20], 3 * base[:10]])
    ids = rng.permutation(len(x))
    return [(int(i), v.tolist()) for i, v in zip(ids, x)]


@pytest.mark.parametrize("small", [False, True])
def test_links_against_all_pairs(spark, monkeypatch, small):
    if small:  # many cells and parts: rows that visit others
        monkeypatch.setattr(rotated_codes, "CELL_ROWS", 40)
        monkeypatch.setattr(rotated_codes, "LEAST_PART", 16)
        monkeypatch.setattr(rotated_codes, "PART_ROWS", 16)
    rows = _groups()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rotated_codes.links(df).collect())
    want = sorted((k, n, c, k == c) for k, n, c in _brute_links(rows))
    assert sum(n for _, n, _, _ in want) > 500
    assert got == want


def test_links_odd_rows(spark):
    v = [1.0, 2.0, 0.5]
    rows = [(5, v), (5, v), (9, [2.0, 4.0, 1.0]), (None, v), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, float("nan"), 0.0]), (4, [1.0, None, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [1.0, 2.0]), (8, []), (10, [-1.0, -2.0, -0.5]), (11, [1e-300, 2e-300, 5e-301])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS).withColumn("n_links", F.lit("x")).withColumn("node", F.lit(1)).withColumn("v", F.lit(2))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rotated_codes.links(df).collect()), key=repr)
    want = [(5, 4, 5, True), (5, 4, 5, True), (9, 4, 5, False), (None, 4, 5, False), (11, 4, 5, False)] + [(i, 0, i, True) for i in (1, 2, 3, 4, 6, 7, 8, 10)]
    assert got == sorted(want, key=repr)
    assert rotated_codes.links(df.limit(0)).count() == 0
    assert [r[1] for r in rotated_codes.links(df.where("vec_id = 1")).collect()] == [0]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((300, 32)), rng.standard_normal((40, 32))
    true = y @ x.T
    errors = []
    for seed in range(20):
        turn = rotated_codes.rotation(32, 128, seed)
        about, off = rotated_codes.estimate(*rotated_codes.encode(x, turn), y, turn)
        assert (np.abs(about - true) <= off + 1e-3).all()
        errors.append(about - true)
    errors = np.array(errors)
    assert abs(errors.mean()) < 3 * errors.std() / math.sqrt(errors.size / 40)
    # Bounds leave out most pairs that are far apart.
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    turn = rotated_codes.rotation(32)
    about, off = rotated_codes.estimate(*rotated_codes.encode(unit, turn), unit, turn)
    assert (about + off >= 0.95).mean() < 0.1


# ---- ranked search ------------------------------------------------------------------------------------------------------


def _brute_ranks(docs, items, k=10):
    import re

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(i, Counter(w), len(w)) for i, w in ((i, pattern.findall(t.translate(lower))) for i, t in docs if t) if w]
    n, total = len(words), sum(w[2] for w in words)
    df = Counter(t for _, c, _ in words for t in c)
    asked = {}
    for key, t in items:
        asked.setdefault(key, set()).update(pattern.findall((t or "").translate(lower)))
    out = []
    for key, terms in asked.items():
        scored = []
        for i, c, size in words:
            m = 10 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0, i))
        out += [(key, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out)


def _corpus(n=900, seed=5):
    rng = np.random.default_rng(seed)
    names = ["w%d" % i for i in range(60)] + ["Éte", "ete", "x9", "Über"]
    weights = 1 / np.arange(1, len(names) + 1)
    texts = [" ".join(rng.choice(names, rng.integers(1, 60), p=weights / weights.sum())) for _ in range(n)]
    return [(int(i), t) for i, t in zip(rng.permutation(n), texts)]


@pytest.mark.parametrize("small", [False, True])
def test_search_against_all_scores(spark, monkeypatch, small):
    if small:  # several shards a task, all terms in the index, several groups of items
        monkeypatch.setattr(ranked_search, "VOCABULARY", 1)
        monkeypatch.setattr(ranked_search, "ITEM_TERMS", 5)
    docs = _corpus() + [(5000, None), (5001, ""), (5002, "?!"), (5003, "w1 W1, w2\u0000w3"), (5003, "w1 W1, w2\u0000w3"), (5004, "word " * 50_000 + "w50")]
    items = [(1, "w0 w1 w2"), (2, "W50 w51_w52 über"), (3, "éte Éte ete"), (4, None), (5, "nothing"), (6, "w3"), (6, "w40 w3"), (7, "word")] + [(10 + i, " ".join(f"w{j}" for j in range(i, 60, 7))) for i in range(7)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("term", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("y")).withColumn("item", F.lit(0))
    got = sorted(tuple(r) for r in ranked_search.search(d, b).select("item_id", "rank", "doc_id", "score").collect())
    assert got == _brute_ranks(docs, items)
    assert ranked_search.search(d.limit(0), b).count() == 0
    assert ranked_search.search(d, b.limit(0)).count() == 0


def test_blocks_are_the_best_cut():
    rng = np.random.default_rng(2)
    for n in (1, 7, 8, 9, 40, 90):
        x = rng.integers(0, 1000, n)
        u = [x[i : i + 8] for i in range(0, n, 8)]

        def cost(cuts):
            return sum(len(np.concatenate(u[a:b])) * np.concatenate(u[a:b]).max() - np.concatenate(u[a:b]).sum() + 1500 for a, b in zip(cuts, [*cuts[1:], len(u)]))

        every = [[0] + [i + 1 for i in range(len(u) - 1) if bits >> i & 1] for bits in range(1 << (len(u) - 1))]
        got = (ranked_search.blocks(x, cost=1500) // 8).tolist()
        assert cost(got) == min(map(cost, every))


def test_search_reads_few_blocks():
    """A rare term decides: most blocks of the common one are passed over, and the result is exact."""
    rng = np.random.default_rng(8)
    n, m = 20_000, np.full(20_000, 100)
    common = ranked_search._List(np.arange(n, dtype=np.int32), np.where(rng.random(n) < 0.01, 9, 1), m)
    rare = ranked_search._List(np.sort(rng.choice(n, 60, replace=False)).astype(np.int32), np.ones(60, np.int64), m)
    found = ranked_search.Searcher({"common": common, "rare": rare}, n)
    docs, score = found.top([("common", 40), ("rare", 3000)], 10)
    whole = np.zeros(n, np.int64)
    whole[common.docs] += 40 * common.impacts
    whole[rare.docs] += 3000 * rare.impacts
    want = np.lexsort((np.arange(n), -whole))[:10]
    assert docs.tolist() == want.tolist() and score.tolist() == whole[want].tolist()
    assert found.read < n / 3


def test_index_serves_later_searches(spark):
    docs = spark.createDataFrame(_corpus(200), "doc_id long, text string")
    items = spark.createDataFrame([(1, "w3 w20"), (2, "w7")], "item_id long, text string")
    held = ranked_search.index(docs)
    again = ranked_search.search(docs.withColumn("text", F.lit("unread")), items, indexed=held)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ranked_search.search(docs, items).collect()))


# ---- vector codes -------------------------------------------------------------------------------------------------------


def _brute_codes(rows, parts=4, entries=256, rounds=4):
    rows = [(i, v, l) for i, v, l in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    most = Counter(len(v) for _, v, _ in rows).most_common(1)[0][0]
    rows = [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows if len(v) == most]
    cut = [most * i // parts for i in range(parts + 1)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in zip(cut, cut[1:])]

    def near(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            own = {}
            for r in rows:
                own.setdefault(near(r[1][a:b], books[p])[1], []).append(r[1][a:b])
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else e for i, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [near(v[a:b], books[p]) for p, (a, b) in enumerate(zip(cut, cut[1:]))], l) for i, v, l in rows]
    total = Counter()
    for _, f, l in found:
        total[l] += sum(d for d, _ in f)
    return sorted(((i, "".join("%02x" % e for _, e in f), sum(d for d, _ in f), total[l], sha) for i, f, l in found), key=repr)


def test_compress_against_all_distances(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((420, 12))
    x[300:] = np.round(x[300:])  # ties
    x[310:340] = x[300]
    rows = [(int(i), v.tolist(), int(i) % 3 or None) for i, v in zip(rng.permutation(420), x)]
    rows += [(7, x[0].tolist(), 1), (None, x[1].tolist(), 2), (900, None, 1), (901, [1.0] * 11 + [None], 1), (902, [float("nan")] * 12, 1), (903, [float("-inf")] * 12, 1), (904, [0.0] * 12, None), (905, [1.0] * 5, 0), (906, [], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit(1)).withColumn("error", F.lit(2)).withColumn("of", F.lit(3)).repartition(3)
    got = sorted((tuple(r) for r in vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)
    assert got == _brute_codes(rows)
    assert vector_codes.compress(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:9], VECTORS)
    assert sorted((tuple(r) for r in vector_codes.compress(few).collect()), key=repr) == _brute_codes(rows[:9])


def test_tree_is_exact_and_passes_over_branches():
    rng = np.random.default_rng(9)
    entries = rng.integers(-40, 40, (256, 2))
    entries[50:60] = entries[0]
    x = rng.integers(-60, 60, (3000, 2))
    own, best, tried = vector_codes.Tree(entries).nearest(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(-1)
    assert own.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()
    assert tried < d.size / 3
    same = np.tile(entries[:1], (256, 1))
    assert set(vector_codes.Tree(same).nearest(x)[0]) == {0}


def test_decode_gives_the_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(60)]
    df = spark.createDataFrame(rows, VECTORS)
    books = vector_codes.train(df, entries=16)
    coded = vector_codes.encode(vector_codes.kept_rows(df, "vec_id", "embedding")[0], books, 8)
    for r in vector_codes.decode(coded, books).collect():
        want = np.concatenate([books[p][int(r["code"][2 * p : 2 * p + 2], 16)] for p in range(4)])
        assert (np.array(r["decoded"]) * 1024).tolist() == want.tolist()
        assert r["error"] == int(((vector_codes.whole(np.array(rows[r["id"]][1])) - want) ** 2).sum())
    with pytest.raises(ValueError):
        vector_codes.train(spark.createDataFrame([(1, [1e30] * 8, 0)], VECTORS))
