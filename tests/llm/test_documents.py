"""op5, op8, op9, op10: brute force and odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import common, decontaminate, sharding, simhash, url_filters

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- op5 --------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, distance=4):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    for t in (None, "", " \t\n", "One", "a b c", "a b c d", "A B C D e f g", "x " * 700, "é\u00a0ü b\x0bc d e", "漢 字 " * 9):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


@pytest.mark.parametrize("limit", [8192, 2])
def test_links_in_full_and_crowded_buckets(spark, limit):
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(4):
        base = int(rng.integers(0, 2**63))
        for _ in range(30):
            x = base
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x - 2**64 if x >= 2**63 else x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in common.components(simhash.links(df, limit=limit)).collect()}
    of = {i: x & (2**64 - 1) for i, x in enumerate(sorted(fps))}
    want = Counter(Counter(brute_components(of).values()).values())
    got = Counter(Counter(roots.get(x, x) for x in fps).values())
    assert got == want


def test_near_duplicates_odd_rows(spark):
    rows = [(3, None), (2, ""), (5, " "), (7, "w x y z q " * 9), (7, "w x y z q " * 9), (None, "w x y z q " * 9), (None, "lonely text of its own")]
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert Counter(got) == Counter([(3, 2), (2, 2), (5, 2), (7, 7), (7, 7), (None, 7), (None, None)])
    assert Counter(r.doc_id for r in simhash.keep_one(df).collect()) == Counter([2, 7, None])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (None, 5)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, **{200 + i: 200 for i in range(1, 30)}}


# ---- op8 --------------------------------------------------------------------------------------------------------------


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_filters(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "a-b.example.com", "/"), ("allow", "b.example.com", "/x"), ("block", "example.com", "/")]
    urls = [None, "", "nope", "http://", "http://EXAMPLE.com/en/a?b#c", "https://www.example.com/en/", "http://x.www.example.com/en/1", "http://notexample.com/en/", "ftp://a-b.example.com", "http://a-b.example.com/", "http://q.a-b.example.com/z",
            "http://example-x.com/", "http://b.example.com/xy", "http://net/es/1", "http://q.net/fr/", "http://com?x", "http://.com/", "http://example.com./", "http://a..com/", "x://y://z.com/", "http://" + "s." * 300 + "example.com/en/q"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, table).collect()}
    assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls + urls)}
    assert url_filters.judge(df.limit(0), table).count() == 0
    assert {r.verdict for r in url_filters.judge(df, table.limit(0)).collect()} == {"allow"}


# ---- op9 --------------------------------------------------------------------------------------------------------------


def brute_scan(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit[k : k + n] = [1] * n
        out.append((d, len(w), sum(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_decontamination_against_brute_force(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 2000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()]
    items += [(900, "One Two"), (901, "one, two!"), (902, None), (903, "..."), (None, "three"), (904, "der")]
    passage = items[0][1]
    docs += [(5000, "x one two y"), (5001, f"start {passage.upper()} end"), (5002, None), (5003, ""), (5003, ""), (None, "three one two"), (5004, "word " * 5000 + passage), (5005, passage + " " + passage)]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(d, b, block_bytes=block_bytes)
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in found.collect()) == brute_scan(docs, items)
    longest = {m.item_id: m.words for m in found.where("doc_id = 5001").first().matches}
    assert longest[str(items[0][0])] == len(decontaminate.words(passage))
    assert decontaminate.remove(d, b).count() == found.where("n_hit = 0").count()
    assert decontaminate.scan(d.limit(0), b).count() == 0
    assert decontaminate.scan(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.digest(["1", "2"]) == hashlib.sha256(b"1,2").hexdigest()


# ---- op10 -------------------------------------------------------------------------------------------------------------


def test_sharding(spark):
    rows = [(i, "é" * (i % 7)) for i in range(3000)] + [(None, "x"), (None, None), (5, "é" * 5), (5, "é" * 5), (9999, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, size int")
    got = sharding.assign(df, [1.0] * 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        assert 0 <= r.shard < 8 and r.law == "key" and r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(300 < len(s) < 450 for s in slots.values())
    moved = sum(r.grown_shard == 8 for r in got)
    assert 230 < moved < 440
    nine = {r.doc_id: r.shard for r in sharding.assign(df, [1.0] * 9).collect()}
    assert all(nine[r.doc_id] == r.grown_shard for r in got)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert sharding.assign(df.limit(0), [1.0] * 8).count() == 0


def test_weights(spark):
    df = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0, 0.0, 4.0]).alias("s"))
    share = {r.s: r["count"] / 20_000 for r in df.groupBy("s").count().collect()}
    assert set(share) == {0, 1, 3} and share[0] == pytest.approx(0.125, abs=0.02) and share[3] == pytest.approx(0.5, abs=0.02)
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [0.0])
