"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming check, connected components.

Null or empty text, or text without words: fingerprint zero, linked like any
other. Repeated rows keep a row each. A null doc_id takes part; it never names
a component unless no document of the component has an id (then null).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, release, settle, small_batches, unnamed

_CASE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles; bit b is set if over half the shingle hashes have it."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_CASE).split() if text else []  # split(): on 0x20 and 0x09-0x0D
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= width:
        return h(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(ends), _STEP):
        some = np.array([h(line[a:b], seed) for a, b in zip(starts[at : at + _STEP], ends[at : at + _STEP])], dtype="<u8")
        ones += _ones(some)
    return _over_half(ones, len(ends))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _over_half(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _sum_of_bits(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    return _over_half(sum((_ones(hashes[at : at + _STEP]) for at in range(0, len(hashes), _STEP)), np.zeros(64, np.int64)), len(hashes))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(k, fp) and the columns in keep: k the key, fp a signed long."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def signed(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["k", "fp", *keep])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(key, text, *keep).mapInArrow(signed, f"k {docs.schema[key].dataType.simpleString()}, fp long{kinds}")


def block_keys(distance: int, blocks: int, bits: int = 64) -> list[list[tuple[int, int]]]:
    """The choices of blocks - distance blocks, each a list of (shift, width): a pair at most `distance` bits apart agrees on all blocks of one choice."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    parts = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [list(c) for c in combinations(parts, blocks - distance)]


def _block_hashes(fp: Column, distance: int, blocks: int) -> list[Column]:
    """A key per choice of blocks."""
    bits = lambda at, w: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1)).cast("string")
    return [F.xxhash64(F.lit(i), F.concat_ws("-", *[bits(at, w) for at, w in c])) for i, c in enumerate(block_keys(distance, blocks))]


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks whose keys have two bits more than it takes to number n fingerprints, so that unrelated ones rarely meet.

    The pairs found are the same with any number of blocks; the number of keys a fingerprint grows with it.
    """
    blocks = distance + 2
    while blocks < 2 * distance + 2 and 64 * (blocks - distance) // blocks < n.bit_length() + 2:
        blocks += 1
    return blocks


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of fingerprints at most `distance` bits apart; every pair is looked at."""
    n = len(fps)
    root = np.arange(n)
    out = []
    for i in range(n - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance)
        for j in near[root[near] != root[i]]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, int(j)))
    return out


def links(fps: DataFrame, distance: int = 4, blocks: int | None = None, limit: int = 8192) -> DataFrame:
    """(a, b): links among the distinct fingerprints `fp` that join exactly those which chains of close pairs join.

    Buckets of up to `limit` fingerprints: all pairs within, of which a spanning
    forest is kept. Larger buckets: each fingerprint meets others at every value
    up to distance / 2 flips away; two are close exactly if they meet, and a
    value is met by so few that no group is unbounded.
    """
    import pandas as pd

    if blocks is None:
        blocks = blocks_for(fps.count(), distance)
    keyed = fps.select("fp", F.explode(F.array(*_block_hashes(F.col("fp"), distance, blocks))).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1")
    hot = settle(sizes.where(F.col("count") > limit).select("key"))
    any_hot = bool(hot.head(1))
    cold = keyed.join(hot, "key", "left_anti") if any_hot else keyed

    def near(batches):
        """Runs of equal keys, over batch ends."""
        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(keys, fp):
            cuts = np.flatnonzero(np.diff(keys)) + 1
            at = np.concatenate([[0], cuts])
            to = np.concatenate([cuts, [len(keys)]])
            a, b = [], []
            two = at[to - at == 2]
            close = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= distance]
            a.append(fp[close])
            b.append(fp[close + 1])
            for s, e in zip(at[to - at > 2], to[to - at > 2]):
                run = fp[s:e]
                if pairs := forest(run.view(np.uint64), distance):
                    i, j = np.array(pairs).T
                    a.append(run[i])
                    b.append(run[j])
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

        for pdf in batches:
            keys = np.concatenate([rest_k, pdf["key"].to_numpy()])
            fp = np.concatenate([rest_f, pdf["fp"].to_numpy()])
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1], "left")
            if last:
                yield found(keys[:last], fp[:last])
            rest_k, rest_f = keys[last:], fp[last:]
        if len(rest_k) > 1:
            yield found(rest_k, rest_f)

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cold.repartition(n, "key").sortWithinPartitions("key", "fp").mapInPandas(near, "a long, b long")
    if any_hot:
        out = out.union(_meet(keyed.join(hot, "key", "left_semi").select("fp").distinct(), distance))
    return out.distinct()


def _meet(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b): links of fingerprints that share a value at most half of `distance` flips from each."""
    import pandas as pd

    masks = [0]
    for k in range(1, (distance + 1) // 2 + 1):
        masks += [sum(1 << i for i in c) for c in combinations(range(64), k)]
    flips = np.array(masks, np.uint64).view(np.int64)

    def around(batches):
        for pdf in batches:
            for some in np.array_split(pdf["fp"].to_numpy(), max(1, len(pdf) // 256)):
                yield pd.DataFrame({"fp": np.repeat(some, len(flips)), "at": (some[:, None] ^ flips[None, :]).ravel()})

    met = fps.mapInPandas(around, "fp long, at long").groupBy("at").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    links = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    # With an odd distance the two halves reach one bit too far.
    return links.where(F.expr(f"bit_count(a ^ b) <= {distance}")) if distance % 2 else links


def _classes(sig: DataFrame, distance: int, blocks: int | None, limit: int) -> DataFrame:
    """(fp, root, component_id) of all distinct fingerprints of sig (k, fp)."""
    fps = settle(sig.groupBy("fp").agg(F.min("k").alias("rep")))
    roots = components(links(fps.select("fp"), distance, blocks, limit))
    of = settle(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    return of.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, distance: int = 4, blocks: int | None = None, limit: int = 8192
) -> DataFrame:
    """key, fp, component_id (the smallest key that chains of close fingerprints reach), one row per input row."""
    sig = settle(fingerprints(docs, key, text, width, seed))
    named = _classes(sig, distance, blocks, limit)
    return sig.join(named, "fp").select(F.col("k").alias(key), "fp", "component_id")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, distance: int = 4, blocks: int | None = None, limit: int = 8192
) -> DataFrame:
    """docs with one row of each component: that with the smallest key (null keys last, equal keys by hash of the text, equal rows once)."""
    names = docs.columns
    docs, key, text = unnamed(docs, key, text)
    name = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    marked = docs.withColumns({"_id": name, "_hash": F.xxhash64(text)})
    sig = settle(fingerprints(marked, key, text, width, seed, keep=("_id", "_hash")))
    named = _classes(sig, distance, blocks, limit)
    row = F.struct(F.col("k").isNull().alias("no"), "k", "_hash", "_id")
    kept = sig.join(named, "fp").groupBy("root").agg(F.min(row).alias("x")).select("x._id", "x._hash")
    out = marked.join(kept, ["_id", "_hash"], "left_semi")
    return out.withColumn("_turn", F.expr("row_number() over (partition by _id, _hash order by _hash)")).where("_turn = 1").select(*docs.columns).toDF(*names)


BANDS, BAND_ROWS = 16, 4  # MinHash bands of a document, and minima in each: of pairs of similarity 0.8, 1 - (1 - 0.8 ** 4) ** 16 = 0.9998 share one
#: Documents up to which a list of them is broadcast, at about 50 bytes each; beyond, a sort-merge join.
BROADCAST_ROWS = 500_000


class _Words(dict):
    """word -> 64-bit hash, kept while there are not too many."""

    def __init__(self, seed: int):
        import xxhash

        self.seed, self.hash = seed, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = self.hash(word, self.seed)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each of them over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 5, of: _Words | None = None) -> np.ndarray:
    """Distinct hashes of the text's word shingles, in ascending order: one of all words if there are fewer than width, none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_CASE).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map((of if of is not None else _Words(42)).__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k, odd in enumerate(_mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)):
        out += h[k : k + len(out)] * odd
    return np.unique(_mixed(out))


def bands(shingle_hashes: np.ndarray, count: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """A key per band: equal in two sets if the minima of `rows` permutations are, so with probability similarity ** rows."""
    at = _mixed(np.arange(1, 2 * count * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    turned, spread = at[::2], at[1::2] | np.uint64(1)
    least = np.full(count * rows, np.iinfo(np.uint64).max)
    for i in range(0, len(shingle_hashes), 64):  # as much as stays in a core's cache
        np.minimum(least, ((shingle_hashes[i : i + 64, None] ^ turned) * spread).min(axis=0), out=least)
    least = least.reshape(count, rows)
    out = np.arange(count, dtype=np.uint64)
    for k in range(rows):
        out = _mixed(out ^ least[:, k])
    return out


def _similar(pairs: DataFrame, of: DataFrame, marked: DataFrame, text: str, width: int, seed: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes (cls, _id, _hash) whose Jaccard similarity over shingles is high enough; shingles are taken again, of candidates only."""
    import pyarrow as pa

    def again(batches):
        known = _Words(seed)
        for b in batches:
            found = [shingles(t.as_py(), width, known).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["cls", "s"])

    pairs = settle(pairs.distinct())
    wanted = settle(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(of, "cls"))
    n = wanted.count()
    if not n:
        return pairs
    found = marked.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, ["_id", "_hash"])
    sets = settle(found.select("cls", text).mapInArrow(again, "cls long, s array<long>").dropDuplicates(["cls"]))
    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    out = settle(both.where(F.expr(f"n >= {similarity}D * (size(sa) + size(sb) - n) - 1e-9D")).select("a", "b"))
    for x in (pairs, wanted, sets):
        release(x)
    return out


def keep_one_by_shingles(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, seed: int = 42, similarity: float = 0.8, distance: int = 4, blocks: int = 6
) -> DataFrame:
    """docs with one row of each group that chains of pairs of at least this Jaccard similarity over word shingles make; the row is that of keep_one.

    Documents with equal sets of shingles count once. Candidates share a choice of
    pigeonhole blocks of their SimHashes, at most `distance` bits apart, or a
    MinHash band: a SimHash of 64 bits differs in about 10 bits at a similarity of
    0.8, more than blocks can find. The sets decide. A bucket is held against its
    first member, and its pairs one by one only where that leaves it apart.
    """
    import pyarrow as pa

    names = docs.columns
    docs, key, text = unnamed(docs, key, text)
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    marked = docs.withColumns({"_id": F.coalesce(F.col(key).cast("string"), F.lit("\x00null")), "_hash": F.xxhash64(text)})

    def signed(batches):
        import xxhash

        known = _Words(seed)
        for b in batches:
            found = [shingles(t.as_py(), width, known) for t in b.column(3)]
            cls = [xxhash.xxh64_intdigest(s.tobytes(), seed) for s in found]
            fps = [_sum_of_bits(s) for s in found]
            keys = pa.array([bands(s).view(np.int64) if len(s) else [] for s in found], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in found], pa.int32())
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cls, fps)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *longs, sizes, keys], ["k", "_id", "_hash", "cls", "fp", "m", "keys"])

    rows = settle(marked.select(key, "_id", "_hash", text).mapInArrow(signed, f"k {kind}, _id string, _hash long, cls long, fp long, m int, keys array<long>"))
    row = F.struct(F.col("k").isNull().alias("no"), "k", "_hash", "_id")
    classes = settle(rows.groupBy("cls").agg(F.min(row).alias("x"), F.max("m").alias("m"), F.max("fp").alias("fp"), F.max("keys").alias("keys")))
    release(rows)
    of = classes.select("cls", "x._id", "x._hash")
    similar = lambda pairs: _similar(pairs, of, marked, text, width, seed, similarity)
    far = F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(64).alias("reach")))
    close = F.array(*[F.struct(k.alias("key"), F.lit(distance).alias("reach")) for k in _block_hashes(F.col("fp"), distance, blocks)])
    dealt = classes.where("m > 0").select("cls", "m", "fp", F.explode(F.concat(far, close)).alias("x")).select("x.key", "x.reach", "cls", "m", "fp")
    shared = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("cls", "m", "fp")).alias("l")).where("n > 1")
    members = settle(dealt.join(shared, "key"))
    fits = f"{{a}}.cls <> b.cls and least({{a}}.m, b.m) >= {similarity}D * greatest({{a}}.m, b.m) - 1e-9D and bit_count({{a}}.fp ^ b.fp) <= b.reach"
    led = members.alias("b").where(fits.format(a="b.l"))
    roots = components(similar(led.select(F.col("b.l.cls").alias("a"), F.col("b.cls").alias("b"))))
    placed = members.where("n > 2").drop("l").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    apart = settle(placed.join(mixed, "key"))
    met = apart.alias("a").join(apart.alias("b"), "key").where(fits.format(a="a") + " and a.cls < b.cls and a.root <> b.root")
    more = similar(met.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")))
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    named = classes.join(roots, F.col("cls") == F.col("node"), "left").groupBy(F.coalesce("root", "cls")).agg(F.min("x").alias("x"))
    kept = settle(named.select("x._id", "x._hash"))
    for x in (members, apart, classes):
        release(x)
    out = marked.join(kept, ["_id", "_hash"], "left_semi")
    return out.withColumn("_turn", F.expr("row_number() over (partition by _id, _hash order by _hash)")).where("_turn = 1").select(*docs.columns).toDF(*names)
