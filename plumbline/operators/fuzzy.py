"""Texts that are nearly equal: an exact similarity self-join by segments (JN-09, STR-09).

The ratio of two texts is 2 M / (n + m), M the characters in their matching blocks.
Those keep their order, so a ratio of r or more leaves at most (1 - r)(n + m)
characters to delete or insert. If the shorter text is cut into two segments more than that
may damage one each, at least two segments stand in the longer text unchanged, and
no farther from their place than the characters left over can shift them. So candidates share a
segment: (length, number, characters) is the key of the join. Segments that many
texts share are no key by themselves: as a pair has two in common, those count in twos only.
Candidates then pass an edit-distance bound in the JVM; the ratio itself is worked
out for what is left.

Texts of more than SHORT characters have many segments of few characters each, and
their keys and twos grow with the square of the length. They meet by length, block
by block: no pair is listed that the bigrams rule out. M matching characters stand in
1 + n + m - 2 M blocks at most, so of their bigrams 3 M - 1 - n - m or more are whole in
both texts. One matrix product a pair of blocks counts those common to two texts. That compares
all texts of near lengths, which is quadratic, but two numbers a pair of texts and nothing shuffled for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import q, strip
from plumbline.plans.shared import settled

LEAST_RATIO = 0.85  # below it, short texts would have fewer characters than segments
FREQUENT = 8  # texts that share a segment of one length and place
SHORT = 20  # characters; longer texts meet in blocks
BLOCK = 4096  # texts of one length in a block, fewer if they are long
_AT_ONCE = 1 << 21  # numbers of a product in memory


def _spare(r: float, total: str) -> str:
    """SQL: characters that texts of so many characters together may leave unmatched."""
    return f"cast(floor({1 - r!r}D * ({total}) + 1e-9D) as int)"


def _segments(r: float, length: int, n: str) -> str:
    """SQL: the number of segments of a text of n characters."""
    longest = f"least({n} + {length}, cast(floor({n} * {(2 - r) / r!r}D + 1e-9D) as int))"
    return f"({_spare(r, f'{n} + {longest}')} + 2)"


def _cut(text: str, n: str, k: str, i: str) -> tuple[str, str]:
    """SQL: where segment i of k begins, and its width."""
    begin = f"cast(floor({i} * {n} / {k}) as int)"
    return begin, f"(cast(floor(({i} + 1) * {n} / {k}) as int) - {begin})"


def shorter_keys(texts: DataFrame, r: float, length: int) -> DataFrame:
    """(t, i, key): the segments of each text."""
    k = _segments(r, length, "n")
    begin, width = _cut("t", "n", "k", "i")
    some = texts.selectExpr("t", "length(t) as n").selectExpr("t", "n", f"{k} as k").where("k > 2")
    each = some.selectExpr("t", "n", "k", "explode(sequence(0, k - 1)) as i")
    return each.selectExpr("t", "i", f"xxhash64(n, i, substring(t, {begin} + 1, {width})) as key")


def longer_keys(texts: DataFrame, r: float, length: int) -> DataFrame:
    """(t, n, i, key): what may be segments of texts of n characters, n no more than its own."""
    least = f"greatest(1, cast(ceil(m * {r / (2 - r)!r}D - 1e-9D) as int), m - {length})"
    one = texts.selectExpr("t", "length(t) as m").where("m > 0").selectExpr("t", "m", f"explode(sequence({least}, m)) as n")
    one = one.selectExpr("t", "m", "n", f"{_spare(r, 'n + m')} as spare", f"{_segments(r, length, 'n')} as k").where("spare > 0 and m - n <= spare")
    one = one.selectExpr("t", "m", "n", "k", "(spare - (m - n)) div 2 as back", "(spare + (m - n)) div 2 as ahead", "explode(sequence(0, k - 1)) as i")
    begin, width = _cut("t", "n", "k", "i")
    one = one.selectExpr("t", "m", "n", "i", f"{begin} as begin", f"{width} as width", "back", "ahead")
    one = one.selectExpr("t", "n", "i", "width", "explode(sequence(greatest(0, begin - back), least(m - width, begin + ahead))) as at").where("at >= 0")
    return one.selectExpr("t", "n", "i", "xxhash64(n, i, substring(t, at + 1, width)) as key").distinct()


def candidates(texts: DataFrame, r: float = 0.88, length: int = 5, frequent: int = FREQUENT) -> DataFrame:
    """(x, y) of the distinct texts (t) that share what similar ones must, x the shorter; a superset of the similar pairs, with repetitions."""
    index, asked = shorter_keys(texts, r, length), longer_keys(texts, r, length)
    counts = index.groupBy("key").agg(F.count("*").alias("texts"))
    known = asked.join(counts, "key")
    rare = index.join(counts.where(f"texts <= {frequent}"), "key").select("key", F.col("t").alias("x"))
    single = rare.join(known.where(f"texts <= {frequent}").select("key", F.col("t").alias("y")), "key").select("x", "y")
    # Frequent segments, two of one text at a time, in the order of their numbers.
    twos = F.flatten(F.transform("held", lambda a: F.transform(F.filter("held", lambda b: a["i"] < b["i"]), lambda b: F.xxhash64(a["key"], b["key"]))))
    held = F.array_sort(F.collect_set(F.struct("i", "key"))).alias("held")
    often = counts.where(f"texts > {frequent}").select("key")
    left = index.join(often, "key").groupBy(F.col("t").alias("x")).agg(held).select("x", F.explode(twos).alias("key"))
    right = known.where(f"texts > {frequent}").groupBy(F.col("t").alias("y"), "n").agg(held).select("y", F.explode(F.array_distinct(twos)).alias("key"))
    both = left.join(right, "key").select("x", "y")
    return single.unionByName(both)


def _bigrams(texts: list[str], n: int, buckets: int) -> np.ndarray:
    """[text, bucket]: 1 where a bigram falls, its first, second, ... occurrence each in a bucket of its own. Two in one bucket make texts look more alike than they are, which loses no pair."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), n).astype(np.uint64)
    g = np.sort(c[:, :-1] << np.uint64(21) | c[:, 1:], axis=1)
    place = np.arange(n - 1)[None, :]
    first = np.maximum.accumulate(np.where(np.diff(g, axis=1, prepend=np.uint64(1 << 63)) != 0, place, 0), axis=1)
    h = (g << np.uint64(20) ^ (place - first).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.zeros((len(texts), buckets), np.float32)
    out[np.arange(len(texts))[:, None], ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)] = 1
    return out


def met(texts: DataFrame, r: float = 0.88, length: int = 5, block: int = BLOCK) -> DataFrame:
    """(x, y) of the distinct texts (t, of two characters or more) whose bigrams leave room for the ratio, x the shorter; a superset of the similar pairs.

    A task holds two blocks of texts of one length each.
    """

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, m = int(key[0]), int(key[2])
        x, y = rows["t"][~rows["second"]].tolist(), rows["t"][rows["second"]].tolist()
        same = n == m and key[1] == key[3]
        buckets = 1 << (16 * m - 1).bit_length()
        whole = 3 * int(np.ceil(r * (n + m) / 2 - 1e-9)) - 1 - n - m
        found: list = []
        b = _bigrams(y, m, buckets)
        least_b = b.sum(axis=1) - (m - 1 - whole)
        step = max(1, _AT_ONCE // len(y)) if y else 1
        for s in range(0, len(x) if y else 0, step):
            a = _bigrams(x[s : s + step], n, buckets)
            least = np.maximum((a.sum(axis=1) - (n - 1 - whole))[:, None], least_b[None, :])
            i, j = np.nonzero(a @ b.T >= least)
            if same:
                i, j = i[i + s < j], j[i + s < j]
            found += [(x[p + s], y[q]) for p, q in zip(i, j)]
        return pd.DataFrame(found, columns=["x", "y"], dtype=object)

    sized = texts.select("t", F.length("t").alias("n")).where("n > 1")
    blocks = sized.groupBy("n").agg(F.expr(f"cast(ceil(count(*) / greatest(32, least({block}, {1 << 19} div n))) as int)").alias("blocks"))
    each = blocks.select("n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = each.select("n", "block", F.explode(F.sequence("n", F.col("n") + length)).alias("m"))
    pairs = asked.join(each.toDF("m", "other"), "m").where(f"(n < m or block <= other) and 2.0D * n / (n + m) >= {r!r}D - 1e-9D")
    placed = sized.join(blocks, "n").select("t", "n", F.pmod(F.xxhash64("t"), "blocks").cast("int").alias("block"))
    one = placed.join(pairs, ["n", "block"]).select("n", "block", "m", "other", "t", F.lit(False).alias("second"))
    two = placed.toDF("t", "m", "other").join(pairs, ["m", "other"]).select("n", "block", "m", "other", "t", F.lit(True).alias("second"))
    return one.unionByName(two).groupBy("n", "block", "m", "other").applyInPandas(meet, "x string, y string")


def close(x: Column, y: Column, r: float) -> Column:
    """Bounds that the ratio implies: lengths, and the distance of edits that the unmatched characters leave room for."""
    n, m = F.length(x), F.length(y)
    return (2.0 * F.least(n, m) / (n + m) >= r) & (F.levenshtein(x, y) <= F.floor((1 - r) * (n + m) + 1e-9))


def matching(a: Column, b: Column) -> Column:
    """The ratio of matching blocks."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)

    return ratio(a, b)


def similar_pairs(values: DataFrame, column: str, ratio: float = 0.88, length: int = 5, frequent: int = FREQUENT) -> DataFrame:
    """a, b, ratio of distinct texts, white space off their ends, a < b: of `ratio` or more when lower-cased, not equal then, lower-cased lengths at most `length` apart.

    Null and empty texts have no partner. Ratios below LEAST_RATIO are refused.
    """
    if ratio < LEAST_RATIO:
        raise ValueError(f"a ratio of {LEAST_RATIO} at least")
    v = values.where(q(column).isNotNull()).select(strip(q(column)).alias("v")).distinct().withColumn("t", F.lower("v"))
    v = settled(v, "texts")
    texts = v.select("t").distinct()
    # Both of a pair are longer, or the shorter has a partner of `length` more at most.
    pairs = candidates(texts.where(F.length("t") <= SHORT + length), ratio, length, frequent).unionByName(met(texts.where(F.length("t") > SHORT), ratio, length))
    pairs = pairs.where((F.col("x") != F.col("y")) & close(F.col("x"), F.col("y"), ratio))
    pairs = pairs.where(F.abs(F.length("x") - F.length("y")) <= length).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    one, two = v.toDF("v1", "x"), v.toDF("v2", "y")
    named = pairs.join(one, "x").join(two, "y").select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b"))
    return named.select("a", "b", matching(F.lower("a"), F.lower("b")).alias("ratio")).where(F.col("ratio") >= ratio)
