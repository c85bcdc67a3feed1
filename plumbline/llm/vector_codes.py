"""Compressed vectors: a codebook for each part of the vector, nearest entries found in vantage-point trees.

Components become whole numbers floor(1024 x). A tree stands over the entries of
each part's codebook: a vantage entry, and the others in two halves by their
distance from it. A branch is passed over only if the triangle inequality, with
distances rounded so that the bound errs towards visiting, puts all of its entries
farther away than the nearest so far; a branch that may hold one just as near is visited, as ties
go to the lower index. What is compared in the end are whole numbers, so the result is exact.

Training rounds add up the parts of each entry in the tasks; codebooks (256 entries a
part) are all that reaches the driver. The table is read once a round, never shuffled.

Vectors that are null or hold null or non-finite components are dropped; so are
those of another length than most, which fit no codebook. Lengths that four does not
divide give parts that differ by one. Repeated rows and ids: a row each; among equal
ids the smaller vector comes first in the codebook; a null id comes last. Fewer
than 256 rows make fewer entries. An empty table gives an empty result. Components whose squares
could leave 64 bits stop the job with a ValueError. Other columns than id,
vector and label are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ann import _matrix
from plumbline.llm.common import small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF = 12
_UP, _DOWN = 1 + 2.0**-50, 1 - 2.0**-50  # more than the error of a square root and a difference of doubles


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[x, y]: squared distances of whole-number rows."""
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)


class Tree:
    """A vantage-point tree over the rows of `entries`, whole numbers."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        self.root = self._grown(np.arange(len(entries)))

    def _grown(self, some: np.ndarray):
        if len(some) <= self.leaf:
            return some
        vantage, rest = some[0], some[1:]
        d = _squared(self.entries[vantage : vantage + 1], self.entries[rest])[0]
        middle = np.partition(d, len(d) // 2)[len(d) // 2]
        halves = []
        for inside in (d < middle, d >= middle):
            if inside.any():
                near, far = math.sqrt(d[inside].min()) * _DOWN, math.sqrt(d[inside].max()) * _UP
                halves.append((near, far, self._grown(rest[inside])))
        return vantage, halves

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of each row's nearest entry, the lower at ties, its squared distance, and how many distances were worked out."""
        own, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        self.tried = 0
        if len(x):
            self._visit(self.root, np.arange(len(x)), x, own, best)
        return own, best, self.tried

    def _hold(self, rows, index, d, own, best):
        better = (d < best[rows]) | ((d == best[rows]) & (index < own[rows]))
        own[rows[better]], best[rows[better]] = index[better] if np.ndim(index) else index, d[better]

    def _visit(self, node, rows, x, own, best):
        if isinstance(node, np.ndarray):
            for at in range(0, len(rows), 2048):
                some = rows[at : at + 2048]
                d = _squared(x[some], self.entries[node])
                self.tried += d.size
                first = d.argmin(axis=1)  # node is in ascending order, so this is the lower index at ties
                self._hold(some, node[first], d[np.arange(len(some)), first], own, best)
            return
        vantage, halves = node
        d = ((x[rows] - self.entries[vantage]) ** 2).sum(axis=1)
        self.tried += len(rows)
        self._hold(rows, np.full(len(rows), vantage), d, own, best)
        away = np.sqrt(d.astype(np.float64))
        # Each row goes first where its distance from the vantage entry lies, or lies nearest.
        gaps = np.stack([np.maximum(0, np.maximum(near - away * _UP, away * _DOWN - far)) for near, far, _ in halves])
        first = gaps.argmin(axis=0)
        for turn in (0, 1):
            for i, (_, _, child) in enumerate(halves):
                going = (first == i) if turn == 0 else (first != i)
                going &= gaps[i] * _DOWN <= np.sqrt(best[rows].astype(np.float64)) * _UP
                if going.any():
                    self._visit(child, rows[going], x, own, best)


def finite(v: Column) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(False))


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE).astype(np.int64)


def edges(dim: int, parts: int = PARTS) -> list[int]:
    return [dim * i // parts for i in range(parts + 1)]


def kept_rows(vectors: DataFrame, key: str, vector: str, label: str | None = None) -> tuple[DataFrame, int]:
    """(id, v[, label]) of the vectors that take part, and their length."""
    more = [F.col(label).alias("label")] if label else []
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), *more).where(finite(F.col("v")) & (F.size("v") > 0))
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), largest.alias("m")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return rows, 0
    if dims["m"] * SCALE >= 2**30 / math.sqrt(dims["d"]):
        raise ValueError(f"components up to {dims['m']:g}: squared distances would leave 64 bits")
    return rows.where(F.size("v") == dims["d"]), dims["d"]


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks: for each part position, [entry, component] of whole numbers."""
    rows, dim = kept_rows(vectors, key, vector)
    return _trained(rows, dim, parts, entries, rounds) if dim else []


def _trained(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    import pyarrow as pa

    spark = rows.sparkSession
    small_batches(spark)
    cut = edges(dim, parts)
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    start = whole(np.array([r["v"] for r in first]))
    books = [start[:, a:b] for a, b in zip(cut, cut[1:])]
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast([Tree(b) for b in books])

        def added(batches):
            trees = shipped.value
            sums = [np.zeros_like(t.entries) for t in trees]
            counts = [np.zeros(len(t.entries), np.int64) for t in trees]
            for b in batches:
                x = whole(_matrix(b.column(0)))
                for p, t in enumerate(trees):
                    if len(x):
                        own, _, _ = t.nearest(x[:, cut[p] : cut[p + 1]])
                        np.add.at(sums[p], own, x[:, cut[p] : cut[p + 1]])
                        counts[p] += np.bincount(own, minlength=len(counts[p]))
            for p, (s, n) in enumerate(zip(sums, counts)):
                e, w = np.nonzero(n)[0], s.shape[1]
                if len(e):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(e) * w, p, np.int32)), pa.array(np.repeat(e, w).astype(np.int32)), pa.array(np.tile(np.arange(w, dtype=np.int32), len(e))), pa.array(s[e].ravel()), pa.array(np.repeat(n[e], w))],
                        ["part", "entry", "place", "s", "n"],
                    )

        sums = rows.select("v").mapInArrow(added, "part int, entry int, place int, s long, n long").groupBy("part", "entry", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        got = sums.toArrow().to_pydict()  # at most entries x dim rows
        books = [b.copy() for b in books]
        for p, e, w, s, n in zip(*(got[c] for c in ("part", "entry", "place", "s", "n"))):
            books[p][e, w] = s // n
        shipped.destroy()
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], dim: int, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """rows (id, v, ...): the kept columns, code (two hex digits a part) and error (squared distances, summed)."""
    import pyarrow as pa

    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    cut = edges(dim, len(books))

    def coded(batches):
        for b in batches:
            x = whole(_matrix(b.column(0)))
            if not len(x):
                continue
            found = [t.nearest(x[:, a:c]) for t, a, c in zip(trees.value, cut, cut[1:])]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], [*b.schema.names[1:], "code", "error"])

    held = rows.select("v", *keep)
    form = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return held.mapInArrow(coded, f"{form}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], column: str = "code") -> DataFrame:
    """codes with `decoded`, the entries' components put together and scaled back; a null code gives null."""
    spark = codes.sparkSession
    flat = [(f"{p}-{e:02x}", [x / SCALE for x in row]) for p, b in enumerate(books) for e, row in enumerate(b.tolist())]
    lookup = spark.createDataFrame([(dict(flat),)], "_entries map<string, array<double>>")
    pieces = [F.col("_entries")[F.concat(F.lit(f"{p}-"), F.substring(column, 2 * p + 1, 2))] for p in range(len(books))]
    return codes.join(F.broadcast(lookup)).withColumn("decoded", F.concat(*pieces)).drop("_entries")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error (errors summed over the rows of its label, nulls together), codebooks_sha256."""
    rows, dim = kept_rows(vectors, key, vector, label)
    kind = vectors.schema[key].dataType.simpleString()
    if not dim:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, code string, error long, label_error long, codebooks_sha256 string")
    books = _trained(rows.select("id", "v"), dim, parts, entries, rounds)
    coded = encode(rows, books, dim, ("id", "label"))
    summed = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    both = coded.join(summed, F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
