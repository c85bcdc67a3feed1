"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on a bounded sample
(SAMPLE vectors, copies left out). So are two numbers, on the true neighbours, within
the sample, of TRIALS of its vectors: the cells to probe, the fewest that hold
TARGET_RECALL of them, and the rows of a cell to measure exactly, the fewest among
which the asymmetric distance tables rank TARGET_RANKED of them. Queries need not be like the
table: TRIALS of them are held against all rows by brute force, and both numbers are raised to
what these need. Every vector is indexed: its cell, its code, and the vector itself for the
rerank. A query probes its nearest cells; in each part of a cell the tables rank the
codes, and the best are measured exactly.

Equal vectors: of each set only the first `k + 1` rows by id are indexed, as no
others can be among anyone's k nearest (ties go to the smaller id). Equal query
vectors are searched once. An id may stand on several rows: each is a candidate
and, if asked for, a query of its own, and leaves out one row, itself. Cells are
cut into parts of about PART_ROWS rows. Vectors that are null, all zeros, of another length than most, or hold null or
non-finite components take no part. A null id takes no part. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
MAX_CELLS = 4096
PART_ROWS = 20_000
TARGET_RECALL, TARGET_RANKED, TRIALS = 0.97, 0.99, 400
BLOCK = 1 << 22  # numbers in a matrix of distances
SUBSPACES, CODES = 16, 256


def usable(v: Column) -> Column:
    """Non-null, not all zeros, all components finite."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one moves to the point that lies farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        own, far = nearest_of(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (empty := np.flatnonzero(n == 0)).size:
            c[empty] = x[np.argsort(-far, kind="stable")[: empty.size]]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, row by row."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def nearest_of(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of c to each row of x, and its squared distance; a bounded matrix at a time."""
    step, own, far = max(1, BLOCK // len(c)), np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), step):
        d = distances(x[at : at + step], c)
        own[at : at + step] = d.argmin(axis=1)
        far[at : at + step] = d.min(axis=1)
    return own, far


def _share(parts: list, share: float) -> int:
    """The number that so many of the numbers in parts don't exceed; 0 without any."""
    return int(np.quantile(np.concatenate(parts), share, method="higher")) if sum(map(len, parts)) else 0


class Model:
    def __init__(self, sample: np.ndarray, total: int):
        sample = sample.astype(np.float64)
        self.centre = sample.mean(axis=0)  # an offset that all rows share would drown their distances
        sample = sample - self.centre
        cells = max(1, min(MAX_CELLS, len(sample), round(math.sqrt(total))))
        self.centroids = kmeans(sample, cells)
        dim = sample.shape[1]
        m = min(SUBSPACES, dim)
        self.edges = [dim * i // m for i in range(m + 1)]
        own = nearest_of(sample, self.centroids)[0]
        residual = sample - self.centroids[own]
        self.books = [kmeans(residual[:, a:b], CODES, rounds=6) for a, b in zip(self.edges, self.edges[1:])]
        self.probes, self.exact = self._tried(sample, own, max(1.0, total / len(sample)))

    def _tried(self, sample: np.ndarray, own: np.ndarray, times: float, k: int = 10) -> tuple[int, int]:
        """Cells to probe, and rows of a cell to measure; the table has `times` the rows of the sample, which is centred."""
        codes, order = self.encode(sample + self.centre, own), np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(len(self.centroids) + 1))
        asked = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
        step, needed, placed = max(1, BLOCK // len(sample)), [], []
        for i in range(0, len(asked), step):
            some = asked[i : i + step]
            d = distances(sample[some], sample)
            d[np.arange(len(some)), some] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
            rank = distances(sample[some], self.centroids).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            needed.append(np.take_along_axis(rank, own[near], axis=1).ravel())
            for q, found in zip(some, near):
                for cell in np.unique(own[found]):
                    rows = order[starts[cell] : starts[cell + 1]]
                    approx = self.approximate(sample[q : q + 1] + self.centre, cell, codes[rows])[0]
                    place = np.argsort(np.argsort(approx, kind="stable"), kind="stable")
                    placed.append(place[np.isin(rows, found)])
        return _share(needed, TARGET_RECALL) + 1, max(k + 1, math.ceil((_share(placed, TARGET_RANKED) + 1) * times))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest_of(x - self.centre, self.centroids)[0]

    def order(self, x: np.ndarray) -> np.ndarray:
        """[row, place]: all cells, the nearest first."""
        return distances(x - self.centre, self.centroids).argsort(axis=1, kind="stable")

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        r = x - self.centre - self.centroids[cell]
        return np.stack([nearest_of(r[:, a:b], book)[0] for a, b, book in zip(self.edges, self.edges[1:], self.books)], axis=1).astype(np.uint8)

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """[query, row]: sums of squared distances from the queries' residuals to the rows' codes, looked up in tables of each subspace."""
        r, out = q - self.centre - self.centroids[cell], np.zeros((len(q), len(codes)))
        for s, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books)):
            out += distances(r[:, a:b], book)[:, codes[:, s]]
        return out


def draw(vectors: DataFrame, sample: int, total: int) -> DataFrame:
    """The `sample` rows (id, v) of the smallest hashes of id and vector, wherever they stand in the table."""
    place = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40))
    # A few more than wanted pass the threshold; of those the smallest are taken.
    upto = math.ceil(min(1.0, (1.2 * sample + 1000) / total) * (1 << 40))
    placed = vectors.select("id", "v", place.alias("place"))
    near = placed.where(F.col("place") < upto)
    if not near.take(1):  # all rows are copies of a few, which the threshold missed
        near = placed
    return near.orderBy("place", "id").limit(sample).select("id", "v")


def fit(vectors: DataFrame, sample: int = SAMPLE) -> tuple[Model | None, int]:
    """vectors: (id, v)."""
    total = vectors.count()
    if not total:
        return None, 0
    flat = draw(vectors, sample, total).select("v").toArrow().column(0).combine_chunks()
    flat = flat.combine_chunks() if hasattr(flat, "combine_chunks") else flat
    return Model(_matrix(flat), total), total


def trial(index: DataFrame, asked: DataFrame, model: Model, k: int) -> tuple[int, int]:
    """Cells to probe, and rows of a cell to measure, by the true neighbours of TRIALS queries among all rows.

    index: (id, cell, code, vec); asked: (v, qk). Two passes over the index: the neighbours by brute force,
    then the rows of their cells that the tables rank no later. k + 1 rows a query come to the driver.
    """
    import pyarrow as pa

    spark = index.sparkSession
    drawn = asked.orderBy(F.xxhash64("v"), "qk").limit(TRIALS).select("v").toArrow().column(0).combine_chunks()
    q = _matrix(drawn.combine_chunks() if hasattr(drawn, "combine_chunks") else drawn)
    if not len(q):
        return 1, k + 1
    shipped = spark.sparkContext.broadcast((model, q))

    def blocks(batches):
        """(id, cell, code, vec) of some thousand rows at a time."""
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= max(1000, BLOCK // len(q)):
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    vectors = lambda t: np.frombuffer(b"".join(t.column("vec").to_pylist())).reshape(t.num_rows, -1)

    def nearest(batches):
        m, q = shipped.value
        best = [np.empty((len(q), 0))] + [np.empty((len(q), 0), np.int64)] * 2 + [np.empty((len(q), 0), object)]
        for t in blocks(batches):
            x = vectors(t)
            rough = distances(q - m.centre, x - m.centre)
            some = min(4 * (k + 1), len(x))
            at = np.argpartition(rough, some - 1, axis=1)[:, :some]
            d = np.stack([((x[a] - v) ** 2).sum(axis=1) for a, v in zip(at, q)])
            ids, cell, code = t.column("id").to_numpy(), t.column("cell").to_numpy(), np.array([*t.column("code").to_pylist(), None], object)[:-1]
            best = [np.concatenate([b, new], axis=1) for b, new in zip(best, (d, ids[at], cell[at], code[at]))]
            few = np.stack([np.lexsort((i, d))[: k + 1] for d, i in zip(best[0], best[1])])
            best = [np.take_along_axis(b, few, axis=1) for b in best]
        n = best[0].shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(q), dtype=np.int32), n)), pa.array(best[0].ravel()), pa.array(best[1].ravel()), pa.array(best[2].ravel().astype(np.int32)), pa.array(best[3].ravel().tolist(), pa.binary())],
            ["q", "d", "id", "cell", "code"],
        )

    found = index.mapInArrow(nearest, "q int, d double, id long, cell int, code binary")
    top = found.withColumn("r", F.expr("row_number() over (partition by q order by d, id)")).where(f"r <= {k + 1}").orderBy("q", "r").toArrow()
    of, cell = top.column("q").to_numpy(), top.column("cell").to_numpy()
    # The first of a query's rows is its own, or a copy.
    first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.empty(0, bool)
    code = [np.frombuffer(c, np.uint8) for c, own in zip(top.column("code").to_pylist(), first) if not own]
    of, cell = of[~first], cell[~first]
    if not len(of):
        return 1, k + 1
    place = np.empty_like(order := model.order(q))
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
    limit = np.array([model.approximate(q[i : i + 1], c, a[None])[0, 0] for i, c, a in zip(of, cell, code)])
    wanted = spark.sparkContext.broadcast((of, cell, limit * (1 + 1e-9)))

    def ranked(batches):
        m, q = shipped.value
        of, cell, limit = wanted.value
        n = np.zeros(len(of), np.int64)
        for t in blocks(batches):
            own = t.column("cell").to_numpy()
            at = np.flatnonzero(np.isin(own, cell))
            codes = np.frombuffer(b"".join(t.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
            for c in np.unique(own[at]):
                mine, rows = np.flatnonzero(cell == c), codes[own[at] == c]
                qs, which = np.unique(of[mine], return_inverse=True)
                approx = m.approximate(q[qs], c, rows)
                for i, w in zip(mine, which):
                    n[i] += (approx[w] <= limit[i]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["i", "n"])

    counts = index.select("id", "cell", "code", "vec").mapInArrow(ranked, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    return _share([place[of, cell]], TARGET_RECALL) + 1, max(k + 1, _share([counts.column("n").to_numpy()], TARGET_RANKED))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    model: tuple[Model, int] | None = None,
    probes: int | None = None,
    exact: int | None = None,
) -> DataFrame:
    """query_id, rank, id, score (Euclidean distance) of each query's k nearest found, its own row aside.

    exact: rows of each probed part that are measured, if not as many as the model says.
    """
    import pyarrow as pa

    from plumbline.llm.common import settle, small_batches

    spark = vectors.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).where(usable(F.col("v")) & F.col("id").isNotNull())
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"query_id long, rank int, {key} long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == dims["d"])
    # Of equal vectors the first k + 1 by id; the rank filter runs before the shuffle too.
    few = settle(rows.withColumn("r", F.expr("row_number() over (partition by v order by id)")).where(f"r <= {k + 1}").select("id", "v", "r"))
    model, total = model or fit(few.where("r = 1"))
    few = few.select("id", "v")
    shipped = spark.sparkContext.broadcast(model)

    def indexed(batches):
        m = shipped.value
        for b in batches:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            cell = m.cells(x)
            code = m.encode(x, cell)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())],
                ["id", "cell", "code", "vec"],
            )

    index = settle(few.mapInArrow(indexed, "id long, cell int, code binary, vec binary"))
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # at most MAX_CELLS rows
    count = np.array([sizes.get(c, 0) for c in range(len(model.centroids))])
    parts = spark.sparkContext.broadcast((count, np.maximum(1, -(-count // PART_ROWS))))

    # A number for each distinct query vector, fixed as it is written.
    asked = settle(rows.where("q").select("v").distinct().withColumn("qk", F.monotonically_increasing_id()))
    needed = (0, 0) if probes and exact else trial(index, asked, model, k)
    probes, exact = min(len(count), probes or max(model.probes, needed[0])), max(k + 1, exact or max(model.exact, needed[1]))

    def probed(batches):
        """(cell, part, qk, vec): the nearest cells of each query, more where these hold few rows."""
        m, (size, pieces) = shipped.value, parts.value
        for b in batches:
            x = _matrix(b.column(0))
            if not len(x):
                continue
            out = [[], [], [], []]
            step = max(1, BLOCK // len(m.centroids))
            orders = (m.order(x[at : at + step]) for at in range(0, len(x), step))
            for i, near in enumerate(near for order in orders for near in order):
                enough = int(np.searchsorted(np.cumsum(size[near]), 4 * (k + 1))) + 1
                for c in near[: max(probes, enough)]:
                    for p in range(pieces[c] if size[c] else 0):
                        out[0].append(int(c))
                        out[1].append(p)
                        out[2].append(b.column(1)[i].as_py())
                        out[3].append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["cell", "part", "id", "vec"])

    queries = settle(asked.select("v", "qk").mapInArrow(probed, "cell int, part int, id long, vec binary"))
    met = {r["cell"] for r in queries.select("cell").distinct().collect()}  # at most MAX_CELLS

    def cut(batches):
        """The rows of cells that a query probes, by parts."""
        size, pieces = parts.value
        wanted = np.zeros(len(size), bool)
        wanted[list(met)] = True
        for b in batches:
            b = b.filter(pa.array(wanted[b.column(1).to_numpy()]))
            cell = b.column(1).to_numpy()
            ids = b.column(0).to_numpy()
            part = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % pieces[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(part.astype(np.int32)), b.column(0), b.column(2), b.column(3)], ["cell", "part", "id", "code", "vec"])

    held = index.mapInArrow(cut, "cell int, part int, id long, code binary, vec binary").select("cell", "part", F.lit(0).alias("kind"), "id", "code", "vec")
    queries = queries.select("cell", "part", F.lit(1).alias("kind"), "id", F.lit(None).cast("binary").alias("code"), "vec")

    def nearest(batches):
        """Rows of a part come before its queries, which stream by."""
        m = shipped.value
        at, ids, codes, vecs = None, [], [], []

        def ask(cell, q_ids, q):
            if isinstance(ids, list) and not ids:
                return
            take = min(exact, len(ids_a))
            if take < len(ids_a):
                best = np.argpartition(m.approximate(q, cell, codes_a), take - 1, axis=1)[:, :take]
            else:
                best = np.tile(np.arange(len(ids_a)), (len(q), 1))
            for i, b in enumerate(best):
                d = np.sqrt(((vecs_a[b] - q[i]) ** 2).sum(axis=1))
                o = np.lexsort((ids_a[b], d))[: k + 1]
                yield from zip([q_ids[i]] * len(o), ids_a[b][o].tolist(), d[o].tolist())

        for batch in batches:
            cell, part, kind, row_id = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            code, vec = batch.column(4), batch.column(5)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            out = []
            for s, e in zip([0, *cuts], [*cuts, len(cell)]):
                if s == e:
                    continue
                here = (int(cell[s]), int(part[s]))
                if here != at:
                    at, ids, codes, vecs, ids_a = here, [], [], [], None
                x = np.frombuffer(b"".join(vec.slice(s, e - s).to_pylist())).reshape(e - s, -1)
                if kind[s] == 0:
                    ids.append(row_id[s:e])
                    codes.append(np.frombuffer(b"".join(code.slice(s, e - s).to_pylist()), np.uint8).reshape(e - s, -1))
                    vecs.append(x)
                    continue
                if ids_a is None and ids:
                    ids_a, codes_a, vecs_a = np.concatenate(ids), np.concatenate(codes), np.concatenate(vecs)
                for i in range(0, e - s, 64):
                    out += ask(here[0], row_id[s + i : min(e, s + i + 64)].tolist(), x[i : i + 64])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["qk", "id", "score"])

    both = held.unionByName(queries).repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "kind", "id")
    found = both.mapInArrow(nearest, "qk long, id long, score double")
    top = found.withColumn("r", F.expr("row_number() over (partition by qk order by score, id)")).where(f"r <= {k + 1}").select("qk", "id", "score")
    lists = top.groupBy("qk").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near"))  # k + 1 entries at most
    # Back to every query with that vector.
    answers = asked.join(lists, "qk").select("v", "near")
    each = rows.where("q").select("id", "v").join(answers, "v")
    # One row at distance 0 with the query's id is the query's own; where k others come before it, it isn't in the list.
    own = F.array_position(F.transform("near", lambda x: (x["id"] == F.col("id")) & (x["score"] == 0)), True)
    others = F.when(own == 0, F.col("near")).otherwise(F.concat(F.slice("near", F.lit(1), own - 1), F.slice("near", own + 1, F.lit(k + 1))))
    each = each.select(F.col("id").alias("query_id"), F.slice(others, 1, k).alias("near")).select("query_id", F.posexplode("near").alias("p", "x"))
    return each.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias(key), F.col("x.score").alias("score"))
