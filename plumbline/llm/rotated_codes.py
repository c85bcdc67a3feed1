"""Near-duplicate vectors: binary codes of randomly rotated residuals, unbiased estimates, exact recomputation where bounds don't decide.

Vectors are scaled to length one. Each lies in the cell of its nearest centroid
(fitted on a bounded sample, SAMPLE vectors). Of its residual, padded to BITS
numbers and turned by one random rotation, the index stores the signs, and the
factor <code, residual> that makes <code, other> / factor an unbiased estimate of
the inner product with any other residual. The estimate's error is that of a
random direction: its bound at SIGMAS standard deviations (one link in 10^9 missed)
leaves out a pair only if even the bound is below the limit. All other pairs are computed
anew in double precision, so no link is below the limit.

Which cells meet: two vectors at distance r in different cells lie both within r
of the plane between these. So a vector visits, besides its own cell, those of smaller
number whose plane lies within r and whose radius reaches it: a bound, no choice of
probes, so no pair is lost. Data without clusters make it visit most cells.
Cells are cut into parts of bounded size; rows visit every part, so no task holds a
cell. A task returns sums of links and a spanning forest, never the pairs.

Equal vectors are one node with a number of copies. Vectors that are null, all
zeros, of another length than most, or hold null or non-finite components link
with nothing: a row each, n_links 0, kept. A null id takes part and never names a
component, unless all of its members are null. Repeated ids: a row each. An empty
table gives an empty result. Other columns of the input are not read, so their
names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ann import _matrix, distances, kmeans, nearest_of, usable
from plumbline.llm.common import components, release, settle, small_batches

SAMPLE = 20_000
CELL_ROWS, MAX_CELLS = 4096, 4096
PART_ROWS, LEAST_PART = 4096, 256
BITS, SIGMAS = 256, 6.0
TRIED = 128  # visitors that are held against a part at once


def rotation(dim: int, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """[bits, dim]: the first columns of a random orthogonal matrix; bits is raised to dim if that is larger."""
    bits = max(bits, dim)
    turn, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (turn * np.sign(np.diag(r)))[:, :dim]


def encode(residual: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, correction factors and lengths of residuals. A residual of length zero has factor 1."""
    length = np.linalg.norm(residual, axis=1)
    unit = residual / np.where(length > 0, length, 1)[:, None]
    turned = unit @ turn.T
    factor = np.where(length > 0, np.abs(turned).sum(axis=1) / math.sqrt(len(turn)), 1.0)
    return np.packbits(turned >= 0, axis=1), factor, length


def estimate(codes: np.ndarray, factor: np.ndarray, length: np.ndarray, asked: np.ndarray, turn: np.ndarray, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """[asked, coded]: unbiased estimates of the inner products of `asked` with the coded residuals, and how far they may be off."""
    bits = len(turn)
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    found = (asked @ turn.T).astype(np.float32) @ signs.T
    found = found * (length / (factor * math.sqrt(bits)))[None]
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, bits - 1))
    return found, sigmas * np.linalg.norm(asked, axis=1)[:, None] * (length * spread)[None]


class _Forest:
    """Which rows of a part hang together; join() says which links are new."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, some: np.ndarray) -> list[int]:
        """A member for each of the groups that `some` touches, if these are several; all become one group."""
        labels, first = np.unique(self.of[some], return_index=True)
        if len(labels) < 2:
            return []
        self.of[np.isin(self.of, labels)] = labels[0]
        return some[first].tolist()


class _Part:
    """The rows that live in a part of a cell, and what visitors find among them."""

    def __init__(self, centre, turn, least, nodes, copies, codes, factor, length, x):
        self.centre, self.turn, self.least = centre, turn, least
        self.nodes, self.copies, self.codes, self.factor, self.length, self.x = nodes, copies, codes, factor, length, x
        self.along = x @ centre
        self.links, self.forest = np.zeros(len(nodes), np.int64), _Forest(len(nodes))

    def linked(self, y: np.ndarray, own_from: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of y, row here) of cosine `least` or more; own_from: y are rows here from that number on, each held against later ones only."""
        about, off = estimate(self.codes, self.factor, self.length, y - self.centre, self.turn)
        about += self.along[None] + (y @ self.centre)[:, None] - self.centre @ self.centre
        open_ = about + off >= self.least - 1e-5  # single precision
        if own_from is not None:
            open_ &= np.arange(len(self.nodes))[None] > (own_from + np.arange(len(y)))[:, None]
        a, b = np.nonzero(open_)
        sure = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 15):
            some = slice(at, at + (1 << 15))
            sure[some] = np.einsum("ij,ij->i", y[a[some]], self.x[b[some]]) >= self.least
        return a[sure], b[sure]

    def meet(self, nodes, copies, y, own_from=None):
        """Counts the links; yields (node, links) of the visitors and (node, node) of the forest."""
        counts, edges = [], []
        a, b = self.linked(y, own_from)
        if len(a):
            np.add.at(self.links, b, copies[a])
            found = np.zeros(len(y), np.int64)
            np.add.at(found, a, self.copies[b])
            who, starts = np.unique(a, return_index=True)
            for i, s, e in zip(who.tolist(), starts, [*starts[1:], len(a)]):
                here, me = b[s:e], int(nodes[i])
                counts.append((me, int(found[i])))
                if own_from is not None:
                    here = np.concatenate([[own_from + i], here])
                else:
                    edges.append((me, int(self.nodes[here[0]])))
                edges += [(int(self.nodes[here[0]]), int(self.nodes[j])) for j in self.forest.join(here) if j != here[0]]
        return counts, edges

    def among(self):
        for at in range(0, len(self.nodes), TRIED):
            some = slice(at, at + TRIED)
            yield self.meet(self.nodes[some], self.copies[some], self.x[some], at)


def _bytes(column, dtype, n) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(n, -1)


def links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: key, n_links (other vectors of cosine `least` or more), component_id (smallest key reachable), kept."""
    import pyarrow as pa

    spark = vectors.sparkSession
    small_batches(spark)
    every = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    valid = every.where(usable(F.col("v")))
    dims = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return every.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    takes_part = F.coalesce(usable(F.col("v")) & (F.size("v") == dims["d"]), F.lit(False))

    # A node for each distinct vector, numbered as it is written.
    nodes = settle(every.where(takes_part).groupBy("v").agg(F.min("id").alias("least_id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    share = min(1.0, sample / n)
    drawn = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).select("v").toArrow()
    if not drawn.num_rows:
        drawn = nodes.orderBy("node").limit(1).select("v").toArrow()
    x = _unit(_matrix(drawn.column(0).combine_chunks()))
    centres = kmeans(x, max(1, min(MAX_CELLS, n // CELL_ROWS, len(x))))
    turn = rotation(dims["d"])
    shipped = spark.sparkContext.broadcast((centres, turn))

    def indexed(batches):
        c, turn = shipped.value
        for b in batches:
            x = _unit(_matrix(b.column(2)))
            if not len(x):
                continue
            cell, far = nearest_of(x, c)
            code, factor, length = encode(x - c[cell], turn)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(factor), pa.array(length), pa.array([r.tobytes() for r in x], pa.binary())],
                ["node", "copies", "cell", "code", "factor", "length", "x"],
            )

    form = "node long, copies long, cell int, code binary, factor double, length double, x binary"
    index = settle(nodes.select("node", "copies", "v").mapInArrow(indexed, form))
    known = {r["cell"]: (r["n"], r["radius"]) for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("length").alias("radius")).collect()}  # at most MAX_CELLS rows
    counts = np.array([known.get(c, (0, 0.0))[0] for c in range(len(centres))])
    radius = np.array([known.get(c, (0, 0.0))[1] for c in range(len(centres))])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_a_part = min(PART_ROWS, max(LEAST_PART, n // (2 * tasks)))
    pieces = -(-counts // rows_a_part)
    plan = spark.sparkContext.broadcast((radius, pieces, np.concatenate([[0], np.cumsum(pieces)])))
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9

    def dealt(batches):
        """Every row to its own part, and as a visitor to the parts where it may have links: (part, kind, row)."""
        c, _ = shipped.value
        radius, pieces, first = plan.value
        gaps = np.sqrt(distances(c, c))
        for b in batches:
            node, cell = b.column(0).to_numpy(), b.column(2).to_numpy()
            if not len(node):
                continue
            own = ((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % pieces[cell].astype(np.uint64)
            own = own.astype(np.int64)
            x = _bytes(b.column(6), np.float64, len(node))
            for at in range(0, len(node), 256):
                some = np.arange(at, min(at + 256, len(node)))
                d = distances(x[some], c)
                mine = cell[some]
                near = d - d[np.arange(len(some)), mine][:, None] <= 2 * reach * gaps[mine] + 1e-9
                near &= np.sqrt(d) <= radius[None] + reach + 1e-6
                near &= np.arange(len(c))[None] < mine[:, None]
                i, j = np.nonzero(near)
                # All parts of the cells visited; those before its own part in its own cell.
                who = np.concatenate([np.repeat(some[i], pieces[j]), np.repeat(some, own[some])])
                start = np.concatenate([np.repeat(first[j], pieces[j]), np.repeat(first[mine], own[some])])
                many = np.concatenate([pieces[j], own[some]])
                turn_no = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                part = start + turn_no
                who, part = np.concatenate([some, who]), np.concatenate([first[mine] + own[some], part])
                kind = np.arange(len(who)) >= len(some)
                for s in range(0, len(who), 4096):
                    take, visits = pa.array(who[s : s + 4096]), kind[s : s + 4096]
                    got = [b.column(k).take(take) for k in range(7)]
                    blank = pa.array(visits)
                    got[3] = pa.compute.if_else(blank, pa.scalar(None, pa.binary()), got[3])
                    yield pa.RecordBatch.from_arrays([pa.array(part[s : s + 4096]), pa.array(visits.astype(np.int32)), *got], ["part", "kind", *b.schema.names])

    def compared(batches):
        """The rows of a part come before its visitors, which stream by: (a, b) edges, or (a, null, links)."""
        c, turn = shipped.value
        first = plan.value[2]
        at, held, part = None, [], None

        def out(found):
            counts, edges = found
            if counts or edges:
                a = [x for x, _ in counts] + [x for x, _ in edges]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(counts) + [y for _, y in edges], pa.int64()), pa.array([y for _, y in counts] + [0] * len(edges), pa.int64())], ["a", "b", "links"])

        def closed():
            """A part's own rows are compared when its visitors begin, or when it ends; its own counts go last."""
            if part is not None and part.links.any():
                some = np.flatnonzero(part.links)
                yield from out((list(zip(part.nodes[some].tolist(), part.links[some].tolist())), []))

        def opened():
            nonlocal part
            if part is None and held:
                joined = [np.concatenate(cols) for cols in zip(*held)]
                part = _Part(c[int(np.searchsorted(first, at, side="right")) - 1], turn, least, *joined)
                for found in part.among():
                    yield from out(found)

        for b in batches:
            where, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(where) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(where)]):
                if s == e:
                    continue
                if where[s] != at:
                    yield from opened()
                    yield from closed()
                    at, held, part = int(where[s]), [], None
                rows = b.slice(s, e - s)
                node, copies, x = rows.column(2).to_numpy(), rows.column(3).to_numpy(), _bytes(rows.column(8), np.float64, e - s)
                if kind[s] == 0:
                    held.append((node, copies, _bytes(rows.column(5), np.uint8, e - s), rows.column(6).to_numpy(), rows.column(7).to_numpy(), x))
                    continue
                yield from opened()
                if part is None:
                    continue
                for i in range(0, e - s, TRIED):
                    yield from out(part.meet(node[i : i + TRIED], copies[i : i + TRIED], x[i : i + TRIED]))
        yield from opened()
        yield from closed()

    blocks = index.mapInArrow(dealt, f"part long, kind int, {form}").repartition(tasks, "part").sortWithinPartitions("part", "kind")
    found = settle(blocks.mapInArrow(compared, "a long, b long, links long"))
    release(index)

    number = found.where("b is null").groupBy("a").agg(F.sum("links").alias("others"))
    groups = components(found.where("b is not null").select("a", "b"))
    named = nodes.select("node", "least_id", "copies", "v").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(number.withColumnRenamed("a", "node"), "node", "left")
    # Smallest id of each component; a component's nodes are summed before they are dealt by its root.
    least_of = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    told = named.join(least_of, "root").select("v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    told = settle(told)
    release(found)
    part_of = every.where(takes_part).join(told, "v").select("id", "n_links", "component_id")
    alone = every.where(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    same = F.col("id").eqNullSafe(F.col("component_id"))
    return part_of.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", same.alias("kept"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very small or large components don't vanish or overflow."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
