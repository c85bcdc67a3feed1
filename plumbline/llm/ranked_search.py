"""Ranked lexical search: an inverted index in shards, blocks of variable size, exact search that skips blocks.

index(): a task turns the documents it reads into shards of at most SHARD_DOCS
documents or SHARD_POSTINGS postings; a row for each term of a shard (documents in
ascending doc_id, occurrences), one for the documents' ids and lengths. No text is
shuffled, and the index is written once: searches read the rows of their terms only.

search(): counts of the whole corpus (documents, terms, documents of each term) come
from the index. In each shard, dynamic programming cuts every list of postings into
blocks: it minimises the sum, over the postings, of the block's largest impact less
the posting's own, plus BLOCK_COST a block. For each item, where the largest impacts of the
blocks that cover a stretch of documents can't sum up to the k-th best score so far,
the stretch is skipped: the stretches with the highest bounds go first, to raise that
score, then the pivots follow in document order. In a stretch, only documents of lists that can reach the score are
scored. A stretch whose bound equals the score is visited, as ties go to the smaller doc_id. So the k best of each shard are exact; the k best of those are the answer.

Null text, and text without terms, is no document. Items without terms, or with none
that a document holds, have no rows. Rows of one item are one item with the terms of all. Repeated
documents are ranked each; a null doc_id comes after all others at ties. Empty tables
give an empty result. Texts are read whole, however long. Only the id and text columns are
read, so other names can't clash.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import release, settle, small_batches

SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 22
BLOCK_COST = 2_000_000  # in units of impact, of which a posting has at most 1,000,000
UNIT, WIDEST = 8, 32  # block boundaries lie between units of so many postings; a block has at most so many units
SHORT = 512  # postings of a list whose blocks may begin anywhere
VOCABULARY, ITEM_TERMS = 500_000, 500_000  # terms that are sent to every task at once, terms of items searched at once
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "shard long, term string, df long, total long, docs binary, counts binary, absent binary"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class _Shard:
    """Documents of a task that are being turned into lists of postings."""

    def __init__(self):
        self.ids, self.lengths, self.lists, self.postings = [], array("q"), {}, 0

    def add(self, doc_id, words: list[bytes], wanted) -> None:
        at, lists = len(self.ids), self.lists
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        counted = Counter(filter(wanted.__contains__, words) if wanted is not None else words)
        self.postings += len(counted)
        for t, n in counted.items():
            held = lists.get(t)
            if held is None:
                held = lists[t] = (array("i"), array("i"))
            held[0].append(at)
            held[1].append(n)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def rows(self, number: int):
        """Record batches of the index: documents are numbered by ascending id."""
        import pyarrow as pa

        absent = np.array([i is None for i in self.ids], bool)
        ids, lengths = np.array([i or 0 for i in self.ids], np.int64), np.frombuffer(self.lengths, np.int64)
        order = np.lexsort((ids, absent))
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids))
        fields = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("total", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("absent", pa.binary())])
        out = [[None, int((lengths > 0).sum()), int(lengths.sum()), ids[order].tobytes(), lengths[order].tobytes(), np.packbits(absent[order]).tobytes()]]
        size = 0
        for t, (docs, counts) in self.lists.items():
            d, c = place[np.frombuffer(docs, np.int32)], np.frombuffer(counts, np.int32)
            o = np.argsort(d)
            out.append([t.decode("utf-8", "surrogatepass"), len(d), int(c.sum()), d[o].tobytes(), c[o].tobytes(), None])
            size += len(d)
            if size > 1 << 18 or len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(out), pa.int64()), *[pa.array(list(x), f.type) for x, f in zip(zip(*out), list(fields)[1:])]], schema=fields)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(out), pa.int64()), *[pa.array(list(x), f.type) for x, f in zip(zip(*out), list(fields)[1:])]], schema=fields)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """The inverted index of docs, written to the shared folder. wanted: a table (term) of the only terms that are indexed; above VOCABULARY rows all are."""
    spark = docs.sparkSession
    small_batches(spark)
    some = None
    if wanted is not None:
        if wanted.count() <= VOCABULARY:
            some = spark.sparkContext.broadcast(frozenset(r[0].encode("utf-8", "surrogatepass") for r in wanted.collect()))

    def built(batches):
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        only = some.value if some is not None else None
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, text in zip(ids, b.column(1)):
                shard.add(i, terms(text.as_py()), only)
                if shard.full():
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.rows(number)

    return settle(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(built, INDEX))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item, term): the distinct terms of each item."""
    import pyarrow as pa

    kind = items.schema[key].dataType.simpleString()

    def split(batches):
        for b in batches:
            found = [list(dict.fromkeys(terms(t.as_py()))) for t in b.column(1)]
            where = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where)), pa.array([t.decode("utf-8", "surrogatepass") for f in found for t in f], pa.string())], ["item", "term"])

    return items.select(key, text).mapInArrow(split, f"item {kind}, term string").distinct()


def blocks(impacts: np.ndarray, cost: float = BLOCK_COST, unit: int = UNIT, widest: int = WIDEST) -> np.ndarray:
    """Where the blocks of a list begin: the cut into runs of units with the least sum of bound errors and block costs."""
    n = len(impacts)
    starts = np.arange(0, n, unit)
    u = len(starts)
    top, summed = np.maximum.reduceat(impacts, starts), np.concatenate([[0], np.cumsum(np.add.reduceat(impacts, starts))])
    ends = np.append(starts[1:], n)
    # error[i, w]: of the block of units i - w to i
    error = np.full((u, min(widest, u)), np.inf)
    most = top.copy()
    for w in range(error.shape[1]):
        if w:
            most[w:] = np.maximum(most[w:], top[: u - w])
        error[w:, w] = most[w:] * (ends[w:] - starts[: u - w]) - (summed[w + 1 :] - summed[: u - w])
    least, back = np.zeros(u + 1), np.zeros(u, np.int64)
    for i in range(u):
        w = min(i + 1, error.shape[1])
        options = error[i, :w] + least[i + 1 - w : i + 1][::-1]
        back[i] = options.argmin()
        least[i + 1] = options[back[i]] + cost
    cuts, i = [], u - 1
    while i >= 0:
        cuts.append(i - back[i])
        i -= back[i] + 1
    return starts[cuts[::-1]]


class _List:
    """Postings of a term in a shard: documents, impacts, and its blocks' first and last documents and largest impacts."""

    def __init__(self, docs: np.ndarray, counts: np.ndarray, m: np.ndarray):
        counts = counts.astype(np.int64)
        self.docs = docs
        self.impacts = (1_000_000_000 * counts) // (1000 * counts + 8 * m[docs])
        begin = blocks(self.impacts, unit=1 if len(docs) <= SHORT else UNIT)
        self.first, self.last = docs[begin], docs[np.append(begin[1:], len(docs)) - 1]
        self.top = np.maximum.reduceat(self.impacts, begin)
        self.most = int(self.top.max())


class Searcher:
    """Exact top k of items over the lists of a shard of n documents, numbered in the order of ties."""

    def __init__(self, lists: dict[str, _List], n: int):
        self.lists, self.score, self.read = lists, np.zeros(n, np.int64), 0

    def _evaluate(self, found: list, lows: np.ndarray, highs: np.ndarray, k: int, best: tuple) -> tuple:
        """Scores the documents in the stretches [low, high), which are disjoint and in order, and keeps the k best.

        Lists whose largest impacts together stay below the k-th score can't bring up a document by themselves: they are
        only looked up for the documents of the others.
        """
        least = best[1][-1] if len(best[0]) == k else 0
        found = sorted(found, key=lambda x: x[1] * x[0].most)
        below = int(np.searchsorted(np.cumsum([w * part.most for part, w in found]), least))  # sums under the k-th score
        touched = []
        for part, w in found[below:]:
            a, b = np.searchsorted(part.docs, lows), np.searchsorted(part.docs, highs)
            n = b - a
            if (total := int(n.sum())) == 0:
                continue
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(total)
            docs = part.docs[at]
            self.score[docs] += w * part.impacts[at]
            self.read += total
            touched.append(docs)
        if touched and below:
            some = np.unique(np.concatenate(touched))
            touched = [some]
            for part, w in found[:below]:
                at = np.minimum(np.searchsorted(part.docs, some), len(part.docs) - 1)
                here = part.docs[at] == some
                self.score[some[here]] += w * part.impacts[at[here]]
                self.read += int(here.sum())
        if not touched:
            return best
        docs = np.concatenate(touched)
        score = self.score[docs]
        if len(best[0]) == k:  # few reach the score of the k-th
            docs, score = docs[score >= best[1][-1]], score[score >= best[1][-1]]
        docs, first = np.unique(docs, return_index=True)
        score = score[first]
        for t in touched:
            self.score[t] = 0
        docs, score = np.concatenate([best[0], docs[score > 0]]), np.concatenate([best[1], score[score > 0]])
        order = np.lexsort((docs, -score))[:k]
        return docs[order], score[order]

    def top(self, item: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and scores of the k best, best first; item: (term, weight)."""
        best = (np.empty(0, np.int64), np.empty(0, np.int64))
        found = [(self.lists[t], w) for t, w in item if t in self.lists and w > 0]
        if not found:
            return best
        firsts, lasts = np.concatenate([p.first for p, _ in found]), np.concatenate([p.last for p, _ in found]) + 1
        tops = np.concatenate([p.top * w for p, w in found])
        edges, where = np.unique(np.concatenate([firsts, lasts]), return_inverse=True)
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, where, np.concatenate([tops, -tops]))
        bound = np.cumsum(change)[:-1]
        lows, highs = edges[:-1], edges[1:]
        done = bound <= 0
        seeds = np.sort(np.argpartition(-bound, min(16, len(bound)) - 1)[:16])
        seeds = seeds[~done[seeds]]
        best = self._evaluate(found, lows[seeds], highs[seeds], k, best)
        done[seeds] = True
        at, width = 0, 64
        while at < len(bound):
            least = best[1][-1] if len(best[0]) == k else 1
            pivots = np.flatnonzero(~done[at:] & (bound[at:] >= least))[:width] + at
            if not len(pivots):
                break
            best = self._evaluate(found, lows[pivots], highs[pivots], k, best)
            at, width = pivots[-1] + 1, width * 4
        return best


def weighed(indexed: DataFrame, items: DataFrame) -> DataFrame:
    """items (item, term) with weight: floor(1000 ln((2N + 2) / (2 df + 1))); terms that no document holds are left out."""
    held = indexed.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    n = indexed.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"))
    both = items.join(held, "term").crossJoin(F.broadcast(n))  # n is one row
    return both.select("item", "term", F.floor(1000 * F.log((2 * F.col("n") + 2).cast("double") / (2 * F.col("df") + 1))).cast("long").alias("weight"))


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10, indexed: DataFrame | None = None) -> DataFrame:
    """item, rank, key, score of each item's k best documents. indexed: what index() returned, where that is at hand; then no text is read."""
    spark = docs.sparkSession
    asked = settle(item_terms(items, item, item_text))
    built = indexed is None
    if built:
        indexed = index(docs, key, text, asked.select("term").distinct())
    kind = items.schema[item].dataType.simpleString()
    weights = settle(weighed(indexed, asked))
    totals = indexed.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    groups = max(1, -(-weights.count() // ITEM_TERMS))
    found = None
    for g in range(groups):
        mine = weights if groups == 1 else weights.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        part = _search(indexed, mine, totals, k, kind)
        part = part if groups == 1 else settle(part)
        found = part if found is None else found.unionByName(part)
    rank = F.expr("row_number() over (partition by item order by score desc, doc asc nulls last)")
    best = settle(found.withColumn("rank", rank).where(f"rank <= {k}"))
    if built:
        release(indexed)
    release(asked)
    release(weights)
    return best.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")


def _search(indexed: DataFrame, weights: DataFrame, totals, k: int, kind: str) -> DataFrame:
    """(item, doc, score): the k best of each shard. weights: at most about ITEM_TERMS rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = indexed.sparkSession
    items: dict = {}
    for r in weights.collect():
        items.setdefault(r["item"], []).append((r["term"], r["weight"]))
    shipped = spark.sparkContext.broadcast((list(items.items()), *totals))
    used = weights.select("term").distinct()
    rows = indexed.where("term is null").unionByName(indexed.join(used, "term", "left_semi").select(*indexed.columns))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    item_type = to_arrow_type(weights.schema["item"].dataType)

    def searched(batches):
        """Rows of a shard come together, that of its documents first."""
        items, n_docs, n_terms = shipped.value
        shard, ids = None, None

        def ended():
            if ids is None or not lists:
                return
            searcher, out = Searcher(lists, len(ids)), ([], [], [])
            for name, wanted in items:
                docs, score = searcher.top(wanted, k)
                out[0].extend([name] * len(docs))
                out[1].extend(None if absent[d] else int(ids[d]) for d in docs)
                out[2].extend(score.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], item_type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["item", "doc", "score"])

        for b in batches:
            for number, term, docs, counts, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4), b.column(5), b.column(6)):
                if number != shard:
                    yield from ended()
                    shard, ids, lists = number, None, {}
                docs = np.frombuffer(docs.as_buffer(), np.int64 if term is None else np.int32)
                if term is None:
                    ids, absent = docs, np.unpackbits(np.frombuffer(gone.as_buffer(), np.uint8), count=len(docs))
                    lengths = np.frombuffer(counts.as_buffer(), np.int64)
                    m = 10 + (90 * lengths * n_docs) // max(1, n_terms)
                else:
                    lists[term] = _List(docs, np.frombuffer(counts.as_buffer(), np.int32), m)
        yield from ended()

    together = rows.repartition(tasks, "shard").sortWithinPartitions(F.col("shard"), F.col("term").asc_nulls_first())
    return together.mapInArrow(searched, f"item {kind}, doc long, score long")
