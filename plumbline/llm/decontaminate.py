"""Benchmark decontamination with suffix arrays of the training text.

Documents stay where they are read. Each task cuts its documents into shards of
bounded size, builds a suffix array of word numbers over each shard, and
binary-searches every suffix of the benchmark in it. The benchmark is numbered
and laid out as windows once, in blocks of bounded size, as many as it needs,
which are broadcast; a task goes through them for each shard and holds one at a
time.

Words: A-Z lower-cased, then runs of ASCII digits and letters and of non-ASCII
characters. A window is `window` consecutive words of an item; an item with
fewer words, but not none, is one window. Null or empty text has no words: such
a document is never hit, such an item never occurs. Items with equal texts all
count. An item without id counts for hits but is not listed. Repeated documents
are judged each on its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import small_batches, unnamed

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK_BYTES = 8 << 20  # of benchmark text in one broadcast, which takes about ten times that
SHARD_WORDS = 1 << 20  # of training text in one suffix array; a longer document is a shard of its own


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Suffixes:
    """One benchmark block: numbered words and its window-long suffixes.

    Word numbers start at 1; 0 is a word that the block lacks. `lead` is the
    length of the shortest window: a training suffix that begins with none of
    the block's runs of `lead` words can't match and is left out of the array.
    """

    def __init__(self, items: list[tuple], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.ids, rows = [], [np.empty((0, window), ">u4")]
        lengths, owners, offsets = ([np.empty(0, np.int64)] for _ in range(3))
        for item_id, text in items:
            if not (found := words(text)):
                continue
            codes = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in found), np.uint32, len(found))
            n = min(window, len(codes))
            each = np.zeros((len(codes) - n + 1, window), ">u4")
            each[:, :n] = np.lib.stride_tricks.sliding_window_view(codes, n)
            rows.append(each)
            lengths.append(np.full(len(each), n))
            owners.append(np.full(len(each), len(self.ids)))
            offsets.append(np.arange(len(each)))
            self.ids.append(None if item_id is None else str(item_id))
        self.rows = np.concatenate(rows).astype(">u4")  # big-endian, so that bytes sort as numbers do
        self.length, self.owner, self.offset = (np.concatenate(x) for x in (lengths, owners, offsets))
        self.lead = min(3, int(self.length.min())) if len(self.length) else 1
        self.leads = np.unique(_pack(self.rows[:, : self.lead].astype(np.uint64)))

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, positions): every occurrence of a window in a shard's word numbers. Documents are parted by `window` zeros."""
        n = len(codes)
        at = np.flatnonzero(codes[: n - self.lead + 1])
        if not len(at) or not len(self.rows):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        leads = _pack(np.stack([codes[at + k] for k in range(self.lead)], axis=1).astype(np.uint64))
        slot = np.searchsorted(self.leads, leads)
        at = at[self.leads[np.minimum(slot, len(self.leads) - 1)] == leads]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        padded = np.concatenate([codes, np.zeros(self.window, codes.dtype)])
        suffix = np.stack([padded[at + k] for k in range(self.window)], axis=1).astype(">u4")
        keys = np.ascontiguousarray(suffix).view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        hits_w, hits_p = [], []
        for n_words in np.unique(self.length):
            which = np.flatnonzero(self.length == n_words)
            asked = np.ascontiguousarray(self.rows[which]).view(f"S{4 * self.window}").ravel()
            low = np.searchsorted(keys, asked, "left")
            after = self.rows[which].copy()  # the first key after all that begin with the window's words
            after[:, n_words - 1] += 1
            high = np.searchsorted(keys, np.ascontiguousarray(after).view(f"S{4 * self.window}").ravel(), "left")
            many = high - low
            hits_w.append(np.repeat(which, many))
            starts = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
            hits_p.append(at[starts + np.arange(many.sum())])
        return np.concatenate(hits_w), np.concatenate(hits_p)


def _pack(codes: np.ndarray) -> np.ndarray:
    out = codes[:, 0].copy()
    for k in range(1, codes.shape[1]):
        out = (out << np.uint64(21)) ^ codes[:, k]
    return out


def _longest(window, position, suffixes: Suffixes) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Per item: (words, start in the document, start in the item) of its longest verbatim match; ties to the first."""
    item, offset = suffixes.owner[window], suffixes.offset[window]
    order = np.lexsort((position, position - offset, item))
    item, offset, position, length = item[order], offset[order], position[order], suffixes.length[window][order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (position[1:] != position[:-1] + 1) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    run = np.diff(np.concatenate([first, [len(item)]]))
    out: dict = {}
    for f, r in zip(first, run):
        m = (int(length[f] + r - 1), int(position[f]), int(offset[f]))
        if int(item[f]) not in out or m[0] > out[int(item[f])][0]:
            out[int(item[f])] = m
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> list:
    """Broadcasts of Suffixes, each of a bounded number of bytes of text (or one item)."""
    out, some, size = [], [], 0
    sc = benchmark.sparkSession.sparkContext
    for row in benchmark.select(item, text).where(F.col(text).isNotNull()).toLocalIterator():
        n = len(row[1].encode("utf-8", "surrogatepass"))
        if some and size + n > block_bytes:
            out.append(sc.broadcast(Suffixes(some, window)))
            some, size = [], 0
        some.append((row[0], row[1]))
        size += n
    out.append(sc.broadcast(Suffixes(some, window)))
    return out


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """keep + key, n_words, n_hit, items, matches, one row per document.

    items: ids with occurring windows, sorted as strings. matches: for each such
    item its longest verbatim match (item_id, words, doc_word, item_word).
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item, item_text, window, block_bytes)
    columns = list(dict.fromkeys([*keep, key]))
    carried = T.StructType([docs.schema[c] for c in columns])
    schema = T.StructType(
        [*[T.StructField(f.name, f.dataType) for f in carried.fields]]
        + T._parse_datatype_string(
            "n_words long, n_hit long, items array<string>, matches array<struct<item_id:string,words:long,doc_word:long,item_word:long>>"
        ).fields
    )

    def searched(batches):
        def shard(texts):
            lists = [words(t) for t in texts]
            sizes = np.array([len(x) for x in lists], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + window)[:-1]])
            hit = np.zeros(int((sizes + window).sum()) + 1, np.int64)
            items = [{} for _ in texts]
            for i, block in enumerate(blocks):
                b = block.value
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)  # one block at a time: the next shard reads it again
                if not len(b.rows):
                    continue
                codes = np.zeros(len(hit) - 1, np.uint32)
                get = b.number.get
                for x, s in zip(lists, starts):
                    codes[s : s + len(x)] = np.fromiter((get(w, 0) for w in x), np.uint32, len(x))
                w, p = b.matches(codes)
                if not len(w):
                    continue
                np.add.at(hit, p, 1)
                np.add.at(hit, p + b.length[w], -1)
                doc = np.searchsorted(starts, p, "right") - 1
                order = np.argsort(doc, kind="stable")
                w, p, doc = w[order], p[order], doc[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
                for a, z in zip(cuts[:-1], cuts[1:]):
                    d = int(doc[a])
                    for k, (n, at, off) in _longest(w[a:z], p[a:z] - starts[d], b).items():
                        items[d][i, k] = (b.ids[k], n, at, off)
            cover = np.cumsum(hit) > 0
            for n, s, found in zip(sizes, starts, items):
                m = sorted((x for x in found.values() if x[0] is not None), key=lambda x: x[0])
                yield int(n), int(cover[s : s + n].sum()), sorted({x[0] for x in m}), m

        def answers():
            """(batch, results of its rows): shards go over the ends of batches."""
            out, some, size, waiting = [], [], 0, []
            for batch in batches:
                waiting.append(batch)
                for x in batch.column(at):
                    t = x.as_py()
                    n = len(t or "") // 5
                    if some and size + n > SHARD_WORDS:
                        out += shard(some)
                        some, size = [], 0
                    some.append(t)
                    size += n
                while waiting and len(out) >= waiting[0].num_rows:
                    first = waiting.pop(0)
                    yield first, out[: first.num_rows]
                    out = out[first.num_rows :]
            out += shard(some) if some else []
            for batch in waiting:
                yield batch, out[: batch.num_rows]
                out = out[batch.num_rows :]

        for batch, out in answers():
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays += [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.string()))]
            arrays.append(
                pa.array(
                    [[{"item_id": a, "words": n, "doc_word": p, "item_word": o} for a, n, p, o in x[3]] for x in out],
                    pa.list_(pa.struct([("item_id", pa.string()), ("words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())])),
                )
            )
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    at = columns.index(text) if text in columns else len(columns)  # the text goes over once
    return docs.select(*columns, *([] if text in columns else [F.col(text)])).mapInArrow(searched, schema)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without a hit, with all their columns."""
    inner, k, t = unnamed(docs, key, text)
    found = scan(inner, benchmark, k, t, keep=tuple(inner.columns), **options)
    return found.where("n_hit = 0").select(*inner.columns).toDF(*docs.columns)
