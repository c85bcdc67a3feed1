"""BPE encoding and decoding through a distinct-word table.

1. Spark tasks split texts into words. A task's documents form a block: a
   dictionary of the block's distinct words, and per document the dictionary
   slot of each position.
2. Distinct (block, word) rows are dealt by word; each distinct word is encoded
   once, and its ids go back to the blocks that have it.
3. Each block gets its documents and its ids; ids are joined back by position.
   Decoding joins ids to the vocabulary's pieces (a table of fixed size).

What is shuffled is dictionaries and compressed slots, never one row per word.
The split is read twice; each block carries a checksum of its dictionary, and a
mismatch of the two reads stops the job rather than give wrong ids.

A worker holds no more than its step needs: splitting loads no vocabulary, and a
block's ids and bytes stand in flat arrays, a few bytes a token.

Null text counts as empty: no tokens. Special tokens of the vocabulary are
recognised in texts as the tokenizers library does. Repeated rows each keep a
row; a null key is carried along.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean, small_batches

BLOCK_CHARS = 64 << 20  # of text in a block
BLOCK_WORDS = 600_000  # distinct words in a block, beyond which it ends with the document at hand
OUT_BYTES = 16 << 20  # of ids and text in a batch of results, beyond which it ends with the document at hand
#: The public pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_PLAIN = "\t\n\r -~¡-¬®-ɏ‐-‧"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"  # all \\p{L} of _PLAIN
_NUMBERS = "0-9²³¹¼-¾"  # all \\p{N} of _PLAIN


def _tokenizer(tokenizer_json: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json)


def without_vocabulary(tokenizer_json: str) -> str:
    """The same tokenizer with an empty vocabulary: all that splitting needs, at a thousandth of the size."""
    spec = json.loads(tokenizer_json)
    spec["model"] |= {"vocab": {}, "merges": []}
    return json.dumps(spec)


class Splitter:
    """Words of a text, as the tokenizer's own pre-tokenizer cuts them; special tokens are words of their own."""

    def __init__(self, tokenizer_json: str):
        self.tokenizer = _tokenizer(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # PATTERN with its letters and numbers spelled out, for texts of the characters that _PLAIN lists.
        # Elsewhere character tables may differ between libraries, and the tokenizer's own splitter is asked.
        self.fast = re.compile(f" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+").findall
        self.odd = re.compile(f"[^{_PLAIN}]").search

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.plain(part)
        return out

    def plain(self, text: str) -> list[str]:
        if not self.odd(text):
            return self.fast(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def byte_pieces(tokenizer_json: str) -> list[bytes]:
    """The bytes of each id. A byte-level vocabulary writes printable bytes as themselves and the n-th other one as U+0100 + n."""
    spec = json.loads(tokenizer_json)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown}
    of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    ids = dict(spec["model"]["vocab"])
    ids |= {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max(ids.values()) + 1)
    for piece, i in ids.items():
        out[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
    return out


def _pack(a: np.ndarray) -> bytes:
    """uint32 values by planes of bytes, compressed; high planes are mostly zeros."""
    return zlib.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Slots(dict):
    """word -> slot; a new word takes the next slot and is noted in `fresh`."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


def _mark(words: list[str], slots) -> int:
    """Sum over words and their slots, the same in whatever order and parts they come."""
    return sum((zlib.crc32(w.encode()) + 1) * (s + 1) for w, s in zip(words, slots)) & 0x7FFFFFFFFFFFFFFF


def _blocks(splitter: Splitter, batches, wanted: str):
    """A task's blocks as Arrow batches: `words`: (block, slot, word); `docs`: (block, kind, key, a), kind 2 a document and 1 the block's checksum."""
    import pyarrow as pa
    from pyspark import TaskContext

    block = (TaskContext.get().partitionId() << 24) - 1
    slot, chars, mark, keys, packed, sent, kind = _Slots(), None, 0, [], [], 0, None

    def flush():
        nonlocal sent, keys, packed, mark
        new, slot.fresh = slot.fresh, []
        mark = (mark + _mark(new, range(sent, sent + len(new)))) & 0x7FFFFFFFFFFFFFFF
        at, sent = range(sent, sent + len(new)), sent + len(new)
        n = len(keys)
        k, a, keys, packed = keys, packed, [], []
        if wanted == "words":
            return pa.RecordBatch.from_arrays([pa.array([block] * len(new), pa.int64()), pa.array(at, pa.int64()), pa.array(new, pa.string())], ["block", "slot", "word"])
        k = pa.concat_arrays(k) if k else pa.nulls(0, kind)
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([2] * n, pa.int32()), k, pa.array(a, pa.binary())], ["block", "kind", "key", "a"])

    def seal():
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.nulls(1, kind), pa.array([mark.to_bytes(8, "little")], pa.binary())], ["block", "kind", "key", "a"]
        )

    for batch in batches:
        kind = batch.column(0).type
        for i, text in enumerate(x.as_py() for x in batch.column(1)):
            if chars is None or chars > BLOCK_CHARS or len(slot) > BLOCK_WORDS:
                if chars is not None:
                    yield flush()
                    if wanted == "docs":
                        yield seal()
                block, slot, chars, mark, sent = block + 1, _Slots(), 0, 0, 0
            found = splitter(text)
            slots = np.fromiter(map(slot.__getitem__, found), np.uint32, len(found))
            chars += len(text or "")
            if wanted == "docs":
                keys.append(batch.column(0).slice(i, 1))
                packed.append(_pack(slots))
            if len(keys) >= 500 or len(slot.fresh) >= 20_000:
                yield flush()
    if chars is not None:
        yield flush()
        if wanted == "docs":
            yield seal()


def _encoded(tokenizer, batches):
    """From (block, slot, word) sorted by word: parts (block, kind 0, key null, a) of the blocks' id tables; a word is encoded once."""
    import pyarrow as pa

    last, last_ids = None, None
    for batch in batches:
        words = batch.column(2).to_pylist()
        blocks, slots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        distinct = [w for i, w in enumerate(words) if (i == 0 and w != last) or (i and w != words[i - 1])]
        new = (e.ids for e in tokenizer.encode_batch(distinct, add_special_tokens=False))
        ids = []
        for i, w in enumerate(words):
            if w != last:
                last, last_ids = w, next(new)
            ids.append(last_ids)
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        out_b, out_a = [], []
        for at in np.split(order, cuts):
            if not len(at):
                continue
            mine = [ids[j] for j in at.tolist()]
            mark = _mark([words[j] for j in at.tolist()], slots[at].tolist())
            body = [_pack(slots[at]), _pack(np.array([len(x) for x in mine], np.uint32)), _pack(np.array([y for x in mine for y in x], np.uint32))]
            out_b.append(int(blocks[at[0]]))
            out_a.append(mark.to_bytes(8, "little") + b"".join(len(x).to_bytes(4, "little") + x for x in body))
        n = len(out_b)
        yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array([0] * n, pa.int32()), pa.array(out_a, pa.binary())], ["block", "kind", "a"])


class _Table:
    """Ids and bytes by slot, put together from a block's parts. pieces: the vocabulary's bytes by id, a large_binary array."""

    def __init__(self, parts: list[bytes], pieces):
        import pyarrow as pa

        self.mark, got = 0, []
        for p in parts:
            self.mark = (self.mark + int.from_bytes(p[:8], "little")) & 0x7FFFFFFFFFFFFFFF
            at, three = 8, []
            for _ in range(3):
                n = int.from_bytes(p[at : at + 4], "little")
                three.append(_unpack(p[at + 4 : at + 4 + n]))
                at += 4 + n
            got.append(three)
        slots, lens, ids = (np.concatenate([g[k] for g in got]) if got else np.empty(0, np.uint32) for k in range(3))
        got.clear()
        lens = lens.astype(np.int64)
        self.place = np.empty(len(slots), np.uint32)  # of a slot among the words as they came
        self.place[slots] = np.arange(len(slots), dtype=np.uint32)
        ends = np.cumsum(lens)
        self.ids, self.lens, self.starts = ids, lens, ends - lens
        spelled = pieces.take(pa.array(ids))
        offsets = np.frombuffer(spelled.buffers()[1], np.int64)[np.concatenate([[0], ends])]
        self.bytes = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), spelled.buffers()[2]])

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, bytes]:
        import pyarrow as pa

        if not len(slots):
            return np.empty(0, np.uint32), b""
        at = self.place[slots]
        lens = self.lens[at]
        first = np.repeat(self.starts[at] - (np.cumsum(lens) - lens), lens)
        _, offsets, data = self.bytes.take(pa.array(at)).buffers()
        return self.ids[first + np.arange(len(first))], data[: np.frombuffer(offsets, np.int64)[len(at)]].to_pybytes()


def _joined(pieces: list[bytes], batches, with_ids: bool, with_text: bool):
    """From (block, kind, key, a) sorted by block and kind: the documents, ids by position and text from the ids."""
    import pyarrow as pa

    pieces = pa.array(pieces, pa.large_binary())
    block, parts, held = None, [], None
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]

    def flush(out):
        keys, ids, digests, decoded, texts = zip(*out)
        cols = [pa.concat_arrays(keys), pa.array(list(map(len, ids)), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        if with_ids:
            cuts = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(ids).astype(np.int32))))
        if with_text:
            cols.append(pa.array(texts, pa.string()))
        return pa.RecordBatch.from_arrays(cols, names)

    for batch in batches:
        out, size = [], 0
        for i, (b, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            a = batch.column(3)[i].as_py()
            if b != block:
                block, parts, held = b, [], None
            if kind == 0:
                parts.append(a)
            elif kind == 1:
                held = _Table(parts, pieces)
                parts = []
                if held.mark != int.from_bytes(a, "little"):
                    raise RuntimeError(f"block {b}: two reads of the documents gave different dictionaries")
            else:
                ids, raw = held.of(_unpack(a))
                ids = ids.astype("<u4", copy=False)
                text = raw.decode("utf-8", "replace")
                digests = hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
                out.append((batch.column(2).slice(i, 1), ids, *digests, text if with_text else None))
                size += ids.nbytes + len(raw) * with_text
                if size > OUT_BYTES:
                    yield flush(out)
                    out, size = [], 0
        if out:
            yield flush(out)


def round_trip(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 (over little-endian 32-bit ids), decoded_sha256; if asked for, ids and the decoded text."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    small = without_vocabulary(spec)
    shipped, pieces = spark.sparkContext.broadcast(spec), spark.sparkContext.broadcast(byte_pieces(spec))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text)
    dictionary = rows.mapInArrow(lambda b: lean(_blocks(Splitter(small), b, "words")), "block long, slot long, word string")
    parts = (
        dictionary.repartition(n, "word").sortWithinPartitions("word")
        .mapInArrow(lambda b: lean(_encoded(_tokenizer(shipped.value), b)), "block long, kind int, a binary")
    )
    packed = rows.mapInArrow(lambda b: lean(_blocks(Splitter(small), b, "docs")), f"block long, kind int, key {kind}, a binary")
    both = packed.unionByName(parts, allowMissingColumns=True).select("block", "kind", "key", "a")
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    # A task's first block goes to the partition of the task's number, its others to steps away: as many blocks everywhere, where a hash heaps some up.
    deal = F.pmod(F.shiftright("block", 24) + F.col("block").bitwiseAND(F.lit((1 << 24) - 1)) * F.lit(n * 618 // 1000), F.lit(n)).cast("int")
    out = (
        both.repartitionById(n, deal).sortWithinPartitions("block", "kind")
        .mapInArrow(lambda b: lean(_joined(pieces.value, b, with_ids, with_text)), schema)
    )
    return out.withColumnRenamed("key", key)


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids."""
    return round_trip(docs, tokenizer_path, key, text).select(key, "ids")


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """encoded + the text of its ids: an id-to-piece lookup, concatenated by position. Unknown or null ids give nothing; null ids arrays give null."""
    import pandas as pd

    spark = encoded.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        pieces = spark.sparkContext.broadcast(byte_pieces(f.read()))

    def joined(s):
        p = pieces.value
        return s.map(lambda x: None if x is None else b"".join([p[i] for i in x if i is not None and 0 <= i < len(p)]).decode("utf-8", "replace"))

    joined.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return encoded.withColumn(name, F.pandas_udf(joined, "string")(F.col(ids)))
