"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of byte pieces; per language a probability for each
piece. The probability of a word is the sum over all its segmentations into
pieces (forward algorithm); that of a text the product over its words. Training
is expectation-maximisation over word counts of a bounded sample of labelled
documents. Scoring ships the model (vocabulary x languages numbers, a fixed
size) to the tasks; documents are not shuffled.

Words are runs of letters, lower-cased, however long: a run of an unspaced script
is scored whole, by a forward pass that is scaled as it goes. Only in training are
words longer than MAX_WORD bytes cut, between characters. Text that is null, empty or without letters:
`und`, score 0. Score: the probability of the predicted language among the
learned ones, all equally likely beforehand. Ties go to the language that sorts
first. With nothing to learn from, every text is `und`. Repeated rows are judged
each on its own.
"""

from __future__ import annotations

import base64
import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches

MAX_PIECE = 12  # bytes
MAX_WORD = 48  # bytes of a word in training; longer ones are cut, and when scoring, scored apart and not kept
SAMPLE_BYTES = 2_000_000  # of text per language that the sample aims at
SAMPLE_ROWS = 8  # of each language that are drawn at least, as far as it has so many
LEAST = 1e-290  # below it, a probability is worked out in scaled form
CACHE_WORDS = 200_000  # scored words that a task's process keeps
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in _LETTERS.findall(text.lower())] if text else []


def cut(word: bytes) -> list[bytes]:
    """The word in parts of at most MAX_WORD bytes, cut between characters."""
    out, at = [], 0
    while len(word) - at > MAX_WORD:
        end = at + MAX_WORD
        while word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return [*out, word[at:]]


def vocabulary(path: str) -> list[bytes]:
    """Lower-case letter pieces of a rank file, and all single bytes: every word has a segmentation."""
    kept = {bytes([b]) for b in range(256)}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0]).strip(b" ")
            if not 1 < len(piece) <= MAX_PIECE:
                continue
            try:
                s = piece.decode()
            except UnicodeDecodeError:
                continue
            if s.lower() == s and _LETTERS.fullmatch(s):
                kept.add(piece)
    return sorted(kept)


class Lattice:
    """All pieces in each word of a batch: ids[word, start, length - 1], -1 where the vocabulary has none."""

    def __init__(self, pieces: list[bytes]):
        self.id = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))

    def ids(self, batch: list[bytes]) -> np.ndarray:
        """Words of one length."""
        n, m, get = len(batch[0]), min(self.longest, len(batch[0])), self.id.get
        cuts = [(i, i + k) for i in range(n) for k in range(1, m + 1) if i + k <= n]
        flat = np.array([[get(w[a:b], -1) for a, b in cuts] for w in batch], np.int32)
        out = np.full((len(batch), n, m), -1, np.int32)
        for c, (a, b) in enumerate(cuts):
            out[:, a, b - a - 1] = flat[:, c]
        return out


def forward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[word, end]: probability of the first `end` bytes, over all segmentations. prob ends with a 0 for piece -1."""
    w, n, m = ids.shape
    alpha = np.zeros((w, n + 1, *prob.shape[1:]))
    alpha[:, 0] = 1
    for end in range(1, n + 1):
        for k in range(1, min(m, end) + 1):
            alpha[:, end] += alpha[:, end - k] * prob[ids[:, end - k, k - 1]]
    return alpha


def log_forward(lattice: Lattice, batch: list[bytes], prob: np.ndarray) -> np.ndarray:
    """[word, language]: log-probability of words of any length, over all segmentations.

    The words are padded to one length with a byte that no longer piece has. Only a
    window of alphas is held; it is scaled every few bytes, so nothing underflows.
    """
    m, lens = lattice.longest, np.array([len(w) for w in batch])
    n = int(lens.max())
    padded = [w + b"\xff" * (n + m - len(w)) for w in batch]
    window = np.zeros((len(batch), m + 1, prob.shape[1]))  # alpha of position p stands at p % (m + 1)
    window[:, 0] = 1
    scale, out = np.zeros((len(batch), prob.shape[1])), np.full((len(batch), prob.shape[1]), -np.inf)
    get = lattice.id.get
    for at in range(n + 1):
        slot = at % (m + 1)
        if (done := lens == at).any():
            with np.errstate(divide="ignore"):
                out[done] = np.log(window[done, slot]) + scale[done]
        now = window[:, slot].copy()
        window[:, slot] = 0
        ids = np.array([[get(w[at : at + k], -1) for k in range(1, m + 1)] for w in padded], np.int32)
        window[:, [(at + k) % (m + 1) for k in range(1, m + 1)]] += now[:, None] * prob[ids]
        if at % 8 == 7:
            top = np.maximum(window.max(axis=1), 1e-300)
            window /= top[:, None]
            scale += np.log(top)
    return out


def _backward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    w, n, m = ids.shape
    beta = np.zeros((w, n + 1))
    beta[:, n] = 1
    for start in range(n - 1, -1, -1):
        for k in range(1, min(m, n - start) + 1):
            beta[:, start] += prob[ids[:, start, k - 1]] * beta[:, start + k]
    return beta


def fit(counts: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = 4, smooth: float = 0.05) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities[piece, language]) by expectation-maximisation from word counts per language."""
    lattice, langs = Lattice(pieces), sorted(counts)
    out = np.zeros((len(pieces) + 1, len(langs)))
    for c, lang in enumerate(langs):
        batches = []
        by: dict[int, list] = {}
        for w, n in counts[lang].items():
            for part in cut(w):
                by.setdefault(len(part), []).append((part, n))
        for group in by.values():
            for at in range(0, len(group), 20_000):
                some = group[at : at + 20_000]
                batches.append((lattice.ids([w for w, _ in some]), np.array([n for _, n in some], float)))
        p = np.zeros(len(pieces) + 1)
        p[:-1] = [0.1 ** min(len(x), 1) * (1 + len(x)) for x in pieces]
        p /= p.sum()
        for _ in range(rounds):
            got = np.zeros(len(pieces) + 1)
            for ids, n in batches:
                a, b = forward(ids, p), _backward(ids, p)
                scale = n / a[:, -1]
                for s in range(ids.shape[1]):
                    for k in range(min(ids.shape[2], ids.shape[1] - s)):
                        i = ids[:, s, k]
                        got += np.bincount(i + (i < 0) * (len(pieces) + 1), scale * a[:, s] * p[i] * b[:, s + k + 1], len(pieces) + 1)
            got[-1] = 0
            p = np.zeros(len(pieces) + 1)
            p[:-1] = (got[:-1] + smooth) / (got.sum() + smooth * len(pieces))
        out[:, c] = p
    return langs, out


def sample_counts(labelled: DataFrame, text: str = "text", lang: str = "lang", by: Column | None = None, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Word counts per language over a sample of labelled rows, as language_counts draws it."""
    out: dict = {}
    found = language_counts(labelled, text, lang, by, sample_bytes)
    for r in found.collect() if found is not None else ():
        out.setdefault(r["lang"], {})[bytes(r["word"])] = r["n"]
    return out


def language_counts(
    labelled: DataFrame, text: str = "text", lang: str = "lang", by: Column | None = None, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame | None:
    """(lang, word, n) over rows drawn by hash `by`: of each language about sample_bytes of text, and a few rows however long; None without any.

    Each language has its own bound, in bytes, so none loses words to another. A drawn row counts whole, however long.
    """
    import pyarrow as pa

    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    hashed = by if by is not None else F.xxhash64(text)
    place = F.pmod(hashed, F.lit(1 << 20))
    # The least place of each of several parts: drawing up to the largest of them takes a row of each part.
    part = F.pmod(F.xxhash64(hashed), F.lit(SAMPLE_ROWS))
    least = F.greatest(*[F.coalesce(F.min(F.when(part == i, place)), F.lit(0)) for i in range(SAMPLE_ROWS)])
    totals = rows.groupBy(F.col(lang).alias("lang")).agg(F.sum(F.octet_length(text)).alias("n"), least.alias("least")).collect()
    if not totals:
        return None
    bounds = [(r["lang"], float(max(min(1.0, sample_bytes / max(1, r["n"])) * (1 << 20), r["least"] + 1))) for r in totals]
    upto = F.coalesce(*[F.when(F.col(lang) == la, F.lit(x)) for la, x in bounds])
    drawn = place < upto
    def counted(batches):
        from collections import Counter

        for b in batches:
            got: Counter = Counter()
            for la, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got.update((la, w) for w in words(t))
            keys = list(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([got[k] for k in keys], pa.int64())],
                ["lang", "word", "n"],
            )

    return rows.where(drawn).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Scorer:
    """Scores words once each, as long as they stay in the cache."""

    def __init__(self, pieces: list[bytes], langs: list[str], prob: np.ndarray):
        self.lattice, self.langs, self.prob = Lattice(pieces), langs, prob
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1024, len(self.langs)), np.float32)

    def learn(self, new: list[bytes]) -> None:
        by: dict[int, list[bytes]] = {}
        for w in new:
            by.setdefault(len(w), []).append(w)
        for group in by.values():
            for i in range(0, len(group), 4096):
                some = group[i : i + 4096]
                plain = forward(self.lattice.ids(some), self.prob)[:, -1]
                with np.errstate(divide="ignore"):
                    score = np.log(plain)
                # Near the smallest doubles the product is inexact or gone: the scaled form has it.
                if (low := np.flatnonzero((plain < LEAST).any(axis=1))).size:
                    score[low] = log_forward(self.lattice, [some[i] for i in low], self.prob)
                first = len(self.at)
                while first + len(some) > len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[first : first + len(some)] = score
                self.at.update((w, first + j) for j, w in enumerate(some))

    def long(self, new: list[bytes]) -> dict[bytes, np.ndarray]:
        """Scores of words that are not kept, words of like lengths together."""
        new, out = sorted(new, key=len), {}
        at = 0
        while at < len(new):
            to = at + 1
            while to < len(new) and to - at < 256 and len(new[to]) <= 1.25 * len(new[at]):
                to += 1
            out |= dict(zip(new[at:to], log_forward(self.lattice, new[at:to], self.prob)))
            at = to
        return out

    def totals(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability sums[text, language], number of words)."""
        lists = [words(t) for t in texts]
        if len(self.at) > CACHE_WORDS:
            self.clear()
        at = self.at
        new = {w for x in lists for w in x if w not in at}
        apart = self.long([w for w in new if len(w) > MAX_WORD])
        if len(new) > len(apart):
            self.learn(sorted(new - apart.keys()))
        out = np.zeros((len(texts), len(self.langs)))
        for i, x in enumerate(lists):
            if apart and (far := [apart[w] for w in x if w in apart]):
                out[i] = np.sum(far, axis=0)
                x = [w for w in x if w not in apart]
            if x:
                out[i] += self.rows[np.fromiter(map(at.__getitem__, x), np.int64, len(x))].sum(axis=0, dtype=np.float64)
        return out, np.array([len(x) for x in lists], np.int64)


_scorers: dict = {}


def predict(docs: DataFrame, model: tuple, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """keep + lang_pred, score. model: (pieces, languages, probabilities)."""
    import pyarrow as pa
    import uuid

    pieces, langs, prob = model
    small_batches(docs.sparkSession)
    shipped, mark = docs.sparkSession.sparkContext.broadcast((pieces, langs, prob)), uuid.uuid4().hex

    def judged(batches):
        if mark not in _scorers:
            _scorers.clear()
            _scorers[mark] = Scorer(*shipped.value)
        s = _scorers[mark]
        for b in batches:
            pred, score = [], []
            for i in range(0, b.num_rows, 256):
                texts = b.column(at).slice(i, 256).to_pylist()
                if not s.langs:
                    pred += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                total, n = s.totals(texts)
                best = total.argmax(axis=1)
                p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                pred += [s.langs[k] if m else "und" for k, m in zip(best, n)]
                score += [float(x) if m else 0.0 for x, m in zip(p, n)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema_names)

    schema_names = [*keep, *names]
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], f"{names[0]} string, {names[1]} double"])
    # The text goes over once, whether or not it is kept.
    at = list(keep).index(text) if text in keep else len(keep)
    return docs.select(*[F.col(c) for c in keep], *([] if text in keep else [F.col(text)])).mapInArrow(judged, schema)


def train(labelled: DataFrame, vocabulary_path: str, text: str = "text", lang: str = "lang", by: Column | None = None) -> tuple:
    """(pieces, languages, probabilities). A language's sample, of bounded size, is fitted in one task; its probabilities alone come to the driver."""
    import pandas as pd

    pieces = vocabulary(vocabulary_path)
    counts = language_counts(labelled, text, lang, by)
    shipped = labelled.sparkSession.sparkContext.broadcast(pieces)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word")  # sums come out the same in any order of rows
        _, prob = fit({0: dict(zip(map(bytes, pdf["word"]), pdf["n"]))}, shipped.value)
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1].to_numpy(), "prob": [prob[:, 0].astype("<f8").tobytes()]})

    rows = counts.groupBy("lang").applyInPandas(fitted, "lang string, prob binary").collect() if counts is not None else []
    rows = sorted(rows, key=lambda r: r["lang"])
    prob = np.stack([np.frombuffer(r["prob"], "<f8") for r in rows], axis=1) if rows else np.zeros((len(pieces) + 1, 0))
    return pieces, [r["lang"] for r in rows], prob


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the key as text leaves remainder 1 by 3; a null key isn't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
