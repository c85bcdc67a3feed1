"""Chunks, vector and keyword search, rank fusion (RG-*)."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
TABLE_SEPARATORS = ("\n\n---", "\n\n", "\n", ". ", " ")


def split(text: str | None, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """RG-01: pieces at the first separator that occurs, packed to about `size` with trailing pieces repeated up to `overlap`;
    chunks over 1.5 * size are split by the finer separators."""
    if not text or not text.strip():
        return []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
    sep = separators[at] if at is not None else ""
    finer = separators[at + 1 :] if at is not None else ()
    out: list[str] = []
    held: list[str] = []
    width = lambda parts: sum(map(len, parts)) + len(sep) * (len(parts) - 1) if parts else 0

    def close() -> None:
        chunk = sep.join(held)
        if len(chunk) > 1.5 * size and finer:
            out.extend(split(chunk, size, overlap, finer))
        elif chunk.strip():
            out.append(chunk.strip())

    for piece in text.split(sep) if sep else list(text):
        if held and width(held) + len(sep) + len(piece) > size:
            close()
            kept: list[str] = []
            for p in reversed(held):
                if width([p, *kept]) > overlap:
                    break
                kept.insert(0, p)
            held[:] = kept
        held.append(piece)
    if held:
        close()
    return out


def chunks(docs: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS, prefix: str = "") -> DataFrame:
    """RG-01, RG-02: key, chunk_index, content. Arrow batches, no shuffle."""
    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        head = lambda c: c if not prefix or c.startswith(prefix[:30]) else f"{prefix}\n{c}"
        return s.map(lambda t: [head(c) for c in split(t, size, overlap, separators)])

    return docs.select(F.col(key), F.posexplode(cut(F.col(text))).alias("chunk_index", "content"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """MTH-05, RG-07: null for vectors of other lengths or without direction."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm))


def vector_search(vectors: DataFrame, query: list[float], k: int = 6, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """RG-03, RG-04, SO-05: key, score of the k most similar; ties by key. A top-k per task, then one merge: no full sort."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.select(F.col(key), cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), key).limit(k)


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def keyword_search(docs: DataFrame, query: str, k: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """RG-05: key, score = |q and d| / (sqrt|q| * sqrt|d| + 1e-6); an empty query scores 0.5 everywhere."""
    import re

    asked = sorted(set(re.findall(r"\w+", query.lower())))
    if not asked:
        return docs.select(F.col(key), F.lit(0.5).alias("score")).orderBy(key).limit(k)
    # A generator brings the array out: a filter on it can't be pushed below, where it would be worked out again.
    own = docs.select(F.col(key), F.explode(F.array(words(F.col(text)))).alias("w")).where("size(w) > 0")
    both = F.size(F.array_intersect("w", F.array(*[F.lit(w) for w in asked])))
    scored = own.select(key, (both / (F.lit(len(asked) ** 0.5) * F.sqrt(F.size("w").cast("double")) + 1e-6)).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def hybrid_search(vector_top: DataFrame, keyword_top: DataFrame, k: int = 6, key: str = "id") -> DataFrame:
    """RG-06, JN-08, WN-01, WN-02: id, vector_distance, keyword_score, rrf, score. Both inputs are (id, score) lists of at most 20 rows."""
    v = vector_top.toDF(key, "_s").select(key, (1 - F.col("_s")).alias("vector_distance"), F.expr("rank() over (order by _s desc)").alias("_v"))
    w = keyword_top.toDF(key, "_s").select(key, F.col("_s").alias("keyword_score"), F.expr("rank() over (order by _s desc)").alias("_k"))
    rrf = F.coalesce(1.0 / (60 + F.col("_v")), F.lit(0.0)) + F.coalesce(1.0 / (60 + F.col("_k")), F.lit(0.0))
    out = v.join(w, key, "full").select(key, F.coalesce("vector_distance", F.lit(1.0)).alias("vector_distance"), F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), rrf.alias("rrf"))
    return out.withColumn("score", F.least(F.lit(0.99), 1 - F.col("vector_distance") + 5 * F.col("rrf"))).orderBy(F.desc("rrf"), key).limit(k)


def merge_hits(hits: DataFrame, k: int = 6, content: str = "content") -> DataFrame:
    """SO-08: the best score of each content, k highest."""
    return hits.groupBy(content).agg(F.max("score").alias("score")).orderBy(F.desc("score"), content).limit(k)


def expand_query(query: str) -> list[str]:
    """RG-08."""
    low, out = query.lower(), [query]
    if any(w in low for w in ("average", "mean", "median", "max", "min", "std", "count", "rows")):
        out.append(f"summary statistics metric bounds distribution {query}")
    if any(w in low for w in ("quality", "missing", "grade", "confidence", "null", "issue")):
        out.append(f"data quality completeness confidence scores quality flags {query}")
    elif any(w in low for w in ("correlation", "relate", "relationship", "affect", "impact", "association")):
        out.append(f"strong correlation feature redundancies association {query}")
    return list(dict.fromkeys(out))


def fact(question: str, summary: DataFrame) -> dict | None:
    """RG-09: the stored statistic that a question names, of the column that it names."""
    low = question.lower()
    stat = next((s for w, s in (("average", "mean"), ("mean", "mean"), ("median", "median"), ("maximum", "max"), ("max", "max"), ("minimum", "min"), ("min", "min"), ("std", "std"), ("count", "count")) if w in low), None)
    for r in summary.collect():  # one row per column
        if stat and (r["column"].lower() in low or r["column"].lower().replace("_", " ") in low):
            return {"column": r["column"], "statistic": stat, "value": r[stat]}
    return None


def clean_question(text: str, longest: int = 2000) -> str:
    """STR-13."""
    return "".join(c for c in text if c >= " " or c in "\n\t")[:longest].strip()


def history(turns: list[tuple[str, str]], last: int = 6) -> str:
    """RG-10: the last turns as prompt text."""
    return "\n".join(f"{role}: {clean_question(text)}" for role, text in turns[-last:])


def named_columns(question: str, columns: list[str]) -> list[str]:
    """The columns that a question names, with underscores or spaces."""
    low = question.lower()
    return [c for c in columns if c.lower() in low or c.lower().replace("_", " ") in low]


def context(question: str, result: dict) -> dict:
    """RG-10: what an analysis result holds on a question: the statistics, roles and scores of the columns it names, and the parts that its words ask for."""
    low = question.lower()
    named = set(named_columns(question, result["columns"]))
    out: dict = {}
    for part in ("summary", "classification", "roles", "confidence"):
        if rows := [r for r in result.get(part) or [] if r["column"] in named]:
            out[part] = rows
    asked = (
        (("correlat", "relat", "depend", "associat"), "strong_correlations"),
        (("outlier", "anomal", "extreme"), "outliers"),
        (("trend", "season", "time", "over the year"), "time_series"),
        (("missing", "null", "empty"), "missing_patterns"),
        (("quality", "issue", "problem", "clean"), "issues"),
        (("categor", "frequent", "common", "share"), "categorical"),
    )
    for words, part in asked:
        if any(w in low for w in words) and result.get(part):
            out[part] = result[part]
    return out


def followups(result: dict | None, k: int = 3) -> list[str]:
    """RG-10: questions that the result can answer."""
    if not result:
        return ["Which quality issues matter most?", "Which columns are correlated most strongly?", "What did cleaning change?"][:k]
    numbers = [r["column"] for r in result.get("summary") or []]
    out = [f"How are {r['column_a']} and {r['column_b']} related?" for r in (result.get("strong_correlations") or [])[:1]] or ([f"How are {numbers[0]} and {numbers[1]} related?"] if len(numbers) > 1 else [])
    worst = max((result.get("outliers") or {}).items(), key=lambda x: x[1]["percentage"], default=None)
    out += [f"Which outliers does {worst[0]} have?"] if worst else [f"Does {numbers[0]} have outliers?"] if numbers else []
    out += [f"How did {c} change over time?" for c, t in (result.get("trends") or {}).items() if t.get("detected")][:1]
    out += ["Which steps do you recommend for this dataset?", "Which quality issues matter most?"]
    return list(dict.fromkeys(out))[:k]
