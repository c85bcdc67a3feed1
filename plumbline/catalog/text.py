"""Retrieval and text queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog.base import query, table
from plumbline.catalog.statistics import rounded
from plumbline.operators import issues, retrieve
from plumbline.operators.fulltext import FullText
from plumbline.plans.shared import shared_folder

_QUERY = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_VECTOR = "[" + ", ".join(map(str, _QUERY)) + "]::double[]"
_ASKED = "the and version license"


def _vector_sql(k: int) -> str:
    return f"select vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::double), {_VECTOR}) as score from embeddings order by score desc, vec_id limit {k}"


@query("vector_topk", f"select vec_id, round(score, 6) as score from ({_vector_sql(10)})")
def vector_topk(spark, d):
    return rounded(retrieve.vector_search(table(spark, d, "embeddings"), _QUERY, 10))


_WORDS = "list_filter(list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')), lambda w: w <> '')"


def _keyword_sql(k: int) -> str:
    n = len(_ASKED.split())
    return f"select doc_id, len(list_intersect(w, {_ASKED.split()!r})) / ({n ** 0.5} * sqrt(len(w)) + 1e-6) as score from (select doc_id, {_WORDS} as w from documents) where len(w) > 0 order by score desc, doc_id limit {k}"


@query("keyword_topk", f"select doc_id, round(score, 6) as score from ({_keyword_sql(10)})")
def keyword_topk(spark, d):
    return rounded(retrieve.keyword_search(table(spark, d, "documents"), _ASKED, 10))


@query(
    "hybrid_rrf",
    f"""with v as (select vec_id as id, 1 - score as dist, rank() over (order by score desc) as r from ({_vector_sql(20)})), k as (select doc_id as id, score, rank() over (order by score desc) as r from ({_keyword_sql(20)}))
    select id, round(vector_distance, 6) as vector_distance, round(keyword_score, 6) as keyword_score, round(rrf, 6) as rrf, round(least(0.99, 1 - vector_distance + 5 * rrf), 6) as score from (
      select coalesce(v.id, k.id) as id, coalesce(v.dist, 1.0) as vector_distance, coalesce(k.score, 0.0) as keyword_score, coalesce(1.0::double / (60 + v.r), 0) + coalesce(1.0::double / (60 + k.r), 0) as rrf from v full join k on v.id = k.id)
    order by rrf desc, id limit 10""",
)
def hybrid_rrf(spark, d):
    v = retrieve.vector_search(table(spark, d, "embeddings"), _QUERY, 20)
    k = retrieve.keyword_search(table(spark, d, "documents"), _ASKED, 20)
    out = retrieve.hybrid_search(v, k, 10)
    return rounded(out.select("id", *[F.col(c).cast("double").alias(c) for c in ("vector_distance", "keyword_score", "rrf", "score")]))


@query("chunking")
def chunking(spark, d):
    return retrieve.chunks(table(spark, d, "documents"), "doc_id", "text")


@query("fuzzy_pairs")
def fuzzy_pairs(spark, d):
    return issues.fuzzy_pairs(table(spark, d, "part"), "p_name")


@query("title_case", "select distinct c_mktsegment as raw, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as titled from customer")
def title_case(spark, d):
    x = table(spark, d, "customer").select(F.col("c_mktsegment").alias("raw"), F.col("c_mktsegment").alias("titled"))
    return issues.Fix("title_case", "titled").apply(x).distinct()


@query("fuzzy_titles")
def fuzzy_titles(spark, d):
    titles = table(spark, d, "pages").select(F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return issues.fuzzy_pairs(titles, "title")


def _index(spark, d, name="documents", key="doc_id", text="text"):
    return FullText(spark, f"{shared_folder(spark)}/fulltext-{uuid.uuid4().hex}").add(table(spark, d, name), key, text)


_ALL_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')"
_BM25 = f"""d as materialized (select doc_id, {_ALL_WORDS} as w from documents), size as (select count(*) as n, sum(len(w)) as total from d where len(w) > 0),
  tf as materialized (select doc_id, term, len(w) as length, count(*) as tf from (select doc_id, w, unnest(w) as term from d) group by all), df as (select term, count(*) as df from tf group by term)"""
_SCORE = "sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length * (n / total))))"


@query("bm25_topk", f"with {_BM25} select doc_id, round({_SCORE}, 6) as score from tf join df using (term), size where term in ({', '.join(repr(w) for w in _ASKED.split())}) group by doc_id order by {_SCORE} desc, doc_id limit 10")
def bm25_topk(spark, d):
    return rounded(_index(spark, d).bm25(_ASKED, 10).withColumnRenamed("doc", "doc_id"))


@query(
    "bm25_batch",
    f"""with {_BM25}, asked as (select distinct item_id, unnest({_ALL_WORDS}) as term from benchmark), s as (select item_id, doc_id, {_SCORE} as score from asked join tf using (term) join df using (term), size group by item_id, doc_id)
    select item_id, cast(rank as integer) as rank, round(score, 5) as score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) where rank <= 5""",
)
def bm25_batch(spark, d):
    """Ties in the last digit may order documents differently, so their ids are left out."""
    found = _index(spark, d).bm25_batch(table(spark, d, "benchmark"), "item_id", "text", 5)
    return rounded(found.drop("doc"), 5)


@query("keyword_index", f"select doc_id, round(score, 6) as score from ({_keyword_sql(10)})")
def keyword_index(spark, d):
    """keyword_topk from the index."""
    return rounded(_index(spark, d).overlap(_ASKED, 10).withColumnRenamed("doc", "doc_id"))
