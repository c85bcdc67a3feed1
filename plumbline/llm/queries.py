"""The queries over the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SHARDS = 8


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file: in PLUMBLINE_TOKENIZERS where that is set, else that of the installed package."""
    import os

    folder = os.environ.get("PLUMBLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def language_model(docs: DataFrame) -> tuple:
    from plumbline.llm.langid import held_out, train

    learn = docs.where(~held_out())
    return train(learn, tokenizer_file("byte_bpe_multi_50k.tiktoken"), by=F.xxhash64("doc_id"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.langid import held_out, predict

    docs = table(spark, sf_dir, "documents")
    found = predict(docs, language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), with_ids=False)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.line_dedup import dedup

    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.url_filters import judge

    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages"), rules)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.decontaminate import scan

    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.rotated_codes import links

    return links(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.ranked_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
with recursive e as materialized (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), u as materialized (
  select vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from e
), link as materialized (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_inner_product(a.v, b.v) >= 0.95
), reach(a, b) as (
  select vec_id, vec_id from u union select reach.a, link.b from reach join link on reach.b = link.a
), least as (select a, min(b) as component_id from reach group by a),
number as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join least on vec_id = least.a left join number on vec_id = number.a
"""

OP12_SQL = r"""
with d as materialized (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents
), size as (select count(*) as docs, cast(sum(len(words)) as bigint) as terms from d where len(words) > 0),
tf as materialized (select doc_id, len(words) as n, term, count(*) as tf from (select doc_id, words, unnest(words) as term from d) group by all),
df as (select term, count(*) as df from tf group by term),
asked as (
  select distinct item_id, term from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
), scored as (
  select item_id, doc_id, cast(sum(cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) as bigint) as score
  from asked join tf using (term) join df using (term), size group by item_id, doc_id
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10
"""


def _op13_sql(rounds: int = 4) -> str:
    """Each round: the nearest entry of each part, then the floors of the means; unused entries stay."""
    out = [
        """k as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as v from k, range(4) r(p)
), book0 as materialized (
  select p, row_number() over (partition by p order by vec_id) - 1 as e, v from parts where vec_id in (select vec_id from k order by vec_id limit 256)
)"""
    ]
    for r in range(rounds + 1):
        out.append(f"""near{r} as materialized (
  select vec_id, label, p, min(d * 256 + e) as de from (
    select x.vec_id, x.label, x.p, e, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v) as d
    from parts x join book{r} b on x.p = b.p) group by all
)""")
        if r < rounds:
            out.append(f"""book{r + 1} as materialized (
  select b.p, b.e, coalesce(n.v, b.v) as v from book{r} b left join (
    select p, e, list(m order by place) as v from (
      select n.p, cast(de as bigint) % 256 as e, place, floor(sum(x.v[place]) / count(*)) as m
      from near{r} n join parts x on n.vec_id = x.vec_id and n.p = x.p, range(1, (select max(len(v)) + 1 from parts)) g(place) group by all) group by p, e) n on b.p = n.p and b.e = n.e
)""")
    last = f"near{rounds}"
    return (
        "with "
        + ", ".join(out)
        + f""", coded as (
  select vec_id, label, string_agg(printf('%02x', cast(de as bigint) % 256), '' order by p) as code, cast(sum(cast(de as bigint) // 256) as bigint) as error from {last} group by vec_id, label
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(cast(v[place] as bigint) as varchar), ',' order by p, e, place)) from book{rounds}, range(1, (select max(len(v)) + 1 from parts)) g(place)) as codebooks_sha256
from coded"""
    )


OP8_SQL = r"""
with u as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path
  from u
), rules(verdict, rhost, rpath) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
)
select page_id, host, path,
  (select rhost || rpath from rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
     order by length(rhost || rpath) desc limit 1) as rule,
  coalesce((select verdict from rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
     order by length(rhost || rpath) desc limit 1), 'allow') as verdict
from h
"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from plumbline.llm.licenses import scan_sql

    return {"op4_licenses": scan_sql(), "op8_url_filters": OP8_SQL, "op11_embedding_dedup": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_vector_codes": _op13_sql()}
