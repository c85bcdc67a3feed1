"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

language: documents without a letter, or of which no language has half the
probability, go. lines: of each group of fuzzily equal lines one occurrence
stays; documents that lose all they had go. near_duplicates: one document of each
component of Jaccard similarity 0.8 or more over shingles of five words stays. decontaminate: documents that hold a benchmark window go.
encode: the tokens of what is left.

Null and letterless texts go in the first stage. Repeated rows are near duplicates: one stays. Texts are read
whole. A table without documents gives one without rows. Columns beside those that a stage reads come through
under their own names, whatever these are, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, langid, line_dedup, simhash
from plumbline.llm.common import settle, table, unnamed
from plumbline.llm.queries import language_model, tokenizer_file

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, text = unnamed(docs, "text")
    found = langid.predict(plain, language_model(docs), text=text, keep=tuple(plain.columns), names=("_lang", "_score"))
    return found.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*plain.columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, key, text = unnamed(docs, "doc_id", "text")
    found = line_dedup.dedup(plain, key, text)
    emptied = (F.col("_n_removed") > 0) & (F.size(line_dedup.words(F.col(text))) == 0)
    kept = found.where(F.col(text).isNull() | ~emptied).select(*plain.columns).toDF(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_by_shingles(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("encode", encode),
]
ORACLE_SQL = None  # language models and tokenizers have no SQL; tests hold near_duplicates and decontaminate against the operators' own brute-force tests, the other stages against properties of their output


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
