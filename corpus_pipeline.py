"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.

Defined cases, for every stage: an empty table gives an empty one; other columns than
those of ``documents`` are left out.  Null and empty texts, null ids, languages and
sources, and repeated rows are rows like others: quality keeps them unless their
language's model rejects the text, lines leaves a null text null, near_copies keeps
one row of each group of near copies (empty texts are one group), benchmark_free keeps
a text without a passage, encoded gives begin and end ids for a null or empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanlens.llm import decontamination, line_dedup, pieces, quality_lm, simhash
from fanlens.llm.queries import piece_model
from fanlens.session import shared_path
from fanlens.sources.interactions import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is at most their language's threshold."""
    return quality_lm.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines."""
    cut = line_dedup.drop_lines(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and decoded text of each document."""
    out = pieces.encode_texts(docs.select("doc_id", "lang", "source", "text"), piece_model())
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("encoded", encoded),
]

#: The language model and the fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "pipeline", name, unique=True)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
