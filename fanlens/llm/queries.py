"""The operators bound to the given tables: one query each, and the pipeline."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanlens.llm import (
    decontamination, hard_negatives, html_extract, learned_index, line_dedup, manifest, ngram_join, pieces, quality_lm,
    sharding, simhash, suffix_dedup, url_filter,
)
from fanlens.llm.common import text_bytes
from fanlens.sources.interactions import table

PIECE_MODEL = "piece_bpe_32k.model"

#: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def piece_model() -> str:
    """Place of the public tokenizer file; ``FANLENS_PIECE_MODEL`` names another."""
    if path := os.environ.get("FANLENS_PIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_articles(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op2_learned_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return learned_index.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_texts(docs, piece_model())
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    judged = quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.where("keep").select("doc_id", "lang", "perplexity", "threshold")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_components(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (text_bytes(F.col("text")) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.interleave(docs, shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    rows = docs.select(
        "doc_id", "source", manifest.leaf_digest(*fields(F.col("text"))).alias("leaf"),
        F.when(chosen, manifest.leaf_digest(*fields(without))).alias("tampered"),
    )
    out = manifest.prove(manifest.build(rows, "source", "doc_id", "leaf", keep=["doc_id", "tampered"]), ["doc_id", "tampered"])
    before, after = F.col("before"), F.col("after")
    out = out.withColumn("folded_root", manifest.folded_root(F.coalesce("tampered", "leaf"), before, after))
    proof = manifest.proof_digest(before, after).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_learned_index, op3_sentencepiece, op4_quality, op5_simhash,
        op6_line_dedup, op7_suffix_dedup, op8_url_filter, op9_sharding, op10_decontamination,
        op11_merkle_manifest, op12_hard_negatives, op13_ngram_jaccard,
    )
}
