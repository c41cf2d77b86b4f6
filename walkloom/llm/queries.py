"""Registered queries of this subpackage, each over its whole table, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed_dedup, exact_dedup, html_text, line_dedup, lm, merkle, near_dedup, packing, pii, quality, spelling, token_store
from .common import new_path, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "tokens")
    manifest = token_store.write_store(table(spark, sf_dir, "documents"), root, tokenizer_file("byte_bpe_50k.json"), "byte", 2)
    return token_store.read_store(manifest, root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def packed(docs: DataFrame) -> DataFrame:
    found = packing.pack(docs, tokenizer_file("word_bpe_49k.json"), "word", 1)
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.joined("base_spans"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), claim))


QUERIES = {
    "op1_lm_scoring": lambda spark, d: lm.lm_scores(table(spark, d, "documents")),
    "op2_token_store": op2,
    "op3_minhash_near_dedup": lambda spark, d: near_dedup.near_groups(table(spark, d, "documents")),
    "op4_quality_classifier": lambda spark, d: quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_decontamination": lambda spark, d: decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op6_best_fit_packing": lambda spark, d: packed(table(spark, d, "documents")),
    "op7_line_dedup": lambda spark, d: line_dedup.drop_boilerplate(table(spark, d, "documents")).select("doc_id", "text", "n_lines", "n_dropped"),
    "op8_html_main_text": lambda spark, d: html_text.main_text(table(spark, d, "pages")),
    "op9_personal_data": op9,
    "op10_exact_dedup": lambda spark, d: exact_dedup.exact_groups(table(spark, d, "documents")),
    "op11_embedding_near_dedup": lambda spark, d: embed_dedup.near_vectors(table(spark, d, "embeddings")),
    "op12_spelling_variants": lambda spark, d: spelling.variants(table(spark, d, "documents")),
    "op13_merkle_manifest": op13,
}

ORACLES = {
    "op7_line_dedup": line_dedup.SQL,
    "op13_merkle_manifest": merkle.SQL,
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS k FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)""",
}
