"""From raw documents to packed training sequences: five stages, each one operator of walkloom.llm.

Each stage gets what its predecessor kept, with the columns of documents, and its result is written as Parquet and read again. Rows with a
null doc_id can't be named by a decision, so the filtering stages keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom.llm import decontaminate, line_dedup, near_dedup, quality, queries
from walkloom.llm.common import by_ids, table, written


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among those of gone, with the columns in their order."""
    ids = written(gone.where("doc_id is not null").select("doc_id").distinct(), "gone")
    return by_ids(docs, ids, "doc_id", "left_anti").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.where("predicted = 0"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_boilerplate(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[n_chars.alias(c) if c == "n_chars" else c for c in docs.columns])


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, near_dedup.near_groups(docs).where("not kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", keep_one_of_group), ("decontamination", drop_leaks), ("packing", pack)]
#: The stages are not expressible in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
