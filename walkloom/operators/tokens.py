"""Tokens, vocabularies and their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.operators.ranks import running

LETTERS = "([A-Za-z]+)"


def tokenize(text: Column, pattern: str = LETTERS) -> Column:
    """All leftmost matches; what doesn't match is skipped."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def mapped_tokens(tokens: Column) -> Column:
    """(atom_no from 0, base) of tokens like [C:3]; others are left out."""
    ours = F.filter(tokens, lambda t: t.startswith("[") & t.contains(":"))
    return F.transform(ours, lambda t: F.struct((F.regexp_extract(t, r":(\d+)", 1).cast("int") - 1).alias("atom_no"), F.substring_index(F.substring(t, 2, 1 << 20), ":", 1).alias("base")))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """token, id: distinct tokens by code point from 0, PAD last. Distinct tokens are numbered by ranges and counts, in as many tasks as there are."""
    ids = running(tokens.select("token").distinct(), [F.col("token")]).select("token", F.col("ahead").cast("int").alias("id"))
    return ids.unionByName(ids.agg(F.lit("PAD").alias("token"), F.coalesce(F.max("id") + 1, F.lit(0)).alias("id")))


def encoded(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """The tokens with their ids; a token outside the vocabulary is an error."""
    found = tokens.join(vocab, "token", "left")
    return found.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("unknown token "), "token"))).otherwise(F.col("id")))
