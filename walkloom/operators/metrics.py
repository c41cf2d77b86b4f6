"""Statistics of targets and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.operators.ranks import running


def mean_mad(rows: DataFrame, by: str) -> DataFrame:
    """Mean and mean absolute deviation of y per group, in two passes."""
    mean = rows.groupBy(by).agg(F.avg("y").alias("mean"))
    return rows.join(mean, by).groupBy(by).agg(F.first("mean").alias("mean"), F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mad"), F.count("*").alias("n_train"))


def summarize(rows: DataFrame, by: list[str], value: str, ddof: int = 0) -> DataFrame:
    """The columns of by, mean, std, lo, hi, n of value: nulls don't count. ddof 0 is the deviation of a population, 1 of a sample, 0 where
    there is one value only."""
    if ddof not in (0, 1):
        raise ValueError("ddof is 0 or 1")
    x = F.col(value)
    std = F.stddev_pop(x) if ddof == 0 else F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, 0.0)
    return rows.groupBy(*by).agg(F.avg(x).alias("mean"), std.alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"))


def standardized(y: Column, mean: Column, std: Column) -> Column:
    return (y - mean) / F.greatest(std, F.lit(1e-8))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Tie-averaged Mann-Whitney AUC of (score, label); NaN with one class. Counts by score first, then running
    sums over the scores, which may be any numbers."""
    by = rows.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    won = running(by, [F.col("score")], "q").withColumn("won", F.col("p") * (F.col("ahead") + F.col("q") / 2))
    total = F.sum("p") * F.sum("q")
    return won.agg(F.when(total > 0, F.sum("won") / total).otherwise(float("nan")).alias("auc"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))


def bce(p: Column, y: Column) -> Column:
    """Cross-entropy with logarithms clamped at -100."""
    low = F.lit(-100.0)
    return -(y * F.greatest(F.ln(p), low) + (1 - y) * F.greatest(F.ln(1 - p), low))


def category_index(value: Column, allowed: list[str], strict: bool = False) -> Column:
    """Place in the list; an absent value takes the last place, or is an error."""
    at = F.array_position(F.array(*map(F.lit, allowed)), value)
    other = F.raise_error(F.lit("value not allowed")).cast("long") if strict else F.lit(len(allowed)).cast("long")
    return (F.when(at > 0, at).otherwise(other) - 1).cast("int")


def one_hot_argmax(v: Column) -> Column:
    """Place of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
