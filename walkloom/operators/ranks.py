"""Ranks and running sums over all rows, or over groups of any size, without a task that holds them all.

Sampled splitters cut the rows into range partitions, each counts or adds up its own rows, and a table of one row for each part and group
holds what lies ahead of a part. Rows that repeat the same keys are told apart by their place in a written table, so that even a third of
all rows with one key spreads over many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.sources.tables import written


def running(rows: DataFrame, order: list[Column], value: str | None = None, group: list[str] | None = None) -> DataFrame:
    """The rows with ahead, the number of rows (or the sum of value) before each in its group by `order`, and total, over its group.

    Rows of equal order come in any order, the same in each run over the same table. Groups may be null. No rows give none.
    """
    group = group or []
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [*map(F.col, group), *order, F.col("__id")]
    kept = written(rows.withColumn("__id", F.monotonically_increasing_id()), "rows")
    placed = kept.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("__part", F.shiftright("__at", 33)), "placed")
    amount = F.lit(1).cast("long") if value is None else F.col(value)
    spans = placed.groupBy(*group, "__part").agg(F.sum(amount).alias("__sum"), F.min("__at").alias("__lo"))
    each = Window.partitionBy(*group)  # over one row for each part
    before = F.sum("__sum").over(each.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__part").alias("__of"), before.alias("__before"), F.sum("__sum").over(each).alias("total"), "__lo")
    same = placed["__part"] == spans["__of"]
    for c in group:
        same = same & placed[c].eqNullSafe(spans[f"__{c}"])
    if value is None:
        own = F.col("__at") - F.col("__lo")
    else:
        own = F.sum(value).over(Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    found = placed.join(spans, same).withColumn("ahead", F.coalesce("__before", F.lit(0)) + F.coalesce(own, F.lit(0)))
    return found.select(*rows.columns, "ahead", "total")
