"""Shared helpers: the folder every executor sees, materialised tables, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the contracts of these operators.
SPACE = r"[\x20\x09-\x0D]"
#: Joins broadcast a side of ids only up to this many rows (about 16 MB as a hash relation); beyond it they shuffle.
BROADCAST_ROWS = 400_000

#: Groups in which the partitions' sums are added before they go to the driver.
GROUPS = 8

_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8388608"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without that setting, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-walkloom-"))
    return "file://" + _own[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, lineage cut, safe against lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_BYTES)  # long texts: batches between the JVM and Python by size, not only by rows
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join on one id column; the ids (a written table) are broadcast only if few, else both sides shuffle."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


#: Parts among which the rows of each host are dealt when host lists are too many to broadcast.
HOST_PARTS = 64


def by_host(rows: DataFrame, lists: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """rows (__host) with the columns of lists (__at_host), null where a host has none. The lists are broadcast if they come from at most
    `most` rows of found; else each host's rows are dealt among many keys and its list is repeated for them, as one host may hold most rows."""
    if found.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(lists), F.col("__host") == F.col("__at_host"), "left")
    part = F.pmod(F.monotonically_increasing_id(), F.lit(HOST_PARTS))
    spread = lists.withColumn("__at_part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1)).cast("array<long>")))
    return rows.withColumn("__part", part).join(spread.hint("merge"), (F.col("__host") == F.col("__at_host")) & (F.col("__part") == F.col("__at_part")), "left")


#: A key with more rows than the first and than this share of all is hot; so there are never more hot keys than the second.
HOT_ROWS, HOT_KEYS = 256, 20_000


def hot_bound(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_KEYS)


#: A table of fewer rows is no work for one task, whatever its keys.
FEW_ROWS = 200_000


def unskewed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join with a table of one row for each key. Hot keys of left (given, or counted here) are at most HOT_KEYS, so their rows of
    right are broadcast; all other keys shuffle. left should be a written table, as it is read for both."""
    if hot is None:
        n = left.count()
        if n <= FEW_ROWS:
            return left.join(right, keys, how)
        hot = left.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_bound(n)).where(" and ".join(f"`{k}` is not null" for k in keys))
        hot = written(hot.select(*keys), "hot")
    if hot.isEmpty():
        return left.join(right.hint("merge"), keys, how)
    hot = hot.select(*keys)
    marked = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    few = right.join(F.broadcast(hot), keys, "left_semi")
    a = marked.where("__hot").drop("__hot").join(F.broadcast(few), keys, how)
    return a.unionByName(marked.where("__hot is null").drop("__hot").join(right.hint("merge"), keys, how))


def whole_text(text: str) -> F.Column:
    return F.coalesce(F.col(text), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sums(of: Callable[[pa.RecordBatch], np.ndarray]) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = of(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"total": [total.astype("<f8").tobytes()]})

    return task


def summed(rows: DataFrame, of: Callable, whole: bool = False) -> np.ndarray | None:
    """Sum of a fixed-size array over all rows: per partition, then per group of partitions, then on the driver.

    of: an array from a batch or, with whole, rows (total binary) of little-endian doubles from all batches of a task.
    """
    parts = rows.mapInArrow(of if whole else _sums(of), "total binary")
    found = parts.repartition(GROUPS).mapInArrow(_sums(lambda b: np.sum([np.frombuffer(x, "<f8") for x in b.column("total").to_pylist()], axis=0)), "total binary").collect()
    return np.sum([np.frombuffer(r["total"], "<f8") for r in found], axis=0) if found else None
