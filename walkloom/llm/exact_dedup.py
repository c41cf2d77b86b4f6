"""Exact deduplication by a content sort.

Sampled splitters range-partition the normalised bytes (head, digest and row order decide where a row goes, so a group of
copies may span partitions), an external sort places equal texts next to each other, and one pass compares each row with its
neighbour in full. Runs that cross a partition border are joined through a table of at most two rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, whole_text, written

_RUNS = "doc_id long, text_sha256 binary, part int, run long, n long, leader_row boolean, leader long, first_run boolean, last_run boolean"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.binary()), ("part", pa.int32()), ("run", pa.int64()), ("n", pa.int64()), ("leader_row", pa.bool_()), ("leader", pa.int64()), ("first_run", pa.bool_()), ("last_run", pa.bool_())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts in one sorted partition; only the ids and digests of the open run are kept."""
    held, last, part, at = [], None, 0, -1  # pieces of the open run, its text, the partition, the run's number

    def sized(pieces: list[tuple], closing: bool) -> pa.RecordBatch:
        ids, sha = (pa.concat_arrays([p[k] for p in pieces]) for k in (0, 1))
        run = np.concatenate([p[2] for p in pieces])
        start = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
        n = np.diff(start, append=len(run))
        head = np.zeros(len(run), bool)
        head[start] = True
        first = np.repeat(start, n)
        return pa.RecordBatch.from_arrays([ids, sha, pa.repeat(pa.scalar(part, pa.int32()), len(run)), pa.array(run), pa.array(np.repeat(n, n)), pa.array(head), ids.take(pa.array(first)), pa.array(run == 0), pa.repeat(closing, len(run))], schema=_SCHEMA)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids, sha = (batch.column(k) for k in ("key", "doc_id", "sha"))
        part = batch.column("part")[0].as_py()
        fresh = np.ones(len(key), bool)
        fresh[0] = last is None or last != key[0]
        if len(key) > 1:
            fresh[1:] = ~pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        run = np.cumsum(fresh) + at
        cut = int(np.searchsorted(run, run[-1]))
        done = [*held, *([(ids.slice(0, cut), sha.slice(0, cut), run[:cut])] if cut else [])]
        rest = (ids.slice(cut), sha.slice(cut), run[cut:])
        if run[-1] == at:  # the whole batch goes on with the open run
            held.append(rest)
        else:
            if done:
                yield sized(done, False)
            held = [rest]
        last, at = key[len(key) - 1], int(run[-1])
    if held:
        yield sized(held, True)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; columns besides id and text are not read.

    Texts are equal when identical without ASCII white space. The row with the most code points in its original text, then the
    smallest id, stays. A null text is empty; all empty texts are one group. A null id sorts after all others and can be kept
    when alone. Of rows that repeat the same id and text one is kept. An empty table gives no rows.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, SPACE + "+", "").cast("binary").alias("key"))
    rows = rows.select("*", F.substring("key", 1, 32).alias("head"), F.unhex(F.sha2("key", 256)).alias("sha"))
    order = [F.col("head"), F.col("sha"), F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last()]
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions("head", "sha", "key", *order[2:])
    runs = written(ranged.select("key", "doc_id", "sha", F.spark_partition_id().alias("part")).mapInArrow(_runs, _RUNS), "runs")

    edge = runs.where("leader_row and (first_run or last_run)").select("part", "run", "text_sha256", "leader", "n")
    ahead = Window.orderBy("part", "run")  # over two rows per partition at most
    chained = edge.withColumn("fresh", (~F.col("text_sha256").eqNullSafe(F.lag("text_sha256").over(ahead))).cast("int")).withColumn("chain", F.sum("fresh").over(ahead))
    whole = Window.partitionBy("chain").orderBy("part", "run")
    joined = chained.select("part", "run", F.first("leader").over(whole).alias("chain_leader"), F.sum("n").over(Window.partitionBy("chain")).alias("chain_n"), (F.row_number().over(whole) == 1).alias("chain_head"))
    return runs.join(F.broadcast(joined), ["part", "run"], "left").select(
        "doc_id",
        F.when(F.col("chain_n").isNull(), F.col("leader")).otherwise(F.col("chain_leader")).alias("keep_id"),
        F.coalesce("chain_n", "n").alias("group_size"),
        (F.col("leader_row") & F.coalesce("chain_head", F.lit(True))).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )
