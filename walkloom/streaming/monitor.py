"""Run monitors over a stream of epoch rows (run, epoch, valid, ts), each with a batch twin of the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def epoch_progress(rows: DataFrame) -> DataFrame:
    """run, last_epoch, best_valid, n over all rows so far; works on a stream (complete or update mode) and on a table."""
    return rows.groupBy("run").agg(F.max("epoch").alias("last_epoch"), F.min("valid").alias("best_valid"), F.count("*").alias("n"))


def run_state(progress: DataFrame, manifest: DataFrame, done: DataFrame) -> DataFrame:
    """done where results are present, running where only epochs are, else pending."""
    found = manifest.join(done.select("run", F.lit(True).alias("is_done")), "run", "left").join(progress.select("run", "n"), "run", "left")
    return found.select("run", F.when(F.col("is_done"), "done").when(F.col("n") > 0, "running").otherwise("pending").alias("state"))


def quiet_spells(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """run, begin, end, n of each spell of rows without a gap that long; on a stream a spell is emitted once its gap has passed."""
    if rows.isStreaming:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", gap)  # watermarks need a time with a zone
    return rows.groupBy("run", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("run", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def retries(spells: DataFrame, most: int = 1) -> DataFrame:
    """Each quiet spell with retry, the number of spells of its run up to it, and skip: whether that is more than a run is given."""
    order = Window.partitionBy("run").orderBy("begin")
    return spells.withColumn("retry", F.row_number().over(order)).withColumn("skip", F.col("retry") > most)


def drained(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """Run a stream over all that is there and return its table: each batch replaces (complete) or extends (append) what is under path."""
    spark: SparkSession = stream.sparkSession
    out = f"{path}/out-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(out)
