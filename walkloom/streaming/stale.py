"""Stale runs decided while the stream runs: quiet spells, retries and skips in the state of each run, with a batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from walkloom.streaming import monitor

COLUMNS = ["run", "begin", "end", "n", "retry", "skip"]
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Spells(StatefulProcessor):
    """State of a run: the open spell, its retries so far, whether it is skipped, and the times that the watermark has not reached.

    Rows come in any order, so a time waits until the watermark has passed it. A timer stands at the next time something can
    happen: the earliest waiting time, or the end of the open spell's gap.
    """

    def __init__(self, gap: timedelta, most: int) -> None:
        self.gap, self.most = pd.Timedelta(gap), most

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.spell = handle.getValueState("spell", "begin timestamp, last timestamp, n long")
        self.count = handle.getValueState("retries", "retry int, skip boolean")
        self.waiting = handle.getListState("waiting", "ts timestamp")

    def _moved(self, run, times: list[pd.Timestamp], watermark_ms: int) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        """Fold the times up to the watermark into spells, emit those that are over, and set the next timer."""
        now = pd.Timestamp(watermark_ms, unit="ms")
        retry, skip = self.count.get() if self.count.exists() else (0, False)
        spell = [pd.Timestamp(x) if k < 2 else x for k, x in enumerate(self.spell.get())] if self.spell.exists() else None
        out, times = [], sorted(times)
        while not skip:
            ready = times and times[0] <= now
            over = spell and ((times[0] - spell[1] >= self.gap) if ready else spell[1] + self.gap <= now)
            if over:
                retry, skip = retry + 1, retry + 1 > self.most
                out.append((run, spell[0], spell[1] + self.gap, spell[2], retry, skip))
                spell = None
            elif ready:
                ts = times.pop(0)
                spell = [spell[0], ts, spell[2] + 1] if spell else [ts, ts, 1]
            else:
                break
        if skip:
            times, spell = [], None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = min([*times[:1], *([spell[1] + self.gap] if spell else [])], default=None)
        if due is not None:
            self.handle.registerTimer(-(-due.value // 1_000_000))
        self.count.update((retry, skip))
        self.spell.update((spell[0].to_pydatetime(), spell[1].to_pydatetime(), spell[2])) if spell else self.spell.clear()
        self.waiting.put([(t.to_pydatetime(),) for t in times]) if times else self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def _waiting(self) -> list[pd.Timestamp]:
        return [pd.Timestamp(t) for (t,) in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803  names that Spark calls
        times = [pd.Timestamp(t) for pdf in rows for t in pdf["ts"]]
        yield from self._moved(key[0], self._waiting() + times, max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._moved(key[0], self._waiting(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stale_spells(rows: DataFrame, minutes: int = 30, most: int = 1) -> DataFrame:
    """run, begin, end, n, retry, skip of each spell of rows (run, ts) that a quiet gap has ended, up to the one that makes a run skipped.

    The first `most` spells of a run are retried; the next one says skip, and what comes later of that run is ignored. On a stream a spell comes
    out once the watermark, one gap behind the newest row, has passed its end; rows older than the watermark are dropped. On a table all spells are
    over. Rows without a run or a time are left out.
    """
    rows = rows.select("run", F.col("ts").cast("timestamp").alias("ts")).where("run is not null and ts is not null")
    if not rows.isStreaming:
        return monitor.retries(monitor.quiet_spells(rows, f"{minutes} minutes"), most).where(F.col("retry") <= most + 1).select(*COLUMNS)
    kind = rows.schema["run"].dataType.simpleString()
    schema = f"run {kind}, begin timestamp, end timestamp, n long, retry int, skip boolean"
    return rows.withWatermark("ts", f"{minutes} minutes").groupBy("run").transformWithStateInPandas(Spells(timedelta(minutes=minutes), most), schema, "Append", "EventTime")


def emitted(stream: DataFrame, path: str) -> DataFrame:
    """All that the stream has emitted so far: run over what is there, from the checkpoint under path on. A batch that is run again replaces its
    own rows, so a restart neither loses nor repeats any."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # timers and lists need it
    try:
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")
