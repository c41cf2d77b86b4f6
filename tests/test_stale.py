"""The stateful monitor equals its batch twin over out-of-order files, drops late rows, and goes on from its checkpoint."""

import tempfile
from datetime import datetime, timedelta

from walkloom.streaming import stale

T = datetime(2024, 5, 1)


def rows_of(*minutes):
    return [(run, T + timedelta(minutes=m)) for run, m in minutes]


def put(spark, folder, rows):
    spark.createDataFrame(rows, "run string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    return spark.readStream.schema("run string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def plain(df):
    return sorted((r["run"], (r["begin"] - T).total_seconds() // 60, (r["end"] - T).total_seconds() // 60, r["n"], r["retry"], r["skip"]) for r in df.collect())


def test_restart_late_rows_and_skips(spark):
    base = tempfile.mkdtemp(prefix="spark-stale-")
    folder, state = f"file://{base}/in", f"file://{base}/state"
    first = rows_of(("a", 10), ("a", 0), ("b", 5), ("a", 100), ("c", 100), ("a", 110), (None, 3))
    put(spark, folder, first)
    got = plain(stale.emitted(stale.stale_spells(read(spark, folder), most=1), state))
    assert got == [("a", 0, 40, 2, 1, False), ("b", 5, 35, 1, 1, False)]  # the watermark stands at 80
    late = rows_of(("b", 20), ("b", 79))
    put(spark, folder, [*late, *rows_of(("b", 200), ("a", 130))])
    got = plain(stale.emitted(stale.stale_spells(read(spark, folder), most=1), state))
    kept = [*first, *rows_of(("b", 200), ("a", 130))]
    assert got == [("a", 0, 40, 2, 1, False), ("a", 100, 160, 3, 2, True), ("b", 5, 35, 1, 1, False), ("c", 100, 130, 1, 1, False)]
    more = rows_of(("a", 210), ("a", 400), ("b", 205), ("c", 900), ("d", 1000))
    put(spark, folder, more)
    got = plain(stale.emitted(stale.stale_spells(read(spark, folder), most=1), state))
    twin = plain(stale.stale_spells(spark.createDataFrame([*kept, *more], "run string, ts timestamp"), most=1))
    assert [r for r in twin if r[2] <= 970] == got and ("a", 100, 160, 3, 2, True) in got and not any(r[0] == "a" and r[4] > 2 for r in got)
