"""Tables of experiment runs: pending work, best configurations, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.operators.ranks import running

#: Epochs of a run that one task looks at.
BLOCK = 4096


#: Order of the places where a report looks for a run's test error.
_FIRST = [f"get(splits, 0).{c}" for c in ("final_test_mae", "test_mae", "best_test_mae")]
REPORTS = {
    "master": ["summary.mean_test_mae", "test_mae", "mean_test_mae", "best_test_mae", *_FIRST],
    "full": ["summary.mean_test_mae", "test_mae", _FIRST[1], _FIRST[0], _FIRST[2]],
    "gap": [_FIRST[1], _FIRST[0], "summary.mean_test_mae"],
}


def _number(place: str) -> Column:
    return F.nanvl(F.expr(place).cast("double"), F.lit(None).cast("double"))


def test_mae(report: str | list[str]) -> Column:
    """The first place with a number, in the order of a report's name or of the list."""
    return F.coalesce(*map(_number, REPORTS[report] if isinstance(report, str) else report))


def complete_runs(rows: DataFrame, rule: str = "number", least_bytes: int = 0) -> DataFrame:
    """Finished runs. number: a mean test error, else one of the first split; summary: a summary at all. Smaller files count as unfinished."""
    done = F.col("summary").isNotNull() if rule == "summary" else F.coalesce(_number("summary.mean_test_mae"), _number(_FIRST[1])).isNotNull()
    return rows.where(done & (F.col("n_bytes") >= least_bytes) if least_bytes else done)


def ab_winner(new: Column, old: Column) -> Column:
    """new, old or undecided: no new result decides nothing, a new one wins without an old one or below it."""
    return F.when(new.isNull(), "undecided").when(old.isNull() | (new < old), "new").otherwise("old")


def config_mismatches(configs: DataFrame, required: dict[str, str]) -> DataFrame:
    """Of rows (run, name, value): run, name, value, want where a required value differs; a missing one differs too."""
    want = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("want")) for k, v in required.items()]))
    wanted = configs.select("run").distinct().select("run", want.alias("w")).select("run", "w.*")
    return wanted.join(configs, ["run", "name"], "left").where(~F.col("value").eqNullSafe(F.col("want"))).select("run", "name", "value", "want")


def aliased(rows: DataFrame, aliases: dict[str, str], column: str = "target") -> DataFrame:
    """Targets under their one name."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return rows.withColumn(column, F.coalesce(F.element_at(known, F.col(column)), F.col(column)))


def best_per(rows: DataFrame, by: list[str], value: Column, tie: list[str], largest: bool = False, nth: int = 1) -> DataFrame:
    """The row with the smallest (or largest) value in each group, or the nth; ties by the columns given. A group with fewer rows has none."""
    order = value.desc() if largest else value
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(order, *tie))).where(F.col("__rn") == nth).drop("__rn")


def early_stop(epochs: DataFrame, min_delta: float = 1e-6, patience: int = 10) -> DataFrame:
    """run, best, best_epoch, last_epoch: replay of early stopping; improved if v < best - min_delta, stopped after `patience` without.

    Whatever improves is lower than all before it, so only such epochs of a run meet in one row: a handful, however long the run is. They are
    found, and numbered, by ranges of epochs.
    """
    placed = running(epochs.select("run", "epoch", "valid"), [F.col("epoch")], group=["run"])
    block = F.floor(F.col("ahead") / BLOCK).alias("block")
    lows = placed.groupBy("run", block).agg(F.min("valid").alias("low"))
    before = Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a run
    lows = lows.select(F.col("run").alias("r"), F.col("block").alias("b"), F.min("low").over(before).alias("earlier"))
    own = placed.withColumn("block", block)
    inner = Window.partitionBy("run", "block").orderBy("ahead").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("inside", F.min("valid").over(inner)).join(lows, own.run.eqNullSafe(F.col("r")) & (F.col("block") == F.col("b")))
    lower = own.where(F.coalesce(F.col("valid") < F.least("earlier", "inside"), F.lit(True)))
    row = F.array_sort(F.collect_list(F.struct("ahead", "epoch", "valid")))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).alias("best_epoch"), F.lit(-1).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        over = x["ahead"] - s["at"] > patience  # epochs since the best, or since the start, have run out
        better = x["valid"] < s["best"] - min_delta
        return F.when(over | ~F.coalesce(better, F.lit(False)), s).otherwise(F.struct(x["valid"].alias("best"), x["epoch"].alias("best_epoch"), x["ahead"].alias("at")))

    ends = lower.groupBy("run").agg(row.alias("e"), F.max("total").alias("total")).select("run", "total", F.aggregate("e", start, step).alias("s"))
    ends = ends.select(F.col("run").alias("r"), "s.best", "s.best_epoch", F.least(F.col("s.at") + patience, F.col("total") - 1).alias("last"))
    return placed.join(ends, placed.run.eqNullSafe(F.col("r")) & (F.col("ahead") == F.col("last"))).select("run", "best", "best_epoch", F.col("epoch").alias("last_epoch"))


def prefer_final(rows: DataFrame, by: list[str]) -> DataFrame:
    """The final row of a key, else its staged row."""
    return best_per(rows, by, F.when(F.col("stage") == "final", 0).otherwise(1), ["mae"])


def first_number(cell: Column) -> Column:
    """The first number in a displayed cell; null where there is none."""
    return F.nullif(F.regexp_extract(cell, r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def best_displayed(cells: DataFrame, column: list[str], cell: str = "cell") -> DataFrame:
    """cells with best: whether the first number displayed is the smallest of its column, to 1e-9. Ties by rounding are all best; a cell
    without a number never is."""
    n = first_number(F.col(cell))
    return cells.withColumn("best", F.coalesce(F.abs(n - F.min(n).over(Window.partitionBy(*column))) < 1e-9, F.lit(False)))


def wall(seconds: Column) -> Column:
    """HhMMmSSs."""
    s = seconds.cast("long")
    return F.concat((s / 3600).cast("long").cast("string"), F.lit("h"), F.lpad(((s % 3600) / 60).cast("long").cast("string"), 2, "0"), F.lit("m"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))


#: From these sizes on a number is shown with so many decimals, smaller ones with four, and none as this.
DECIMALS, ABSENT = ((100, 2), (1, 3)), "--"


def decimals(x: Column, k: int) -> Column:
    """The number with k decimals, halves away from zero."""
    q = F.round(F.abs(x) * 10**k).cast("long")
    sign = F.when((x < 0) & (q > 0), "-").otherwise("")
    return F.concat(sign, F.floor(q / 10**k).cast("string"), F.lit("."), F.lpad((q % 10**k).cast("string"), k, "0"))


def shown(x: Column) -> Column:
    """The number with decimals by its size."""
    out = decimals(x, 4)
    for least, k in reversed(DECIMALS):
        out = F.when(F.abs(x) >= least, decimals(x, k)).otherwise(out)
    return F.coalesce(F.when(~F.isnan(x), out), F.lit(ABSENT))
