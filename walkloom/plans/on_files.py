"""Queries that write files to the shared folder as earlier runs would have left them, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from walkloom.operators import graph
from walkloom.plans import fixtures as fx
from walkloom.plans.catalog import query
from walkloom.plans.fixtures import G1, RUNS, read, runs
from walkloom.sources import tables


def _folder(spark, name):
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


NAMES = ["quantity", "price", "discount", "tax"]


@query("WITH x AS (SELECT l_orderkey g, unnest(['quantity', 'price', 'discount', 'tax']) target, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) v FROM lineitem) SELECT target, count(*) n, round(sum(v), 2) total FROM x GROUP BY target")
def target_tables_resumed(spark, d):
    """Target tables after a run that left one target whole and one in part, a run that mends it, and a retry that finds nothing to do."""
    path = _folder(spark, "targets")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias("y"))
    first = rows.select("g", F.explode(F.array(F.struct(F.lit("tax").alias("target"), F.get("y", F.lit(3)).alias("value")), F.struct(F.lit("price").alias("target"), F.get("y", F.lit(1)).alias("value")))).alias("s")).select("g", "s.value", "s.target")
    first.where("target = 'tax' or g % 3 = 0").write.partitionBy("target").parquet(path)
    for _ in range(2):
        tables.write_target_tables(rows, path, NAMES)
    found = spark.read.schema("g long, value double, target string").parquet(path)
    return found.groupBy("target").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {RUNS} SELECT model, m, target, seed, stage, mae, round(wall, 2) wall FROM runs WHERE NOT (m % 3 = 0 AND seed = 43)")
def metrics_files(spark, d):
    """Results read from one file a run: some have a second object after the first, some are cut off and left out, one folder has no object."""
    root = _folder(spark, "metrics")
    body = F.to_json(F.struct(F.struct("target", "seed", "m").alias("config"), F.struct(F.col("mae").alias("mean_test_mae"), F.col("wall").alias("total_wall_sec")).alias("summary")))
    second = F.concat(body, F.lit('\n{"summary": {"mean_test_mae": -1.0}, "note": "a } in a string"}'))
    cut = F.substring(body, F.lit(1), F.length(body) - 12)
    text = F.when((F.col("m") % 3 == 0) & (F.col("seed") == 43), cut).when(F.col("m") % 2 == 0, second).otherwise(body)
    folder = [F.concat("model", F.lit("_m"), "m").alias("run"), F.col("target").alias("of"), F.concat(F.lit("split"), "seed").alias("part"), F.col("stage").alias("stage")]
    # The stage stands before the run, so that each run has a folder of its own.
    runs(spark, d).select(text.alias("value"), *folder).repartition("stage", "run", "of", "part").write.partitionBy("stage", "run", "of", "part").text(root)
    found = tables.read_run_metrics(spark, root, "*.txt")
    return found.select("model", "m", "target", "seed", F.regexp_extract("path", "/stage=([^/]+)/", 1).alias("stage"), F.col("summary.mean_test_mae").alias("mae"), F.round("summary.total_wall_sec", 2).alias("wall"))


@query(f"WITH {G1}, s AS (SELECT g, count(*) n, sum(z) z, sum(v * v) v2 FROM n GROUP BY g), t AS (SELECT g, count(*) e FROM e GROUP BY g) SELECT s.g, n, z, v2, coalesce(e, 0) e, n % 3 AS extra FROM s LEFT JOIN t USING (g)")
def graph_tables(spark, d):
    """Node, edge and target tables as a writer of other types left them, read in the library's types with their further column."""
    nodes, edges = fx.g1(spark, d)
    root = _folder(spark, "graphs")
    size = nodes.groupBy("g").agg(F.count("*").alias("n"))
    nodes.select(F.col("z").cast("string"), F.col("v").cast("long"), F.col("g").cast("string")).write.parquet(f"{root}/nodes")
    edges.select(F.col("v").cast("double"), "g", F.col("u").cast("string")).write.parquet(f"{root}/edges")
    size.select((F.col("n") % 3).alias("extra"), "g", F.array(F.col("n").cast("float")).alias("y")).write.parquet(f"{root}/targets")
    n, e, t = tables.read_graph_tables(spark, f"{root}/nodes", f"{root}/edges", f"{root}/targets")
    counted = n.groupBy("g").agg(F.count("*").alias("n"), F.sum("z").alias("z"), F.sum(F.col("v") * F.col("v")).alias("v2"))
    return counted.join(graph.degrees(e).groupBy("g").agg(F.sum("n_edges").alias("e")), "g", "left").join(t, "g").select("g", "n", "z", "v2", F.coalesce("e", F.lit(0)).alias("e"), "extra")
