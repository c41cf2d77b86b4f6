"""Rules that raise errors, widths, and bases of pairs."""

import math

import pytest
from pyspark.sql import functions as F

from walkloom.operators import attributes, experiments, features, splits
from walkloom.sources import tables


def test_widths():
    assert attributes.pe_width("walk", 8, True, True) == 16 + 16 + 3 and attributes.pe_width("search", 8, True, True, True, True) == 8 + 16 + 3 + 8 + 8
    assert attributes.pe_width("mdlr", 8) == 0 and attributes.pe_width("walk_rum", 8, bonds=True) == 3
    with pytest.raises(ValueError, match="unknown"):
        attributes.pe_width("other", 8)


def test_unknown_names_are_errors(spark):
    rows = spark.range(1).select(F.array(*[F.lit(float(k)) for k in range(12)]).alias("y"), F.lit("nope").alias("t"))
    assert rows.select(attributes.select_target(F.col("y"), "r2").alias("x")).first()["x"] == 5.0
    with pytest.raises(ValueError, match="unknown"):
        attributes.select_target(F.col("y"), "nope")
    with pytest.raises(Exception, match="unknown target nope"):
        rows.select(attributes.select_target(F.col("y"), F.col("t"))).collect()


def test_positions_must_match(spark):
    a, b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "ordinal int, y double"), spark.createDataFrame([(0, 7), (1, 8)], "ordinal int, id long")
    assert sorted((r["id"], r["y"]) for r in splits.recovered_by_position(a, b).collect()) == [(7, 1.0), (8, 2.0)]
    with pytest.raises(Exception, match="differ in length"):
        splits.recovered_by_position(a, b.limit(1)).collect()


def test_small_and_unfinished_runs(spark):
    schema = "run int, n_bytes int, summary struct<mean_test_mae:double>, test_mae double, splits array<struct<test_mae:double,final_test_mae:double,best_test_mae:double>>"
    rows = spark.createDataFrame([(1, 500, (0.1,), None, []), (2, 500, (float("nan"),), None, [(0.2, None, None)]), (3, 500, (None,), 0.3, None), (4, 50, (0.4,), None, None), (5, 500, None, None, [])], schema)
    assert [r["run"] for r in experiments.complete_runs(rows, least_bytes=100).collect()] == [1, 2]
    assert [r["run"] for r in experiments.complete_runs(rows, rule="summary").collect()] == [1, 2, 3, 4]


def test_pair_basis(spark):
    pairs = spark.createDataFrame([(0, 0, 0, 0, 0.0, None, None, None), (0, 0, 1, 2, 5.0, 0.5, 1.0, 2.0)], "g int, walk int, i int, j int, dist double, angle_i double, angle_j double, dihedral double")
    x = {r["i"]: r["x"] for r in features.pair_basis(pairs).collect()}
    assert len(x[0]) == len(x[1]) == 16 + 8 + 8 + 8 and x[0][0] == 1.0 and x[0][16:] == [0.0] * 24
    assert x[1][15] == 1.0 and x[1][16] == pytest.approx(math.cos(0.5)) and x[1][24] == pytest.approx(math.cos(1)) and x[1][32] == pytest.approx(math.sin(2)) and x[1][36] == pytest.approx(math.cos(2))


def test_graph_tables_keep_their_types_and_name_missing_columns(spark, tmp_path):
    spark.sql("SELECT 1 AS v, 6 AS z, 7 AS g, 'C' AS symbol").write.parquet(f"{tmp_path}/nodes")
    spark.sql("SELECT 7 AS g, 0 AS u, 1 AS v").write.parquet(f"{tmp_path}/edges")
    spark.sql("SELECT 7 AS g, 0 AS u").write.parquet(f"{tmp_path}/short")
    nodes, edges = tables.read_graph_tables(spark, f"{tmp_path}/nodes", f"{tmp_path}/edges")
    assert nodes.dtypes == [("g", "bigint"), ("v", "int"), ("z", "int"), ("symbol", "string")] and edges.dtypes == [("g", "bigint"), ("u", "int"), ("v", "int")]
    with pytest.raises(ValueError, match="no column v"):
        tables.read_graph_tables(spark, f"{tmp_path}/nodes", f"{tmp_path}/short")


def test_run_metrics_take_their_keys_from_the_path(spark, tmp_path):
    for where in ("d1_m4/gap/split2", "m16/mu/seed43", "other"):
        folder = tmp_path / where
        folder.mkdir(parents=True)
        (folder / "metrics.json").write_text('{"summary": {"mean_test_mae": 0.5}}')
    found = {(r["model"], r["m"], r["target"], r["seed"]) for r in tables.read_run_metrics(spark, str(tmp_path)).collect()}
    assert found == {("d1", 4, "gap", 2), (None, 16, "mu", 43), (None, None, None, None)}
