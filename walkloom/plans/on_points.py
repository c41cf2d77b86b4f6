"""Queries on the 3-D graphs (G2): distances, angles, dihedrals, and pair geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from walkloom.functions import geometry
from walkloom.operators import features, graph, walks
from walkloom.plans import fixtures as fx
from walkloom.plans.catalog import query
from walkloom.plans.fixtures import G2

R = "WITH RECURSIVE "


def _search(spark, d, depth_first=True):
    nodes = fx.g2_nodes(spark, d)
    edges = fx.g2_edges(nodes)
    graphs = graph.packed(nodes.withColumn("z", F.lit(0)), edges)
    return nodes, edges, walks.steps(walks.search(graphs, 1, depth_first=depth_first))


@query(f"WITH {G2} SELECT g, u, v, round(dist, 5) dist FROM d")
def pairwise_distances(spark, d):
    return graph.pair_distances(fx.g2_nodes(spark, d)).withColumn("dist", F.round("dist", 5))


@query(f"WITH {G2}, c AS (SELECT i, 5.0::DOUBLE * i / 15 c FROM range(16) t(i)) SELECT g, u, v, CAST(i AS INT) i, round(exp(-((dist - c) * (dist - c)) / (2 * 0.3125::DOUBLE * 0.3125)), 5) x FROM d, c WHERE u <> v")
def rbf_expand(spark, d):
    pairs = graph.pair_distances(fx.g2_nodes(spark, d)).where("u <> v").withColumn("r", geometry.rbf(F.col("dist")))
    return pairs.select("g", "u", "v", F.posexplode("r").alias("i", "x")).withColumn("x", F.round("x", 5))


def _steps_sql(depth_first: bool) -> str:
    return f"{R}{G2}, {fx.sql_search(1, depth_first)}, w AS (SELECT g, walk, CAST(k - 1 AS INT) pos, ids[k] node FROM (SELECT g, walk, ids, unnest(generate_series(1, len(ids))) k FROM found)), p AS (SELECT w.*, lag(node) OVER (PARTITION BY g, walk ORDER BY pos) prev FROM w)"


@query(f"{_steps_sql(True)} SELECT p.g, walk, pos, round(coalesce(dist, 0), 5) dist FROM p LEFT JOIN d ON d.g = p.g AND d.u = prev AND d.v = node")
def step_edge_feature_dfs(spark, d):
    nodes, _, steps = _search(spark, d)
    return features.step_bonds(steps, nodes).withColumn("dist", F.round("dist", 5))


@query(f"{_steps_sql(False)} SELECT p.g, walk, pos, round(CASE WHEN e.g IS NULL THEN 0 ELSE coalesce(dist, 0) END, 5) dist FROM p LEFT JOIN d ON d.g = p.g AND d.u = prev AND d.v = node LEFT JOIN e ON e.g = p.g AND e.u = prev AND e.v = node")
def step_edge_feature_bfs(spark, d):
    nodes, edges, steps = _search(spark, d, depth_first=False)
    return features.step_bonds(steps, nodes, edges).withColumn("dist", F.round("dist", 5))


@query(f"{_steps_sql(True)} SELECT w.g, walk, pos, n.x, n.y, n.z FROM w JOIN n ON n.g = w.g AND n.v = w.node")
def emit_xyz(spark, d):
    nodes, _, steps = _search(spark, d)
    return features.placed(steps, nodes).select("g", "walk", "pos", "xyz.x", "xyz.y", "xyz.z")


# Along the chain of each graph, so that the oracle needs only self-joins.
def _chain(spark, d):
    nodes = fx.g2_nodes(spark, d)
    return nodes.select("g", F.lit(0).alias("walk"), F.col("v").alias("pos"), F.col("v").alias("node"), F.col("pos").alias("xyz"))


def _sub(a: str, b: str) -> list[str]:
    return [f"({a}.{k} - {b}.{k})" for k in "xyz"]


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def sql_angle(p0: str, p1: str, p2: str) -> str:
    a, b = _sub(p0, p1), _sub(p2, p1)
    return f"acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}) + 1e-8))))"


def sql_dihedral(p0: str, p1: str, p2: str, p3: str) -> str:
    b1, b2, b3 = _sub(p1, p0), _sub(p2, p1), _sub(p3, p2)
    n1, n2 = _cross(b1, b2), _cross(b2, b3)
    size = f"sqrt({_dot(b2, b2)})"
    unit = [f"({x} / greatest({size}, 1e-8))" for x in b2]
    return f"CASE WHEN {size} < 1e-8 THEN 0 ELSE atan2({_dot(_cross(n1, unit), n2)}, {_dot(n1, n2)}) END"


_CHAIN = f"WITH {G2}, c AS (SELECT n.*, lag(v, 1) OVER o p1, lag(v, 2) OVER o p2, lag(v, 3) OVER o p3 FROM n WINDOW o AS (PARTITION BY g ORDER BY v))"
_BACK = "".join(f" LEFT JOIN n q{k} ON q{k}.g = c.g AND q{k}.v = c.p{k}" for k in (1, 2, 3))


@query(f"{_CHAIN} SELECT c.g, c.v pos, round({sql_angle('q2', 'q1', 'c')}, 4) angle FROM c{_BACK} WHERE c.p2 IS NOT NULL")
def bond_angle(spark, d):
    return features.step_angles(_chain(spark, d)).where("angle is not null").select("g", "pos", F.round("angle", 4).alias("angle"))


@query(f"{_CHAIN} SELECT c.g, c.v pos, round(cos({sql_dihedral('q3', 'q2', 'q1', 'c')}), 4) c, round(sin({sql_dihedral('q3', 'q2', 'q1', 'c')}), 4) s FROM c{_BACK} WHERE c.p3 IS NOT NULL")
def dihedral(spark, d):
    return features.step_angles(_chain(spark, d)).where("dihedral is not null").select("g", "pos", F.round(F.cos("dihedral"), 4).alias("c"), F.round(F.sin("dihedral"), 4).alias("s"))


@query(f"{_CHAIN} SELECT c.g, c.v pos, CAST(k AS INT) k, round(cos(k * {sql_angle('q2', 'q1', 'c')}), 4) x FROM c{_BACK} CROSS JOIN range(1, 9) t(k) WHERE c.p2 IS NOT NULL")
def angle_basis(spark, d):
    rows = features.step_angles(_chain(spark, d)).where("angle is not null").withColumn("b", geometry.angle_basis(F.col("angle")))
    return rows.select("g", "pos", F.posexplode("b").alias("k", "x")).select("g", "pos", (F.col("k") + 1).alias("k"), F.round("x", 4).alias("x"))


@query(f"{_CHAIN} SELECT c.g, c.v pos, CAST(k AS INT) k, round(CASE WHEN k < 4 THEN sin((k + 1) * {sql_dihedral('q3', 'q2', 'q1', 'c')}) ELSE cos((k - 3) * {sql_dihedral('q3', 'q2', 'q1', 'c')}) END, 3) x FROM c{_BACK} CROSS JOIN range(8) t(k) WHERE c.p3 IS NOT NULL")
def dihedral_basis(spark, d):
    rows = features.step_angles(_chain(spark, d)).where("dihedral is not null").withColumn("b", geometry.dihedral_basis(F.col("dihedral")))
    return rows.select("g", "pos", F.posexplode("b").alias("k", "x")).withColumn("x", F.round("x", 3))


@query(f"""WITH {G2} SELECT i.g, i.v i, j.v j, round(sqrt({_dot(_sub('i', 'j'), _sub('i', 'j'))}), 5) dist,
  CASE WHEN i.v <> j.v AND b.g IS NOT NULL THEN round({sql_angle('b', 'i', 'j')}, 4) END angle_i, CASE WHEN i.v <> j.v AND a.g IS NOT NULL THEN round({sql_angle('i', 'j', 'a')}, 4) END angle_j,
  CASE WHEN i.v <> j.v AND a.g IS NOT NULL AND b.g IS NOT NULL THEN round(cos({sql_dihedral('b', 'i', 'j', 'a')}), 3) + 0.0::DOUBLE END turn
  FROM n i JOIN n j ON i.g = j.g LEFT JOIN n b ON b.g = i.g AND b.v = i.v - 1 LEFT JOIN n a ON a.g = j.g AND a.v = j.v + 1""")
def pair_geometry(spark, d):
    out = features.pair_geometry(_chain(spark, d))
    return out.select("g", "i", "j", F.round("dist", 5).alias("dist"), F.round("angle_i", 4).alias("angle_i"), F.round("angle_j", 4).alias("angle_j"), F.round(F.cos("dihedral"), 3).alias("turn"))


@query(f"""WITH {G2}, pg AS (SELECT i.g, i.v i, j.v j, sqrt({_dot(_sub('i', 'j'), _sub('i', 'j'))}) dist,
  CASE WHEN i.v <> j.v AND b.g IS NOT NULL THEN {sql_angle('b', 'i', 'j')} END a1, CASE WHEN i.v <> j.v AND a.g IS NOT NULL THEN {sql_angle('i', 'j', 'a')} END a2,
  CASE WHEN i.v <> j.v AND a.g IS NOT NULL AND b.g IS NOT NULL THEN {sql_dihedral('b', 'i', 'j', 'a')} END t
  FROM n i JOIN n j ON i.g = j.g LEFT JOIN n b ON b.g = i.g AND b.v = i.v - 1 LEFT JOIN n a ON a.g = j.g AND a.v = j.v + 1)
  SELECT g, i, j, CAST(k AS INT) k, round(CASE WHEN k < 16 THEN exp(-((dist - 5.0::DOUBLE * k / 15) * (dist - 5.0::DOUBLE * k / 15)) / (2 * 0.3125::DOUBLE * 0.3125)) WHEN k < 24 THEN coalesce(cos((k - 15) * a1), 0)
  WHEN k < 32 THEN coalesce(cos((k - 23) * a2), 0) WHEN k < 36 THEN coalesce(sin((k - 31) * t), 0) ELSE coalesce(cos((k - 35) * t), 0) END, 3) + 0.0::DOUBLE x FROM pg, range(40) r(k)""")
def pair_basis(spark, d):
    rows = features.pair_basis(features.pair_geometry(_chain(spark, d)))
    return rows.select("g", "i", "j", F.posexplode_outer("x").alias("k", "x")).withColumn("x", F.round("x", 3) + 0.0)


@query(f"WITH {G2} SELECT g, count(*) n, md5(string_agg(CAST(CAST(round(dist * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(round(dist * 100) AS BIGINT))) k FROM d WHERE u < v GROUP BY g")
def distance_multiset_key(spark, d):
    whole = F.round(F.col("dist") * 100).cast("long")
    pairs = graph.pair_distances(fx.g2_nodes(spark, d)).where("u < v")
    return pairs.groupBy("g").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(whole)), lambda x: x.cast("string")), ",")).alias("k"))


@query("WITH t AS (SELECT conv_id, turn pos FROM conversations) SELECT conv_id, CAST(pos AS BIGINT) pos, CAST(i AS INT) i, round(CASE WHEN i % 2 = 0 THEN sin(pos / pow(10000, 2 * (i // 2) / 6.0::DOUBLE)) ELSE cos(pos / pow(10000, 2 * (i // 2) / 6.0::DOUBLE)) END, 6) x FROM t, range(6) r(i)")
def position_encoding(spark, d):
    rows = fx.read(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos")).withColumn("e", features.position_encoding(F.col("pos"), 6))
    return rows.select("conv_id", "pos", F.posexplode("e").alias("i", "x")).withColumn("x", F.round("x", 6))
