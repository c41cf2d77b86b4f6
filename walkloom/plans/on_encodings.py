"""Queries of whole step encodings on the 3-D graphs (G2), kind by kind, and of the blocks of a walk's pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from walkloom.operators import encodings, graph, lockstep, walks
from walkloom.plans import fixtures as fx
from walkloom.plans.catalog import query
from walkloom.plans.fixtures import G2
from walkloom.plans.on_large import _CUM
from walkloom.plans.on_points import sql_angle, sql_dihedral

R = "WITH RECURSIVE "
S, NW, L = 3, 2, 8


def _graphs(spark, d):
    nodes = fx.g2_nodes(spark, d)
    edges = fx.g2_edges(nodes)
    bond = F.array(*[x.cast("double") for x in ((F.col("u") + F.col("v")) % 4, (F.col("u") * F.col("v")) % 3, (F.col("u") + F.col("v")) % 2)])
    return encodings.with_geometry(graph.packed(nodes.withColumn("z", F.lit(0)), edges), nodes, edges.withColumn("attr", bond))


def _long(kind, found, graphs):
    pe = encodings.step_encoding(kind, found, graphs, S, distances=True, bonds=True, angles=True, dihedrals=True)
    steps = pe.select("g", "walk", F.posexplode("pe").alias("pos", "x"))
    return steps.select("g", "walk", "pos", F.posexplode("x").alias("i", "x")).withColumn("x", F.round("x", 4) + 0.0)


_ORDER = "w AS (SELECT g, walk, CAST(k - 1 AS INT) pos, ids[k] node FROM (SELECT g, walk, ids, unnest(generate_series(1, len(ids))) k FROM found))"
_MDLR = f"""size AS (SELECT g, count(*) n FROM n GROUP BY g), {_CUM},
w AS (SELECT g, CAST(k AS INT) walk, 0 pos, CAST({fx.sql_u32("0", "g", "k", "0")} % n AS INT) node FROM size, range({NW}) t(k)
  UNION ALL SELECT w.g, w.walk, w.pos + 1, CASE WHEN c.nbs IS NULL THEN w.node ELSE c.nbs[least(len(list_filter(c.cs, lambda y: y <= {fx.sql_u32("0", "w.g", "w.walk", "w.pos + 1")} / 4294967296.0::DOUBLE * c.cs[-1])), len(c.nbs) - 1) + 1] END
  FROM w LEFT JOIN cum c ON c.g = w.g AND c.v = w.node WHERE w.pos + 1 < {L})"""


def _sql(steps: str, repeats: bool, edge_bits: bool, if_adjacent: bool, bent: bool) -> str:
    """All blocks of an encoding, each at its place in the vector."""
    blocks, at = [], 0
    prior = f"FROM w a CROSS JOIN range(1, {S + 1}) t(d) LEFT JOIN w b ON b.g = a.g AND b.walk = a.walk AND b.pos = a.pos - d"
    if repeats:
        blocks.append(f"SELECT a.g, a.walk, a.pos, d - 1 i, CASE WHEN b.node = a.node THEN 1.0 ELSE 0.0 END x {prior}")
        at += S
    if edge_bits:
        blocks.append(f"SELECT a.g, a.walk, a.pos, {at} + d - 1 i, CASE WHEN e.g IS NOT NULL THEN 1.0 ELSE 0.0 END x {prior} LEFT JOIN e ON e.g = a.g AND e.u = b.node AND e.v = a.node")
        at += S
    seen = "near" if if_adjacent else "pos > 0"
    blocks.append(f"SELECT g, walk, pos, {at} + k i, CASE WHEN {seen} THEN exp(-((dist - 5.0::DOUBLE * k / 15) * (dist - 5.0::DOUBLE * k / 15)) / (2 * 0.3125::DOUBLE * 0.3125)) ELSE 0.0 END x FROM q, range(16) r(k)")
    blocks.append(f"SELECT g, walk, pos, {at} + 16 + k, CASE WHEN near THEN CASE k WHEN 0 THEN (node + b1) % 4 WHEN 1 THEN (node * b1) % 3 ELSE (node + b1) % 2 END ELSE 0.0 END FROM q, range(3) r(k)")
    if bent:
        blocks.append(f"SELECT g, walk, pos, {at} + 18 + k, CASE WHEN pos > 1 THEN cos(k * bend) ELSE 0.0 END FROM q, range(1, 9) r(k)")
        blocks.append(f"SELECT g, walk, pos, {at} + 27 + k, CASE WHEN pos < 3 THEN 0.0 WHEN k < 4 THEN sin((k + 1) * turn) ELSE cos((k - 3) * turn) END FROM q, range(8) r(k)")
    return f"""{R}{G2}, {steps}, p AS (SELECT w.*, lag(node, 1) OVER o b1, lag(node, 2) OVER o b2, lag(node, 3) OVER o b3 FROM w WINDOW o AS (PARTITION BY g, walk ORDER BY pos)),
q AS (SELECT p.*, d.dist, e.g IS NOT NULL near, {sql_angle('n2', 'n1', 'n0')} bend, {sql_dihedral('n3', 'n2', 'n1', 'n0')} turn FROM p LEFT JOIN d ON d.g = p.g AND d.u = b1 AND d.v = node LEFT JOIN e ON e.g = p.g AND e.u = b1 AND e.v = node
  LEFT JOIN n n0 ON n0.g = p.g AND n0.v = node LEFT JOIN n n1 ON n1.g = p.g AND n1.v = b1 LEFT JOIN n n2 ON n2.g = p.g AND n2.v = b2 LEFT JOIN n n3 ON n3.g = p.g AND n3.v = b3)
SELECT g, walk, pos, CAST(i AS INT) i, round(CAST(x AS DOUBLE), 4) + 0.0::DOUBLE x FROM ({' UNION ALL '.join(blocks)})"""


@query(_sql(fx.sql_walk(NW, L), True, True, False, False))
def encode_walk(spark, d):
    graphs = _graphs(spark, d)
    return _long("walk", walks.sample("walk", graphs, NW, L), graphs)


@query(_sql(_MDLR, False, False, False, False))
def encode_mdlr(spark, d):
    graphs = _graphs(spark, d)
    return _long("mdlr", walks.sample("mdlr", graphs, NW, L), graphs)


@query(_sql(f"{fx.sql_search(1, True)}, {_ORDER}", False, True, False, True))
def encode_dfs(spark, d):
    graphs = _graphs(spark, d)
    return _long("dfs", lockstep.search(graphs, 1), graphs)


@query(_sql(f"{fx.sql_search(1, False)}, {_ORDER}", False, True, True, False))
def encode_bfs(spark, d):
    graphs = _graphs(spark, d)
    return _long("bfs", lockstep.search(graphs, 1, depth_first=False), graphs)


_PAIRS = f"""w AS (SELECT g, walk, CAST(k - 1 AS INT) pos, ids[k] node FROM (SELECT g, walk, ids, unnest(generate_series(1, len(ids))) k FROM found)), st AS (SELECT w.*, n.x, n.y, n.z FROM w JOIN n ON n.g = w.g AND n.v = w.node),
pg AS (SELECT i.g, i.walk, i.pos i, j.pos j, sqrt((i.x-j.x)*(i.x-j.x) + (i.y-j.y)*(i.y-j.y) + (i.z-j.z)*(i.z-j.z)) dist, CASE WHEN i.pos <> j.pos AND b.g IS NOT NULL THEN {sql_angle('b', 'i', 'j')} END a1,
  CASE WHEN i.pos <> j.pos AND a.g IS NOT NULL THEN {sql_angle('i', 'j', 'a')} END a2, CASE WHEN i.pos <> j.pos AND a.g IS NOT NULL AND b.g IS NOT NULL THEN {sql_dihedral('b', 'i', 'j', 'a')} END t
  FROM st i JOIN st j ON i.g = j.g AND i.walk = j.walk LEFT JOIN st b ON b.g = i.g AND b.walk = i.walk AND b.pos = i.pos - 1 LEFT JOIN st a ON a.g = j.g AND a.walk = j.walk AND a.pos = j.pos + 1)"""


@query(f"""{R}{G2}, {fx.sql_search(1, True)}, {_PAIRS} SELECT g, i, round(sum(CASE WHEN k < 16 THEN exp(-((dist - 5.0::DOUBLE * k / 15) * (dist - 5.0::DOUBLE * k / 15)) / (2 * 0.3125::DOUBLE * 0.3125)) WHEN k < 24 THEN coalesce(cos((k - 15) * a1), 0)
  WHEN k < 32 THEN coalesce(cos((k - 23) * a2), 0) WHEN k < 36 THEN coalesce(sin((k - 31) * t), 0) ELSE coalesce(cos((k - 35) * t), 0) END * (k + 1) * (j + 1)), 2) + 0.0::DOUBLE x FROM pg, range(40) r(k) GROUP BY g, i""")
def pair_block_sums(spark, d):
    """A weighted sum of each step's slice of a search's pair block, which every number of the block enters."""
    graphs = _graphs(spark, d)
    found = lockstep.search(graphs, 1).join(graphs.select("g", "xyz"), "g").select("g", "walk", F.transform("ids", lambda v: F.get("xyz", v)).alias("xyz"))
    blocks = encodings.pair_blocks(found)
    step = F.explode(F.sequence(F.lit(0), F.col("length") - 1))
    part = F.slice("block", F.col("i") * F.col("length") * 40 + 1, F.col("length") * 40)
    total = F.aggregate(F.transform("part", lambda x, k: x * (k % 40 + 1) * (F.floor(k / 40) + 1)), F.lit(0.0), lambda a, x: a + x)
    return blocks.withColumn("i", step).withColumn("part", part).select("g", "i", (F.round(total, 2) + 0.0).alias("x"))
