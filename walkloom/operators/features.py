"""Features of each step of a walk (long form: g, walk, pos, node) and of walks as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.functions import geometry


def along():  # noqa: ANN201
    """The steps of a walk in order."""
    return Window.partitionBy("g", "walk").orderBy("pos")


def repeat_encoding(steps: DataFrame, s: int) -> DataFrame:
    """g, walk, pos, d, bit: whether the node equals the one d steps before."""
    bits = F.array(*[F.coalesce((F.col("node") == F.lag("node", d).over(along())).cast("int"), F.lit(0)) for d in range(1, s + 1)])
    return steps.withColumn("bits", bits).select("g", "walk", "pos", F.posexplode("bits").alias("d", "bit")).withColumn("d", F.col("d") + 1)


def edge_encoding(steps: DataFrame, edges: DataFrame, s: int) -> DataFrame:
    """g, walk, pos, d, bit: whether the node and the one d steps before are adjacent in either direction."""
    back = F.array(*[F.lag("node", d).over(along()) for d in range(1, s + 1)])
    pairs = steps.withColumn("back", back).select("g", "walk", "pos", "node", F.posexplode("back").alias("d", "prev"))
    both = edges.select("g", F.col("u").alias("prev"), F.col("v").alias("node")).unionByName(edges.select("g", F.col("v").alias("prev"), F.col("u").alias("node"))).dropDuplicates().withColumn("bit", F.lit(1))
    return pairs.join(both, ["g", "prev", "node"], "left").select("g", "walk", "pos", (F.col("d") + 1).alias("d"), F.coalesce("bit", F.lit(0)).alias("bit"))


def edge_encoding_packed(walks: DataFrame, s: int) -> DataFrame:
    """The rows of edge_encoding from walks beside their graph (g, walk, ids, adj), inside the row: no pair of steps is dealt out."""
    def bit(node: Column, prev: Column) -> Column:
        return F.coalesce((F.array_contains(F.get("adj", prev), node) | F.array_contains(F.get("adj", node), prev)).cast("int"), F.lit(0))

    bits = F.transform("ids", lambda x, k: F.transform(F.sequence(F.lit(1), F.lit(s)), lambda d: F.when(k >= d, bit(x, F.get("ids", k - d))).otherwise(0)))
    rows = walks.select("g", "walk", F.posexplode_outer(bits).alias("pos", "bits")).where("pos is not null")
    return rows.select("g", "walk", "pos", F.posexplode("bits").alias("d", "bit")).withColumn("d", F.col("d") + 1)


def anonymised(ids: Column) -> Column:
    """Rank of first appearance of each node: 1 2 1 3 becomes 0 1 0 2."""
    return F.transform(ids, lambda x: (F.array_position(F.array_distinct(ids), x) - 1).cast("int"))


def step_bonds(steps: DataFrame, nodes: DataFrame, adjacent: DataFrame | None = None) -> DataFrame:
    """Distance of each step from the step before, 0 at the start; with `adjacent`, 0 also where the two are no edge. nodes: g, v, pos.
    Only the pairs that a walk visits are measured."""
    at = nodes.select("g", F.col("v").alias("node"), F.col("pos").alias("xyz"))
    moved = steps.join(at, ["g", "node"], "left").withColumn("prev", F.lag("node").over(along())).withColumn("dist", geometry.distance(F.lag("xyz").over(along()), F.col("xyz")))
    if adjacent is not None:
        ends = adjacent.select("g", F.col("u").alias("prev"), F.col("v").alias("node"), F.lit(1).alias("near")).dropDuplicates()
        moved = moved.join(ends, ["g", "prev", "node"], "left").withColumn("dist", F.when(F.col("near") == 1, F.col("dist")))
    return moved.select("g", "walk", "pos", F.coalesce("dist", F.lit(0.0)).alias("dist"))


def placed(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    return steps.join(nodes.select("g", F.col("v").alias("node"), F.col("pos").alias("xyz")), ["g", "node"])


def step_angles(located: DataFrame) -> DataFrame:
    """g, walk, pos, angle (from step 2) and dihedral (from step 3), null before."""
    p = [F.lag("xyz", k).over(along()) for k in range(4)]
    rows = located.select("g", "walk", "pos", F.col("xyz").alias("p0"), *[p[k].alias(f"p{k}") for k in (1, 2, 3)])
    c = F.col
    return rows.select("g", "walk", "pos", F.when(c("p2").isNotNull(), geometry.bond_angle(c("p2"), c("p1"), c("p0"))).alias("angle"), F.when(c("p3").isNotNull(), geometry.dihedral(c("p3"), c("p2"), c("p1"), c("p0"))).alias("dihedral"))


def position_encoding(pos: Column, d: int) -> Column:
    return F.array(*[(F.sin if i % 2 == 0 else F.cos)(pos / 10000 ** (2 * (i // 2) / d)) for i in range(d)])


def pair_geometry(located: DataFrame) -> DataFrame:
    """g, walk, i, j, dist, angle_i, angle_j, dihedral for all ordered pairs of steps; angles are null where a neighbour is missing or i = j."""
    rows = located.select("g", "walk", "pos", "xyz", F.lag("xyz").over(along()).alias("before"), F.lead("xyz").over(along()).alias("after"))
    a, b = rows.select("g", "walk", F.col("pos").alias("i"), F.col("xyz").alias("xi"), "before"), rows.select("g", "walk", F.col("pos").alias("j"), F.col("xyz").alias("xj"), "after")
    c, off = F.col, F.col("i") != F.col("j")
    return a.join(b, ["g", "walk"]).select("g", "walk", "i", "j", geometry.distance(c("xi"), c("xj")).alias("dist"), F.when(off & c("before").isNotNull(), geometry.bond_angle(c("before"), c("xi"), c("xj"))).alias("angle_i"), F.when(off & c("after").isNotNull(), geometry.bond_angle(c("xi"), c("xj"), c("after"))).alias("angle_j"), F.when(off & c("before").isNotNull() & c("after").isNotNull(), geometry.dihedral(c("before"), c("xi"), c("xj"), c("after"))).alias("dihedral"))


def node_mean(steps: DataFrame, value: str) -> DataFrame:
    """Mean of a value over all visits of a node."""
    return steps.groupBy("g", "node").agg(F.avg(value).alias("mean"))


def write_back(steps: DataFrame, value: str) -> DataFrame:
    return steps.withColumn("mean", F.avg(value).over(Window.partitionBy("g", "node")))


def graph_pool(means: DataFrame, zero_fill: bool = False) -> DataFrame:
    """mean, total and most over the visited nodes; zero_fill counts unvisited nodes below the largest visited one as zeros."""
    n = F.max("node") + 1 if zero_fill else F.count("*")
    most = F.max("mean")
    if zero_fill:
        most = F.when(F.count("*") <= F.max("node"), F.greatest(most, F.lit(0.0))).otherwise(most)
    return means.groupBy("g").agg((F.sum("mean") / n).alias("mean"), F.sum("mean").alias("total"), most.alias("most"))


def approx_coverage(steps: DataFrame, nodes: DataFrame, rsd: float = 0.02) -> DataFrame:
    """g, seen, n, share: about how many of a graph's nodes (g, v) its walks visit, from one sketch a graph and task; for graphs too large
    for exact sets. The error is about rsd."""
    seen = steps.groupBy("g").agg(F.approx_count_distinct("node", rsd).alias("seen"))
    n = nodes.groupBy("g").agg(F.approx_count_distinct("v", rsd).alias("n"))
    return n.join(seen, "g", "left").select("g", F.coalesce("seen", F.lit(0)).alias("seen"), "n", F.round(F.coalesce("seen", F.lit(0)) / F.col("n"), 6).alias("share"))


def coverage(steps: DataFrame) -> DataFrame:
    """g, seen: how many of a graph's nodes its walks visit, all walks together."""
    return steps.select("g", "node").distinct().groupBy("g").agg(F.count("*").alias("seen"))


def coverage_sketches(steps: DataFrame, *by: str, bits: int = 12) -> DataFrame:
    """g, the columns of by, sketch: a sketch of the nodes visited, to be stored and united later; 2**bits registers, error about 1.04 / 2**(bits / 2)."""
    return steps.groupBy("g", *by).agg(F.hll_sketch_agg(F.col("node").cast("long"), bits).alias("sketch"))


def united(sketches: DataFrame, *by: str) -> DataFrame:
    """g, the columns of by, about: the number of different nodes in all of a group's sketches together."""
    return sketches.groupBy("g", *by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))


def edge_attr_pairs(raw: DataFrame) -> DataFrame:
    """g, u, v, attr of both directions of raw edges (g, u, v, attr, ord). Of repeated edges the last counts, and an edge's own reverse is
    written after all edges, so that it wins where both are given."""
    def last(u: str, v: str, name: str) -> DataFrame:
        return raw.groupBy("g", F.col(u).alias("a"), F.col(v).alias("b")).agg(F.max_by("attr", "ord").alias(name)).withColumnsRenamed({"a": "u", "b": "v"})

    return last("u", "v", "own").join(last("v", "u", "back"), ["g", "u", "v"], "full").select("g", "u", "v", F.coalesce("back", "own").alias("attr"))


def edge_feature(dist: Column | None, bond: Column | None) -> Column:
    """Distance basis, then the bond's vector; either may be off, and without both there is none."""
    parts = [p for p in (geometry.rbf(dist) if dist is not None else None, F.transform(bond, lambda x: x.cast("double")) if bond is not None else None) if p is not None]
    return F.concat(*parts) if parts else F.lit(None).cast("array<double>")


def walk_pe(steps: DataFrame, edges: DataFrame, s: int, repeats: bool = True) -> DataFrame:
    """g, walk, pos, pe: the repeat bits (walks only), then the edge bits of each step."""
    parts = [edge_encoding(steps, edges, s).withColumn("at", F.col("d") + s)]
    if repeats:
        parts.append(repeat_encoding(steps, s).withColumn("at", F.col("d")))
    bits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    pe = F.transform(F.array_sort(F.collect_list(F.struct("at", "bit"))), lambda x: x["bit"])
    return bits.groupBy("g", "walk", "pos").agg(pe.alias("pe"))


def pair_mask(steps: DataFrame, causal: bool = False) -> DataFrame:
    """g, walk, i, j: the pairs of true steps; causal: j not after i."""
    a, b = steps.select("g", "walk", F.col("pos").alias("i")), steps.select("g", "walk", F.col("pos").alias("j"))
    pairs = a.join(b, ["g", "walk"])
    return pairs.where("j <= i") if causal else pairs


def pair_basis(pairs: DataFrame, rbf: int = 16, angle_k: int = 8, dihedral_k: int = 4) -> DataFrame:
    """g, walk, i, j, x of pair_geometry: distance basis, both angles' bases and the dihedral's; zeros where an angle is missing."""
    def or_zeros(value: str, basis: Column, width: int) -> Column:
        return F.when(F.col(value).isNotNull(), basis).otherwise(F.array_repeat(F.lit(0.0), width))

    x = F.concat(geometry.rbf(F.col("dist"), rbf), or_zeros("angle_i", geometry.angle_basis(F.col("angle_i"), angle_k), angle_k), or_zeros("angle_j", geometry.angle_basis(F.col("angle_j"), angle_k), angle_k), or_zeros("dihedral", geometry.dihedral_basis(F.col("dihedral"), dihedral_k), 2 * dihedral_k))
    return pairs.select("g", "walk", "i", "j", x.alias("x"))
