"""Walks on one graph of any size and skew: a join a level, over cumulative weights stored as trees of short rows.

The neighbours of a node are numbered by ranges and counts (no window over a hub) and cut into runs of FAN; a run is a row of at most FAN
neighbours with their cumulative weights, and FAN runs are a row of the level above, up to one top row a node. A step descends from the top:
at each level the walk keeps the child whose cumulative weight first exceeds what it has drawn. Inner rows belong to hubs, which many
walks visit at once, so they stand in SALTS copies among which the walks are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.functions.draws import pick, u32
from walkloom.operators.ranks import running
from walkloom.sources.tables import written

FAN, SALTS = 64, 16


def _height(d: Column) -> Column:
    """Levels of the tree over d neighbours."""
    out, most = F.lit(1), FAN
    for level in range(2, 12):
        out = F.when(d > most, level).otherwise(out)
        most *= FAN
    return out


def _tallied(weights: Column) -> Column:
    """Running sums of a short array."""
    return F.transform(weights, lambda w, k: F.aggregate(F.slice(weights, 1, k + 1), F.lit(0.0), lambda a, b: a + b))


def neighbour_trees(edges: DataFrame, weighted: bool = False) -> list[DataFrame]:
    """Level by level from the leaves: node, block, salt, sums; at the leaves also to and to_height, the neighbours and the heights of their trees.

    edges: u, v, both directions of each edge once. Weights are 1, or 1 / min(degree of u, degree of v).
    """
    rows = running(edges.select("u", "v"), [F.col("v")], group=["u"]).withColumnsRenamed({"ahead": "k", "total": "d"})
    rows = running(rows, [F.col("u")], group=["v"]).withColumnRenamed("total", "dv").drop("ahead")
    weight = 1.0 / F.least("d", "dv") if weighted else F.lit(1.0)
    entry = F.struct("k", "v", weight.alias("w"), _height(F.col("dv")).alias("height"))
    runs = rows.groupBy("u", F.floor(F.col("k") / FAN).alias("block"), "d").agg(F.array_sort(F.collect_list(entry)).alias("r"))
    leaves = runs.select(F.col("u").alias("node"), "block", "d", F.lit(0).alias("salt"), _tallied(F.transform("r", lambda x: x["w"])).alias("sums"), F.transform("r", lambda x: x["v"]).alias("to"), F.transform("r", lambda x: x["height"]).alias("to_height"))
    levels = [written(leaves, "leaves")]
    more = levels[0]
    while not (more := more.where(F.col("d") > FAN ** len(levels))).isEmpty():
        child = F.struct("block", F.element_at("sums", -1).alias("w"))
        above = more.where("salt = 0").groupBy("node", F.floor(F.col("block") / FAN).alias("block"), "d").agg(F.array_sort(F.collect_list(child)).alias("r"))
        copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        more = written(above.select("node", "block", "d", copies, _tallied(F.transform("r", lambda x: x["w"])).alias("sums")), "inner")
        levels.append(more)
    return levels


def _descended(at: DataFrame, levels: list[DataFrame], drawn: Column) -> DataFrame:
    """Walks (walk, node, height, path) one step on; drawn: a number in [0, 1) as a share of the node's weight, or a count below it."""
    at = at.select("walk", "node", "height", "path", F.lit(0).cast("long").alias("block"), F.lit(None).cast("double").alias("t"))
    for level in range(len(levels), 0, -1):
        tree = levels[level - 1].select(F.col("node").alias("n"), F.col("block").alias("b"), "salt", "sums", *(["to", "to_height"] if level == 1 else []))
        # Files hold equal copies and counts in a 160th of their rows' size: by that the optimizer would take a tree for small and send it through the driver.
        tree = tree.hint("merge")
        # A walk at a node of fewer levels passes: its key, one of many, is no block's.
        passing = -1 - F.pmod(F.xxhash64("walk"), F.lit(1 << 20))
        key = F.col("block") if level == 1 else F.when(F.col("height") >= level, F.col("block")).otherwise(passing)
        salt = F.lit(0) if level == 1 else F.pmod(F.xxhash64("walk"), F.lit(SALTS))
        both = at.withColumn("key", key).withColumn("s", salt.cast("int")).join(tree, (F.col("node") == F.col("n")) & (F.col("key") == F.col("b")) & (F.col("s") == F.col("salt")), "left")
        both = both.withColumn("t", F.coalesce("t", drawn(F.element_at("sums", -1))))
        both = both.withColumn("k", F.least(F.size(F.filter("sums", lambda c: c <= F.col("t"))), F.size("sums") - 1))
        if level > 1:
            rest = F.col("t") - F.coalesce(F.when(F.col("k") > 0, F.get("sums", F.col("k") - 1)), F.lit(0.0))
            block = F.when(F.col("b").isNull(), F.col("block")).otherwise(F.col("block") * FAN + F.col("k"))
            at = both.select("walk", "node", "height", "path", block.alias("block"), F.when(F.col("b").isNotNull(), rest).alias("t"))
    node, height = F.coalesce(F.get("to", F.col("k")), "node"), F.coalesce(F.get("to_height", F.col("k")), "height")
    return both.select("walk", node.alias("node"), height.alias("height"), F.concat("path", F.array(node)).alias("path"))


def huge_walks(edges: DataFrame, starts: DataFrame, length: int, seed: int = 0, weighted: bool = False, every: int = 4) -> DataFrame:
    """walk, pos, node of walks of `length` nodes from starts (walk, node); a node without neighbours keeps a walk in place.

    A uniform step takes the neighbour numbered draw % degree, a weighted one the first whose share of the node's weight, added up in the order of
    the neighbours, exceeds draw / 2**32. The walks' state is a written table every `every` steps.
    """
    levels = neighbour_trees(edges, weighted)
    heights = levels[0].where("block = 0").select(F.col("node").alias("n"), _height(F.col("d")).alias("height"))
    first = starts.join(heights, F.col("node") == F.col("n"), "left").select("walk", "node", F.coalesce("height", F.lit(1)).alias("height"))
    at, out, begun = first.withColumn("path", F.array("node")), None, 0
    for j in range(1, length + 1):
        if j == length or (j - begun) % every == 0:
            at = written(at, "walks")
            steps = at.select("walk", F.posexplode("path").alias("k", "node")).select("walk", (F.col("k") + begun).alias("pos"), "node")
            out = steps if out is None else out.unionByName(steps)
            begun, at = j, at.withColumn("path", F.array().cast(at.schema["path"].dataType))
        if j < length:
            draw = (lambda total, j=j: u32(seed, F.col("walk"), j) / F.lit(4294967296.0) * total) if weighted else (lambda total, j=j: pick(total, seed, F.col("walk"), j).cast("double"))
            at = _descended(at, levels, draw)
    return out
