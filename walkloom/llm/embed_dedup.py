"""Near-duplicates among vectors by cosine: small-world graphs of shards, each searched for every vector.

Equal vectors form a class. Classes are dealt into shards of bounded size; a task builds a shard's graph and the local groups that its
own searches link. Every class then visits every shard: its beam finds the local groups it links to, and all its links into a group
are counted exactly, by angles to the group's centre where those decide (nearly all members of a tight group, at once) and by cosine in
double precision elsewhere, so a large group makes no pairs; a link that only one side's search has met is counted on both. Before that, an audit searches a set of vectors with ever wider beams,
compares with all vectors of the shard, and takes the first beam that reaches the wanted recall; if none does, shards are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import small_world
from .common import unskewed, written
from .near_dedup import components

#: Bytes of a shard's vectors in double precision, and rows from which there are several shards, up to four, for the sake of parallel work.
SHARD_BYTES, PARALLEL_ROWS = 64 << 20, 8192
#: Beams that the audit tries, the recall it wants, and about how many vectors it searches at most (those with an id divisible by 100).
BEAMS, RECALL, AUDITED = (16, 32, 64, 128, 256, 512), 0.995, 4096
#: Angles nearer than this to a bound are not decided by it.
SLACK = 1e-6
#: Queries that a task searches at once.
TOGETHER = 1024

_INDEX = "dim int, shard int, pos int, node long, n long, x binary, links binary, home long"


def _unit(values: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(values), np.float64).reshape(len(values), dim)
    x = x / np.abs(x).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector's doubles and a digest of them; null where it can link with nothing."""
    for batch in batches:
        keys, vectors = [], []
        for i, values in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
            x = None if values.as_py() is None or i is None else values.values
            ok = x is not None and len(x) and not x.null_count
            x = np.asarray(x, np.float64) + 0.0 if ok else None  # no negative zeros
            ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
            vectors.append(x.astype("<f8").tobytes() if ok else None)
            keys.append(hashlib.md5(vectors[-1]).digest() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "key", "x"])


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of n places over links (a, b)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verified(x: np.ndarray, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of q and places in x of those found that reach the cosine in double precision."""
    row, k = np.nonzero((ids >= 0) & (sims >= least - 1e-4))
    at = ids[row, k]
    keep = np.einsum("ij,ij->i", q[row], x[at]) >= least
    return row[keep], at[keep]


def _index(least: float, beam: int) -> Callable:
    """A shard's classes as rows of its index."""
    def task(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        order = np.argsort([hashlib.md5(k).digest() for k in group.column("key").to_pylist()], kind="stable")  # random, but the same again
        group = group.take(pa.array(order))
        x = _unit(group.column("x").to_pylist(), dim)
        graph = small_world.built(x.astype(np.float32))
        found = [_verified(x, x[a : a + TOGETHER], *small_world.search(graph, graph.x[a : a + TOGETHER], beam), least) for a in range(0, len(x), TOGETHER)]
        a = np.concatenate([r + k * TOGETHER for k, (r, _) in enumerate(found)])
        label = _joined(len(x), a, np.concatenate([p for _, p in found]))
        node = group.column("node").to_numpy()
        links = [b"".join(layer[k].tobytes() for layer in graph.links if k < len(layer)) for k in range(len(x))]
        named = group.select(["dim", "shard", "node", "n", "x"]).add_column(2, "pos", pa.array(np.arange(len(x), dtype=np.int32)))
        return named.append_column("links", pa.array(links, pa.binary())).append_column("home", pa.array(node[label]))

    return task


class Shard:
    """A shard's index, put together from its rows."""

    def __init__(self, rows: pa.Table, least: float) -> None:
        self.node, self.n, self.home = (rows.column(c).to_numpy() for c in ("node", "n", "home"))
        self.x, self.least, self.turn = _unit(rows.column("x").to_pylist(), rows.column("dim")[0].as_py()), least, np.arccos(least)
        raw, width, links = rows.column("links").to_pylist(), 4 * small_world.DEGREE, []
        while any(len(r) > width * len(links) for r in raw):
            level = len(links)
            links.append(np.frombuffer(b"".join(r[width * level : width * (level + 1)] for r in raw), np.int32).reshape(-1, small_world.DEGREE))
        top = len(raw)
        for _ in links:
            top = max(1, top // small_world.SHRINK)
        self.graph = small_world.Graph(self.x.astype(np.float32), links, top)
        self.place = dict(zip(self.node.tolist(), range(len(self.node)), strict=True))
        self.homes, self.group = np.unique(self.home, return_inverse=True)
        self.order = np.argsort(self.group, kind="stable")
        self.start = np.searchsorted(self.group[self.order], np.arange(len(self.homes) + 1))
        self.members: dict[int, tuple] = {}

    def _members(self, g: int) -> tuple:
        """Centre of a group, its members by angle to it, the angles, and sums of their numbers of rows."""
        if g not in self.members:
            at = self.order[self.start[g] : self.start[g + 1]]
            centre = self.x[at].sum(axis=0)
            size = np.sqrt(centre @ centre)
            centre = centre / size if size > 1e-9 else self.x[at[0]]
            angle = np.arccos(np.clip(self.x[at] @ centre, -1, 1))
            by = np.argsort(angle, kind="stable")
            self.members[g] = centre, at[by], angle[by], np.concatenate(([0], np.cumsum(self.n[at[by]])))
        return self.members[g]

    def into(self, g: int, q: np.ndarray) -> np.ndarray:
        """Rows of group g that each q links to."""
        centre, at, angle, sums = self._members(g)
        own = np.arccos(np.clip(q @ centre, -1, 1))
        sure = np.searchsorted(angle, self.turn - own - SLACK, "right")
        low = np.maximum(sure, np.searchsorted(angle, own - self.turn - SLACK))
        high = np.maximum(low, np.searchsorted(angle, own + self.turn + SLACK, "right"))
        links = sums[sure].copy()
        open_ = np.flatnonzero(low < high)
        for a in range(0, len(open_), 64):
            some = open_[a : a + 64]
            first, end = low[some].min(), high[some].max()
            place = np.arange(first, end)
            hit = (q[some] @ self.x[at[first:end]].T >= self.least) & (place >= low[some][:, None]) & (place < high[some][:, None])
            links[some] += hit @ self.n[at[first:end]]
        return links

    def links(self, node: np.ndarray, q: np.ndarray, beam: int | None) -> tuple[np.ndarray, list[list[int]]]:
        """For each query the number of rows it links to, its own left out, and the homes of other groups it links to. No beam: a full comparison."""
        if beam is None:
            row, at = np.nonzero(q @ self.x.T >= self.least)
        else:
            row, at = _verified(self.x, q, *small_world.search(self.graph, q.astype(np.float32), beam), self.least)
        here = np.array([self.place.get(i, -1) for i in node.tolist()])
        mine = np.flatnonzero(here >= 0)
        pairs = np.unique(np.stack((np.concatenate((self.group[at], self.group[here[mine]])), np.concatenate((row, mine)))), axis=1)
        total, homes = np.zeros(len(q), np.int64), [[] for _ in range(len(q))]
        total[mine] -= self.n[here[mine]]
        cuts = np.flatnonzero(np.diff(pairs[0], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], pairs.shape[1]), strict=True):
            g, rows = pairs[0, a], pairs[1, a:b]
            total[rows] += self.into(g, q[rows])
            for r in rows:
                if here[r] < 0 or self.group[here[r]] != g:
                    homes[r].append(int(self.homes[g]))
        return total, homes


def _visited(least: float, answer: Callable[[Shard, pa.Table, np.ndarray], pa.RecordBatch]) -> Callable:
    """Sorted rows of one shard after another, first its index (kind 0), then those that visit it: answers for these."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard, wait = None, [], None, []

        def asked() -> Iterator[pa.RecordBatch]:
            nonlocal shard, parts, wait
            if wait:
                if shard is None:
                    shard, parts = Shard(pa.concat_tables(parts), least), []
                rows = pa.concat_tables(wait)
                wait = []
                yield answer(shard, rows, _unit(rows.column("x").to_pylist(), key[0]))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            tags = np.stack([table.column(c).to_numpy() for c in ("dim", "shard", "part", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1), len(tags)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                *at, kind = tags[a].tolist()
                if at != key:
                    yield from asked()
                    key, parts, shard = at, [], None
                if kind == 0:
                    parts.append(table.slice(a, b - a))
                    continue
                for k in range(a, b, TOGETHER):
                    wait.append(table.slice(k, min(TOGETHER, b - k)))
                    if sum(map(len, wait)) >= TOGETHER:
                        yield from asked()
        yield from asked()

    return task


def _answers(beam: int | None) -> Callable:
    def answer(shard: Shard, rows: pa.Table, q: np.ndarray) -> pa.RecordBatch:
        node = rows.column("node").to_numpy()
        total, homes = shard.links(node, q, beam)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(total), pa.array(homes, pa.list_(pa.int64()))], names=["node", "n_links", "homes"])

    return answer


def _audited(beams: tuple[int, ...]) -> Callable:
    def answer(shard: Shard, rows: pa.Table, q: np.ndarray) -> pa.RecordBatch:
        node = rows.column("node").to_numpy()
        own = np.array([shard.n[shard.place[i]] if i in shard.place else 0 for i in node.tolist()])
        truth = (q @ shard.x.T >= shard.least) @ shard.n - own
        found = np.stack([np.minimum(shard.links(node, q, b)[0], truth) for b in beams], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(truth), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["truth", "found"])

    return answer


def _recounted(shard: Shard, rows: pa.Table, q: np.ndarray) -> pa.RecordBatch:
    """Links of each query into the groups that it asks for."""
    wanted = rows.column("wanted").to_pylist()
    row = np.repeat(np.arange(len(q)), [len(w) for w in wanted])
    group = np.searchsorted(shard.homes, np.array([h for w in wanted for h in w], np.int64))
    total = np.zeros(len(q), np.int64)
    for g in np.unique(group):
        own = row[group == g]
        total[own] += shard.into(int(g), q[own])
    node = rows.column("node").combine_chunks()
    return pa.RecordBatch.from_arrays([node, pa.array(total), pa.array([[] for _ in total], pa.list_(pa.int64()))], names=["node", "n_links", "homes"])


def _both_ways(found: DataFrame, index: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """found, and the links that only the other side's search has met: where any class of one group links into another group, all classes
    of both are counted against the other group."""
    hit = found.select("node", F.explode("homes").alias("to"))
    ties = written(hit.join(index.select("node", "home"), "node").select("home", "to").distinct(), "ties")
    ties = ties.unionByName(ties.select(F.col("to").alias("home"), F.col("home").alias("to"))).distinct()
    open_ = unskewed(index.select("node", "home"), ties, ["home"]).select("node", "to").join(hit, ["node", "to"], "left_anti")
    open_ = written(open_, "open")
    if open_.isEmpty():
        return found
    asks = open_.join(index.select(F.col("node").alias("to"), "dim", "shard"), "to").groupBy("node", "dim", "shard").agg(F.collect_list("to").alias("wanted"))
    asks = asks.join(classes.select("node", "x"), "node").withColumn("kind", F.lit(1))
    own = index.join(asks.select("dim", "shard").distinct(), ["dim", "shard"], "left_semi").withColumn("kind", F.lit(0))
    rows = own.unionByName(asks, allowMissingColumns=True).withColumn("part", F.lit(0))
    rows = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "pos")
    return found.unionByName(rows.mapInArrow(_visited(least, _recounted), "node long, n_links long, homes array<long>"))


def _visits(index: DataFrame, queries: DataFrame, shards: int, parts: int) -> DataFrame:
    """Every query beside every shard of its dimension; a shard's index stands in each of its parts."""
    some = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = index.withColumn("part", some(parts)).withColumn("kind", F.lit(0))
    all_ = queries.select("dim", F.lit(-1).alias("pos"), "node", F.lit(0).cast("long").alias("n"), "x", F.lit(b"").alias("links"), F.lit(-1).cast("long").alias("home"), F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), some(shards).alias("shard"))
    rows = own.unionByName(all_)
    return rows.repartition(shards * parts, "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "kind", "pos")


def wanted_beam(index: DataFrame, classes: DataFrame, shards: int, least: float, beams: tuple[int, ...] = BEAMS, recall: float = RECALL) -> tuple[int | None, dict[int, float]]:
    """The first beam whose recall, over the audited classes' links, is the wanted one, or None; and the recall of each beam."""
    audit = classes.where("audit")
    share = max(1, -(-audit.count() // AUDITED))
    audit = audit.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0)
    rows = _visits(index, audit, shards, 1).mapInArrow(_visited(least, _audited(beams)), "truth long, found array<long>")
    sums = rows.agg(F.sum("truth").alias("truth"), *[F.sum(F.get("found", F.lit(k))).alias(f"b{k}") for k in range(len(beams))])
    found = sums.first()
    got = {b: (found[f"b{k}"] / found["truth"] if found["truth"] else 1.0) for k, b in enumerate(beams)}
    return next((b for b in beams if got[b] >= recall), None), got


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, shard_bytes: int = SHARD_BYTES, parallel_rows: int = PARALLEL_ROWS, beams: tuple[int, ...] = BEAMS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; columns besides id and vector are not read.

    Rows link if the cosine of their vectors is `least` or more, copies included. A vector that is null, empty, zero or holds null or
    non-finite numbers links with nothing, and so does a row with a null id (its component_id is null, kept is true); vectors of
    different length don't link. component_id is the smallest id reachable, the row's own included. Rows that repeat an id are rows of their own, each
    with the links of its vector. An empty table gives no rows.
    """
    spark = rows.sparkSession
    raw = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    prep = written(raw.mapInArrow(_prepared, "vec_id long, key binary, x binary"), "vectors")
    own = prep.where("key is not null")
    classes = own.groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.max(F.col("vec_id") % 100 == 0).alias("audit"), F.first("x").alias("x"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", (F.octet_length("x") / 8).cast("int")), "classes")
    size = classes.agg(F.sum(F.octet_length("x")).alias("bytes"), F.count("*").alias("n")).first()
    shards = max(1, -(-(size["bytes"] or 0) // shard_bytes), min(4, -(-size["n"] // parallel_rows)))
    parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    sharded = classes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    index = written(sharded.groupBy("dim", "shard").applyInArrow(_index(least, beams[0]), _INDEX), "index")

    beam, _ = wanted_beam(index, classes, shards, least, beams)
    found = written(_visits(index, classes, shards, parts).mapInArrow(_visited(least, _answers(beam)), "node long, n_links long, homes array<long>"), "found")
    found = written(_both_ways(found, index, classes, least), "found")
    links = found.select(F.col("node").alias("a"), F.explode("homes").alias("b")).unionByName(index.where("node <> home").select(F.col("node").alias("a"), F.col("home").alias("b")))
    labels = components(written(links, "links"))
    named = classes.join(labels.withColumnRenamed("v", "node"), "node", "left").select("key", "node", "n", "least_id", F.coalesce("comp", "node").alias("comp"))
    named = written(named.join(found.groupBy("node").agg(F.sum("n_links").alias("more")), "node"), "named")
    lows = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    whole = unskewed(named, lows, ["comp"]).select("key", (F.col("n") - 1 + F.col("more")).alias("n_links"), "component_id")
    linked = unskewed(written(own.select("vec_id", "key"), "rows"), written(whole, "whole"), ["key"]).select("vec_id", "n_links", "component_id")
    alone = prep.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
