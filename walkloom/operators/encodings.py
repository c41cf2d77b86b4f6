"""All that a step of a walk or search says about itself, in one vector of fixed width, and all pairs of a walk's steps in one block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.functions import geometry
from walkloom.operators.attributes import pe_width


def with_geometry(graphs: DataFrame, nodes: DataFrame, attrs: DataFrame | None = None) -> DataFrame:
    """Packed graphs with xyz, each node's place (nodes: g, v, pos), and, from attrs (g, u, v, attr), bond_to and bonds: each node's partners and
    their vectors in the same order. One shuffle by graph for either."""
    def listed(rows: DataFrame, value: Column, name: str) -> DataFrame:
        return rows.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("v"), value.alias("x")))), lambda r: r["x"]).alias(name))

    out = graphs.join(listed(nodes, F.col("pos"), "xyz"), "g")
    if attrs is None:
        return out
    ends = attrs.groupBy("g", F.col("u").alias("v")).agg(F.array_sort(F.collect_list(F.struct(F.col("v").alias("to"), "attr"))).alias("r"))
    own = nodes.select("g", "v").join(ends, ["g", "v"], "left").withColumn("r", F.coalesce("r", F.array().cast(ends.schema["r"].dataType)))
    return out.join(listed(own, F.col("r"), "r"), "g").select("*", F.transform("r", lambda r: r["to"]).alias("bond_to"), F.transform("r", lambda r: r["attr"]).alias("bonds")).drop("r")


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def step_encoding(kind: str, found: DataFrame, graphs: DataFrame, s: int, distances: bool = False, bonds: bool = False, angles: bool = False, dihedrals: bool = False, rbf: int = 16, angle_k: int = 8, dihedral_k: int = 4, bond_width: int = 3) -> DataFrame:
    """g, walk, pe: for each step of found (g, walk, ids) one vector, in this order and of the width that pe_width gives, else an error.

    Walks: repeat bits and edge bits of the s steps before; searches: edge bits; degree-weighted and anonymous walks: neither. Then, from the second step
    on, the distance basis and the bond's vector of the step from the node before: zeros for a bond that isn't there, and for a
    breadth-first search also the distance where the two are no edge. Depth-first searches add the angle from the third and the dihedral from
    the fourth step on. graphs: g, adj, and what with_geometry adds.
    """
    plain = kind.removeprefix("walk_") if kind not in ("walk", "walk_ada") else "walk"
    is_walk, is_bfs, is_search = plain == "walk", plain in ("bfs", "search_bfs"), plain in ("search", "dfs", "bfs", "search_bfs")
    bent, width = is_search and not is_bfs, pe_width(kind, s, distances, bonds, angles and not is_bfs, dihedrals and not is_bfs, rbf, angle_k, dihedral_k)

    def near(a: Column, b: Column) -> Column:
        return F.array_contains(F.get("adj", a), b) | F.array_contains(F.get("adj", b), a)

    def one(node: Column, j: Column) -> Column:
        back = lambda d: F.get("ids", j - d)
        at = lambda d: F.get("xyz", back(d) if d else node)
        parts = []
        if is_walk:
            parts.append(F.array(*[F.coalesce((node == back(d)).cast("double"), F.lit(0.0)) for d in range(1, s + 1)]))
        if is_walk or is_search:
            parts.append(F.array(*[F.coalesce(near(node, back(d)).cast("double"), F.lit(0.0)) for d in range(1, s + 1)]))
        seen = (j > 0) & near(node, back(1)) if is_bfs else j > 0
        if distances:
            parts.append(F.when(seen, geometry.rbf(geometry.distance(at(1), at(0)), rbf)).otherwise(_zeros(rbf)))
        if bonds:
            value = F.get(F.get("bonds", back(1)), F.array_position(F.get("bond_to", back(1)), node).cast("int") - 1)
            parts.append(F.coalesce(F.when(seen, value), _zeros(bond_width)))
        if angles and bent:
            parts.append(F.when(j > 1, geometry.angle_basis(geometry.bond_angle(at(2), at(1), at(0)), angle_k)).otherwise(_zeros(angle_k)))
        if dihedrals and bent:
            parts.append(F.when(j > 2, geometry.dihedral_basis(geometry.dihedral(at(3), at(2), at(1), at(0)), dihedral_k)).otherwise(_zeros(2 * dihedral_k)))
        return F.concat(*parts) if parts else F.array().cast("array<double>")

    needed = ["g", "adj", *(["xyz"] if distances or bent and (angles or dihedrals) else []), *(["bond_to", "bonds"] if bonds else [])]
    rows = found.select("g", "walk", "ids").join(graphs.select(*needed), "g").select("g", "walk", F.transform("ids", one).alias("pe"))
    bad = F.exists("pe", lambda x: F.size(x) != width)
    return rows.select("g", "walk", F.when(bad, F.raise_error(F.lit(f"a step's encoding is not {width} wide")).cast("array<array<double>>")).otherwise(F.col("pe")).alias("pe"))


def _angles(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Angle at q."""
    a, b = p - q, r - q
    size = np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1))
    return np.arccos(np.clip((a * b).sum(-1) / (size + geometry.EPS), -1, 1))


def _dihedrals(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    b1, b2, b3 = q - p, r - q, s - r
    size = np.sqrt((b2 * b2).sum(-1))
    n1, n2 = np.cross(b1, b2), np.cross(b2, b3)
    unit = b2 / np.maximum(size, geometry.EPS)[..., None]
    return np.where(size < geometry.EPS, 0.0, np.arctan2((np.cross(n1, unit) * n2).sum(-1), (n1 * n2).sum(-1)))


def _block(x: np.ndarray, rbf: int, angle_k: int, dihedral_k: int, cutoff: float = 5.0) -> np.ndarray:
    """(steps, steps, width) of the places x of a walk's steps."""
    n = len(x)
    out = np.zeros((n, n, rbf + 2 * angle_k + 2 * dihedral_k))
    gap = x[:, None] - x[None]
    dist = np.sqrt((gap * gap).sum(-1))
    out[..., :rbf] = np.exp(-((dist[..., None] - cutoff * np.arange(rbf) / (rbf - 1)) ** 2) / (2 * (cutoff / rbf) ** 2))
    off = ~np.eye(n, dtype=bool)
    xi, xj = np.broadcast_to(x[:, None], gap.shape), np.broadcast_to(x[None], gap.shape)
    before, after = np.roll(xi, 1, axis=0), np.roll(xj, -1, axis=1)
    has_i, has_j = off & (np.arange(n) > 0)[:, None], off & (np.arange(n) < n - 1)[None]
    l, m = np.arange(1, angle_k + 1), np.arange(1, dihedral_k + 1)
    out[has_i, rbf : rbf + angle_k] = np.cos(_angles(before[has_i], xi[has_i], xj[has_i])[:, None] * l)
    out[has_j, rbf + angle_k : rbf + 2 * angle_k] = np.cos(_angles(xi[has_j], xj[has_j], after[has_j])[:, None] * l)
    both = has_i & has_j
    turn = _dihedrals(before[both], xi[both], xj[both], after[both])[:, None] * m
    out[both, rbf + 2 * angle_k :] = np.concatenate((np.sin(turn), np.cos(turn)), axis=1)
    return out


def _blocks(rbf: int, angle_k: int, dihedral_k: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("xyz").flatten()
            x = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1) if len(points) else np.zeros((0, 3))
            sizes = np.array([len(r) for r in batch.column("xyz")], np.int64)
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
            for k in range(batch.num_rows):  # one walk's block at a time: its steps squared are what memory holds
                block = _block(x[ends[k] : ends[k + 1]], rbf, angle_k, dihedral_k)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("g", "walk")), pa.array([sizes[k]], pa.int32()), pa.array([block.ravel()], pa.list_(pa.float64()))], names=["g", "walk", "length", "block"])

    return task


def pair_blocks(walks: DataFrame, rbf: int = 16, angle_k: int = 8, dihedral_k: int = 4) -> DataFrame:
    """g, walk, length, block of walks (g, walk, xyz: each step's place): the basis vectors of all ordered pairs of steps, one row a walk, no join.

    The pair (i, j) starts at (i * length + j) * width: distance basis, the angles (i - 1, i, j) and (i, j, j + 1), the dihedral
    (i - 1, i, j, j + 1); zeros where i = j or a step is missing.
    """
    kind = walks.schema["g"].dataType.simpleString()
    return walks.select("g", "walk", "xyz").mapInArrow(_blocks(rbf, angle_k, dihedral_k), f"g {kind}, walk int, length int, block array<double>")
