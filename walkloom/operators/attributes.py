"""Attributes of nodes and edges, targets by name, and rules on names and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.operators.metrics import category_index

# Places of the named targets, and the allowed values of node and edge attributes.
TARGETS = {"mu": 0, "alpha": 1, "homo": 2, "lumo": 3, "gap": 4, "r2": 5, "R2": 5, "zpve": 6, "U0": 7, "U": 8, "H": 9, "G": 10, "Cv": 11}
BOND_TYPES = ["SINGLE", "DOUBLE", "TRIPLE", "AROMATIC", "misc"]
BOND_STEREO = ["STEREONONE", "STEREOZ", "STEREOE", "STEREOCIS", "STEREOTRANS", "STEREOANY"]
ATOMS, DEGREES, HYDROGENS = 118, 10, 8  # numbers 1 to 118, 0 to 10 and 0 to 8 have places of their own; others take the place after them
SP, SP2, SP3, OTHER_HYBRID = 0, 1, 2, 5
NO_CHARGE = 5  # charges start at -5
#: Walk kinds by parts of a model's name, the first that fits.
WALK_OF_NAME = [("crwl_ada", "walk_ada"), ("mdlr_ada", "mdlr_ada"), ("rum_ada", "rum_ada"), ("base_ada", "walk_ada"), ("mdlr", "mdlr"), ("rum", "rum"), ("RWNN", "walk"), ("RSNN", "search")]
#: Columns that only sampling needs.
SAMPLING = ("distances", "pos", "y_full", "z", "idx")


def select_target(y: Column, name: str | Column) -> Column:
    """The named entry of a target array; an unknown name is an error (at once for a fixed name, else when a row has it)."""
    if isinstance(name, str):
        if name not in TARGETS:
            raise ValueError(f"unknown target {name!r}")
        return F.get(y, F.lit(TARGETS[name]))
    at = F.element_at(F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair]), name)
    return F.get(y, F.coalesce(at, F.raise_error(F.concat(F.lit("unknown target "), name)).cast("int")))


def _numbered(value: Column, first: int, last: int) -> Column:
    return F.when(value.between(first, last), value - first).otherwise(last - first + 1).cast("int")


def atom_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """g, v, x: nine whole numbers from z, aromatic, sp, sp2, sp3 (0 or 1) and n_hs; the degree counts edges out of the node, repeated ones too.

    Chirality, charge, radical electrons and rings are not known and have their neutral places."""
    degree = edges.groupBy("g", F.col("u").alias("v")).agg(F.count("*").alias("degree"))
    rows = nodes.join(degree, ["g", "v"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hybrid = F.when(F.col("sp") != 0, SP).when(F.col("sp2") != 0, SP2).when(F.col("sp3") != 0, SP3).otherwise(OTHER_HYBRID)
    x = [_numbered(F.col("z"), 1, ATOMS), F.lit(0), _numbered(F.col("degree"), 0, DEGREES), F.lit(NO_CHARGE), _numbered(F.col("n_hs"), 0, HYDROGENS), F.lit(0), hybrid, (F.col("aromatic") != 0).cast("int"), F.lit(0)]
    return rows.select("g", "v", F.array(*x).alias("x"))


def bond_features(kind: Column, stereo: Column, conjugated: Column) -> Column:
    """Three places: the bond's type (unknown ones take the last), stereo (an unknown one is an error), and whether it is conjugated."""
    return F.array(category_index(kind, BOND_TYPES), category_index(stereo, BOND_STEREO, strict=True), conjugated.cast("int"))


def zero_features_if(zero: Column, v: Column) -> Column:
    """Zeros of the same width where asked for."""
    return F.when(zero, F.transform(v, lambda x: x * 0)).otherwise(v)


def limit_graphs(graphs: DataFrame, n: int) -> DataFrame:
    """The first n graphs by id; all for n <= 0."""
    return graphs.orderBy("g").limit(n) if n > 0 else graphs


def walk_type_of(name: Column) -> Column:
    """Walk kind of a model's name; null where no part fits."""
    kind = F.lit(None).cast("string")
    for part, walk in reversed(WALK_OF_NAME):
        kind = F.when(name.contains(part), walk).otherwise(kind)
    return kind


def stripped(rows: DataFrame) -> DataFrame:
    """Without the columns that only sampling needs."""
    return rows.drop(*SAMPLING)


def pe_width(kind: str, w: int, distances: bool = False, bonds: bool = False, angles: bool = False, dihedrals: bool = False, rbf: int = 16, angle_k: int = 8, dihedral_k: int = 4) -> int:
    """Numbers in a step's encoding. Walks have repeat and edge bits, searches edge bits; only searches have angles."""
    extra = rbf * distances + 3 * bonds
    if kind in ("walk", "walk_ada"):
        return 2 * w + extra
    if kind in ("search", "dfs", "bfs", "search_bfs"):
        return w + extra + angle_k * angles + 2 * dihedral_k * dihedrals
    if kind.removeprefix("walk_") in ("mdlr", "rum", "mdlr_ada", "rum_ada"):
        return extra
    raise ValueError(f"unknown walk kind {kind!r}")
