"""Merkle manifest of a table, one ternary tree a source and one over the sources, with a witness for each row.

Rows are numbered inside their source by sampled range partitions and counts, and cut into aligned blocks of 3**6 leaves. A task appends the
leaves of a block one by one: completed subtrees wait, open, for their siblings, and every leaf under them holds the part of its witness
known so far; a completed run of three extends the witnesses of all three. The roots of the blocks are appended in the same way one level
up, as often as it takes, then the roots of the sources. A leaf's witness is its block's part followed by the parts of the blocks above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unskewed, written

#: A block of leaves, cut at multiples of its size, is a subtree of this height.
ARITY, HEIGHT = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """sha256 of the values one after another, each `-` if null, else its length in UTF-8 bytes, a colon, and itself."""
    def framed(x: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[framed(v.cast("string")) for v in values]), 256))


def _parent(run: list[bytes]) -> bytes:
    return sha256("".join(x.hex() for x in run).encode()).digest()


def _appended(leaves: list[bytes], height: int, whole: bool) -> tuple[bytes, list[bytearray]]:
    """Root of a block and the witness of each of its leaves; a whole tree ends where one node is left, a block of a larger one at its height.

    A witness has a byte for each level, place in the run + 4 * size of the run, followed by the run's other digests from left to right.
    """
    witness = [bytearray() for _ in leaves]
    open_: list[list[tuple[bytes, int, int]]] = [[] for _ in range(height + 1)]

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        digests = [d for d, _, _ in run]
        for place, (_, first, end) in enumerate(run):
            more = bytes([place + 4 * len(run)]) + b"".join(d for k, d in enumerate(digests) if k != place)
            for i in range(first, end):
                witness[i] += more
        open_[level + 1].append((_parent(digests), run[0][1], run[-1][2]))

    for i, leaf in enumerate(leaves):
        open_[0].append((leaf, i, i + 1))
        level = 0
        while level < height and len(open_[level]) == ARITY:
            close(level)
            level += 1
    for level in range(height):
        if whole and len(open_[level]) == 1 and not any(open_[level + 1 :]):
            return open_[level][0][0], witness
        if open_[level]:
            close(level)
    return open_[height][0][0], witness


def _blocks(height: int) -> Callable:
    """Rows (grp, idx, n, digest), sorted, of whole blocks: each with its witness and, on a block's first row, the block's root."""
    size = ARITY**height

    def done(held: list[tuple]) -> pa.RecordBatch:
        grp, n = held[0][0], held[0][2]
        root, witness = _appended([r[3] for r in held], height, n <= size)
        cols = [[grp] * len(held), [r[1] for r in held], [r[1] // size for r in held], [bytes(w) for w in witness], [root, *[None] * (len(held) - 1)], [n] * len(held)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["grp", "idx", "block", "witness", "block_root", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("grp", "idx", "n", "digest")], strict=True):
                if held and (held[0][0] != row[0] or held[0][1] // size != row[1] // size):
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return task


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The rows of a written table with idx, the place of a row in its group from 0, and n, the group's size; no task holds a whole group.

    Range partitions by (group, order) give each row its place in its part; the parts' counts, one row for each group and part, the rest.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "placed")
    spans = placed.groupBy(group, "__part").agg(F.min("__at").alias("__lo"), F.count("*").alias("__k"))
    each = Window.partitionBy(group)
    before = F.sum("__k").over(each.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("__lo")).alias("__shift"), F.sum("__k").over(each).alias("n"))
    return placed.join(spans, [group, "__part"]).withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def trees(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """grp, idx, root, witness (up to the root) of each node (grp, idx, n, digest), a written table; a tree for each grp."""
    size, levels, at = ARITY**height, [], nodes
    while True:
        block = F.expr(f"idx div {size}")
        rows = at.select("grp", "idx", "n", "digest").repartition(F.col("grp"), block).sortWithinPartitions("grp", "idx")
        done = written(rows.mapInArrow(_blocks(height), "grp string, idx long, block long, witness binary, block_root binary, n long"), "blocks")
        levels.append(done)
        heads = done.where("block_root is not null")
        above = heads.where(F.col("n") > size)
        if above.isEmpty():
            break
        at = above.select("grp", F.col("block").alias("idx"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("block_root").alias("digest"))
    found = None  # of each block of a level: its tree's root and the witness of the block's root
    for done in reversed(levels):
        ends = done.where("block_root is not null and n <= " + str(size)).select("grp", "block", F.col("block_root").alias("root"), F.lit(b"").alias("rest"))
        found = ends if found is None else ends.unionByName(found)
        full = done.join(found, ["grp", "block"]).select("grp", "idx", "root", F.concat("witness", "rest").alias("witness"))
        found = full.select("grp", F.col("idx").alias("block"), "root", F.col("witness").alias("rest"))
    return full


def manifest(docs: DataFrame, claim: Column | None = None, fields: tuple[str, ...] = FIELDS, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, claimed, subroot, root (binary digests) and witness of each row; columns besides the five fields are not read.

    Leaves of a source ascend by doc_id, null first, rows that repeat a doc_id by their digest; a null source is a source of its own, before
    all others. claimed is the digest of the row with `claim` in the place of text (null where claim leaves it as it is). A lone leaf is
    its source's root. An empty table gives no rows.
    """
    doc_id, source, *rest = [F.col(c) for c in fields]
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-")).alias("grp"), leaf_digest([doc_id, source, *rest]).alias("digest"), (F.lit(None).cast("binary") if claim is None else F.when(claim.isNotNull(), leaf_digest([doc_id, source, *rest[:-1], claim]))).alias("claimed"))
    leaves = written(numbered(written(rows, "leaves"), "grp", [F.col("doc_id"), F.col("digest")]), "leaves")
    own = written(trees(leaves, height), "witnesses")
    sources = own.where("idx = 0").select("grp", F.col("root").alias("digest"))
    tops = numbered(written(sources.select(F.lit("").alias("__all"), "grp", "digest"), "subroots"), "__all", [F.col("grp")])
    tops = written(tops.select(F.col("__all").alias("grp"), F.col("grp").alias("source"), "idx", "n", "digest"), "subroots")
    over = tops.select("source", "idx").join(trees(tops, height).select("idx", "root", "witness"), "idx")
    over = written(over.select(F.col("source").alias("grp"), F.col("root").alias("top"), F.col("witness").alias("up")), "tops")
    both = leaves.select("grp", "idx", "doc_id", "digest", "claimed").join(own, ["grp", "idx"])
    return unskewed(written(both, "rows"), over, ["grp"]).select("doc_id", F.col("digest").alias("leaf"), "claimed", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("witness", "up").alias("witness"))


def siblings(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """For each level: place in the run and the run's others."""
    at = 0
    while at < len(witness):
        size, place = divmod(witness[at], 4)
        end = at + 1 + 32 * (size - 1)
        yield place, [witness[k : k + 32] for k in range(at + 1, end, 32)]
        at = end


def folded(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    for place, others in siblings(witness):
        leaf = _parent([*others[:place], leaf, *others[place:]])
    return leaf


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs, roots = [], []
        for leaf, claimed, witness in zip(*[batch.column(c).to_pylist() for c in ("leaf", "claimed", "witness")], strict=True):
            proofs.append(sha256("".join(x.hex() for _, others in siblings(witness) for x in others).encode()).hexdigest())
            roots.append(folded(leaf if claimed is None else claimed, witness))
        same = [a == b for a, b in zip(roots, batch.column("root").to_pylist(), strict=True)]
        hexed = [pa.array([x.hex() for x in batch.column(c).to_pylist()], pa.string()) for c in ("leaf", "subroot", "root")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *hexed, pa.array(proofs, pa.string()), pa.array([x.hex() for x in roots], pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def verified(rows: DataFrame) -> DataFrame:
    """Rows of a manifest, each held against the root: digests as hex text, proof_sha256 of all siblings from the leaf up, folded_root that
    the claimed leaf (else the leaf) and the siblings give, and whether that is the root."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.select("doc_id", "leaf", "claimed", "subroot", "root", "witness").mapInArrow(_verified, schema)


def _level_sql(name: str, base: str) -> str:
    """A recursive CTE of the levels of trees: grp, lv, nodes."""
    return f"""{name} AS ({base} UNION ALL SELECT grp, lv + 1, [sha256(array_to_string(nodes[{ARITY} * k + 1 : {ARITY} * k + {ARITY}], '')) FOR k IN range((len(nodes) + {ARITY - 1}) // {ARITY})]
    FROM {name} WHERE len(nodes) > 1)"""


def _fold_sql(name: str, base: str, levels: str) -> str:
    """A recursive CTE (id, grp, i, lv, h, claimed, proof): one level of levels a step."""
    run = f"nodes[{ARITY} * (i // {ARITY}) + 1 : {ARITY} * (i // {ARITY}) + {ARITY}]"
    mixed = f"sha256(array_to_string([CASE WHEN k - 1 = i % {ARITY} THEN {{0}} ELSE {run}[k] END FOR k IN range(1, len({run}) + 1)], ''))"
    return f"""{name} AS ({base} UNION ALL SELECT id, f.grp, i // {ARITY}, f.lv + 1, {mixed.format('h')}, {mixed.format('claimed')},
    concat(proof, array_to_string([{run}[k] FOR k IN range(1, len({run}) + 1) IF k - 1 <> i % {ARITY}], ''))
    FROM {name} f JOIN {levels} t ON t.grp = f.grp AND t.lv = f.lv WHERE len(nodes) > 1)"""


_CRC = "xor(list_reduce([ascii(CAST(doc_id AS VARCHAR)[k + 1]) FOR k IN range(length(CAST(doc_id AS VARCHAR)))], lambda c, b: list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295), 4294967295)"


def _leaf_sql(text: str) -> str:
    framed = ", ".join(f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in (*(f"CAST({c} AS VARCHAR)" for c in FIELDS[:-1]), text))
    return f"sha256(concat({framed}))"


#: Leaves, levels, witnesses and roots by recursion; every tree is a list here.
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('s' || source, '-') AS grp, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 AND text IS NOT NULL THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS claimed FROM documents),
  leaves AS (SELECT row_number() OVER (ORDER BY grp, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, * FROM d),
  {_level_sql('t', 'SELECT grp, 0 AS lv, list(leaf ORDER BY i) AS nodes FROM leaves GROUP BY grp')},
  subs AS (SELECT grp AS source, nodes[1] AS h, row_number() OVER (ORDER BY grp) - 1 AS i FROM t WHERE len(nodes) = 1),
  {_level_sql('u', "SELECT '' AS grp, 0 AS lv, list(h ORDER BY i) AS nodes FROM subs")},
  {_fold_sql('f', "SELECT id, grp, i, 0 AS lv, leaf AS h, claimed, '' AS proof FROM leaves", 't')},
  low AS (SELECT id, grp, arg_max(h, lv) AS h, arg_max(claimed, lv) AS claimed, arg_max(proof, lv) AS proof FROM f GROUP BY id, grp),
  {_fold_sql('g', "SELECT low.id, '' AS grp, subs.i, 0 AS lv, low.h, low.claimed, low.proof FROM low JOIN subs ON subs.source = low.grp", 'u')},
  high AS (SELECT id, arg_max(h, lv) AS root, arg_max(claimed, lv) AS folded, arg_max(proof, lv) AS proof FROM g GROUP BY id)
SELECT doc_id, leaf, low.h AS subroot, high.root AS root, sha256(high.proof) AS proof_sha256, folded AS folded_root, folded = high.root AS verified
FROM leaves JOIN low USING (id) JOIN high USING (id)"""
