"""MinHash near-deduplication with fast similarity sketches.

Each text's set of word shingles is sketched by rounds of hashed bin placement: in round i of the first t rounds a shingle goes
to a random bin, in round t + j all go to bin j, and a bin keeps the smallest (round, hash); so every coordinate fills after at
most 2t rounds, usually a few, and agreement of coordinates estimates similarity with the usual concentration bounds. Bands of
coordinates give candidate buckets, and every link is confirmed on the full sets.

Texts with equal sets form one class and only its smallest id goes on. Small buckets compare all their members; large ones
compare members with the bucket's most central member first, and afterwards only members that are still in different components and
that exact bounds don't keep apart, so that a large group of near-copies costs about as many comparisons as it has members and no link
between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import by_ids, hot_bound, unskewed, whole_text, written
from .textkit import U, mix, seeds, shingles, slices, word_hashes

WIDTH = 5
BANDS, ROWS = 44, 5  # a link at similarity 0.75 is missed with probability (1 - 0.75**5)**44 = 7e-6
COORDS = BANDS * ROWS
#: Buckets up to this many members compare all pairs.
SMALL = 8


def sketch(hashes: np.ndarray, offsets: np.ndarray, t: int = COORDS) -> np.ndarray:
    """Fast similarity sketch of each set: an (n, t) table, all ones for empty sets."""
    n = len(offsets) - 1
    table = np.full(n * t, U(2**64 - 1))
    owner = np.repeat(np.arange(n), np.diff(offsets))
    salts = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * U(0xD1342543DE82EF95))
    for i in range(2 * t):
        if not len(hashes):
            break
        h = mix(hashes ^ salts[i])
        cell = owner * t + (((h >> U(32)) * U(t)) >> U(32)).astype(np.int64) if i < t else owner * t + (i - t)
        np.minimum.at(table, cell, (h & U((1 << 48) - 1)) | U(i << 48))
        open_ = (table.reshape(n, t) == U(2**64 - 1)).any(axis=1)[owner]
        hashes, owner = hashes[open_], owner[open_]
    return table.reshape(n, t)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factor = seeds(ROWS, 23)
    for batch in batches:
        for part in slices(batch, "text"):
            words, at = word_hashes(part.column("text"))
            sets, at = shingles(words, at, WIDTH)
            owner = np.repeat(np.arange(part.num_rows), np.diff(at))
            order = np.lexsort((sets, owner))
            sets, owner = sets[order], owner[order]
            keep = np.ones(len(sets), bool)
            keep[1:] = (sets[1:] != sets[:-1]) | (owner[1:] != owner[:-1])
            sets, owner = sets[keep], owner[keep]
            n = np.bincount(owner, minlength=part.num_rows)
            at = np.concatenate(([0], np.cumsum(n)))
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ U(s))))) for s in (0x1B56C4E9, 0x7F4A7C15)]
            f1, f2 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
            rows = sketch(sets, at).reshape(part.num_rows, BANDS, ROWS)
            bands = mix((rows * factor).sum(axis=2, dtype=np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(f1), pa.array(f2), pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))], names=["doc_id", "n_shingles", "f1", "f2", "bands"])


def _sets(texts: pa.Array) -> list[np.ndarray]:
    words, at = word_hashes(texts)
    sh, at = shingles(words, at, WIDTH)
    return [np.unique(sh[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets have 100 * intersection >= 75 * union."""
    for batch in batches:
        for part in slices(batch, "text_a"):
            good = []
            for x, y in zip(_sets(part.column("text_a")), _sets(part.column("text_b")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= 75 * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among candidate pairs, a table; texts has doc_id and text; a repeated id only repeats its links."""
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    own = by_ids(texts, needed, "doc_id", "left_semi")
    side = lambda name: own.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(_confirmed, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every linked id (v, comp), by min-label passes with pointer jumping on written tables."""
    edges = written(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct(), "edges")
    n = edges.count()
    few = n <= common.FEW_ROWS
    hubs = None if few else written(edges.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > hot_bound(n)).select("v"), "hubs")
    labels = written(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("comp")).withColumnRenamed("u", "v"), "labels")
    while True:
        near = (edges.join(labels, "v") if few else unskewed(edges, labels, ["v"], hot=hubs)).groupBy("u").agg(F.min("comp").alias("least"))
        step = labels.join(near, labels.v == near.u).select("v", F.col("comp").alias("old"), F.least("comp", "least").alias("mid"))
        up = labels.select(F.col("v").alias("mid"), F.col("comp").alias("top"))
        raised = step.join(up, "mid", "left") if few else unskewed(written(step, "step"), up, ["mid"], "left")
        moved = written(raised.select("v", "old", F.least("mid", "top").alias("comp")), "labels")
        labels = moved.select("v", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; columns besides id and text are not read.

    A text's set: distinct 5-word shingles of its lowered words; with fewer words the whole sequence; without words empty and
    linked with nothing. component_id is the smallest id reachable over links of similarity 0.75 or more. A null id can't stand for
    a group: its component_id is the group's smallest other id, or null, and kept is false or, when alone, true. Rows that repeat an
    id count as one node; each such row has the same result. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = written(texts.mapInArrow(_profiles, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "profiles")

    classes = written(rows.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = rows.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"]).dropDuplicates(["doc_id", "f1", "f2"])
    reps = written(reps.select(F.col("doc_id").alias("v"), F.col("n_shingles").alias("n"), "bands"), "reps")
    cells = reps.select("v", "n", F.posexplode("bands").alias("band", "sig"))
    shared = written(cells.groupBy("band", "sig").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    bound = hot_bound(BANDS * reps.count())
    members = written(unskewed(cells, shared, ["band", "sig"], hot=shared.where(F.col("size") > bound)), "members")

    central = members.groupBy("v").agg(F.sum("size").alias("score"))
    large = members.where(F.col("size") > SMALL).join(central, "v")
    first = written(large.groupBy("band", "sig").agg(F.max_by("v", F.struct("score", -F.col("v"))).alias("w"), F.max("size").alias("size")), "heads")
    hot, first = first.where(F.col("size") > bound), first.drop("size")
    led = unskewed(members.where(F.col("size") > SMALL), first, ["band", "sig"], hot=hot)
    small = members.where(F.col("size") <= SMALL)
    led = written(led.select("v", "w", "n").distinct(), "led")
    pairs = _sized(led, reps).unionByName(_within(small))
    tried = written(pairs.distinct(), "pairs")
    links = confirm(tried, texts)
    comps = components(links)

    more = _left(led, comps, texts)
    if more is not None:
        links = links.unionByName(confirm(written(more.join(tried, ["a", "b"], "left_anti"), "pairs"), texts))
        comps = components(links)

    found = classes.join(comps.withColumnRenamed("v", "rep"), "rep", "left").select("f1", "f2", F.coalesce("comp", "rep").alias("comp"))
    # All copies of a text have one key, and so have all texts without words, which are in no class.
    own = rows.select("doc_id", "n_shingles", "f1", "f2")
    named = unskewed(own.where("n_shingles > 0"), found, ["f1", "f2"], "left").select("doc_id", "n_shingles", "comp")
    named = named.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("comp")))
    return named.select("doc_id", "n_shingles", F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.col("comp").isNull()).alias("kept"))


def _fits(x: F.Column, y: F.Column) -> F.Column:
    """Sets of these sizes can have a similarity of 0.75."""
    return 100 * F.least(x, y) >= 75 * F.greatest(x, y)


def _pair(x: F.Column, y: F.Column) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _sized(led: DataFrame, reps: DataFrame) -> DataFrame:
    """Each member of a large bucket with the bucket's head."""
    size = reps.select(F.col("v").alias("w"), F.col("n").alias("m"))
    pairs = unskewed(led.where("v <> w"), size, ["w"])
    return pairs.where(_fits(F.col("n"), F.col("m"))).select(*_pair(F.col("v"), F.col("w")))


def _within(rows: DataFrame) -> DataFrame:
    """All pairs of each small bucket: at most SMALL - 1 for a row."""
    x, y = rows.select("band", "sig", "v", "n"), rows.select("band", "sig", F.col("v").alias("w"), F.col("n").alias("m"))
    return x.join(y, ["band", "sig"]).where((F.col("v") < F.col("w")) & _fits(F.col("n"), F.col("m"))).select(*_pair(F.col("v"), F.col("w")))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each member v and head w: how many shingles they share, and the shingles of v alone."""
    for batch in batches:
        for part in slices(batch, "text_v"):
            shared, own = [], []
            for x, y in zip(_sets(part.column("text_v")), _sets(part.column("text_w")), strict=True):
                alone = np.setdiff1d(x, y, assume_unique=True)
                shared.append(len(x) - len(alone))
                own.append(alone.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([part.column("v"), part.column("w"), pa.array(shared, pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["v", "w", "i", "own"])


def _left(led: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Pairs (a, b) that may still link components among the members (v, w, n) of large buckets with one head w; None if there are none.

    Members x and y of head w share at most min(|x & w|, |y & w|) shingles of w, and else only shingles outside w. So a link needs either
    enough shingles of w in both, which the counts decide, or a common shingle outside w; and then, by the usual prefix argument, one among
    the rarest |x| / 4 + 1 outside shingles of both. Members that differ from the head by words of their own thus meet nobody.
    """
    own = led.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    mixed = own.groupBy("w").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("w")
    open_ = written(unskewed(written(own, "own"), mixed, ["w"]), "open")
    if open_.isEmpty():
        return None
    needed = written(open_.select(F.explode(F.array("v", "w")).alias("doc_id")).distinct(), "needed")
    text = by_ids(texts, needed, "doc_id", "left_semi")
    side = lambda name: text.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))
    both = open_.where("v <> w").select("v", "w").join(side("w"), "w").join(side("v"), "v").select("v", "w", "text_v", "text_w")
    measured = both.mapInArrow(_measured, "v long, w long, i long, own array<long>").dropDuplicates(["v", "w"])
    rows = open_.join(measured, ["v", "w"], "left").withColumn("i", F.coalesce("i", "n"))
    rows = written(rows, "measured")

    # A partner has three quarters of a member's shingles at least, so enough shingles of w are three quarters of its own; and it is of the
    # member's own step of size or of a neighbouring one.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)))
    kinds = written(rows.where("4 * i >= 3 * n").select("w", "comp", "n", "i").distinct().withColumn("step", step), "kinds")
    other = kinds.select("w", *[F.col(c).alias(f"{c}2") for c in ("comp", "n", "i")], F.explode(F.array(*[F.col("step") + k for k in (-1, 0, 1)])).alias("step"))
    enough = 3 * (F.col("n") + F.col("n2")) <= 7 * F.least("i", "i2")
    pass_ = kinds.join(other, ["w", "step"]).where((F.col("comp") < F.col("comp2")) & _fits(F.col("n"), F.col("n2")) & enough)
    member = rows.select("w", "comp", "n", "i", "v")
    second = rows.select("w", F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("v").alias("v2"))
    near = pass_.join(member, ["w", "comp", "n", "i"]).join(second, ["w", "comp2", "n2", "i2"]).select(*_pair(F.col("v"), F.col("v2")))

    parts = rows.select("w", "v", "n", "comp", F.explode("own").alias("s")).withColumn("df", F.count("*").over(Window.partitionBy("w", "s")))
    rare = parts.withColumn("place", F.row_number().over(Window.partitionBy("w", "v").orderBy("df", "s"))).where("df > 1 and 4 * (place - 1) <= n").select("w", "s", "v", "n", "comp")
    rare2 = rare.select("w", "s", F.col("v").alias("v2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
    far = rare.join(rare2, ["w", "s"]).where((F.col("comp") < F.col("comp2")) & _fits(F.col("n"), F.col("n2"))).select(*_pair(F.col("v"), F.col("v2")))
    return near.unionByName(far).distinct()
