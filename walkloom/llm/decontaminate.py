"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Fixed masks select some of the next tokens and ignore the others, so a seed still matches when an ignored token was replaced. Test
items and training texts are hashed under every mask and joined on (mask, hash). Each diagonal (text position minus item position) with
a hit is then compared token by token over the whole overlap of item and text, and its best run decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, by_ids, whole_text, written

#: Token offsets that each mask reads; the gaps are ignored.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 5, 6, 8), (0, 2, 3, 4, 7, 8))
SPAN = 9
#: A verified stretch has this many tokens at least (or the whole item, if shorter), of which this share matches.
MIN_TOKENS, MIN_SHARE = 13, 0.75
#: Items with fewer tokens than this have no place for the masks; they match where the whole item stands.
MIN_ITEM = 8
#: Parts among which a seed's texts are dealt where seeds are too many to broadcast, as many texts may share a passage.
PARTS = 16
#: Test seeds are broadcast only up to this many rows; beyond, both sides shuffle by hash.
BROADCAST_SEEDS = 600_000


def _hashes(text: F.Column) -> F.Column:
    """Array of a hash for each lowered word."""
    words = F.filter(F.split(F.lower(text), SPACE + "+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, ids: list[str], masks: dict[int, tuple[int, ...]]) -> DataFrame:
    """ids, pos, mask, hash: a row for each mask at each position where the mask fits. The hashes that follow a position stand beside it before
    positions become rows, so that no row carries its whole text."""
    ahead = F.arrays_zip(*[F.slice("h", k + 1, F.size("h")).alias(f"h{k}") for k in range(SPAN)])
    at = rows.select(*ids, F.posexplode(ahead).alias("pos", "w"))
    own = [F.struct(F.lit(m).alias("mask"), F.when(F.col(f"w.h{mask[-1]}").isNotNull(), F.xxhash64(*[F.col(f"w.h{k}") for k in mask])).alias("hash")) for m, mask in masks.items()]
    return at.select(*ids, "pos", F.explode(F.array(*own)).alias("s")).select(*ids, "pos", "s.mask", "s.hash").where("hash is not null")


def _stretches(checked: DataFrame) -> DataFrame:
    """For each (doc_id, row, item_id, want): best, the most equal tokens of any run of enough tokens that reaches the share on one diagonal, 0 if
    there is none; near, the equal tokens of the best stretch around the hits; all, the item's places in such stretches of any diagonal.

    checked has a row for each diagonal, with `equal` from the item's place `start` on. The places of a diagonal become rows, as many as the item
    has tokens. A run reaches the share if at its end the level, four times the equal tokens so far less three times the tokens, is not below
    the level at its start, so the longest run to an end starts at the earliest place among those of no higher level.
    """
    key = ["doc_id", "row", "item_id", "diagonal"]
    at = checked.select(*key, "want", "start", "lo", "hi", F.posexplode(F.concat(F.array(F.lit(0)), F.transform("equal", lambda e: e.cast("int")))).alias("k", "e"))
    each = Window.partitionBy(*key)
    at = at.withColumn("sum", F.sum("e").over(each.orderBy("k"))).withColumn("level", 4 * F.col("sum") - 3 * F.col("k"))
    first = F.min(F.struct("k", "sum")).over(each.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    low, high = (F.max(F.when(F.col("k") == F.col(c), F.col("level"))).over(each) for c in ("lo", "hi"))
    at = at.withColumn("first", first).withColumn("low", low).withColumn("high", high)
    left = F.min(F.when((F.col("k") <= F.col("lo")) & (F.col("level") <= F.col("low")), F.col("k"))).over(each)
    right = F.max(F.when((F.col("k") >= F.col("hi")) & (F.col("level") >= F.col("high")), F.col("k"))).over(each)
    at = at.withColumn("left", left).withColumn("right", right)
    run = F.when(F.col("k") - F.col("first.k") >= F.least(F.lit(MIN_TOKENS), F.col("want")), F.col("sum") - F.col("first.sum")).otherwise(0)
    place = F.when((F.col("e") == 1) & (F.col("k") > F.col("left")) & (F.col("k") <= F.col("right")), F.col("k") + F.col("start"))
    one = at.withColumn("run", run).withColumn("place", place)
    of = ["doc_id", "row", "item_id", "want"]
    by_diagonal = one.groupBy(*of, "diagonal").agg(F.max("run").alias("best"), F.count("place").alias("near"), F.collect_list("place").alias("places"))
    return by_diagonal.groupBy(*of).agg(F.max("best").alias("best"), F.max("near").alias("near"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("all"))


def contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated document: doc_id, contaminated (true), n_items, item_ids, matched_tokens (of the best stretch).

    A document is contaminated by an item if on one diagonal that a seed hits any run of at least 13 tokens (or the whole of a shorter
    item) has 75 % of its tokens equal, or if stretches around the hits of several diagonals (tokens inserted or lost) together match 75 %
    of the item. matched_tokens are the equal tokens of the longest such run, or of the best stretch where only several do together. An item under
    8 tokens matches where it stands as a whole. Null or empty texts and items match nothing; rows with a null id are not reported; rows that repeat
    an id are judged apart, and the id is reported once if any of them is contaminated.
    Columns besides id and text are not read. Empty tables give no rows.
    """
    items = written(tests.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), _hashes(whole_text(item_text_col)).alias("h")).where(F.size("h") > 0), "items")
    masks = dict(enumerate(MASKS))
    short = {100 + n: tuple(range(n)) for n in sorted(r["n"] for r in items.select(F.size("h").alias("n")).where(F.col("n") < MIN_ITEM).distinct().collect())}  # at most 8
    seeds = _seeds(items.where(F.size("h") >= MIN_ITEM), ["item_id"], masks)
    for mask, places in short.items():
        seeds = seeds.unionByName(_seeds(items.where(F.size("h") == len(places)), ["item_id"], {mask: places}))
    seeds = written(seeds.withColumnRenamed("pos", "item_pos"), "seeds")
    few = seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    text = whole_text(text_col)
    # Rows that repeat an id are told apart by their texts, so that no row's diagonal is laid over another text.
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), _hashes(text).alias("h"))
    own = _seeds(texts, ["doc_id", "row"], masks | short)
    if few:
        hits = own.join(F.broadcast(seeds), ["mask", "hash"])
    else:
        part = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(PARTS))
        spread = seeds.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>")))
        hits = own.withColumn("part", part).join(spread.hint("merge"), ["mask", "hash", "part"])
    spans = hits.groupBy("doc_id", "row", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.min("item_pos").alias("lo"), F.max("item_pos").alias("hi"))
    spans = written(spans, "spans")

    # Only documents with a hit are read again; each brings the list of its stretches, whose number its own length bounds.
    hit_ids = written(spans.select("doc_id").distinct(), "hit_ids")
    again = by_ids(texts, hit_ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "row"])
    checked = again.join(spans, ["doc_id", "row"]).join(items.select("item_id", F.col("h").alias("item_h")), "item_id")
    # The whole overlap of item and text on the diagonal, from the item's place `start` on, as whether each token is equal.
    start, want = F.greatest(F.lit(0), -F.col("diagonal")), F.size("item_h")
    end = F.least(want, F.size("h") - F.col("diagonal"))
    equal = F.transform(F.sequence(start, end - 1), lambda i: F.coalesce(F.get("h", i + F.col("diagonal")) == F.get("item_h", i), F.lit(False)))
    checked = checked.where(end > start).select("doc_id", "row", "item_id", "diagonal", want.alias("want"), start.alias("start"), (F.col("lo") - start).alias("lo"), (F.least(F.col("hi") + SPAN, end) - start).alias("hi"), equal.alias("equal"))
    pairs = _stretches(checked).where((F.col("best") > 0) | (F.col("all") >= MIN_SHARE * F.col("want")))
    matched = F.when(F.col("best") > 0, F.col("best")).otherwise(F.col("near"))
    ids = F.array_sort(F.collect_set("item_id"))
    return pairs.groupBy("doc_id").agg(F.lit(True).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.max(matched).cast("long").alias("matched_tokens"))
