"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

The program has a variable for each configuration (a multiset of lengths that fills a sequence). Multiplicative weights solve it
approximately: each length has a price that falls as its demand is covered, a knapsack dynamic program over exact lengths prices out
configurations near the best, and each covers a further part of the demand. The solution is rounded to whole sequences, what remains
is packed best-fit decreasing, and every piece finds its place from its rank among the pieces of its length. Only the histogram (at most
`capacity` numbers) and the plan (whose size the number of lengths and rounds bounds) are on the driver.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written
from .textkit import slices
from .tokens import SLICE, encode, with_ends

CAPACITY = 4096
#: Rounds of pricing, configurations drawn from each round's table, and how far below the best price (as a share) a choice in one may be.
ROUNDS, DRAWS, NEAR = 200, 48, 0.02
#: Share of a length's demand that one configuration covers at most, and how fast prices fall.
STEP, FALL = 0.25, 3.0
#: Tokens that a configuration may leave free.
SLACK = 2
#: Pieces of one length are ranked in lots of at most about so many, so that a length which most pieces share is ranked by many tasks.
LOT = 4000


def _table(sizes: np.ndarray, prices: np.ndarray, room: int) -> np.ndarray:
    """Unbounded knapsack: the highest price of sizes that add up to exactly 0, 1, ... room; minus infinity where none do."""
    value = np.full(room + 1, -np.inf)
    value[0] = 0
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        if upto[c]:
            value[c] = (value[c - sizes[: upto[c]]] + prices[: upto[c]]).max()
    return value


def _drawn(sizes: np.ndarray, prices: np.ndarray, value: np.ndarray, room: int, rng: np.random.Generator) -> Counter[int]:
    """A configuration that fills `room` at nearly the highest price: how often it takes each size (its index)."""
    found: Counter[int] = Counter()
    near = NEAR * value[room]
    while room:
        n = int(np.searchsorted(sizes, room, side="right"))
        gain = value[room - sizes[:n]] + prices[:n]
        good = np.flatnonzero(gain >= gain.max() - near)
        k = int(good[rng.integers(len(good))])
        found[k] += 1
        room -= int(sizes[k])
    return found


def fractional(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], float]]:
    """Configurations over lengths (length: number of pieces) and how many sequences use each, covering the demand while they are full."""
    sizes = np.array(sorted(demand))
    need = np.array([demand[s] for s in sizes], float)
    covered, used, rng = np.zeros(len(sizes)), {}, np.random.default_rng(3)
    for _ in range(ROUNDS):
        left = np.flatnonzero(covered < 1)
        if not len(left):
            break
        own, low = sizes[left], covered[left].min()
        prices = own * np.exp(-FALL * (covered[left] - low))
        value = _table(own, prices, room)
        full = next((c for c in range(room, room - SLACK - 1, -1) if np.isfinite(value[c])), None)
        if full is None:
            break  # nothing that is left fills a sequence
        for _ in range(DRAWS):
            took = _drawn(own, prices, value, full, rng)
            n = STEP * min(need[left[k]] / a for k, a in took.items())
            for k, a in took.items():
                covered[left[k]] += a * n / need[left[k]]
            key = tuple(sorted((int(own[k]), a) for k, a in took.items()))
            used[key] = used.get(key, 0.0) + n
    return [(dict(key), n) for key, n in used.items()]


def best_fit(lengths: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing with counts: configurations over lengths and how many sequences use each."""
    free: list[tuple[int, int]] = []
    bins: list[Counter[int]] = []
    for length in sorted(lengths, reverse=True):
        n = lengths[length]
        while n:
            at = bisect.bisect_left(free, (length, -1))
            if at < len(free):
                room, b = free.pop(at)
            else:
                room, b = capacity, len(bins)
                bins.append(Counter())
            k = min(n, room // length)
            bins[b][length] += k
            n -= k
            if room - k * length:
                bisect.insort(free, (room - k * length, b))
    return [(dict(key), n) for key, n in Counter(tuple(sorted(b.items())) for b in bins).items()]


def rounded(lengths: dict[int, int], amounts: list[tuple[dict[int, int], float]], share: float) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of sequences for a share of the configurations, the most used first, as far as there are pieces for them."""
    left, out = Counter(lengths), []
    for config, amount in sorted(amounts, key=lambda x: -x[1])[: math.ceil(share * len(amounts))]:
        n = min(max(1, round(amount)), *(left[x] // a for x, a in config.items()))
        if n:
            out.append((config, n))
            for x, a in config.items():
                left[x] -= a * n
    return out


def programmed(lengths: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], list[tuple[dict[int, int], int]]]:
    """The program's configurations over lengths, and those of the pieces that are left; together they hold every piece exactly once.

    Should they need more sequences than best-fit decreasing alone (rounding can cost one), fewer of the program's are used.
    """
    whole = [({capacity: 1}, lengths[capacity])] if lengths.get(capacity) else []
    rest = {x: n for x, n in lengths.items() if n and x < capacity}
    most = sum(n for _, n in best_fit(rest, capacity))
    amounts = fractional(rest, capacity) if rest else []
    for share in (1.0, 0.9, 0.75, 0.5, 0.25):
        ours = rounded(rest, amounts, share)
        left = Counter(rest)
        for config, n in ours:
            left.subtract({x: a * n for x, a in config.items()})
        more = best_fit({x: n for x, n in left.items() if n}, capacity)
        if sum(n for _, n in ours) + sum(n for _, n in more) <= most:
            return ours, whole + more
    return [], whole + best_fit(rest, capacity)


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations over lengths and how many sequences use each; together they hold every piece exactly once."""
    ours, others = programmed(lengths, capacity)
    return ours + others


def _places(configs: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Length, first rank, end of ranks, pieces a sequence, first sequence, offset of each place in a configuration."""
    rows, sequence, seen = [], 0, Counter()
    for config, n in configs:
        offset = 0
        for length in sorted(config, reverse=True):
            a = config[length]
            rows.append((length, seen[length], seen[length] + a * n, a, sequence, offset))
            seen[length] += a * n
            offset += a * length
        sequence += n
    return rows


def _pieces(tokenizer: str, kind: str, end_id: int, capacity: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, at = with_ends(*encode(tokenizer, kind, part.column("text")), end_id)
                pieces = -(-np.diff(at) // capacity)
                doc = np.repeat(np.arange(part.num_rows), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                cuts = np.append(at[doc] + start, at[-1])
                ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(np.diff(cuts)), ids], names=["doc_id", "piece", "start", "length", "ids"])

    return task


def pack(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit, binary), sequence_id, offset of every piece.

    A document is the ids of its whole text (null: empty) and end_id. Only documents longer than `capacity` are cut. Every sequence is filled
    from offset 0 without gaps. Rows with a null id, and rows that repeat an id, are packed like others. Columns besides id and text are not
    read. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    pieces = written(texts.mapInArrow(_pieces(tokenizer, kind, end_id, capacity), "doc_id long, piece int, start long, length long, ids binary"), "pieces")
    pieces = pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece", F.crc32("ids")), F.lit(max(16, pieces.count() // LOT))))
    counts = written(pieces.groupBy("length", "lot").count(), "counts")
    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "lot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    order = Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "ids")
    ranked = pieces.withColumn("own", F.row_number().over(order)).join(ahead.hint("merge"), ["length", "lot"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("ahead") + F.col("own") - 1).alias("rank"))
    # The lengths and the program's rounds bound the plan, not the documents: a few ten thousand rows at most.
    places = docs.sparkSession.createDataFrame(_places(plan(lengths, capacity)), "of long, first long, end long, each long, sequence long, at long")
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    k = F.col("rank") - F.col("first")
    return found.select("doc_id", "piece", "start", "length", "ids", (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"), (F.col("at") + k % F.col("each") * F.col("length")).alias("offset"))
