"""Packing of documents into as few sequences as possible: a configuration linear program over lengths."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.llm.common import scratch, small_batches
from fairground.llm.packing import encode

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Share of a length's pieces that one step covers at most, how fast a price falls as they are covered, and how
#: much less than the best a configuration may be worth to be taken.
STEP, RATE, LOSS = 0.05, 10.0, 0.02
#: Configurations read off one table of the knapsack at most, and tables.
READ, TABLES = 512, 100

# ---------------------------------------------------------------------------------------------
# the plan: configurations (how many pieces of which lengths share a sequence) and how often each is used


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """prices: of every size from 0 to the capacity, below 0 where there is no piece. For every room the most
    that pieces in it can be worth, any number of each size, the size of one of them, and the room after it."""
    rooms = len(prices)
    worth, taken, rest = np.zeros(rooms), [0] * rooms, [0] * rooms
    for room in range(1, rooms):
        values = prices[1 : room + 1] + worth[room - 1 :: -1] if room > 1 else prices[1:2]
        i = int(values.argmax())
        if values[i] > worth[room - 1]:
            worth[room], taken[room], rest[room] = values[i], i + 1, room - i - 1
        else:
            worth[room], taken[room], rest[room] = worth[room - 1], taken[room - 1], rest[room - 1]
    return worth, taken, rest


def configuration(taken: list[int], rest: list[int], room: int, first: int = 0) -> Counter:
    """The pieces of the best configuration, or of the best that holds one of size first."""
    held = Counter([first] if first else [])
    room -= first
    while taken[room]:
        held[taken[room]] += 1
        room = rest[room]
    return held


def fractional(counts: dict[int, int], capacity: int) -> tuple[dict[tuple, float], float]:
    """counts: how many pieces of each size. Configurations (sorted pairs of size and number) and how often each
    is used, no size covered more than once, and a number of sequences that no packing can do without.

    Multiplicative weights: a size's price starts as its share of a sequence and falls by exp(-RATE) with the share
    of its pieces that is covered, so that sizes are covered evenly and those hard to place become dear.
    A knapsack table gives what is worth most at these prices; from one table a configuration is read for the
    sizes that lag, and used if it is worth nearly as much. At any prices, all pieces' prices over
    the best worth are a bound from below (the dual of the program)."""
    need, covered = np.zeros(capacity + 1), np.zeros(capacity + 1)
    for size, n in counts.items():
        need[size] = n
    used: dict[tuple, float] = defaultdict(float)
    bound, sizes = 0.0, np.arange(capacity + 1)
    for _ in range(TABLES):
        open_ = np.flatnonzero((need > 0) & (covered < 1 - 1e-9))
        if not len(open_):
            break
        prices = np.full(capacity + 1, -1.0)
        prices[open_] = open_ * np.exp(-RATE * covered[open_])
        worth, taken, rest = knapsack(prices)
        bound = max(bound, float((need * np.maximum(prices, 0)).sum() / worth[capacity]))
        began, read = covered.copy(), 0
        for size in open_[np.argsort(covered[open_], kind="stable")].tolist():
            if prices[size] + worth[capacity - size] < (1 - LOSS) * worth[capacity]:
                continue
            held = configuration(taken, rest, capacity, size)
            own, each = np.array(list(held)), np.array(list(held.values()))
            grows = np.minimum(np.maximum(STEP, 1 / need[own]), np.minimum(1, began[own] + 4 * STEP + 1 / need[own]) - covered[own])
            times = float((grows * need[own] / each).min())
            if times > 1e-9:
                used[tuple(sorted(held.items()))] += times
                covered[own] += times * each / need[own]
                read += 1
                if read == READ:
                    break
    return dict(used), bound


def best_fit(left: dict[int, int], capacity: int) -> dict[tuple, int]:
    """Pieces, the longest first, each into the fullest sequence with room for it, like sequences together."""
    rooms: dict[int, Counter] = defaultdict(Counter)
    for size in sorted(left, reverse=True):
        n = left[size]
        for room in sorted(r for r in rooms if r >= size):
            for held in sorted(rooms[room]):
                if not n:
                    break
                many, fit = rooms[room].pop(held), room // size
                full = min(many, n // fit)
                part = n - full * fit if full < many else 0
                for used, each in ((full, fit), (1 if part else 0, part), (many - full - (1 if part else 0), 0)):
                    if used:
                        rooms[room - each * size][(*held, (size, each)) if each else held] += used
                n -= full * fit + part
            if not rooms[room]:
                del rooms[room]
        fit = capacity // size
        for used, each in ((n // fit, fit), (1, n % fit)):
            if used and each:
                rooms[capacity - each * size][((size, each),)] += used
    made: Counter = Counter()
    for held in rooms.values():
        for config, n in held.items():
            made[tuple(sorted(config))] += n
    return dict(made)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple, int]], float]:
    """counts: pieces of each size, a bounded histogram. Configurations and how often each is used, all pieces
    placed once, and the bound from below.

    The fractions are rounded up, those used most first, as far as pieces are left for whole configurations;
    what no configuration takes is placed by best fit. Sizes and configurations are few, however many pieces there are."""
    shares, bound = fractional(counts, capacity) if counts else ({}, 0.0)
    left, chosen = dict(counts), []
    for config, share in sorted(shares.items(), key=lambda c: (-min(c[1], 1), sum(s * k for s, k in c[0]) < capacity, -c[1], c[0])):
        times = min(int(np.ceil(share - 1e-9)), *(left[s] // k for s, k in config))
        if times > 0:
            chosen.append((config, times))
            for s, k in config:
                left[s] -= k * times
    chosen += sorted(best_fit({s: n for s, n in left.items() if n}, capacity).items())
    return chosen, max(bound, sum(s * n for s, n in counts.items()) / capacity)


class Slots:
    """The plan turned round: for the pieces of a length, ranked from 0, the runs of ranks that a configuration
    takes. Its size is that of the plan, which depends on the capacity, not on the number of pieces."""

    def __init__(self, chosen: list[tuple[tuple, int]]) -> None:
        ranks: Counter = Counter()
        rows, sequence = [], 0
        for config, times in chosen:
            offset = 0
            for size, each in config:
                rows.append((size, ranks[size], sequence, each, offset))
                ranks[size] += each * times
                offset += size * each
            sequence += times
        rows.sort()
        self.size, self.rank, self.sequence, self.each, self.offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        self.key = self._key(self.size, self.rank)

    @staticmethod
    def _key(size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (size << 48) + rank

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of each piece."""
        i = np.searchsorted(self.key, self._key(size, rank), side="right") - 1
        n = rank - self.rank[i]
        return self.sequence[i] + n // self.each[i], self.offset[i] + n % self.each[i] * size


# ---------------------------------------------------------------------------------------------
# Spark


def _cut(batches, path: str, capacity: int, end_id: int):
    """The pieces of every text, each with its rank among this task's pieces of its length."""
    task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
    end, rows = np.array([end_id], dtype="<u4"), []

    def out():
        columns = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    for doc_id, ids in encode(batches, path):
        raw = memoryview(np.concatenate((ids, end)).astype("<u4", copy=False)).cast("B")
        total = len(ids) + 1
        for piece, start in enumerate(range(0, total, capacity)):
            n = min(capacity, total - start)
            rows.append((doc_id, piece, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), task, int(seen[n])))
            seen[n] += 1
        if len(rows) >= 8192:
            yield out()
            rows = []
    if rows:
        yield out()


def _placed(batches, slots: Slots):
    for batch in batches:
        sequence, offset = slots.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        kept = [batch.column(c.split()[0]) for c in PIECES.split(", ")]
        yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=[*[c.split()[0] for c in PIECES.split(", ")], "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into as few sequences of at most `capacity` tokens as the method finds; a document has its
    text's ids and end_id, and only one that is longer than a sequence is cut, into full pieces and a rest.

    Texts are read once; what is kept of a piece are seven numbers. Pieces are counted by task and length, the
    sums of these counts rank all pieces of a length, and the histogram (at most `capacity` rows) is what the driver solves
    for. The plan goes to the tasks as arrays whose size the capacity bounds; a piece finds its place in it by length and rank,
    so that pieces are shuffled once, by task and length, however many are alike.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one piece of one
    token; repeated rows are packed as often as they occur, a null id stays null, an empty table gives no pieces, and
    columns besides the two named are ignored."""
    if not 0 < capacity < 1 << 15:
        raise ValueError(f"a capacity of {capacity} isn't between 1 and {(1 << 15) - 1}")
    small_batches(docs.sparkSession)
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    pieces = scratch(rows.mapInArrow(partial(_cut, path=tokenizer, capacity=capacity, end_id=end_id), f"{PIECES}, task long, rank long"), "pieces")
    counts = scratch(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    chosen, _ = plan(histogram, capacity)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("first")).drop("task", "first")
    return ranked.mapInArrow(partial(_placed, slots=Slots(chosen)), f"{PIECES}, sequence_id long, offset long")
