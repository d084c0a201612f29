"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairground.llm.common import named, scratch, shingle_hashes, small_batches, whole

#: Minimum functions. An item of q shingles is looked for in windows of less than 8 q: at containment
#: 0.75 their Jaccard similarity is over 1/11, so all functions miss with probability under 1.1e-4.
FUNCTIONS = 96
#: Segment of the smallest size class, in shingles; each class doubles it. A window is four segments
#: of its class and overlaps the next by one, so an item of the class lies in a window whole.
SEGMENT, WINDOW, STRIDE = 8, 4, 3
#: Items and bytes of item text in a block, whose index (about 2 KB an item) is broadcast; more items are
#: searched for block after block, one index at a time.
BLOCK_ITEMS, BLOCK_BYTES = 16_384, 16 << 20

_SPACED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
SCHEMA = "doc_id long, item_id long, n_shared long, item_shingles long, containment double"


def shingles_of(texts: list, k: int) -> list[np.ndarray]:
    """The hashes of every k consecutive words of each text: lower-cased letters and digits of any
    script, and whatever stands between them separates."""
    lowered = pa.array([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], pa.binary())
    return shingle_hashes(lowered, k, _SPACED)[0]


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return (rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint32), rng.integers(0, 2**31, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))


def _values(shingles: np.ndarray) -> np.ndarray:
    """functions x shingles, 32 bits."""
    flip, mult = _multipliers()
    with np.errstate(over="ignore"):
        v = ((shingles >> np.uint64(32)).astype(np.uint32)[None, :] ^ flip[:, None]) * mult[:, None]
    return v


def _size_class(q: int) -> int:
    return max(0, int(np.ceil(np.log2(q / SEGMENT))))


class Index:
    """The items of a block: their sets, and per size class the minima of all functions, sorted."""

    def __init__(self, items: list[tuple[int, str]], k: int) -> None:
        self.k, self.ids, self.sets, self.classes = k, [], [], {}
        short: list[int] = []
        keys: dict[int, list] = {}
        for item_id, s in zip([i for i, _ in items], map(np.unique, shingles_of([t for _, t in items], k)), strict=True):
            if not len(s):
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(s)
            if len(s) < SEGMENT // 2:
                short.append(at)
            else:
                own = _values(s).min(axis=1).astype(np.uint64) | (np.arange(FUNCTIONS, dtype=np.uint64) << np.uint64(32))
                keys.setdefault(_size_class(len(s)), []).append((own, np.full(FUNCTIONS, at)))
        for c, parts in keys.items():
            key, item = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(key, kind="stable")
            self.classes[c] = (key[order], item[order])
        pairs = sorted((int(h), at) for at in short for h in self.sets[at])
        self.short = (np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=np.int64))

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Items that share a window's minimum, or, for the very short ones, a shingle."""
        found: set[int] = set()
        if len(self.short[0]):
            found |= _lookup(*self.short, shingles)
        if not self.classes:
            return found
        least = np.minimum.reduceat(_values(shingles), np.arange(0, len(shingles), SEGMENT), axis=1)
        for c in range(max(self.classes) + 1):
            if c:
                if least.shape[1] % 2:
                    least = np.concatenate((least, least[:, -1:]), axis=1)
                least = np.minimum(least[:, 0::2], least[:, 1::2])
            if c in self.classes:
                windows = np.minimum.reduceat(least, np.arange(0, least.shape[1], STRIDE), axis=1)
                if least.shape[1] > STRIDE:  # the segment that a window shares with the next
                    shared = least[:, STRIDE::STRIDE]
                    windows[:, : shared.shape[1]] = np.minimum(windows[:, : shared.shape[1]], shared)
                probe = windows.astype(np.uint64) | (np.arange(FUNCTIONS, dtype=np.uint64) << np.uint64(32))[:, None]
                found |= _lookup(*self.classes[c], probe.ravel())
        return found


def _lookup(keys: np.ndarray, items: np.ndarray, probe: np.ndarray) -> set[int]:
    lo = np.searchsorted(keys, probe, side="left")
    hit = keys[np.minimum(lo, len(keys) - 1)] == probe
    if not hit.any():
        return set()
    probe, lo = probe[hit], lo[hit]
    hi = np.searchsorted(keys, probe, side="right")
    return {int(i) for a, b in zip(lo, hi, strict=True) for i in items[a:b]}


def _found(shingles: np.ndarray, index: Index, containment: float):
    """Items that a text holds: their place in the index, shingles shared, shingles in all."""
    found = index.candidates(shingles) if len(shingles) else ()
    if found:
        own = np.unique(shingles)
        for at in sorted(found):
            s = index.sets[at]
            shared = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
            if shared >= containment * len(s):
                yield at, shared, len(s)


def _search(batches, shared_index, containment: float):
    index = shared_index.value
    for batch in batches:
        out = []
        for doc_id, digest, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingles_of(batch.column(2).to_pylist(), index.k), strict=True):
            out += [(doc_id, index.ids[at], shared, n, shared / n, digest) for at, shared, n in _found(own, index, containment)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [*[pa.int64()] * 4, pa.float64(), pa.string()]
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "n_shared", "item_shingles", "containment", "digest"])


def _matches(docs: DataFrame, benchmark: DataFrame, k: int, containment: float, id_col: str | None, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """SCHEMA and a digest of the document's text, over all items."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text"))
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows * 2 // BLOCK_ITEMS), -(-size * 2 // BLOCK_BYTES))
    text = named(docs, text_col).cast("string")
    ids = named(docs, id_col).cast("long") if id_col else F.lit(None).cast("long")
    texts = docs.select(ids.alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared_index = spark.sparkContext.broadcast(Index([tuple(r) for r in block], k))
        part = scratch(texts.mapInArrow(partial(_search, shared_index=shared_index, containment=containment), f"{SCHEMA}, digest string"), "leaks")
        shared_index.destroy()  # the driver and the executors hold one index at a time
        found = part if found is None else found.union(part)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, containment: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: at least `containment` of the item's
    distinct k-word shingles are among the document's, counted exactly on the whole text.

    Words are lower-cased runs of letters and digits. An item with fewer than k words is one shingle,
    its whole sequence, and so found only in documents of just these words. Documents are cut into
    overlapping windows in proportion to each size class of items, so that short items in long documents
    keep a similarity that FUNCTIONS minima find; candidates are verified. Documents aren't shuffled.
    Items are searched for in blocks of bounded size, one pass over the documents for each.

    Null and empty texts and items hold and match nothing. Repeated documents come out as often as they
    are in, repeated items too. Null ids are kept as null. Empty tables give an empty result. Other
    columns are ignored."""
    return _matches(docs, benchmark, k, containment, id_col, text_col, item_col, item_text_col).drop("digest")


def decontaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, containment: float = 0.75, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns of whatever names, that hold no item of the benchmark in the sense
    of leaks(). Rows are judged by their text alone: repeated rows go or stay together, null and empty
    texts stay, an empty table stays empty. Spark broadcasts the digests of the texts to go if they are
    few, and shuffles otherwise."""
    gone = _matches(docs, benchmark, k, containment, None, text_col, item_col, item_text_col).select("digest").distinct()
    gone = scratch(gone, "contaminated")
    rows = docs.select(F.md5(named(docs, text_col).cast("string").cast("binary")).alias("digest"), whole(docs).alias("row"))
    return rows.join(gone, "digest", "left_anti").select("row.*")
