"""What several operators of this subpackage share: scratch tables, word shingles, components."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a folder of this machine in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file:///tmp/checkpoints"
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the Python process ends."""
    path = f"{checkpoint_dir(spark)}/fairground/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and
    survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_scratch() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm, target = spark._jvm, path
            at = jvm.org.apache.hadoop.fs.Path(target)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: S112  the JVM, or this table, may be gone by now
            continue
    _WRITTEN.clear()


def named(rows: DataFrame, name: str) -> Column:
    """A column of rows by its whole name, whatever signs that has."""
    return rows["`" + name.replace("`", "``") + "`"]


def whole(rows: DataFrame, names: list[str] | None = None) -> Column:
    """The row, or some of its columns, as one struct."""
    return F.struct(*[named(rows, c).alias(c) for c in names or rows.columns])


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of whole texts stay small, whatever their number in a partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# ---------------------------------------------------------------------------------------------
# words and shingles

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


#: Bytes to bytes: A-Z to a-z, and what separates words `[^\\x20\\x09-\\x0D]+` to a blank.
LOWERED = bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts and where each begins and ends in them; nulls are empty."""
    texts = pc.fill_null(texts, "")
    if texts.offset or not len(texts):
        texts = pa.concat_arrays([texts, pa.array([""], texts.type)])[: len(texts)]
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[: len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[: bounds[-1]], bounds


def hashed_words(texts: pa.Array, table: bytes = LOWERED) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, in order, and where the texts' words begin and end.

    table maps bytes to bytes; words are runs of anything but blanks then. Each different word of a
    batch is hashed once."""
    raw, bounds = _buffer(texts)
    raw = np.frombuffer(table, dtype=np.uint8)[raw]
    blank = raw == 32
    begins = ~blank
    begins[1:] &= blank[:-1]
    inner = bounds[:-1][np.diff(bounds) > 0]
    begins[inner] = ~blank[inner]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    kept = ~blank
    letters = raw[kept]
    offsets = np.append((np.cumsum(kept) - 1)[first], len(letters)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    one = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
    names = pc.binary_join(one, b" ")[0].as_py().split(b" ")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    return hashes[words.indices.to_numpy()], np.searchsorted(first, bounds)


def shingle_hashes(texts: pa.Array, k: int, table: bytes = LOWERED) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The hashes of every k consecutive words of each text, in order (with fewer words, of all of them),
    and hashed_words()."""
    words, bounds = hashed_words(texts, table)
    with np.errstate(over="ignore"):
        grown = mix(words + _ODD)
        for j in range(1, k):
            grown = mix(grown[:-1] * _ODD + words[j:])
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(grown[a : b - k + 1])
            elif b > a:
                short = mix(words[a : a + 1] + _ODD)
                for j in range(a + 1, b):
                    short = mix(short * _ODD + words[j : j + 1])
                out.append(short)
            else:
                out.append(words[:0])
    return out, words, bounds


def minhashes(shingles: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """sets x seeds: 32-bit minima (odd 64-bit multipliers) over non-empty sets, or lists with repeats."""
    out = np.empty((len(shingles), len(seeds)), dtype=np.uint32)
    if shingles:
        flat = np.concatenate(shingles)
        first = np.cumsum([0, *map(len, shingles[:-1])])
        with np.errstate(over="ignore"):
            for i, seed in enumerate(seeds):
                out[:, i] = np.minimum.reduceat((flat * seed) >> np.uint64(32), first)
    return out


def seeds(n: int, salt: int = 7) -> np.ndarray:
    return np.random.default_rng(salt).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def groups_in_order(batches, key: str, columns: list[str]):
    """From Arrow batches sorted by key: one dict of column lists per key, whole groups only."""
    held: dict[str, list] | None = None
    current = None
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in columns}
        keys = cols[key]
        i, n = 0, len(keys)
        while i < n:
            j = i
            while j < n and keys[j] == keys[i]:
                j += 1
            if held is not None and current == keys[i]:
                for c in columns:
                    held[c].extend(cols[c][i:j])
            else:
                if held is not None:
                    yield held
                held, current = {c: cols[c][i:j] for c in columns}, keys[i]
            i = j
    if held is not None:
        yield held


class Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


# ---------------------------------------------------------------------------------------------
# connected components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges.

    Alternating large-star and small-star rounds: each reroutes edges to the smallest neighbour,
    until every component is a star. Minima are pre-aggregated before the shuffle and joined back,
    so that a hub with very many neighbours is a skewed join that Spark splits, never one group.
    Every round is a scratch table. Self-loops and null ends are ignored."""
    low, high = F.least(a, b), F.greatest(a, b)
    stars = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    stars = scratch(stars.select(high.alias("u"), low.alias("v")).distinct(), name)
    last = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = small.union(least.select("u", F.col("m").alias("v")))
        stars = scratch(found.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or now[0] == 0:
            break
        last = now
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
