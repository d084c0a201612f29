"""A versioned index of vectors: cells around pivots, searched exactly by the triangle inequality; and the near
copies that a burst keeps out, by rounds over the graph of its conflicts."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.operators import vectors
from fairground.sources.shared import append, stored

#: Pivots at most, and rows and queries that are compared at once.
PIVOTS, BLOCK = 1024, 2048
#: Similarities are rounded to so many digits; what a bound allows for it.
DIGITS, SLACK = 6, 2e-6


@dataclass(frozen=True)
class Index:
    """One published version: rows (product, other, second, v, cell, apart) and cells (cell, pivot, low, high, rows).
    Its files are never touched again, so that who reads it isn't disturbed by later versions."""

    version: int
    rows: DataFrame
    cells: DataFrame


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles; no row is null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors, each with each."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def rebuild(rows: DataFrame, path: str, dim: int, spark: SparkSession | None = None) -> Index:
    """rows: id, product, v. Write the next version of the index at path and publish it; returns it.

    Vectors of another length, with null or non-finite components or without a norm are left out. Equal vectors of a product are
    one row with the two smallest ids. The pivots are those of the smallest hashes, as many as the root of the number of rows,
    PIVOTS at most: the only part that is fitted on a sample; every vector is in the cell of its nearest pivot. A version becomes visible
    by one row added to a log, after all of it is written."""
    spark = spark or rows.sparkSession
    unit = vectors.valid(rows.where("product IS NOT NULL AND id IS NOT NULL"), "v", dim).withColumn("v", vectors.normalised(F.col("v")))
    least = unit.groupBy("product", "v").agg(F.min("id").alias("other"))
    again = unit.join(least, ["product", "v"]).where("id <> other").groupBy("product", "v").agg(F.min("id").alias("second"))
    held = stored(least.join(again, ["product", "v"], "left"), "index_rows")
    n = held.count()
    pivots = np.array([r["v"] for r in held.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(min(PIVOTS, isqrt(n) + 1)).collect()], dtype=float).reshape(-1, dim)

    def assigned(batches):
        for batch in batches:
            apart = _distances(_matrix(batch.column("v")), pivots)
            cell = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "apart"])

    kinds = ", ".join(f"{c} {t}" for c, t in held.dtypes)
    version = 1 + max((r["version"] for r in _versions(spark, path)), default=0)
    at = f"{path}/{version}"
    dealt = held.mapInArrow(assigned, f"{kinds}, cell int, apart double")
    dealt.repartitionByRange("cell", "other").sortWithinPartitions("cell", "other").write.parquet(f"{at}/rows")
    made = spark.read.parquet(f"{at}/rows").groupBy("cell").agg(F.min("apart").alias("low"), F.max("apart").alias("high"), F.count("*").alias("rows"))
    centres = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
    made.join(F.broadcast(centres), "cell").coalesce(1).write.parquet(f"{at}/cells")
    append(spark.createDataFrame([(version, at)], "version int, at string").coalesce(1), f"{path}/versions")
    return latest(spark, path)


def _versions(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema("version int, at string").parquet(f"{path}/versions").collect()
    except AnalysisException:  # nothing was published yet
        return []


def latest(spark: SparkSession, path: str) -> Index:
    """The newest version that was published."""
    found = max(_versions(spark, path), default=None)
    if found is None:
        raise ValueError(f"no index was published at {path}")
    return Index(found["version"], spark.read.parquet(f"{found['at']}/rows"), spark.read.parquet(f"{found['at']}/cells"))


# ---------------------------------------------------------------------------------------------
# search

_VISITS = "query long, v array<double>, bound double, cell int, block int, apart double"
_FOUND = "query long, product long, other long, score double, computed long"


def _visits(batches, pivots, low, high, blocks, cells, home: bool):
    """The cells that each query looks into: its nearest, or all others that may hold something within the bound."""
    for batch in batches:
        v, bound = _matrix(batch.column("v")), batch.column("bound").to_numpy()
        apart = _distances(v, pivots)
        near = np.zeros_like(apart, dtype=bool)
        near[np.arange(len(v)), apart.argmin(1)] = True
        if not home:
            near = ~near & (apart - high <= bound[:, None]) & (low - apart <= bound[:, None])
        q, c = np.nonzero(near)
        q, c = np.repeat(q, blocks[c]), np.repeat(c, blocks[c])
        first = np.flatnonzero(np.r_[True, (np.diff(q) != 0) | (np.diff(c) != 0)]) if len(q) else np.zeros(0, dtype=np.int64)
        block = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        for a in range(0, len(q), 4096):  # a query may go to very many cells
            i, j = q[a : a + 4096], c[a : a + 4096]
            columns = [batch.column("query").take(pa.array(i)), batch.column("v").take(pa.array(i)), pa.array(bound[i]), pa.array(cells[j], pa.int32()), pa.array(block[a : a + 4096], pa.int32()), pa.array(apart[i, j])]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _VISITS.split(", ")])


def _compared(left: pa.Table, right: pa.Table, products: int) -> pa.Table:
    """The queries that look into a block of rows: the best row of each of its best products. Rows are ordered by
    their distance from the pivot; who differs in it by more than the bound can't be nearer than that."""
    out = []
    if left.num_rows and right.num_rows:
        right = right.sort_by("apart")
        apart, g = right["apart"].to_numpy(), _matrix(right["v"])
        product, other = right["product"].to_numpy(), right["other"].to_numpy()
        second = right["second"].to_pylist()
        for query, v, bound, own in zip(left["query"].to_pylist(), _matrix(left["v"]), left["bound"].to_numpy(), left["apart"].to_numpy(), strict=True):
            a, b = int(np.searchsorted(apart, own - bound, side="left")), int(np.searchsorted(apart, own + bound, side="right"))
            sims = np.round(np.clip(g[a:b] @ v, -1, 1), DIGITS)
            best: dict = {}
            for i in np.lexsort((other[a:b], product[a:b], -sims)):
                i = int(i)
                name = other[a + i] if other[a + i] != query else second[a + i]
                if name is not None and product[a + i] not in best:
                    best[product[a + i]] = (query, int(product[a + i]), int(name), float(sims[i]), 0)
                    if len(best) == products:
                        break
            out += best.values()
            out.append((query, None, None, None, int(b - a)))
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])


def nearest(index: Index, queries: DataFrame, products: int = 2) -> DataFrame:
    """queries: id, v. The best row of each query's best products: query, rank, product, other, score, and computed, how many
    rows the query was compared with in all. Exact, as if all were compared with all, itself left out; equal scores go to
    the smaller product and then the smaller row.

    A query first looks into the cell of its nearest pivot. The score of the last product wanted bounds how far away a
    better row can be, and only cells that reach so far are looked into, and only rows whose distance from the pivot
    allows it. Rows and queries meet in blocks, so that no cell, however full, is one task. Queries without a valid vector and
    an empty index give no rows."""
    cells = sorted(index.cells.collect(), key=lambda r: r["cell"])
    if not cells:
        return queries.sparkSession.createDataFrame([], "query long, rank int, product long, other long, score double, computed long")
    names = np.array([r["cell"] for r in cells])
    pivots = np.array([r["pivot"] for r in cells], dtype=float)
    low, high = (np.array([r[c] for r in cells]) for c in ("low", "high"))
    blocks = np.array([-(-r["rows"] // BLOCK) for r in cells])
    by_cell = F.broadcast(queries.sparkSession.createDataFrame([(int(c), int(b)) for c, b in zip(names, blocks, strict=True)], "cell int, blocks int"))
    asked = vectors.valid(queries.select(F.col("id").alias("query"), "v"), "v", pivots.shape[1]).withColumn("v", vectors.normalised(F.col("v")))
    asked = stored(asked, "queries")
    parts = max(1, -(-asked.count() // BLOCK))
    rows = index.rows.join(by_cell, "cell").withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks")).cast("int")).drop("blocks")

    def looked(rows_of: DataFrame, home: bool) -> DataFrame:
        visits = rows_of.mapInArrow(lambda b: _visits(b, pivots, low, high, blocks, names, home), _VISITS).withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
        wide = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ["cell", "block", "part"]
        return visits.groupBy(*keys).cogroup(wide.groupBy(*keys)).applyInArrow(lambda a, b: _compared(a, b, products), _FOUND)

    by = W.partitionBy("query").orderBy(F.desc("score"), "product", "other")
    def best(found: DataFrame) -> DataFrame:
        per = found.where("product IS NOT NULL").groupBy("query", "product").agg(F.min_by("other", F.struct(-F.col("score"), "other")).alias("other"), F.max("score").alias("score"))
        return per.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= products)

    first = stored(looked(asked.withColumn("bound", F.lit(2.0)), True), "home")
    last = best(first).where(F.col("rank") == products).select("query", F.sqrt(2 - 2 * (F.col("score") - SLACK)).alias("bound"))
    bounded = asked.join(last, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(2.0)) + 1e-9)
    found = stored(first.union(looked(bounded, False)), "found")
    computed = found.groupBy("query").agg(F.sum("computed").alias("computed"))
    return best(found).join(computed, "query").select("query", "rank", "product", "other", "score", "computed")


# ---------------------------------------------------------------------------------------------
# near copies within a burst

#: Cosine from which on a frame shows nothing new (fixed value).
SAME_VIEW = 0.98


def _grid(dim: int, axes: int = 3) -> list[list[float]]:
    """Unit vectors at right angles to each other, onto which frames are projected."""
    q, _ = np.linalg.qr(np.random.default_rng(11).normal(size=(dim, axes)))
    return q.T.tolist()


def conflicts(frames: DataFrame, dim: int, cosine: float = SAME_VIEW) -> DataFrame:
    """burst, a, b: frames of a burst that look the same, a the earlier. Projections of two such frames lie at most their
    distance apart, so only frames of neighbouring cells of a grid are compared. Frames are unit vectors, all different."""
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    cell = F.array(*[F.floor(vectors.dot(F.col("v"), F.array(*map(F.lit, axis))) / reach) for axis in _grid(dim)])
    rows = frames.withColumn("cell", cell)
    steps = F.array(*[F.array(*[F.lit(d) for d in (x, y, z)]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    a = rows.select("burst", F.col("frame").alias("a"), F.col("v").alias("u"), F.explode(F.transform(steps, lambda s: F.zip_with(F.col("cell"), s, lambda c, d: c + d))).alias("cell"))
    b = rows.select("burst", F.col("frame").alias("b"), F.col("v").alias("w"), "cell")
    return a.join(b, ["burst", "cell"]).where((F.col("a") < F.col("b")) & (F.round(vectors.dot(F.col("u"), F.col("w")), 9) >= cosine)).select("burst", "a", "b")


def kept_frames(frames: DataFrame, dim: int, cosine: float = SAME_VIEW) -> DataFrame:
    """frames: burst, frame, v. burst, frame, status (kept, duplicate, invalid) and round (in which it was decided).

    In order, a frame is kept unless one kept before it looks the same. Frames are decided in rounds: one is kept as soon as all
    earlier ones that look the same are out, and out as soon as one of them is kept; every round decides at least the first open frame of
    each burst. Equal frames are out at once, but for the first, so they make no pairs. Repeated frame numbers of a burst stand for
    the one of the smallest vector; frames without a valid vector are invalid, null bursts one of their own."""
    valid = vectors.valid(frames.select("burst", "frame", "v"), "v", dim).groupBy("burst", "frame").agg(F.min("v").alias("v")).withColumn("v", vectors.normalised(F.col("v")))
    numbered = frames.select("burst", "frame").distinct()
    first = stored(valid.groupBy("burst", "v").agg(F.min("frame").alias("frame")), "frames")
    edges = stored(conflicts(first.select(F.coalesce(F.to_json(F.struct("burst")), F.lit("")).alias("burst"), "frame", "v"), dim, cosine), "conflicts")
    names = first.select(F.coalesce(F.to_json(F.struct("burst")), F.lit("")).alias("burst"), F.col("burst").alias("own"), "frame")
    open_, decided, number = edges, None, 0
    left = edges.select("burst", F.col("a").alias("frame")).union(edges.select("burst", F.col("b").alias("frame"))).distinct()
    while not open_.isEmpty():
        number += 1
        waits = open_.select("burst", F.col("b").alias("frame")).distinct()
        won = left.join(waits, ["burst", "frame"], "left_anti").withColumn("status", F.lit("kept"))
        out = open_.join(won.select("burst", F.col("frame").alias("a")), ["burst", "a"], "left_semi").select("burst", F.col("b").alias("frame")).distinct().withColumn("status", F.lit("duplicate"))
        now = stored(won.union(out).withColumn("round", F.lit(number)), "decided")
        decided = now if decided is None else decided.union(now)
        left = stored(left.join(now, ["burst", "frame"], "left_anti"), "left")
        gone = now.where("status = 'duplicate'").select("burst", "frame")
        met = now.select("burst", "frame")
        open_ = open_.join(gone.select("burst", F.col("frame").alias("a")), ["burst", "a"], "left_anti").join(met.select("burst", F.col("frame").alias("b")), ["burst", "b"], "left_anti")
        open_ = stored(open_.select("burst", "a", "b"), "open")
    if decided is not None:
        last = left.withColumn("status", F.lit("kept")).withColumn("round", F.lit(number + 1))
        names = names.join(decided.union(last), ["burst", "frame"], "left")
    else:
        names = names.withColumn("status", F.lit(None).cast("string")).withColumn("round", F.lit(None).cast("int"))
    names = names.select(F.col("own").alias("burst"), "frame", F.coalesce("status", F.lit("kept")).alias("status"), F.coalesce("round", F.lit(0)).alias("round"))
    known = valid.select(F.col("burst"), F.col("frame"), F.lit(True).alias("valid"))
    rows = numbered.alias("n").join(known.alias("k"), F.expr("n.burst <=> k.burst AND n.frame <=> k.frame"), "left").join(names.alias("d"), F.expr("n.burst <=> d.burst AND n.frame <=> d.frame"), "left")
    status = F.when(F.col("k.valid").isNull(), "invalid").otherwise(F.coalesce("d.status", F.lit("duplicate")))
    return rows.select("n.burst", "n.frame", status.alias("status"), F.coalesce("d.round", F.lit(0)).alias("round"))
