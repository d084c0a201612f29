"""Similarity of embeddings as column expressions, and matching of bursts against a gallery."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Similarity that supports a match, least gap to the runner-up, least share of frames that agree and
#: that support, least frames (fixed values).
SUPPORT, GAP, AGREEMENT, SUPPORTED, FRAMES = 0.62, 0.03, 0.70, 0.65, 5
TRIM = 0.2
#: Rows of a block; tasks that a smaller gallery is dealt into, by at least so many rows; queries of a slice of the matrix.
BLOCK, TASKS, LEAST, SLICE = 16384, 32, 1024, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Scaled to length one; as it is if it has next to none."""
    norm = F.sqrt(dot(v, v))
    # the array of one holds the norm, so that it isn't computed again for every component
    return F.get(F.transform(F.array(F.when(norm > 1e-12, norm).otherwise(1.0)), lambda n: F.transform(v, lambda x: x / n)), 0)


def cosine(a: Column, b: Column) -> Column:
    """0 where one is null or has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 1e-12, dot(a, b) / norm), F.lit(0.0))


def valid(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vector has the right length, finite components and a norm."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size(v) == dim) & finite).where(F.sqrt(dot(v, v)) >= 1e-8)


def mean_vectors(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, mean: component by component, summed before the shuffle."""
    per = rows.select(key, F.posexplode(column).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    return per.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def _blocks(rows: DataFrame) -> int:
    """How many blocks rows are dealt into: of about BLOCK rows each, smaller ones if that leaves too few tasks."""
    n = rows.count()
    return max(1, -(-n // BLOCK), min(TASKS, -(-n // LEAST)))


def all_pairs(asked: DataFrame, gallery: DataFrame, compared: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """compared(block of asked, block of the gallery) of every two blocks, each pair of blocks a group of its own: a task
    holds two blocks and a slice of their matrix, however many rows there are.

    asked has `query`, gallery `other` (null: the row has none), by which they are dealt out."""
    n, m = max(1, -(-asked.count() // BLOCK)), _blocks(gallery)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda key, count: F.pmod(F.xxhash64(*key), F.lit(count)).cast("int")
    left = asked.withColumn("part", own(["query"], n)).withColumn("block", every(m))
    right = gallery.withColumn("block", own([c for c in gallery.columns if c != "g"], m)).withColumn("part", every(n))
    dealt = lambda rows: rows.repartition(min(n * m, 2000), "part", "block").groupBy("part", "block")
    return dealt(left).cogroup(dealt(right)).applyInArrow(compared, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length, row by row."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1 if len(whole) else 0)


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, of keys in order."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def own_columns(query: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a matrix at which a query meets itself; other: ids, -1 for none."""
    order = np.argsort(other, kind="stable")
    begin, end = np.searchsorted(other[order], query, "left"), np.searchsorted(other[order], query, "right")
    row = np.repeat(np.arange(len(query)), end - begin)
    at = np.arange(len(row)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)
    return row, order[at]


def _best_looks(asked: pa.Table, gallery: pa.Table) -> pa.Table:
    """The matrix product finds each product's best look; its dot is then added up in order, so that equal vectors have
    equal dots wherever they stand."""
    gallery = gallery.take(np.argsort(gallery["product"].to_numpy(), kind="stable"))
    query, other, product = (t[c].to_numpy() for t, c in ((asked, "query"), (gallery, "other"), (gallery, "product")))
    q, g = matrix(asked["v"]), matrix(gallery["g"])
    first = runs_of(product)
    found = []
    for lo in range(0, len(query) if len(other) else 0, SLICE):
        part, ids = q[lo : lo + SLICE], query[lo : lo + SLICE]
        sims = part @ g.T
        sims[own_columns(ids, other)] = -np.inf
        best = np.stack([a + sims[:, a:b].argmax(axis=1) for a, b in zip(first, [*first[1:], len(product)], strict=True)], axis=1)
        row, run = np.nonzero(np.take_along_axis(sims, best, axis=1) > -np.inf)
        at = best[row, run]
        x, y, score = part[row].T, g[at].T, np.zeros(len(row))
        for a, b in zip(x, y, strict=True):
            score += a * b
        found.append((ids[row], product[at], score))
    return pa.table({c: np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, (c, t) in enumerate((("query", "i8"), ("product", "i8"), ("score", "f8")))})


def best_looks(asked: DataFrame, gallery: DataFrame) -> DataFrame:
    """asked: query, v; gallery: other, product, g; vectors of length one. query, product, score: the best dot of every query
    with every product's looks but itself."""
    longs = lambda rows, *names: rows.select(*[F.col(c).cast("long").alias(c) for c in names], rows.columns[-1])
    met = all_pairs(longs(asked.select("query", "v"), "query"), longs(gallery.select("other", "product", "g"), "other", "product"), _best_looks, "query long, product long, score double")
    return met.groupBy("query", "product").agg(F.max("score").alias("score"))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 1e-12)


def best_and_mean_looks(asked: DataFrame, gallery: DataFrame, colours: int, share: float) -> DataFrame:
    """asked: query, own (camera), v; gallery: other, label, camera, single, g. query, label, best (single look but itself), mean
    (the best mean look, those that aren't single), n (single looks met). Looks of one camera are compared by their
    cosine, across cameras the last components, colours, and the others by a cosine each, weighted by share."""

    def forms(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _unit(v), np.hstack([(1 - share) ** 0.5 * _unit(v[:, :-colours]), share**0.5 * _unit(v[:, -colours:])])

    def compared(asked: pa.Table, gallery: pa.Table) -> pa.Table:
        gallery = gallery.take(np.lexsort((gallery["single"].to_numpy(), gallery["label"].to_numpy())))
        query, own, other = asked["query"].to_numpy(), asked["own"].to_numpy(), gallery["other"].fill_null(-1).to_numpy()
        label, camera, single = (gallery[c].to_numpy() for c in ("label", "camera", "single"))
        (plain, cross), (g_plain, g_cross) = forms(matrix(asked["v"])), forms(matrix(gallery["g"]))
        first = runs_of(label, single)
        size = np.diff([*first, len(label)])
        found = []
        for cam in np.unique(own) if len(label) else ():
            same, of = camera == cam, np.flatnonzero(own == cam)
            for lo in range(0, len(of), SLICE):
                rows = of[lo : lo + SLICE]
                sims = np.empty((len(rows), len(label)))
                sims[:, same], sims[:, ~same] = plain[rows] @ g_plain[same].T, cross[rows] @ g_cross[~same].T
                n = np.repeat(np.where(single[first], size, 0)[None], len(rows), axis=0)
                row, column = own_columns(query[rows], other)
                sims[row, column] = -np.inf
                np.subtract.at(n, (row, np.searchsorted(first, column, "right") - 1), 1)
                best = np.maximum.reduceat(sims, first, axis=1)
                row, run = np.nonzero(best > -np.inf)
                found.append((query[rows][row], label[first][run], single[first][run], best[row, run], n[row, run]))
        kinds = (("query", "i8"), ("label", "i8"), ("single", "?"), ("sim", "f8"), ("n", "i8"))
        return pa.table({c: np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, (c, t) in enumerate(kinds)})

    met = all_pairs(asked.select("query", "own", "v"), gallery.select("other", "label", "camera", "single", "g"), compared, "query long, label long, single boolean, sim double, n long")
    return met.groupBy("query", "label").agg(F.max(F.when(F.col("single"), F.col("sim"))).alias("best"), F.max(F.when(~F.col("single"), F.col("sim"))).alias("mean"), F.sum("n").alias("n"))


def burst_match(live: DataFrame, gallery: DataFrame) -> DataFrame:
    """live: burst_id, frame_no, v; gallery: template, product, v. Per burst the best product, its score and
    how sure that is. A frame isn't compared with the template of its own number.

    A frame's similarity with a product is the best over its templates; a product's score the mean of
    the median and the trimmed mean over the frames. Every frame, the stated queries, meets the gallery
    block by block."""
    asked = live.select(F.col("frame_no").alias("query"), normalised(F.col("v")).alias("v"))
    met = best_looks(asked.distinct(), gallery.select(F.col("template").alias("other"), "product", normalised(F.col("v")).alias("g")))
    sim = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))
    per = live.select("burst_id", "frame_no").join(met, F.col("frame_no") == F.col("query")).select("burst_id", "frame_no", "product", sim.alias("sim"))
    best = F.row_number().over(W.partitionBy("burst_id", "frame_no").orderBy(F.desc("sim"), "product")) == 1
    per = per.withColumn("wins", best)
    scored = per.groupBy("burst_id", "product").agg(F.count("*").alias("n"), F.median("sim").alias("median"), F.sort_array(F.collect_list("sim")).alias("sims"), F.count_if("wins").alias("wins"), F.count_if(F.col("sim") >= SUPPORT).alias("supports"))
    cut = F.floor(F.col("n") * TRIM).cast("int")
    kept = F.slice("sims", cut + 1, (F.col("n") - 2 * cut).cast("int"))
    trimmed = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)
    scored = scored.withColumn("score", 0.5 * F.col("median") + 0.5 * trimmed)
    by = W.partitionBy("burst_id").orderBy(F.desc("score"), "product")
    top = scored.withColumn("next", F.lead("score").over(by)).withColumn("rank", F.row_number().over(by)).where("rank = 1")
    agreement, support = F.col("wins") / F.col("n"), F.col("supports") / F.col("n")
    unsure = (F.col("score") - F.coalesce("next", F.lit(-1.0)) < GAP) | (agreement < AGREEMENT) | (support < SUPPORTED)
    status = F.when(F.col("n") < FRAMES, "unstable").when(F.col("score") < SUPPORT, "unknown").when(unsure, "ambiguous").otherwise("matched")
    return top.select("burst_id", "product", F.round("score", 6).alias("score"), F.round(agreement, 6).alias("agreement"), F.round(support, 6).alias("support"), status.alias("status"))
