"""Near-duplicate embeddings by collision-counting projections."""

from __future__ import annotations

from functools import partial
from math import ceil, comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairground.llm.common import connected_components, mix, scratch

#: One-dimensional projections, and how many of them decide whether the rest are looked at.
PROJECTIONS, FIRST = 48, 16
#: Half-width of a query's window, in standard deviations of the projected difference of a pair that is
#: just similar enough.
WIDTH = 1.5
#: Share of such pairs that each of the two counts may lose.
MISS = 2e-4
#: Levels of a projected value; 256 levels span 8 standard deviations.
LEVELS_PER_UNIT = 32
#: Vectors in a cell, a range of the first projection, or a part of one; two at most meet in a task.
CELL = 8192
#: Standard deviations of a projected difference within which cells meet: a pair that is just similar
#: enough lies further apart with probability 6e-5.
REACH = 4.0


def windows(cosine: float) -> tuple[int, int, int]:
    """Half-width in levels, and the least counts over FIRST and over all projections."""
    sigma = sqrt(2 - 2 * cosine)
    width = int(WIDTH * sigma * LEVELS_PER_UNIT)
    # both values are rounded down to levels, so only differences this small are sure to collide
    p = erf((width / LEVELS_PER_UNIT) / sigma / sqrt(2))
    least = []
    for m in (FIRST, PROJECTIONS):
        lost, t = 0.0, 0
        while True:
            lost += comb(m, t) * p**t * (1 - p) ** (m - t)
            if lost > MISS:
                break
            t += 1
        least.append(t)
    return width, least[0], least[1]


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(5).standard_normal((dim, PROJECTIONS)).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by the largest component first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _first_projection(batches):
    for batch in batches:
        v = batch.column(1).to_pylist()
        p = [float((_unit(np.array([x], dtype=np.float64)) @ directions(len(x))[:, :1])[0, 0]) for x in v] if len({len(x) for x in v}) > 1 else (
            (_unit(_matrix(batch.column(1), len(v))) @ directions(len(v[0]))[:, 0]).tolist() if v else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(p, pa.float64())], names=["rep", "v", "copies", "dim", "p"])


def _cell_counts(batches, marks: np.ndarray):
    for batch in batches:
        cell, n = np.unique(np.searchsorted(marks, batch.column(0).to_numpy()), return_counts=True)
        yield pa.record_batch({"cell": pa.array(cell, pa.int32()), "n": pa.array(n, pa.int64())})


def _units(marks: np.ndarray, counts: dict, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every cell: its parts, the number of the first of them, and the range of parts within reach. Cells
    with more vectors than CELL, such as those of one value, are cut into parts by a hash."""
    low, high = np.append(-np.inf, marks), np.append(marks, np.inf)
    parts = np.array([max(1, ceil(counts.get(c, 0) / CELL)) for c in range(len(low))], dtype=np.int64)
    first = np.cumsum(parts) - parts
    near, far = np.searchsorted(high + reach, low), np.searchsorted(low - reach, high, side="right") - 1
    return parts, first, first[near], first[far] + parts[far] - 1


def _place(batches, marks: np.ndarray, units: tuple):
    parts, first, near, far = units
    for batch in batches:
        cell = np.searchsorted(marks, batch.column("p").to_numpy())
        part = mix(batch.column("rep").to_numpy().astype(np.uint64)) % parts[cell].astype(np.uint64)
        own = {"unit": first[cell] + part.astype(np.int64), "near": near[cell], "far": far[cell]}
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, own.values())], names=[*batch.schema.names, *own])


def _count_and_verify(table: pa.Table, cosine: float) -> pa.Table:
    """Two cells (or one with itself): links of their vectors, counted, and a forest over them."""
    width, least_first, least_all = windows(cosine)
    own = table.column("left").to_numpy()
    diagonal = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    rep, copies, p0 = table.column("rep").to_numpy(), table.column("copies").to_numpy(), table.column("p").to_numpy()
    unit = _unit(_matrix(table.column("v"), table.num_rows))
    levels = np.floor(unit @ directions(unit.shape[1]) * LEVELS_PER_UNIT).astype(np.int64).astype(np.uint8).T.copy()
    order = np.argsort(p0, kind="stable")
    a = order if diagonal else order[own[order]]
    b = order if diagonal else order[~own[order]]
    added = np.zeros(len(rep), dtype=np.int64)
    up = np.arange(len(rep))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    edge_a, edge_b = [], []
    reach = REACH * sqrt(2 - 2 * cosine)
    low = np.searchsorted(p0[b], p0[a] - reach, side="left")
    high = np.searchsorted(p0[b], p0[a] + reach, side="right")
    span = np.uint8(2 * width)
    for lo in range(0, len(a), 256):
        rows = a[lo : lo + 256]
        start = lo if diagonal else int(low[lo])
        stop = int(high[min(lo + 256, len(a)) - 1])
        for at in range(start, stop, 2048):
            cols = b[at : min(at + 2048, stop)]
            count = np.zeros((len(rows), len(cols)), dtype=np.uint8)
            for k in range(FIRST):
                count += (levels[k, rows][:, None] + np.uint8(width) - levels[k, cols][None, :]) <= span
            x, y = np.nonzero(count >= least_first)
            if diagonal:
                later = (at + y) > (lo + x)
                x, y = x[later], y[later]
            if not len(x):
                continue
            x, y = rows[x], cols[y]
            full = np.zeros(len(x), dtype=np.uint8)
            for k in range(PROJECTIONS):
                full += (levels[k, x] + np.uint8(width) - levels[k, y]) <= span
            x, y = x[full >= least_all], y[full >= least_all]
            for part in range(0, len(x), 1 << 16):
                xs, ys = x[part : part + (1 << 16)], y[part : part + (1 << 16)]
                near = np.einsum("ij,ij->i", unit[xs], unit[ys]) >= cosine
                xs, ys = xs[near], ys[near]
                np.add.at(added, xs, copies[ys])
                np.add.at(added, ys, copies[xs])
                for i, j in zip(xs.tolist(), ys.tolist(), strict=True):
                    i, j = root(i), root(j)
                    if i != j:
                        up[max(i, j)] = min(i, j)
                        edge_a.append(rep[i])
                        edge_b.append(rep[j])
    seen = np.flatnonzero(added)
    n, m = len(seen), len(edge_a)
    return pa.table({
        "rep": pa.array([*rep[seen].tolist(), *[None] * m], pa.int64()), "links": pa.array([*added[seen].tolist(), *[None] * m], pa.int64()),
        "a": pa.array([*[None] * n, *edge_a], pa.int64()), "b": pa.array([*[None] * n, *edge_b], pa.int64()),
    })


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal vectors are one representative with a number of copies. Representatives are projected on
    PROJECTIONS fixed random directions and cut into cells of about CELL vectors along the first, larger
    ones into parts. Parts of cells within reach of one another meet in a task, in the order of that projection: there a vector counts,
    for every one in its range, the projections on which the other lies in the window centred on it.
    Pairs whose count passes the threshold set for recall (see windows) are verified by their cosine in
    double precision. A task returns sums of links and a forest, never the pairs.

    Vectors that are null or empty, have null or non-finite components or are zero link with nothing and
    are kept; vectors of different lengths never link. Null ids are kept apart from all others, as
    unlinked; rows with the same id share its component, and count as links of one another if similar.
    An empty table gives no rows. Other columns are ignored."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("h1", F.when(F.col("good"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(1), "v")))
    reps = rows.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    flat = reps.select("rep", "v", "copies", F.size("v").alias("dim")).mapInArrow(_first_projection, "rep long, v array<double>, copies long, dim int, p double")
    flat = scratch(flat, "projected")
    total = flat.count()
    cells = max(1, ceil(total / CELL))
    marks = flat.select(F.percentile_approx("p", [i / cells for i in range(1, cells)], 100 * cells)).first()[0] if cells > 1 else []
    marks = np.array(sorted(set(marks or [])), dtype=np.float64)
    counted = flat.select("p").mapInArrow(partial(_cell_counts, marks=marks), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    units = _units(marks, {r["cell"]: r["n"] for r in counted}, REACH * sqrt(2 - 2 * cosine))
    placed = flat.mapInArrow(partial(_place, marks=marks, units=units), "rep long, v array<double>, copies long, dim int, p double, unit long, near long, far long")
    met = placed.withColumn("other", F.explode(F.sequence("near", "far")))
    met = met.select(F.least("unit", "other").alias("i"), F.greatest("unit", "other").alias("j"), (F.col("unit") <= F.col("other")).alias("left"), "rep", "v", "copies", "dim", "p")

    def compare(table: pa.Table) -> pa.Table:
        return _count_and_verify(table, cosine)

    found = met.groupBy("i", "j", "dim").applyInArrow(compare, "rep long, links long, a long, b long")
    found = scratch(found, "collisions")
    links = found.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    same_id = rows.where("good").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).where("vec_id <> rep").join(rows.groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1"), "vec_id", "left_semi")
    edges = found.where("a IS NOT NULL").select("a", "b").union(same_id.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    components = connected_components(edges, name="vectors")
    known = reps.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(components, F.col("rep") == components["node"], "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
