"""What runs along a key's rows, in pieces that tasks can share: walks between two bounds, the last row of another table, numbers
in a global order; and fits of all groups at once by sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.operators.folds import fold
from fairground.sources.shared import stored


def _within(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def clamped_walk(rows: DataFrame, key: str, ts: str, tie: str, step: Column, low: int, high: int, start: int, slot: float) -> DataFrame:
    """rows with `before` and `after`: a value that begins at start and goes by step, but never under low nor over high.

    A walk over some rows is x -> min(max(x + s, l), h), whatever they are, and so is one such walk after another. So
    the rows of a slot of time (so many seconds) are summed up as s, l, h, a key's few slots are walked through for where each begins,
    and then the slots are walked again side by side: a key with very many rows is spread by time. Rows without a time are left
    out; null steps stay."""
    names = rows.columns
    rows = rows.where(F.col(ts).isNotNull()).withColumn("slot_", F.floor(F.col(ts) / slot)).withColumn("d_", F.coalesce(step, F.lit(0)).cast("int"))
    per = rows.groupBy(key, "slot_").agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(tie).alias("tie"), F.col("d_").alias("d"), F.struct(*names).alias("row")))).alias("rows"))
    per = stored(per, "slots")
    lo, hi = F.lit(low), F.lit(high)
    walk = F.aggregate("rows", F.struct(F.lit(0).alias("s"), lo.alias("l"), hi.alias("h")), lambda f, r: F.struct((f["s"] + r["d"]).alias("s"), _within(f["l"] + r["d"], lo, hi).alias("l"), _within(f["h"] + r["d"], lo, hi).alias("h")))

    def onward(x: int, row: dict) -> tuple[int, list[dict]]:
        return min(max(x + row["s"], row["l"]), row["h"]), [{key: row[key], "slot_": row["slot_"], "x": x}]

    sums = per.select(key, "slot_", walk.alias("f")).select(key, "slot_", "f.*")
    kind = {"bigint": "long"}.get(dict(rows.dtypes)[key], dict(rows.dtypes)[key])
    begins = fold(sums, [key], ["slot_"], lambda: start, onward, f"{key} {kind}, slot_ long, x int")
    empty = F.array().cast("array<int>")
    seen = F.aggregate("rows", F.struct(F.col("x"), empty.alias("all")), lambda a, r: F.struct(_within(a["x"] + r["d"], lo, hi).alias("x"), F.concat(a["all"], F.array(_within(a["x"] + r["d"], lo, hi))).alias("all")))
    both = per.join(begins, [key, "slot_"]).withColumn("all", seen["all"])
    each = both.select("x", "all", F.posexplode("rows").alias("i", "r"))
    return each.select("r.row.*", F.when(F.col("i") > 0, F.get("all", F.col("i") - 1)).otherwise(F.col("x")).alias("before"), F.get("all", "i").alias("after"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, tie: str, slot: float) -> DataFrame:
    """left, with `found`: the row of right, as a struct, with the same key and the greatest time not after left's (of equal times the greatest
    tie), null if there is none. Both have key, ts and tie.

    Both tables are sorted together within slots of time; what no row of a slot answers is the last row of the slots before,
    one row a slot, so a key with very many rows is spread by time. Keys and times that are null find nothing."""
    where = lambda rows: F.floor(rows[ts] / slot).alias("slot")
    own = F.struct(*left.columns)
    other = right.where(F.col(ts).isNotNull() & F.col(key).isNotNull())
    a = left.select(left[key].alias("key"), where(left), left[ts].alias("t"), F.lit(1).alias("asks"), left[tie].alias("tie"), own.alias("own"), F.lit(None).cast(other.select(F.struct("*")).schema[0].dataType).alias("other"))
    b = other.select(other[key].alias("key"), where(other), other[ts].alias("t"), F.lit(0).alias("asks"), other[tie].alias("tie"), F.lit(None).cast(left.select(own).schema[0].dataType).alias("own"), F.struct(*other.columns).alias("other"))
    both = a.union(b)
    by = W.partitionBy("key", "slot").orderBy("t", "asks", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = both.withColumn("found", F.last("other", ignorenulls=True).over(by)).where("asks = 1")
    last = b.groupBy("key", "slot").agg(F.max_by("other", F.struct("t", "tie")).alias("last"))
    slots = a.select("key", "slot").distinct().join(last, ["key", "slot"], "full")
    carry = slots.withColumn("carried", F.last("last", ignorenulls=True).over(W.partitionBy("key").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.join(carry.select("key", "slot", "carried"), ["key", "slot"], "left")
    return rows.select("own.*", F.coalesce("found", "carried").alias("found"))


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """rows with their place, from 1, in the order of all: sorted by ranges, each range numbered by itself, and every range's number is
    moved on by how many rows come in the ranges before. No task sorts or counts more than a range."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range_").agg(F.count("*").alias("n"))
    firsts = counts.withColumn("first_", F.coalesce(F.sum("n").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("range_", "first_")  # a row a range
    local = ranged.withColumn("own_", F.row_number().over(W.partitionBy("range_").orderBy(*order)))
    return local.join(F.broadcast(firsts), "range_").withColumn(name, F.col("own_") + F.col("first_")).drop("range_", "own_", "first_")


#: Most that a decision point is moved, rows of each class that a group's own takes, and the ridge on the slope (fixed values).
MOST_BIAS, LEAST_ROWS, RIDGE = 2.0, 60, 1e-3


def fitted_bias(rows: DataFrame, group: str, score: str, truth: str, least: int = LEAST_ROWS) -> DataFrame:
    """group, bias, before, after, rounds: how far the decision point of each group is moved so that both classes are told equally well,
    and the balanced accuracy before and after; no farther than MOST_BIAS, and not at all if it doesn't help, if the score says nothing, or
    if a class has fewer than `least` rows.

    A logistic fit of slope and offset with both classes weighing the same, by Newton's method: a round is one sum over all rows, of all
    groups at once, of gradient and curvature; only these five sums a group come to the driver. Groups that have converged stay. Null scores, truths and
    groups are left out."""
    rows = stored(rows.select(F.col(group).alias("group_"), F.col(score).cast("double").alias("x"), F.col(truth).cast("boolean").alias("y")).where("group_ IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), "scores")
    spark = rows.sparkSession
    sizes = {r[0]: (r["yes"], r["no"]) for r in rows.groupBy("group_").agg(F.count_if("y").alias("yes"), F.count_if(~F.col("y")).alias("no")).collect()}
    fits = {g: [1.0, 0.0] for g, (yes, no) in sizes.items() if min(yes, no) >= max(least, 1)}
    moving, rounds, kind = set(fits), 0, dict(rows.dtypes)["group_"]
    while moving and rounds < 50:
        rounds += 1
        now = spark.createDataFrame([(g, *fits[g], 0.5 / sizes[g][0], 0.5 / sizes[g][1]) for g in sorted(moving)], f"group_ {kind}, a double, c double, wy double, wn double")
        z = _within(F.col("a") * F.col("x") + F.col("c"), F.lit(-30.0), F.lit(30.0))
        met = rows.join(F.broadcast(now), "group_").withColumn("p", 1 / (1 + F.exp(-z))).withColumn("w", F.when(F.col("y"), F.col("wy")).otherwise(F.col("wn")))
        met = met.withColumn("g", F.col("w") * (F.col("p") - F.col("y").cast("double"))).withColumn("r", F.col("w") * F.col("p") * (1 - F.col("p")) + 1e-12)
        sums = met.groupBy("group_").agg(*[F.sum(e).alias(f"s{i}") for i, e in enumerate((F.col("g") * F.col("x"), F.col("g"), F.col("r") * F.col("x") * F.col("x"), F.col("r") * F.col("x"), F.col("r")))])
        for name, gx, g, rxx, rx, r in sums.collect():
            a, c = fits[name]
            try:
                step = np.linalg.solve([[rxx + RIDGE, rx], [rx, r]], [gx + RIDGE * (a - 1), g])
            except np.linalg.LinAlgError:
                step = np.full(2, np.inf)
            fits[name] = [a - float(step[0]), c - float(step[1])]
            if not np.isfinite(fits[name]).all():
                fits[name] = [0.0, 0.0]  # it leads nowhere: the point isn't moved
            if fits[name] == [0.0, 0.0] or np.abs(step).max() < 1e-8:
                moving.discard(name)
    bias = {g: float(np.clip(c / a, -MOST_BIAS, MOST_BIAS)) if a > 1e-6 else 0.0 for g, (a, c) in fits.items()}
    moved = spark.createDataFrame([(g, bias.get(g, 0.0)) for g in sorted(sizes)], f"group_ {kind}, b double")
    rate = lambda told, own: F.coalesce(F.avg(F.when(own, told.cast("double"))), F.lit(0.0))
    balanced = lambda b: (rate(F.col("x") + b > 0, F.col("y")) + rate(F.col("x") + b <= 0, ~F.col("y"))) / 2
    found = rows.join(F.broadcast(moved), "group_").groupBy("group_").agg(F.first("b").alias("b"), balanced(F.lit(0.0)).alias("before"), balanced(F.col("b")).alias("then"))
    helps = F.col("then") >= F.col("before")
    return found.select(F.col("group_").alias(group), F.when(helps, F.col("b")).otherwise(0.0).alias("bias"), "before", F.when(helps, F.col("then")).otherwise(F.col("before")).alias("after"), F.lit(rounds).alias("rounds"))
