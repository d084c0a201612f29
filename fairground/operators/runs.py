"""Decisions that turn on runs of like rows: windows over a key's rows, no row-by-row code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def switches(rows: DataFrame, key: str, ts: str, tie: str, on: Column, off: Column, on_rows: int = 1, off_rows: int = 1, on_seconds: float = 0.0, off_seconds: float = 0.0) -> DataFrame:
    """key, ts, on: when a state that begins off turns, once `on` has held for so many rows in a row over so
    many seconds, and back once `off` has. on and off exclude one another; a row that is neither breaks
    a run; rows without a time are left out.

    A run can turn the state at one row only, its first with enough rows and seconds behind it; the state
    follows these rows, and turns where they change."""
    kind = F.when(on, 1).when(off, -1).otherwise(0)
    rows = rows.where(F.col(ts).isNotNull()).select(key, F.col(ts).alias("at"), F.col(tie).alias("tie"), kind.alias("kind"))
    by = W.partitionBy(key).orderBy("at", "tie")
    rows = rows.withColumn("begins", F.coalesce((F.lag("kind").over(by) != F.col("kind")), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("begins").over(by)).where("kind <> 0")
    within = W.partitionBy(key, "run").orderBy("at", "tie")
    rows = rows.withColumn("n", F.row_number().over(within)).withColumn("since", F.first("at").over(within))
    enough = F.when(F.col("kind") == 1, (F.col("n") >= on_rows) & (F.col("at") - F.col("since") >= on_seconds)).otherwise((F.col("n") >= off_rows) & (F.col("at") - F.col("since") >= off_seconds))
    turned = rows.where(enough).groupBy(key, "run").agg(F.min(F.struct("at", "tie", "kind")).alias("first"))
    before = F.lag("first.kind", 1, -1).over(W.partitionBy(key).orderBy("run"))
    return turned.withColumn("before", before).where("before <> first.kind").select(key, F.col("first.at").alias("ts"), (F.col("first.kind") == 1).alias("on"))


def clamped_count(rows: DataFrame, keys: list[str], order: list[str], up: Column) -> DataFrame:
    """rows with `count`: up by one where `up` holds, else down by one, never under zero."""
    by = W.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("sum", F.sum(F.when(up, 1).otherwise(-1)).over(by))
    return rows.withColumn("count", F.col("sum") - F.least(F.lit(0), F.min("sum").over(by))).drop("sum")


#: Seconds and rows looked back on for support, and the overlap that supports (fixed values).
BACK_SECONDS, BACK_ROWS, SUPPORT_IOU = 4.0, 12, 0.2


def supported(rows: DataFrame, keys: list[str], ts: str, tie: str, iou) -> DataFrame:
    """rows (with x1, y1, x2, y2) and `support`: how many of the key's last BACK_ROWS rows, of the last
    BACK_SECONDS, overlap this one. iou is a function of two boxes of columns."""
    box = F.struct(F.col(ts).alias("at"), "x1", "y1", "x2", "y2")
    back = F.collect_list(box).over(W.partitionBy(*keys).orderBy(ts, tie).rowsBetween(-BACK_ROWS, -1))
    own = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    near = F.filter("back", lambda h: (F.col(ts) - h["at"] <= BACK_SECONDS) & (iou((h["x1"], h["y1"], h["x2"], h["y2"]), own) >= SUPPORT_IOU))
    return rows.withColumn("back", back).withColumn("support", F.size(near)).drop("back")


#: Share of changed pixels, rows and seconds that turn presence on and off (fixed values).
ON, OFF = (0.12, 10, 0.6), (0.04, 12, 0.6)


def presence(rows: DataFrame, key: str, ts: str, tie: str, ratio: str) -> DataFrame:
    """key, ts, state: PRESENT or EMPTY, whenever it turns."""
    turned = switches(rows, key, ts, tie, F.col(ratio) >= ON[0], F.col(ratio) <= OFF[0], ON[1], OFF[1], ON[2], OFF[2])
    return turned.select(key, "ts", F.when(F.col("on"), "PRESENT").otherwise("EMPTY").alias("state"))


def hysteresis(rows: DataFrame, key: str, ts: str, tie: str, value: str, high: float, low: float, seconds: float) -> DataFrame:
    """key, ts, state: `paused` once the value was at or over high for so long, `resumed` once it was at
    or under low for so long."""
    turned = switches(rows, key, ts, tie, F.col(value) >= high, F.col(value) <= low, on_seconds=seconds, off_seconds=seconds)
    return turned.select(key, "ts", F.when(F.col("on"), "paused").otherwise("resumed").alias("state"))


#: Overlap that counts as contact, count of it and pixels of movement that confirm (fixed values).
CONTACT, CONTACT_COUNT, MOVED_PX = 0.02, 3, 15.0


def interactions(rows: DataFrame, tie: str) -> DataFrame:
    """rows: person, product, ts, tie, iou, cx, cy; status of every row. Contact counts up and down; with
    none left the product rests where it is, and how far it moved is measured from there."""
    keys = ["person", "product"]
    rows = clamped_count(rows, keys, ["ts", tie], F.col("iou") >= CONTACT)
    by = W.partitionBy(*keys).orderBy("ts", tie)
    rows = rows.withColumn("rests", F.sum((F.col("count") == 0).cast("int")).over(by))
    part = W.partitionBy(*keys, "rests").orderBy("ts", tie)
    moved = F.hypot(F.col("cx") - F.first("cx").over(part), F.col("cy") - F.first("cy").over(part))
    rows = rows.withColumn("apart", moved)
    rows = rows.withColumn("moved", F.max("apart").over(part))
    sure = (F.col("count") >= CONTACT_COUNT) & (F.col("moved") >= MOVED_PX)
    return rows.withColumn("status", F.when(sure, "CONFIRMED_INTERACTION").when(F.col("iou") >= CONTACT, "POSSIBLE_INTERACTION").otherwise("UNKNOWN"))


#: Box sizes in pixels of full and of least trust, least confidence and further rows at the latter (fixed values).
FULL_PX, LEAST_PX, FAR_CONFIDENCE, FAR_ROWS = 80.0, 24.0, 0.75, 2


def distance_penalty(px: Column) -> Column:
    """From 0 for boxes of full trust and of unknown size, to 1 at the smallest."""
    clipped = F.least(F.greatest(px, F.lit(LEAST_PX)), F.lit(FULL_PX))
    return F.coalesce(1 - (clipped - LEAST_PX) / (FULL_PX - LEAST_PX), F.lit(0.0))
