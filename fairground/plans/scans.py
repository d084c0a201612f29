"""Walks, as-of joins, fits and numbers in order over whole logs (inventory ids T31, J23, E05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.operators import scans
from fairground.sources import bindings as B
from fairground.sources.bindings import EVENT_SQL

#: Every so many frames are looked at, at least and at most; sides of the picture, the largest first (fixed values).
FRAMES, SIDES = (1, 5), (640, 480, 320)
#: Seconds of a slot: a day.
DAY = 86400.0


def t31_step_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera that can't keep up looks at fewer frames first and then at smaller ones, a step a tick, and goes back the other way
    round; it is degraded if it can't keep up and has no step left. One lever after the other is one walk."""
    rows = B.events(spark, sf_dir).withColumn("overloaded", (F.col("value") > 25) | (F.col("event_type") == "error"))
    steps = FRAMES[1] - FRAMES[0]
    walked = scans.clamped_walk(rows.select("user_id", "ts", "event_id", "overloaded"), "user_id", "ts", "event_id", F.when(F.col("overloaded"), 1).otherwise(-1), 0, steps + len(SIDES) - 1, 0, DAY)
    side = F.get(F.array(*map(F.lit, SIDES)), F.greatest(F.lit(0), F.col("after") - steps))
    degraded = F.col("overloaded") & (F.col("before") == steps + len(SIDES) - 1)
    return walked.select("user_id", "event_id", (F.least(F.lit(steps), "after") + FRAMES[0]).alias("every"), side.alias("side"), degraded.alias("degraded"))


def j23_last_sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings with where their person was seen last before."""
    crossings = B.crossings(spark, sf_dir).select("id", F.col("track_id").alias("person"), "ts", "direction")
    seen = B.events(spark, sf_dir).where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("person"), "ts", "k")
    rows = scans.as_of(crossings, seen, "person", "ts", "id", DAY)
    return rows.select("id", "direction", F.col("found.id").alias("sighting"), F.col("found.k").alias("place"), F.round(F.col("ts") - F.col("found.ts"), 6).alias("seconds"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of five sizes, told by a score that leans to one side, the more so the smaller they are."""
    lean = F.log1p("value") - 3 + F.when(F.col("user_id") % 2 == 0, 0.5).otherwise(-0.5) + (F.col("k") % 5 - 3) / 2
    return B.events(spark, sf_dir).select((F.col("k") % 5).alias("bucket"), F.round(lean, 9).alias("score"), (F.col("user_id") % 2 == 0).alias("female"))


def e05_fitted_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.fitted_bias(_scores(spark, sf_dir), "bucket", "score", "female")
    return found.select("bucket", *[F.round(c, 6).alias(c) for c in ("bias", "before", "after")])


QUERIES = {f.__name__: f for f in (t31_step_controller, j23_last_sighting, e05_fitted_bias)}

_S = f"(SELECT k % 5 AS bucket, round(ln(1 + value) - 3 + CASE WHEN user_id % 2 = 0 THEN 0.5 ELSE -0.5 END::DOUBLE + (k % 5 - 3) / 2, 9) AS x, user_id % 2 = 0 AS y FROM ({EVENT_SQL}))"
_TOP = FRAMES[1] - FRAMES[0] + len(SIDES) - 1
ORACLE_SQL = {
    "t31_step_controller": f"""WITH RECURSIVE r AS (SELECT user_id, event_id, value > 25 OR event_type = 'error' AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ({EVENT_SQL})),
  w AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS i, 0 AS x, false AS degraded FROM r UNION ALL
    SELECT r.user_id, r.event_id, r.i, CASE WHEN o THEN least(x + 1, {_TOP}) ELSE greatest(x - 1, 0) END, o AND x = {_TOP} FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1)
  SELECT user_id, event_id, (least({FRAMES[1] - FRAMES[0]}, x) + {FRAMES[0]})::INT AS every, {list(SIDES)}[greatest(0, x - {FRAMES[1] - FRAMES[0]}) + 1]::INT AS side, degraded FROM w WHERE i > 0""",
    "j23_last_sighting": f"""WITH c AS (SELECT event_id AS id, user_id, ts, CASE event_type WHEN 'signup' THEN 'in' ELSE 'out' END AS direction FROM ({EVENT_SQL}) WHERE event_type IN ('signup', 'purchase')), s AS (SELECT * FROM ({EVENT_SQL}) WHERE event_type = 'view')
  SELECT c.id, direction, s.event_id AS sighting, s.k AS place, round(c.ts - s.ts, 6) AS seconds FROM c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.ts >= s.ts""",
    "e05_fitted_bias": f"""WITH RECURSIVE n AS (SELECT bucket, count(*) FILTER (y) AS yes, count(*) FILTER (NOT y) AS no FROM {_S} GROUP BY 1), d AS (SELECT s.*, CASE WHEN y THEN 0.5::DOUBLE / yes ELSE 0.5::DOUBLE / no END AS w FROM {_S} s JOIN n USING (bucket) WHERE least(yes, no) >= {scans.LEAST_ROWS}),
  f AS (SELECT DISTINCT bucket, 0 AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS c FROM d UNION ALL
    SELECT bucket, i + 1, a - (r * gx - rx * g) / (rxx * r - rx * rx), c - (rxx * g - rx * gx) / (rxx * r - rx * rx) FROM (
      SELECT bucket, i, a, c, sum(w * (p - y::INT) * x) + {scans.RIDGE}::DOUBLE * (a - 1) AS gx, sum(w * (p - y::INT)) AS g, sum(q * x * x) + {scans.RIDGE}::DOUBLE AS rxx, sum(q * x) AS rx, sum(q) AS r FROM (
        SELECT *, w * p * (1 - p) + 1e-12 AS q FROM (SELECT f.bucket, i, a, c, x, y, w, 1 / (1 + exp(-least(30.0::DOUBLE, greatest(-30.0::DOUBLE, a * x + c)))) AS p FROM f JOIN d ON d.bucket = f.bucket WHERE i < 25)) GROUP BY bucket, i, a, c)),
  b AS (SELECT n.bucket, coalesce(least(2.0::DOUBLE, greatest(-2.0::DOUBLE, c / CASE WHEN a > 1e-6 THEN a END)), 0.0::DOUBLE) AS b FROM n LEFT JOIN f ON f.bucket = n.bucket AND i = 25),
  h AS (SELECT bucket, any_value(b) AS b, (coalesce(avg((x > 0)::INT) FILTER (y), 0) + coalesce(avg((x <= 0)::INT) FILTER (NOT y), 0)) / 2 AS before, (coalesce(avg((x + b > 0)::INT) FILTER (y), 0) + coalesce(avg((x + b <= 0)::INT) FILTER (NOT y), 0)) / 2 AS after FROM {_S} JOIN b USING (bucket) GROUP BY bucket)
  SELECT bucket, round(CASE WHEN after >= before THEN b ELSE 0 END, 6) AS bias, round(before, 6) AS before, round(greatest(after, before), 6) AS after FROM h""",
}
