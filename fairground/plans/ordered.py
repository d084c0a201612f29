"""Order-dependent analytics (inventory ids N02-N13, T10, T22, Q32-Q35, Q43, Q44, W03, L09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.functions.scope import half_up
from fairground.operators.folds import throttle
from fairground.sources import bindings as B
from fairground.sources.bindings import CROSSING_SQL, EVENT_SQL, HEALTH_SQL, INTERACTION_SQL, POSITION_SQL

def _by_person():
    return W.partitionBy("person").orderBy("ts", "id")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.positions(spark, sf_dir)
    for c in ("x", "y", "ts"):
        rows = rows.withColumn(f"{c}0", F.lag(c).over(_by_person()))
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    return rows.withColumn("distance", F.sqrt(dx * dx + dy * dy)).withColumn("dt", F.greatest(F.col("ts") - F.col("ts0"), F.lit(0.001)))


def n02_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("id", "person", F.round(F.col("distance") / F.col("dt"), 6).alias("speed"))


def n03_path_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).groupBy("person").agg(F.round(F.coalesce(F.sum("distance"), F.lit(0.0)), 3).alias("distance"))


def n04_zones_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones in order, without rows outside of zones, repeats in a row as one."""
    zone = F.when(F.col("x") < 3, "A").when(F.col("x") < 6, "B").when(F.col("x") < 8, "C")
    rows = B.positions(spark, sf_dir).withColumn("zone", zone).where("zone IS NOT NULL")
    rows = rows.withColumn("before", F.lag("zone").over(_by_person())).where("before IS NULL OR before <> zone")
    path = F.transform(F.sort_array(F.collect_list(F.struct("ts", "id", "zone"))), lambda s: s["zone"])
    return rows.groupBy("person").agg(F.array_join(path, ">").alias("zones"), F.count("*").alias("n_zones"))


def n05_path_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = F.col("distance").isNull() | (F.col("distance") / F.col("dt") <= 0.05)
    return _steps(spark, sf_dir).groupBy("person").agg(F.every(fine).alias("consistent"), F.count_if(~fine).alias("jumps"))


def n06_dwell_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between two rows go to the later one's cell, unless they are too many."""
    rows = _steps(spark, sf_dir).withColumn("w", F.when((F.col("ts") > F.col("ts0")) & (F.col("ts") - F.col("ts0") < 3600), F.col("ts") - F.col("ts0")).otherwise(0.0))
    return rows.groupBy(F.col("x").cast("int").alias("col"), F.col("y").cast("int").alias("row")).agg(F.round(F.sum("w"), 3).alias("dwell_sec"))


def n09_visit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a person to a camera: rows within two hours of the one before extend the visit."""
    by = W.partitionBy("user_id", "camera_id").orderBy("ts", "event_id")
    rows = B.events(spark, sf_dir).withColumn("camera_id", F.col("k") % 3)
    rows = rows.withColumn("starts", F.coalesce(F.col("ts") - F.lag("ts").over(by) > 7200, F.lit(True)).cast("int"))
    rows = rows.withColumn("visit", F.sum("starts").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy("user_id", "camera_id", "visit").agg(F.round(F.min("ts"), 6).alias("first_seen"), F.round(F.max("ts"), 6).alias("last_seen"), F.count("*").alias("rows"))


def n10_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per second over the last hours of each user: (n - 1) / span."""
    near = W.partitionBy("user_id").orderBy("us").rangeBetween(-4 * 3_600_000_000, 0)
    rows = B.events(spark, sf_dir).withColumn("us", F.round(F.col("ts") * 1_000_000).cast("long"))
    rows = rows.withColumn("n", F.count("*").over(near)).withColumn("span", (F.max("us").over(near) - F.min("us").over(near)) / 1e6)
    return rows.select("event_id", F.when(F.col("span") > 0, F.round((F.col("n") - 1) / F.col("span"), 9)).otherwise(0.0).alias("rate"))


def n11_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the last 300 samples, whatever their age."""
    last = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-299, W.currentRow)
    return B.events(spark, sf_dir).select("event_id", F.round(F.avg("value").over(last), 10).alias("avg_latency"))


def n12_decayed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e = 0.95 e + x over a user's rows in order: the closed form with ranks counted from the end."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    rows = B.events(spark, sf_dir).withColumn("rank", rank)
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.pow(F.lit(0.95), F.col("rank"))), 4).alias("evidence"))


def n13_runner_up_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = B.events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("score"))
    by = W.partitionBy("user_id").orderBy(F.desc("score"), "event_type")
    rows = per.withColumn("next", F.lead("score").over(by)).withColumn("rank", F.row_number().over(by)).where("rank = 1")
    return rows.select("user_id", F.col("event_type").alias("best"), "score", F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6).alias("margin"))


def t10_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's rows at least six hours after the last one that was taken."""
    return throttle(B.events(spark, sf_dir).select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 21600.0).select("user_id", "event_id")


def t22_interest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look and dwell of a person near a target; dwell counts from the row before, near or not."""
    by = W.partitionBy("user_id", "target").orderBy("ts", "event_id")
    rows = B.events(spark, sf_dir).withColumn("target", F.col("k") % 5).withColumn("before", F.lag("ts").over(by)).where("value < 120")
    dwell = F.greatest(F.col("ts") - F.col("before"), F.lit(0.0))
    return rows.groupBy("user_id", "target").agg(F.round(F.max("ts") - F.min("ts"), 6).alias("look"), F.round(F.coalesce(F.sum(F.when(F.col("before").isNotNull(), dwell)), F.lit(0.0)), 3).alias("dwell"))


#: Midnight of the day that the hourly reports show.
DAY = 1704844800


def _hours(rows: DataFrame) -> DataFrame:
    """24 buckets from midnight, empty ones too."""
    bucket = F.floor((F.col("ts") - DAY) / 3600).cast("long")
    per = rows.where((F.col("ts") >= DAY) & (F.col("ts") < DAY + 86400)).groupBy(bucket.alias("hour")).agg(F.count("*").alias("n"))
    spine = rows.sparkSession.range(24).withColumnRenamed("id", "hour")
    return spine.join(per, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def q32_hour_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(B.interactions(spark, sf_dir))


def q33_hourly_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(B.crossings(spark, sf_dir).where("direction = 'in'"))


def q34_top8_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hold_events(spark, sf_dir, "product_name").groupBy("product_name").agg(F.count("*").alias("mover_count")).orderBy(F.desc("mover_count"), "product_name").limit(8)


def q35_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = B.events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return per.select("event_type", "n", half_up(F.col("n") * 100 / total).alias("percent"))


def q43_outage_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outages by component: from the first error after a good row to the next good row."""
    by = W.partitionBy("component").orderBy("ts", "id")
    rows = B.health_events(spark, sf_dir).withColumn("before", F.lag("status").over(by)).where("before IS NULL OR before <> status")
    rows = rows.withColumn("until", F.lead("ts").over(by)).where("status = 'error' AND until IS NOT NULL")
    return rows.groupBy("component").agg(F.count("*").alias("outages"), F.round(F.max_by(F.col("until") - F.col("ts"), F.struct("ts", "id")), 6).alias("last_recovery_sec"), F.round(F.avg(F.col("until") - F.col("ts")), 6).alias("avg_recovery_sec"))


def q44_health_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("component").orderBy("ts", "id")
    rows = B.health_events(spark, sf_dir).withColumn("before", F.lag("status").over(by)).where("before IS NULL OR before <> status")
    return rows.select("id", "component", "before", "status", F.when(F.col("status") == "error", "critical").otherwise("info").alias("severity"))


def w03_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By camera: rows taken, and rows dropped since their number isn't over the greatest before."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = B.events(spark, sf_dir).withColumn("most", F.max("k").over(by.rowsBetween(W.unboundedPreceding, -1)))
    taken = F.col("most").isNull() | (F.col("k") > F.col("most"))
    return rows.groupBy("user_id").agg(F.count_if(taken).alias("accepted"), F.count_if(~taken).alias("dropped"))


def w05_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users silent for a day at the end of the log."""
    per = B.events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last"))
    # one row, the end of the log, beside every user
    rows = per.join(F.broadcast(per.agg(F.max("last").alias("now"))))
    return rows.select("user_id", F.when(F.col("now") - F.col("last") > 86400, "OFFLINE").otherwise("ONLINE").alias("state"))


def l09_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.interactions(spark, sf_dir).select("ts", F.lit("interaction").alias("kind"), "id")
    b = B.health_events(spark, sf_dir).select("ts", F.lit("health").alias("kind"), "id")
    c = B.crossings(spark, sf_dir).select("ts", F.lit("crossing").alias("kind"), "id")
    return a.unionByName(b).unionByName(c).orderBy(F.desc("ts"), F.desc("id"), "kind").limit(300).select(F.round("ts", 6).alias("ts"), "kind", "id")


QUERIES = {f.__name__: f for f in (
    n02_speed, n03_path_distance, n04_zones_visited, n05_path_consistency, n06_dwell_weight, n09_visit_merge, n10_rate, n11_latency, n12_decayed_evidence, n13_runner_up_margin, t10_throttle, t22_interest_sessions,
    q32_hour_buckets, q33_hourly_entries, q34_top8_products, q35_percentages, q43_outage_recovery, q44_health_transitions, w03_out_of_order, w05_stale, l09_timeline,
)}

_OVER = "OVER (PARTITION BY person ORDER BY ts, id)"
_STEPS = f"SELECT *, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) AS distance, greatest(ts - ts0, 0.001) AS dt FROM (SELECT *, lag(x) {_OVER} AS x0, lag(y) {_OVER} AS y0, lag(ts) {_OVER} AS ts0 FROM ({POSITION_SQL}))"
_USER = "PARTITION BY user_id ORDER BY ts, event_id"
_COMPONENT = "PARTITION BY component ORDER BY ts, id"
_CHANGES = f"SELECT * FROM (SELECT *, lag(status) OVER ({_COMPONENT}) AS before FROM ({HEALTH_SQL})) WHERE before IS NULL OR before <> status"


def _hours_sql(rows: str) -> str:
    return f"""SELECT h.hour, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN (SELECT floor((ts - {DAY}) / 3600)::BIGINT AS hour, count(*) AS n
  FROM ({rows}) WHERE ts >= {DAY} AND ts < {DAY} + 86400 GROUP BY 1) USING (hour)"""


ORACLE_SQL = {
    "n02_speed": f"SELECT id, person, round(distance / dt, 6) AS speed FROM ({_STEPS})",
    "n03_path_distance": f"SELECT person, round(coalesce(sum(distance), 0), 3) AS distance FROM ({_STEPS}) GROUP BY 1",
    "n04_zones_visited": f"""WITH z AS (SELECT *, CASE WHEN x < 3 THEN 'A' WHEN x < 6 THEN 'B' WHEN x < 8 THEN 'C' END AS zone FROM ({POSITION_SQL})), c AS (SELECT *, lag(zone) {_OVER} AS before FROM z WHERE zone IS NOT NULL)
  SELECT person, string_agg(zone, '>' ORDER BY ts, id) AS zones, count(*)::BIGINT AS n_zones FROM c WHERE before IS NULL OR before <> zone GROUP BY 1""",
    "n05_path_consistency": f"SELECT person, bool_and(coalesce(distance / dt <= 0.05, true)) AS consistent, count(*) FILTER (distance / dt > 0.05)::BIGINT AS jumps FROM ({_STEPS}) GROUP BY 1",
    "n06_dwell_weight": f"SELECT trunc(x)::INT AS col, trunc(y)::INT AS row, round(sum(CASE WHEN ts > ts0 AND ts - ts0 < 3600 THEN ts - ts0 ELSE 0 END), 3) AS dwell_sec FROM ({_STEPS}) GROUP BY 1, 2",
    "n09_visit_merge": f"""WITH e AS (SELECT *, k % 3 AS camera_id FROM ({EVENT_SQL})), s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 7200 THEN 0 ELSE 1 END AS starts FROM e WINDOW w AS (PARTITION BY user_id, camera_id ORDER BY ts, event_id)),
  v AS (SELECT *, sum(starts) OVER (PARTITION BY user_id, camera_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM s)
  SELECT user_id, camera_id, visit::BIGINT AS visit, round(min(ts), 6) AS first_seen, round(max(ts), 6) AS last_seen, count(*)::BIGINT AS rows FROM v GROUP BY 1, 2, 3""",
    "n10_rate": f"""WITH e AS (SELECT *, round(ts * 1000000)::BIGINT AS us FROM ({EVENT_SQL})), w AS (SELECT *, count(*) OVER r AS n, (max(us) OVER r - min(us) OVER r) / 1e6 AS span FROM e
  WINDOW r AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 14400000000 PRECEDING AND CURRENT ROW)) SELECT event_id, CASE WHEN span > 0 THEN round((n - 1) / span, 9) ELSE 0 END AS rate FROM w""",
    "n11_latency": f"SELECT event_id, round(avg(value) OVER ({_USER} ROWS 299 PRECEDING), 10) AS avg_latency FROM ({EVENT_SQL})",
    "n12_decayed_evidence": f"SELECT user_id, round(sum(value * pow(0.95, rank)), 4) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS rank FROM ({EVENT_SQL})) GROUP BY 1",
    "n13_runner_up_margin": f"""WITH p AS (SELECT user_id, event_type, round(sum(value), 6) AS score FROM ({EVENT_SQL}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM p
  WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_type)) SELECT user_id, event_type AS best, score, round(score - coalesce(next, 0), 6) AS margin FROM r WHERE rank = 1""",
    "t10_throttle": f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER ({_USER}) AS i FROM ({EVENT_SQL})), t AS (SELECT user_id, i, event_id, ts AS taken_at, true AS taken FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN e.ts - taken_at >= 21600 THEN e.ts ELSE taken_at END, e.ts - taken_at >= 21600 FROM t JOIN e ON e.user_id = t.user_id AND e.i = t.i + 1)
  SELECT user_id, event_id FROM t WHERE taken""",
    "t22_interest_sessions": f"""WITH e AS (SELECT *, k % 5 AS target FROM ({EVENT_SQL})), b AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, target ORDER BY ts, event_id) AS before FROM e)
  SELECT user_id, target, round(max(ts) - min(ts), 6) AS look, round(coalesce(sum(greatest(ts - before, 0)) FILTER (before IS NOT NULL), 0), 3) AS dwell FROM b WHERE value < 120 GROUP BY 1, 2""",
    "q32_hour_buckets": _hours_sql(INTERACTION_SQL),
    "q33_hourly_entries": _hours_sql(f"SELECT * FROM ({CROSSING_SQL}) WHERE direction = 'in'"),
    "q34_top8_products": f"SELECT product_name, count(*)::BIGINT AS mover_count FROM ({B.HOLD_SQL}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    "q35_percentages": f"SELECT event_type, count(*)::BIGINT AS n, floor(count(*) * 100.0 / (SELECT count(*) FROM events) + 0.5)::BIGINT AS percent FROM ({EVENT_SQL}) GROUP BY 1",
    "q43_outage_recovery": f"""SELECT component, count(*)::BIGINT AS outages, round(arg_max(until - ts, (ts, id)), 6) AS last_recovery_sec, round(avg(until - ts), 6) AS avg_recovery_sec
  FROM (SELECT *, lead(ts) OVER ({_COMPONENT}) AS until FROM ({_CHANGES})) WHERE status = 'error' AND until IS NOT NULL GROUP BY 1""",
    "q44_health_transitions": f"SELECT id, component, before, status, CASE status WHEN 'error' THEN 'critical' ELSE 'info' END AS severity FROM ({_CHANGES})",
    "w03_out_of_order": f"""SELECT user_id, count(*) FILTER (most IS NULL OR k > most)::BIGINT AS accepted, count(*) FILTER (k <= most)::BIGINT AS dropped
  FROM (SELECT *, max(k) OVER ({_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM ({EVENT_SQL})) GROUP BY 1""",
    "w05_stale": f"SELECT user_id, CASE WHEN (SELECT max(ts) FROM ({EVENT_SQL})) - max(ts) > 86400 THEN 'OFFLINE' ELSE 'ONLINE' END AS state FROM ({EVENT_SQL}) GROUP BY 1",
    "l09_timeline": f"""SELECT round(ts, 6) AS ts, kind, id FROM (SELECT ts, 'interaction' AS kind, id FROM ({INTERACTION_SQL}) UNION ALL SELECT ts, 'health', id FROM ({HEALTH_SQL})
  UNION ALL SELECT ts, 'crossing', id FROM ({CROSSING_SQL})) ORDER BY ts DESC, id DESC, kind LIMIT 300""",
}
