"""Booth analytics (inventory ids Q01-Q22, J01, J06-J08) over the views of fairground.sources.bindings.

Q01 to Q13 take a scope: event_id, booth_id, camera_id and date (a local day), each of which may be left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.functions.scope import local_day, not_merged
from fairground.operators.balance import running_balance
from fairground.sources import bindings as B
from fairground.sources.bindings import CROSSING_SQL, HEALTH_SQL, HOLD_SQL, INTERACTION_SQL, PERSON_SQL, hold_events, table


def q01_summary(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    """Four figures of one row; each side is reduced to one row before they meet."""
    seen, health = B.interactions(spark, sf_dir, **where), B.health_events(spark, sf_dir, **where)
    a = seen.agg(F.count("*").alias("total_interactions"), F.countDistinct("product_name").alias("unique_products"))
    b = health.agg(F.count_if(F.col("status") == "error").alias("open_alerts"))
    c = seen.select("booth_id").union(health.select("booth_id")).distinct().agg(F.count("*").alias("active_booths"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(a).join(one(b), "one").join(one(c), "one").drop("one")


def q02_top_products(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    return B.interactions(spark, sf_dir, **where).groupBy("product_name").agg(F.count("*").alias("interactions")).orderBy(F.desc("interactions"), "product_name").limit(10)


def _interest(holds: DataFrame, *keys: str) -> DataFrame:
    return holds.groupBy(*keys).agg(F.count("*").alias("mover_count"), F.round(F.sum("duration_sec"), 6).alias("total_duration_sec"), F.countDistinct("global_person_id").alias("unique_people"))


def q03_product_movers(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    return _interest(hold_events(spark, sf_dir, "product_name", "duration_sec", "global_person_id", **where), "product_name").orderBy(F.desc("mover_count"), "product_name").limit(10)


def q04_interest_summary(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    """By key and name: a product that was renamed comes as two rows."""
    return _interest(hold_events(spark, sf_dir, "product_key", "product_name", "duration_sec", "global_person_id", **where), "product_key", "product_name")


def _matrix(holds: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts by product, one column for each value, the last for all without one; other values come
    as a map."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(values[-1]))
    per = holds.groupBy("product_key", value.alias("value")).agg(F.count("*").alias("n"), F.min("product_name").alias("name"))
    counts = [F.coalesce(F.sum(F.when(F.col("value") == v, F.col("n"))), F.lit(0)).alias(v.lower()) for v in values]
    other = F.map_from_entries(F.sort_array(F.collect_list(F.when(~F.col("value").isin(values), F.struct("value", "n")))))
    return per.groupBy("product_key").agg(F.min("name").alias("product_name"), *counts, F.to_json(other).alias("other"))


def q05_gender_matrix(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    return _matrix(hold_events(spark, sf_dir, "product_key", "product_name", "gender", **where), "gender", ["MALE", "FEMALE", "UNKNOWN"]).drop("other")


def q06_age_matrix(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    return _matrix(hold_events(spark, sf_dir, "product_key", "product_name", "age_category", **where), "age_category", ["CHILD", "ADULT", "UNKNOWN"]).drop("other")


def q07_gender_totals(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    known = F.col("gender").isin("MALE", "FEMALE")
    return hold_events(spark, sf_dir, "gender", **where).agg(F.count_if(F.col("gender") == "MALE").alias("male"), F.count_if(F.col("gender") == "FEMALE").alias("female"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"))


def q08_age_totals(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    known = F.col("age_category").isin("CHILD", "ADULT")
    return hold_events(spark, sf_dir, "age_category", **where).agg(F.count_if(F.col("age_category") == "CHILD").alias("child"), F.count_if(F.col("age_category") == "ADULT").alias("adult"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"))


def q09_interest_overview(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    return hold_events(spark, sf_dir, "global_person_id", **where).agg(F.count("*").alias("total_events"), F.countDistinct("global_person_id").alias("unique_people"))


def q10_presence_stats(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    d = F.col("duration_sec").cast("double")
    return hold_events(spark, sf_dir, "duration_sec", **where).agg(F.count("*").alias("sessions"), zero(F.avg(d)).alias("avg_sec"), zero(F.min(d)).alias("min_sec"), zero(F.max(d)).alias("max_sec"))


def q11_presence_breakdown(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    c = F.lower("age_category")
    known = F.coalesce(c.isin("child", "adult", "staff"), F.lit(False))
    return hold_events(spark, sf_dir, "age_category", **where).agg(*[F.count_if(c == k).alias(k) for k in ("child", "adult", "staff")], F.count_if(~known).alias("unknown"))


def q12_tripwire_stats(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    """By booth: totals, who is inside by the totals, the peak of a balance that never falls below 0."""
    rows = running_balance(B.crossings(spark, sf_dir, **where), ["booth_id"])
    per = rows.groupBy("booth_id").agg(F.count_if(F.col("delta") > 0).alias("total_in"), F.count_if(F.col("delta") < 0).alias("total_out"), F.greatest(F.max("balance"), F.lit(0)).cast("long").alias("peak_inside"))
    return per.withColumn("current_inside", F.greatest(F.col("total_in") - F.col("total_out"), F.lit(0)))


def visits(crossings: DataFrame) -> DataFrame:
    """track_id, entered_at, exited_at: an entry opens a visit, the next exit closes it; further entries
    and exits with nothing open are passed over."""
    by = W.partitionBy("track_id").orderBy("ts", "id")
    before = F.lag("direction").over(by)
    edges = crossings.withColumn("before", before).where(((F.col("direction") == "in") & (F.coalesce("before", F.lit("out")) == "out")) | ((F.col("direction") == "out") & (F.col("before") == "in")))
    edges = edges.withColumn("exited_at", F.lead("ts").over(by)).where("direction = 'in'")
    return edges.select("track_id", "booth_id", F.col("ts").alias("entered_at"), "exited_at")


def t03_booth_sessions(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    out = visits(B.crossings(spark, sf_dir, **where))
    return out.select("track_id", F.round("entered_at", 6).alias("entered_at"), F.round("exited_at", 6).alias("exited_at"), F.round(F.col("exited_at") - F.col("entered_at"), 6).alias("dwell_seconds"), F.when(F.col("exited_at").isNull(), "active").otherwise("closed").alias("status"))


def q13_session_stats(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    rows = visits(B.crossings(spark, sf_dir, **where)).withColumn("dwell", F.col("exited_at") - F.col("entered_at"))
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return rows.agg(F.count("*").alias("sessions"), F.count_if(F.col("exited_at").isNull()).alias("active"), zero(F.avg("dwell")).alias("avg_dwell"), zero(F.min("dwell")).alias("min_dwell"), zero(F.max("dwell")).alias("max_dwell"))


def q14_unique_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.persons(spark, sf_dir).where(not_merged("global_id")).agg(F.count("*").alias("unique_people"))


def q15_attribute_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.persons(spark, sf_dir).where(not_merged("global_id")).select(F.explode(F.array(F.struct(F.lit("gender").alias("attribute"), F.col("gender").alias("value")), F.struct(F.lit("age").alias("attribute"), F.coalesce("age_category", F.lit("UNKNOWN")).alias("value")))).alias("x"))
    return rows.groupBy("x.attribute", "x.value").agg(F.count("*").alias("people"))


def _scoped(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [B.interactions(spark, sf_dir).select("booth_id", "ts"), B.health_events(spark, sf_dir).select("booth_id", "ts"), B.crossings(spark, sf_dir).select("booth_id", "ts"), hold_events(spark, sf_dir, "booth_id", "ts").select(F.col("booth_id").cast("long"), "ts")]


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """booth_id and day of every table, distinct within each first."""
    found = None
    for rows in _scoped(spark, sf_dir):
        own = rows.where("booth_id IS NOT NULL AND ts IS NOT NULL").select("booth_id", local_day("ts").alias("day")).distinct()
        found = own if found is None else found.union(own)
    return found.distinct()


def q16_available_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("day").distinct().orderBy(F.desc("day"))


def q17_known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("booth_id").distinct().orderBy("booth_id")


def q18_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type IS NOT NULL AND event_type <> ''").select("event_type").distinct().orderBy("event_type")


def q19_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booth and day, with the booth's name where it is registered, else its id."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("booth_id"), "n_name")
    rows = _days(spark, sf_dir).join(names, "booth_id", "left")
    return rows.select("day", "booth_id", F.coalesce("n_name", F.col("booth_id").cast("string")).alias("booth_name"))


def q20_daily_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day any table knows, with that day's figures; the balance starts anew each day."""
    day = local_day("ts").alias("day")
    seen = B.interactions(spark, sf_dir).groupBy(day).agg(F.count("*").alias("interactions"))
    health = B.health_events(spark, sf_dir).groupBy(day).agg(F.count_if(F.col("status") == "error").alias("alerts"))
    crossed = running_balance(B.crossings(spark, sf_dir).withColumn("day", day), ["day"]).groupBy("day").agg(F.count_if(F.col("delta") > 0).alias("total_in"), F.greatest(F.max("balance"), F.lit(0)).cast("long").alias("peak_inside"))
    out = _days(spark, sf_dir).select("day").distinct()
    for part in (seen, health, crossed):
        out = out.join(part, "day", "left")
    return out.fillna(0).orderBy("day")


def q21_count_booths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").agg(F.count("*").alias("booths"))


def q22_events_with_booths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("booth_count"))
    rows = table(spark, sf_dir, "region").join(counts, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.select(F.col("r_name").alias("event_name"), F.coalesce("booth_count", F.lit(0)).alias("booth_count"))


def j01_booths_with_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "nation").join(events, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select(F.col("n_nationkey").alias("booth_id"), F.col("n_name").alias("booth_name"), F.col("r_name").alias("event_name")).orderBy("booth_name")


def j06_no_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that nobody has held for long."""
    held = hold_events(spark, sf_dir, "product_key", "duration_sec").where("duration_sec > 49").select("product_key")
    return table(spark, sf_dir, "part").join(held, F.col("p_partkey") == F.col("product_key"), "left_anti").select(F.col("p_partkey").alias("product_key"), F.col("p_name").alias("product_name"))


def j10_camera_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras that are live or counted, with both figures; a counter has the number of another camera here,
    so that some are only the one or the other."""
    live = B.interactions(spark, sf_dir).groupBy(F.col("booth_id").alias("camera_id")).agg(F.max("ts").alias("last_seen"))
    counted = B.crossings(spark, sf_dir).groupBy((F.col("booth_id") + 3).alias("camera_id")).agg(F.count("*").alias("crossings"))
    return live.join(counted, "camera_id", "full").select("camera_id", F.round("last_seen", 6).alias("last_seen"), F.coalesce("crossings", F.lit(0)).alias("crossings"))


def l01_newest_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.interactions(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).limit(200).select("id", "product_name", "booth_id", F.round("ts", 6).alias("ts"))


def l02_oldest_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.crossings(spark, sf_dir).orderBy("ts", "id").limit(2000).select("id", "direction", F.round("ts", 6).alias("ts"))


QUERIES = {f.__name__: f for f in (
    q01_summary, q02_top_products, q03_product_movers, q04_interest_summary, q05_gender_matrix, q06_age_matrix, q07_gender_totals, q08_age_totals, q09_interest_overview, q10_presence_stats, q11_presence_breakdown,
    q12_tripwire_stats, t03_booth_sessions, q13_session_stats, q14_unique_people, q15_attribute_breakdown, q16_available_dates, q17_known_ids, q18_distinct, q19_event_sessions, q20_daily_breakdown, q21_count_booths,
    q22_events_with_booths, j01_booths_with_event, j06_no_interest, j10_camera_union, l01_newest_interactions, l02_oldest_crossings,
)}

_MOVERS = "count(*)::BIGINT AS mover_count, round(sum(duration_sec), 6) AS total_duration_sec, count(DISTINCT global_person_id)::BIGINT AS unique_people"
_ISO = "strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d')"
_DAYS = f"""SELECT DISTINCT booth_id::BIGINT AS booth_id, {_ISO} AS day FROM (SELECT booth_id, ts FROM ({INTERACTION_SQL})
  UNION ALL SELECT booth_id, ts FROM ({HEALTH_SQL}) UNION ALL SELECT booth_id, ts FROM ({CROSSING_SQL}) UNION ALL SELECT booth_id, ts FROM ({HOLD_SQL}))"""
_VISITS = f"""SELECT track_id, ts AS entered_at, exited_at FROM (SELECT *, lead(ts) OVER (PARTITION BY track_id ORDER BY ts, id) AS exited_at FROM (
  SELECT *, lag(direction) OVER (PARTITION BY track_id ORDER BY ts, id) AS before FROM ({CROSSING_SQL}))
  WHERE (direction = 'in' AND coalesce(before, 'out') = 'out') OR (direction = 'out' AND before = 'in')) WHERE direction = 'in'"""


def _balance(by: str, rows: str) -> str:
    return f"""SELECT *, s - least(0, min(s) OVER (PARTITION BY {by} ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) AS balance FROM (
  SELECT *, sum(delta) OVER (PARTITION BY {by} ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE direction WHEN 'in' THEN 1 ELSE -1 END AS delta FROM ({rows})))"""


def _matrix_sql(column: str, values: list[str]) -> str:
    counts = ", ".join(f"count(*) FILTER (coalesce({column}, '{values[-1]}') = '{v}')::BIGINT AS {v.lower()}" for v in values)
    return f"SELECT product_key, min(product_name) AS product_name, {counts} FROM ({HOLD_SQL}) GROUP BY product_key"


ORACLE_SQL = {
    "q01_summary": f"""SELECT (SELECT count(*) FROM ({INTERACTION_SQL}))::BIGINT AS total_interactions, (SELECT count(DISTINCT product_name) FROM ({INTERACTION_SQL}))::BIGINT AS unique_products,
  (SELECT count(*) FROM ({HEALTH_SQL}) WHERE status = 'error')::BIGINT AS open_alerts,
  (SELECT count(*) FROM (SELECT booth_id FROM ({INTERACTION_SQL}) UNION SELECT booth_id FROM ({HEALTH_SQL})))::BIGINT AS active_booths""",
    "q02_top_products": f"SELECT product_name, count(*)::BIGINT AS interactions FROM ({INTERACTION_SQL}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "q03_product_movers": f"SELECT product_name, {_MOVERS} FROM ({HOLD_SQL}) GROUP BY product_name ORDER BY mover_count DESC, product_name LIMIT 10",
    "q04_interest_summary": f"SELECT product_key, product_name, {_MOVERS} FROM ({HOLD_SQL}) GROUP BY product_key, product_name",
    "q05_gender_matrix": _matrix_sql("gender", ["MALE", "FEMALE", "UNKNOWN"]),
    "q06_age_matrix": _matrix_sql("age_category", ["CHILD", "ADULT", "UNKNOWN"]),
    "q07_gender_totals": f"SELECT count(*) FILTER (gender = 'MALE')::BIGINT AS male, count(*) FILTER (gender = 'FEMALE')::BIGINT AS female, count(*) FILTER (gender IS NULL)::BIGINT AS unknown FROM ({HOLD_SQL})",
    "q08_age_totals": f"SELECT count(*) FILTER (age_category = 'CHILD')::BIGINT AS child, count(*) FILTER (age_category = 'ADULT')::BIGINT AS adult, count(*) FILTER (age_category IS NULL)::BIGINT AS unknown FROM ({HOLD_SQL})",
    "q09_interest_overview": f"SELECT count(*)::BIGINT AS total_events, count(DISTINCT global_person_id)::BIGINT AS unique_people FROM ({HOLD_SQL})",
    "q10_presence_stats": f"SELECT count(*)::BIGINT AS sessions, round(avg(duration_sec), 6) AS avg_sec, min(duration_sec)::DOUBLE AS min_sec, max(duration_sec)::DOUBLE AS max_sec FROM ({HOLD_SQL})",
    "q11_presence_breakdown": f"SELECT count(*) FILTER (age_category = 'CHILD')::BIGINT AS child, count(*) FILTER (age_category = 'ADULT')::BIGINT AS adult, 0::BIGINT AS staff, count(*) FILTER (age_category IS NULL)::BIGINT AS unknown FROM ({HOLD_SQL})",
    "q12_tripwire_stats": f"""SELECT booth_id, count(*) FILTER (delta > 0)::BIGINT AS total_in, count(*) FILTER (delta < 0)::BIGINT AS total_out, greatest(max(balance), 0)::BIGINT AS peak_inside,
  greatest(sum(delta), 0)::BIGINT AS current_inside FROM ({_balance('booth_id', CROSSING_SQL)}) GROUP BY booth_id""",
    "t03_booth_sessions": f"""SELECT track_id, round(entered_at, 6) AS entered_at, round(exited_at, 6) AS exited_at, round(exited_at - entered_at, 6) AS dwell_seconds,
  CASE WHEN exited_at IS NULL THEN 'active' ELSE 'closed' END AS status FROM ({_VISITS})""",
    "q13_session_stats": f"""SELECT count(*)::BIGINT AS sessions, count(*) FILTER (exited_at IS NULL)::BIGINT AS active, coalesce(round(avg(exited_at - entered_at), 6), 0) AS avg_dwell,
  coalesce(round(min(exited_at - entered_at), 6), 0) AS min_dwell, coalesce(round(max(exited_at - entered_at), 6), 0) AS max_dwell FROM ({_VISITS})""",
    "q14_unique_people": f"SELECT count(*)::BIGINT AS unique_people FROM ({PERSON_SQL}) WHERE global_id NOT LIKE 'merged:%'",
    "q15_attribute_breakdown": f"""SELECT 'gender' AS attribute, gender AS value, count(*)::BIGINT AS people FROM ({PERSON_SQL}) WHERE global_id NOT LIKE 'merged:%' GROUP BY gender
  UNION ALL SELECT 'age', coalesce(age_category, 'UNKNOWN'), count(*)::BIGINT FROM ({PERSON_SQL}) WHERE global_id NOT LIKE 'merged:%' GROUP BY 2""",
    "q16_available_dates": f"SELECT DISTINCT day FROM ({_DAYS}) ORDER BY day DESC",
    "q17_known_ids": f"SELECT DISTINCT booth_id FROM ({_DAYS}) ORDER BY booth_id",
    "q18_distinct": "SELECT DISTINCT event_type FROM events WHERE event_type <> '' ORDER BY 1",
    "q19_event_sessions": f"SELECT day, booth_id, coalesce(n_name, booth_id::VARCHAR) AS booth_name FROM ({_DAYS}) LEFT JOIN nation ON n_nationkey = booth_id",
    "q20_daily_breakdown": f"""WITH d AS (SELECT DISTINCT day FROM ({_DAYS})), a AS (SELECT {_ISO} AS day, count(*) AS n FROM ({INTERACTION_SQL}) GROUP BY 1),
  b AS (SELECT {_ISO} AS day, count(*) AS n FROM ({HEALTH_SQL}) WHERE status = 'error' GROUP BY 1),
  c AS (SELECT day, count(*) FILTER (delta > 0) AS n, greatest(max(balance), 0) AS peak FROM ({_balance('day', f'SELECT *, {_ISO} AS day FROM ({CROSSING_SQL})')}) GROUP BY day)
  SELECT day, coalesce(a.n, 0)::BIGINT AS interactions, coalesce(b.n, 0)::BIGINT AS alerts, coalesce(c.n, 0)::BIGINT AS total_in, coalesce(c.peak, 0)::BIGINT AS peak_inside
  FROM d LEFT JOIN a USING (day) LEFT JOIN b USING (day) LEFT JOIN c USING (day) ORDER BY day""",
    "q21_count_booths": "SELECT count(*)::BIGINT AS booths FROM nation",
    "q22_events_with_booths": "SELECT r_name AS event_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::BIGINT AS booth_count FROM region",
    "j01_booths_with_event": "SELECT n_nationkey AS booth_id, n_name AS booth_name, r_name AS event_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey ORDER BY n_name",
    "j06_no_interest": f"SELECT p_partkey AS product_key, p_name AS product_name FROM part WHERE NOT EXISTS (SELECT 1 FROM ({HOLD_SQL}) h WHERE h.product_key = p_partkey AND duration_sec > 49)",
    "j10_camera_union": f"""SELECT coalesce(a.c, b.c) AS camera_id, round(last_seen, 6) AS last_seen, coalesce(n, 0)::BIGINT AS crossings FROM (SELECT booth_id AS c, max(ts) AS last_seen FROM ({INTERACTION_SQL}) GROUP BY 1) a
  FULL JOIN (SELECT booth_id + 3 AS c, count(*) AS n FROM ({CROSSING_SQL}) GROUP BY 1) b ON a.c = b.c""",
    "l01_newest_interactions": f"SELECT id, product_name, booth_id, round(ts, 6) AS ts FROM ({INTERACTION_SQL}) ORDER BY ts DESC, id DESC LIMIT 200",
    "l02_oldest_crossings": f"SELECT id, direction, round(ts, 6) AS ts FROM ({CROSSING_SQL}) ORDER BY ts, id LIMIT 2000",
}
