"""Views that give the star-schema test tables the shape of the booth's log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.functions.scope import scope


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str):
    """Seconds since 1970 of a timestamp without a zone, as the logs keep time."""
    return (F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1_000_000)).cast("double")


def hold_events(spark: SparkSession, sf_dir: str, *columns: str, **where) -> DataFrame:
    """Product hold events: a line item is a hold of a part, its order's customer the person. Of the given
    columns (all, if none is given) and scope; what they don't need isn't joined. Every line item has its order,
    part and supplier."""
    made = {
        "product_key": F.col("l_partkey"), "product_name": F.col("p_name"), "duration_sec": F.col("l_quantity"),
        "gender": F.when(F.col("l_returnflag") == "A", "MALE").when(F.col("l_returnflag") == "R", "FEMALE"),
        "age_category": F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linestatus") == "F", "ADULT").otherwise("CHILD"),
        "global_person_id": F.when(F.col("l_linenumber") != 1, F.col("o_custkey")),
        "booth_id": F.col("l_suppkey"), "event_id": F.col("s_nationkey"), "camera_id": F.col("l_linenumber"),
        "ts": epoch("l_shipdate"), "order_id": F.col("l_orderkey"), "price": F.col("l_extendedprice"),
    }
    wanted = columns or tuple(made)
    scoped = [c for c in ("event_id", "booth_id", "camera_id") if where.get(c) not in (None, "")] + ["ts"] * bool(where.get("date"))
    rows = table(spark, sf_dir, "lineitem")
    for needs, name, key, own in (("global_person_id", "orders", "l_orderkey", "o_orderkey"), ("product_name", "part", "l_partkey", "p_partkey"), ("event_id", "supplier", "l_suppkey", "s_suppkey")):
        if needs in wanted or needs in scoped:
            rows = rows.join(table(spark, sf_dir, name), F.col(key) == F.col(own))
    every = rows.select(*[made[c].alias(c) for c in dict.fromkeys([*wanted, *scoped])])
    return scope(every, **where).select(*wanted)


HOLD_SQL = """SELECT l_partkey AS product_key, p_name AS product_name, l_quantity AS duration_sec,
  CASE l_returnflag WHEN 'A' THEN 'MALE' WHEN 'R' THEN 'FEMALE' END AS gender,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN 'ADULT' ELSE 'CHILD' END AS age_category,
  CASE WHEN l_linenumber <> 1 THEN o_custkey END AS global_person_id, l_suppkey AS booth_id, s_nationkey AS event_id,
  l_linenumber AS camera_id, epoch(l_shipdate) AS ts, l_orderkey AS order_id, l_extendedprice AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""


def _day(column: str = "ts"):
    return F.date_format(F.timestamp_seconds(column), "yyyy-MM-dd")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", epoch("ts").alias("ts"), "user_id", "event_type", "value", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))


EVENT_SQL = "SELECT event_id, epoch(ts) AS ts, user_id, event_type, value, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events"


def interactions(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    """A view or click is an interaction with a product."""
    rows = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return scope(rows.select(F.col("event_id").alias("id"), "ts", F.col("k").alias("product_name"), (F.col("value") / 500).alias("confidence"), (F.col("user_id") % 4).alias("camera_id"), (F.col("user_id") % 10).alias("booth_id"), (F.col("user_id") % 3).alias("event_id")), **where)


INTERACTION_SQL = f"""SELECT event_id AS id, ts, k AS product_name, value / 500 AS confidence, user_id % 4 AS camera_id,
  user_id % 10 AS booth_id, user_id % 3 AS event_id FROM ({EVENT_SQL}) WHERE event_type IN ('view', 'click')"""


def health_events(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    """Errors and views are health rows of the booth."""
    rows = events(spark, sf_dir).where(F.col("event_type").isin("view", "error"))
    return scope(rows.select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), (F.col("user_id") % 12).alias("booth_id"), (F.col("user_id") % 3).alias("event_id"), (F.col("user_id") % 7).alias("component")), **where)


HEALTH_SQL = f"""SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status,
  user_id % 12 AS booth_id, user_id % 3 AS event_id, user_id % 7 AS component FROM ({EVENT_SQL}) WHERE event_type IN ('view', 'error')"""


def crossings(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    """A sign-up is an entry, a purchase an exit."""
    rows = events(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase"))
    return scope(rows.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("track_id"), F.when(F.col("event_type") == "signup", "in").otherwise("out").alias("direction"), (F.col("user_id") % 10).alias("booth_id"), (F.col("k") % 4).alias("camera_id"), (F.col("user_id") % 3).alias("event_id")), **where)


CROSSING_SQL = f"""SELECT event_id AS id, ts, user_id AS track_id, CASE event_type WHEN 'signup' THEN 'in' ELSE 'out' END AS direction,
  user_id % 10 AS booth_id, k % 4 AS camera_id, user_id % 3 AS event_id FROM ({EVENT_SQL}) WHERE event_type IN ('signup', 'purchase')"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a scan; products from 80 on are unknown to the kiosk."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.when(F.col("k") < 80, F.col("k")).alias("product_id"), (F.col("event_type") != "error").alias("matched"),
        (F.col("event_type") == "signup").alias("corrected"), (F.col("value") / 500).alias("confidence"), F.col("ts").alias("created_at"),
    )


SCAN_SQL = f"""SELECT event_id AS id, CASE WHEN k < 80 THEN k END AS product_id, event_type <> 'error' AS matched,
  event_type = 'signup' AS corrected, value / 500 AS confidence, ts AS created_at FROM ({EVENT_SQL})"""


def kiosk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("category"), F.col("p_brand").alias("origin"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("material"), F.col("p_retailprice").alias("price"))


PRODUCT_SQL = "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size > 5 THEN p_type END AS category, p_brand AS origin, 'size ' || p_size AS material, p_retailprice AS price FROM part"


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are identities; every fiftieth was merged into another."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.when(key % 50 == 0, "merged:").otherwise(""), F.col("c_name")).alias("global_id"),
        F.when(key % 3 == 0, "MALE").when(key % 3 == 1, "FEMALE").otherwise("UNKNOWN").alias("gender"),
        F.when(key % 4 == 0, "CHILD").when(key % 4 == 1, None).otherwise("ADULT").alias("age_category"),
        F.col("c_nationkey").alias("booth_id"),
    )


PERSON_SQL = """SELECT concat(CASE WHEN c_custkey % 50 = 0 THEN 'merged:' ELSE '' END, c_name) AS global_id,
  CASE c_custkey % 3 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' ELSE 'UNKNOWN' END AS gender,
  CASE c_custkey % 4 WHEN 0 THEN 'CHILD' WHEN 1 THEN NULL ELSE 'ADULT' END AS age_category, c_nationkey AS booth_id FROM customer"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("person"), F.pmod(F.col("value"), F.lit(10.0)).alias("x"), ((F.col("k") % 24) / 4).alias("y"), "ts")


POSITION_SQL = f"SELECT event_id AS id, user_id AS person, value % 10.0 AS x, (k % 24) / 4 AS y, ts FROM ({EVENT_SQL})"
