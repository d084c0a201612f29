"""Kiosk and server analytics (inventory ids Q23-Q31, Q45-Q47, J04, J05, S04-S06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.functions.scope import half_up, local_day
from fairground.operators import sinks
from fairground.sources import bindings as B
from fairground.sources.bindings import EVENT_SQL, HOLD_SQL, PRODUCT_SQL, SCAN_SQL, kiosk_products, scans

#: The period of the reports, in seconds since 1970: the test events are of January 2024.
SINCE = 1705276800.0
STATUS = ("CONFIRMED", "POSSIBLE", "NONE")


def _hour(ts: str = "created_at"):
    return F.hour(F.timestamp_seconds(ts)).cast("long")


def _per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product, with its matched scans of the period; the condition is on the scans before the
    join, so products without any stay."""
    counted = scans(spark, sf_dir).where((F.col("matched")) & (F.col("created_at") >= SINCE) & F.col("product_id").isNotNull())
    counted = counted.groupBy("product_id").agg(F.count("id").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.round(F.max("created_at"), 6).alias("last_scan"))
    rows = kiosk_products(spark, sf_dir).join(counted, F.col("id") == F.col("product_id"), "left")
    return rows.withColumn("scan_count", F.coalesce("n", F.lit(0)))


def q27_product_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_product(spark, sf_dir).select("id", "name", "scan_count", "avg_confidence", "last_scan").orderBy(F.desc("scan_count"), "name", "id")


def q28_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(spark, sf_dir).where((F.col("created_at") >= SINCE) & F.col("matched")).groupBy(_hour().alias("hour")).agg(F.count("*").alias("scans"))


def q29_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from the first to the last of the table, 60 at most, with 0 where nothing was scanned."""
    per = scans(spark, sf_dir).where("matched").groupBy(local_day("created_at").cast("date").alias("day")).agg(F.count("*").alias("n"))
    last = scans(spark, sf_dir).agg(F.to_date(F.timestamp_seconds(F.max("created_at"))).alias("last"), F.to_date(F.timestamp_seconds(F.min("created_at"))).alias("first"))
    spine = last.select(F.explode(F.sequence(F.greatest("first", F.date_sub("last", 59)), "last")).alias("day"))
    return spine.join(per, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("scans")).orderBy("day")


def q30_product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_product(spark, sf_dir).select("id", "name", "category", "price", "scan_count", "avg_confidence")


def q31_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans(spark, sf_dir).where(F.col("created_at") >= SINCE)
    known = F.col("product_id").isNotNull()
    out = rows.agg(
        F.count_if(F.col("matched") & known).alias("successful"), F.count_if(~F.col("matched")).alias("unmatched"), F.count_if(F.col("corrected") & known).alias("corrected"),
        F.count_if(F.col("matched") & ~known).alias("orphaned"), F.countDistinct(F.when(F.col("matched"), F.col("product_id"))).alias("products_scanned"), F.count("*").alias("total"),
    )
    return out.withColumn("success_rate", F.round(F.try_divide(F.col("successful"), F.col("successful") + F.col("unmatched")), 6))


def j04_scans_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = kiosk_products(spark, sf_dir).select(F.col("id").alias("product_id"), "name")
    return scans(spark, sf_dir).join(names, "product_id", "left").select("id", F.col("product_id").cast("string").alias("product_id"), "name", F.when(~F.col("matched"), "unmatched").when(F.col("corrected"), "corrected").otherwise("matched").alias("outcome"))


def j05_stale_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without a confident scan."""
    current = scans(spark, sf_dir).where("confidence >= 0.6").select(F.col("product_id").alias("id"))
    return kiosk_products(spark, sf_dir).join(current, "id", "left_anti").select("id", "name")


def searched(products: DataFrame, query: str | None) -> DataFrame:
    """Products of which every word of the query occurs somewhere in name, category, origin or material; all, without words."""
    hay = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "category", "origin", "material")]))
    for word in (query or "").lower().split():
        products = products.where(F.contains(hay, F.lit(word)))
    return products


def facets(products: DataFrame, query: str | None = None, active: str | None = None) -> DataFrame:
    """chip, products, active: how many products of the search each category has, those without one last, and of all first (__all__). The
    category that is chosen stays, if need be with none."""
    per = searched(products, query).groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit(NO_CATEGORY)).alias("chip")).agg(F.count("*").alias("products"))
    whole = per.agg(F.lit(ALL).alias("chip"), F.coalesce(F.sum("products"), F.lit(0)).alias("products"))
    rows = whole.union(per)
    if active is not None:
        chosen = products.sparkSession.createDataFrame([(active, 0)], "chip string, products long")
        rows = rows.union(chosen).groupBy("chip").agg(F.max("products").alias("products"))
    first, last = F.col("chip") != ALL, F.col("chip") == NO_CATEGORY
    return rows.withColumn("active", F.col("chip") == F.lit(active if active is not None else ALL)).orderBy(first, last, F.desc("products"), F.collate("chip", "th"))


#: Names of the chips of all products and of those without a category (the latter a fixed value).
ALL, NO_CATEGORY = "__all__", "__none__"
#: A search, and a category that none of its products has.
SEARCH, CHOSEN = "Red size 1", "no such category"


def q45_catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(kiosk_products(spark, sf_dir), SEARCH).select("id", "name", "material")


def q46_category_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets(kiosk_products(spark, sf_dir))


def q46_facets_of_a_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets(kiosk_products(spark, sf_dir), SEARCH, CHOSEN)


def q47_peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the hours with most scans, and its share of all in percent, halves up."""
    per = scans(spark, sf_dir).groupBy(_hour().alias("hour")).agg(F.count("*").alias("n"))
    out = per.agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"), F.max("n").alias("scans"), F.sum("n").alias("total"))
    return out.select("peak_hour", "scans", half_up(F.col("scans") * 100 / F.col("total")).alias("percent"))


def _status():
    return F.when(F.col("duration_sec") >= 40, STATUS[0]).when(F.col("duration_sec") >= 20, STATUS[1]).otherwise(STATUS[2])


def q23_zone_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = B.hold_events(spark, sf_dir, "camera_id", "global_person_id", "duration_sec").withColumn("status", _status()).groupBy(F.col("camera_id").alias("zone_id"))
    return per.agg(F.countDistinct("global_person_id").alias("unique_people"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUS])


def q24_product_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hold_events(spark, sf_dir, "product_key", "duration_sec").groupBy("product_key", _status().alias("status")).agg(F.count("*").alias("events"))


def q25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by gender and by age group as name and number."""
    rows = B.persons(spark, sf_dir)
    by = lambda what, c: rows.groupBy(F.concat_ws(":", F.lit(what), F.coalesce(c, F.lit("unknown"))).alias("stat")).agg(F.count("*").alias("n"))
    return by("gender", F.col("gender")).union(by("age", F.col("age_category"))).union(rows.agg(F.countDistinct("global_id").alias("n")).select(F.lit("persons").alias("stat"), "n"))


def q26_camera_person_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons per camera, from each person's list of cameras kept as JSON."""
    seen = B.events(spark, sf_dir).groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_set(F.col("k") % 6))).alias("cameras_seen"))
    cameras = F.coalesce(F.from_json("cameras_seen", "array<bigint>"), F.array().cast("array<bigint>"))
    return seen.select(F.explode(cameras).alias("camera_id")).groupBy("camera_id").agg(F.count("*").alias("persons"))


def s04_idempotent_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that was delivered twice, some rows without a key."""
    key = F.when(F.col("user_id") % 7 != 0, F.concat_ws(":", "user_id", "event_type", "k"))
    rows = B.events(spark, sf_dir).withColumn("event_key", key)
    return sinks.idempotent(rows.union(rows), "event_key").groupBy("event_type").agg(F.count("*").alias("kept"), F.count_if(F.col("event_key").isNull()).alias("without_key"))


def s05_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.upsert(B.events(spark, sf_dir), ["user_id"], ["ts", "event_id"], overwritten=["event_type", "value"], frozen=["k"])
    return out.select("user_id", "event_type", "value", "k")


def s06_upsert_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.upsert_merged(B.events(spark, sf_dir).withColumn("last_seen", F.col("ts")), ["user_id"], ["ts", "event_id"], least=["ts"], greatest=["last_seen"], overwritten=["k"])
    return out.select("user_id", F.round("ts", 6).alias("first_seen"), F.round("last_seen", 6).alias("last_seen"), "k")


def t19_merge_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interest by person after a chain of merges: 3k+2 into 3k+1, 3k+1 into 3k."""
    holds = B.hold_events(spark, sf_dir, "global_person_id", "duration_sec").where("global_person_id IS NOT NULL").select(F.col("global_person_id").alias("person"), "duration_sec")
    ids = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("loser")).where("loser % 3 <> 0")
    merged = sinks.resolve_merges(ids.withColumn("winner", F.col("loser") - 1))
    rows = holds.join(merged, F.col("person") == F.col("loser"), "left").select(F.coalesce("winner", "person").alias("person"), "duration_sec")
    return rows.groupBy("person").agg(F.count("*").alias("holds"), F.round(F.sum("duration_sec"), 6).alias("duration_sec"))


QUERIES = {f.__name__: f for f in (
    q23_zone_analytics, q24_product_analytics, q25_stats, q26_camera_person_counts, q27_product_summary, q28_hourly, q29_daily, q30_product_rows, q31_overview, j04_scans_with_names, j05_stale_products,
    q45_catalog_search, q46_category_facets, q46_facets_of_a_search, q47_peak_hour, s04_idempotent_crossings, s05_upsert_latest, s06_upsert_min_max, t19_merge_propagation,
)}

_PER = f"""SELECT p.*, count(s.id)::BIGINT AS scan_count, round(avg(confidence), 6) AS avg_confidence, round(max(created_at), 6) AS last_scan
  FROM ({PRODUCT_SQL}) p LEFT JOIN ({SCAN_SQL}) s ON s.product_id = p.id AND s.matched AND s.created_at >= {SINCE} GROUP BY ALL"""
_STATUS = "CASE WHEN duration_sec >= 40 THEN 'CONFIRMED' WHEN duration_sec >= 20 THEN 'POSSIBLE' ELSE 'NONE' END"
_AT = "to_timestamp(created_at) AT TIME ZONE 'UTC'"
_FOUND = f"SELECT * FROM ({PRODUCT_SQL}) WHERE " + " AND ".join(f"contains(lower(concat_ws(' ', name, category, origin, material)), '{w}')" for w in SEARCH.lower().split())
ORACLE_SQL = {
    "q23_zone_analytics": f"""SELECT camera_id AS zone_id, count(DISTINCT global_person_id)::BIGINT AS unique_people, {", ".join(f"count(*) FILTER ({_STATUS} = '{s}')::BIGINT AS {s.lower()}" for s in STATUS)}
  FROM ({HOLD_SQL}) GROUP BY 1""",
    "q24_product_analytics": f"SELECT product_key, {_STATUS} AS status, count(*)::BIGINT AS events FROM ({HOLD_SQL}) GROUP BY 1, 2",
    "q25_stats": f"""SELECT 'gender:' || gender AS stat, count(*)::BIGINT AS n FROM ({B.PERSON_SQL}) GROUP BY 1 UNION ALL SELECT 'age:' || coalesce(age_category, 'unknown'), count(*)::BIGINT FROM ({B.PERSON_SQL}) GROUP BY 1
  UNION ALL SELECT 'persons', count(DISTINCT global_id)::BIGINT FROM ({B.PERSON_SQL})""",
    "q26_camera_person_counts": f"SELECT k % 6 AS camera_id, count(DISTINCT user_id)::BIGINT AS persons FROM ({EVENT_SQL}) GROUP BY 1",
    "q27_product_summary": f"SELECT id, name, scan_count, avg_confidence, last_scan FROM ({_PER}) ORDER BY scan_count DESC, name, id",
    "q28_hourly": f"SELECT extract(hour FROM {_AT})::BIGINT AS hour, count(*)::BIGINT AS scans FROM ({SCAN_SQL}) WHERE created_at >= {SINCE} AND matched GROUP BY 1",
    "q29_daily": f"""WITH s AS (SELECT *, ({_AT})::DATE AS day FROM ({SCAN_SQL})), b AS (SELECT greatest(min(day), max(day) - 59) AS first, max(day) AS last FROM s),
  d AS (SELECT unnest(generate_series(first::TIMESTAMP, last::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM b), n AS (SELECT day, count(*) AS n FROM s WHERE matched GROUP BY day)
  SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0)::BIGINT AS scans FROM d LEFT JOIN n USING (day) ORDER BY 1""",
    "q30_product_rows": f"SELECT id, name, category, price, scan_count, avg_confidence FROM ({_PER})",
    "q31_overview": f"""SELECT s AS successful, u AS unmatched, c AS corrected, o AS orphaned, d AS products_scanned, t AS total, round(s / nullif(s + u, 0), 6) AS success_rate FROM (SELECT
  count(*) FILTER (matched AND product_id IS NOT NULL)::BIGINT AS s, count(*) FILTER (NOT matched)::BIGINT AS u, count(*) FILTER (corrected AND product_id IS NOT NULL)::BIGINT AS c,
  count(*) FILTER (matched AND product_id IS NULL)::BIGINT AS o, count(DISTINCT product_id) FILTER (matched)::BIGINT AS d, count(*)::BIGINT AS t FROM ({SCAN_SQL}) WHERE created_at >= {SINCE})""",
    "j04_scans_with_names": f"""SELECT s.id, product_id::VARCHAR AS product_id, name, CASE WHEN NOT matched THEN 'unmatched' WHEN corrected THEN 'corrected' ELSE 'matched' END AS outcome
  FROM ({SCAN_SQL}) s LEFT JOIN ({PRODUCT_SQL}) p ON p.id = product_id""",
    "j05_stale_products": f"SELECT id, name FROM ({PRODUCT_SQL}) p WHERE NOT EXISTS (SELECT 1 FROM ({SCAN_SQL}) s WHERE s.product_id = p.id AND confidence >= 0.6)",
    "q45_catalog_search": f"SELECT id, name, material FROM ({_FOUND})",
    "q46_category_facets": f"""WITH c AS (SELECT coalesce(category, '__none__') AS chip, count(*)::BIGINT AS products FROM ({PRODUCT_SQL}) GROUP BY 1)
  SELECT chip, products, false AS active FROM c UNION ALL SELECT '__all__', sum(products)::BIGINT, true FROM c""",
    "q46_facets_of_a_search": f"""WITH c AS (SELECT coalesce(category, '__none__') AS chip, count(*)::BIGINT AS products FROM ({_FOUND}) GROUP BY 1)
  SELECT chip, products, false AS active FROM c UNION ALL SELECT '__all__', coalesce(sum(products), 0)::BIGINT, false FROM c UNION ALL SELECT '{CHOSEN}', 0, true""",
    "q47_peak_hour": f"""SELECT hour AS peak_hour, n AS scans, floor(n * 100.0 / (SELECT count(*) FROM events) + 0.5)::BIGINT AS percent FROM (SELECT extract(hour FROM {_AT})::BIGINT AS hour, count(*)::BIGINT AS n
  FROM ({SCAN_SQL}) GROUP BY 1) ORDER BY n DESC, hour LIMIT 1""",
    "s04_idempotent_crossings": f"""WITH e AS (SELECT *, CASE WHEN user_id % 7 <> 0 THEN concat_ws(':', user_id, event_type, k) END AS key FROM ({EVENT_SQL}))
  SELECT event_type, (count(DISTINCT key) + 2 * count(*) FILTER (key IS NULL))::BIGINT AS kept, (2 * count(*) FILTER (key IS NULL))::BIGINT AS without_key FROM e GROUP BY 1""",
    "s05_upsert_latest": f"SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, arg_min(k, (ts, event_id)) AS k FROM ({EVENT_SQL}) GROUP BY 1",
    "s06_upsert_min_max": f"SELECT user_id, round(min(ts), 6) AS first_seen, round(max(ts), 6) AS last_seen, arg_max(k, (ts, event_id)) AS k FROM ({EVENT_SQL}) GROUP BY 1",
    "t19_merge_propagation": f"""SELECT global_person_id - global_person_id % 3 AS person, count(*)::BIGINT AS holds, round(sum(duration_sec), 6) AS duration_sec
  FROM ({HOLD_SQL}) WHERE global_person_id IS NOT NULL GROUP BY 1""",
}
