"""Streams run to their end over a finished log (inventory ids S07, W02, W04, W05): each query writes its table when it is
built, batch by batch, and gives it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.operators.folds import fold
from fairground.sources import bindings as B
from fairground.sources.bindings import EVENT_SQL, table
from fairground.sources.shared import shared_path
from fairground.streaming import timers

#: Requests accepted of an address within so many seconds.
LIMIT, WITHIN = 3, 43200.0
#: Hours of silence until offline, that rows may be late, and that a hold may last.
SILENCE, LATE, LONGEST = 12, 1, 60


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream: what these queries need of it is delivered to a folder, file by file, and streamed from there."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))
    path = shared_path(spark, "delivered")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def w04_ordered_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's positions in the order of their times, as far as no earlier one can come any more."""
    rows = _events(spark, sf_dir).select("user_id", "at", "event_id")
    path = timers.drained(timers.reordered(rows, "user_id", "at", "event_id", f"{LATE} hours"), "paths")
    return path.select("user_id", "event_id", "place")


def w05_offline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When users go online, and offline after hours of silence."""
    rows = _events(spark, sf_dir).select("user_id", "at")
    turns = timers.drained(timers.presence(rows, "user_id", "at", SILENCE * 3600, f"{LATE} hours"), "presence")
    return turns.select("user_id", "status", (F.unix_millis("at")).alias("at_ms"))


def s07_finalised_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds that were confirmed, with their end if it came in time: a view is a hold, two of three of which end, so many
    hours later as its number says."""
    log = _events(spark, sf_dir)
    views = log.where("event_type = 'view'")
    begun = views.select(F.col("event_id").alias("hold"), F.col("at").alias("confirmed_at"), "user_id")
    ended = log.where("event_type = 'view' AND k % 3 < 2").select(F.col("event_id").alias("hold"), F.timestamp_micros(F.unix_micros("at") + F.col("k") * 3_600_000_000).alias("ended_at"))
    rows = timers.drained(timers.finalised(begun, ended, "hold", f"{LONGEST} hours", f"{LATE} hours"), "holds")
    return rows.select("hold", "user_id", "status", ((F.unix_micros("ended_at") - F.unix_micros("confirmed_at")) / 1_000_000).alias("duration_sec"))


def w02_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most LIMIT requests of a user within WITHIN seconds; a refused one doesn't count."""
    rows = B.events(spark, sf_dir).select("user_id", "ts", "event_id")
    limited = fold(rows, ["user_id"], ["ts", "event_id"], list, timers.limit_step("ts", LIMIT, WITHIN), "user_id long, ts double, event_id long, accepted boolean")
    return limited.select("user_id", "event_id", "accepted")


QUERIES = {f.__name__: f for f in (w02_rate_limit, w04_ordered_path, w05_offline_events, s07_finalised_holds)}

_MS = "(epoch_us(ts) // 1000)"
_WATERMARK = f"(SELECT max({_MS}) - {LATE * 3600000} FROM events)"
ORACLE_SQL = {
    "w02_rate_limit": f"""WITH RECURSIVE r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ({EVENT_SQL})),
  l AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS i, []::DOUBLE[] AS kept, false AS accepted FROM r UNION ALL
    SELECT user_id, event_id, i, CASE WHEN len(k) < {LIMIT} THEN list_append(k, ts) ELSE k END, len(k) < {LIMIT} FROM (SELECT r.user_id, r.event_id, r.i, r.ts, list_filter(l.kept, lambda t: r.ts - t < {WITHIN}) AS k FROM l JOIN r ON r.user_id = l.user_id AND r.i = l.i + 1))
  SELECT user_id, event_id, accepted FROM l WHERE i > 0""",
    "w04_ordered_path": f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events WHERE {_MS} < {_WATERMARK}",
    "w05_offline_events": f"""WITH r AS (SELECT user_id, {_MS} AS ms, lag({_MS}) OVER u AS before, lead({_MS}) OVER u AS next FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, 'ONLINE' AS status, ms AS at_ms FROM r WHERE before IS NULL OR ms - before > {SILENCE * 3600000}
  UNION ALL SELECT user_id, 'OFFLINE', ms + {SILENCE * 3600000} FROM r WHERE next - ms > {SILENCE * 3600000} OR (next IS NULL AND ms + {SILENCE * 3600000} <= {_WATERMARK})""",
    "s07_finalised_holds": f"""WITH v AS (SELECT event_id AS hold, user_id, epoch_us(ts) AS us, k, k % 3 < 2 AS ends FROM (SELECT *, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events) WHERE event_type = 'view'),
  w AS (SELECT least(max(us), max(us + k * 3600000000) FILTER (ends)) - {LATE * 3600} * 1000000::BIGINT AS w FROM v)
  SELECT hold, user_id, CASE WHEN ends AND k <= {LONGEST} THEN 'finalized' ELSE 'confirmed' END AS status, CASE WHEN ends AND k <= {LONGEST} THEN (k * 3600)::DOUBLE END AS duration_sec
  FROM v, w WHERE (ends AND k <= {LONGEST}) OR us + {LONGEST * 3600} * 1000000::BIGINT < w""",
}
