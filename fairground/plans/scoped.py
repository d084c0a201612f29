"""The booth's reports asked for a scope, as its dashboard asks them: one booth on one day, one camera of an event, one day; and
counts over the periods of the kiosk; scopes deleted and booths renamed in a log (inventory ids F01, F02, F07, J21)."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.functions.scope import period_start
from fairground.plans import booth
from fairground.sources import bindings as B
from fairground.sources import rewrites
from fairground.sources.bindings import CROSSING_SQL, HEALTH_SQL, HOLD_SQL, INTERACTION_SQL, SCAN_SQL
from fairground.sources.shared import shared_path

#: Name, what is asked for, and the reports: those on holds go back some decades. The last day is one of a clock change.
SCOPES = (
    ("booth_day", {"booth_id": 3, "date": "2024-01-09"}, ("q01_summary", "q02_top_products", "q12_tripwire_stats", "q13_session_stats")),
    ("event_camera", {"event_id": 7, "camera_id": 2}, ("q03_product_movers", "q04_interest_summary", "q05_gender_matrix", "q06_age_matrix", "q07_gender_totals", "q08_age_totals", "q11_presence_breakdown")),
    ("day", {"date": "1995-03-26"}, ("q09_interest_overview", "q10_presence_stats")),
)
PERIODS = ("today", "7d", "30d", "all")


def _query(report: str, where: dict):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return booth.QUERIES[report](spark, sf_dir, **where)

    return query


def f07_period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of each period that ends with the log: the periods' beginnings are worked out from one row, its last time."""
    scans = B.scans(spark, sf_dir)
    last = scans.agg(F.max("created_at")).first()[0]
    now = datetime.fromtimestamp(last or 0.0, UTC)
    counts = [F.count_if(F.col("created_at") >= period_start(p, now)).alias(f"scans_{p}") for p in PERIODS]
    return scans.agg(*counts)


#: The columns of an interaction.
_INTERACTION = "id long, ts double, product_name long, confidence double, camera_id long, booth_id long, event_id long"


def j21_deleted_and_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of interactions in parts by booth, after an event's rows of a booth were deleted and another booth joined to a third: writes
    its table when it is built."""
    path = shared_path(spark, "interactions")
    rewrites.write(B.interactions(spark, sf_dir), path, "booth_id")
    rewrites.delete(spark, path, _INTERACTION, "booth_id", (F.col("booth_id") == 3) & (F.col("event_id") == 1))
    rewrites.rename(spark, path, _INTERACTION, "booth_id", "booth_id", 4, 7)
    rows = rewrites.read(spark, path, _INTERACTION)
    return rows.groupBy("booth_id", "event_id").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"))


def _condition(where: dict) -> str:
    start = f"epoch(TIMESTAMP '{where.get('date')} 00:00:00')"
    return " AND ".join([f"{c} = {v}" for c, v in where.items() if c != "date"] + [f"ts >= {start} AND ts < {start} + 86400"] * ("date" in where))


def _sql(report: str, where: dict) -> str:
    found = booth.ORACLE_SQL[report]
    for rows in (HOLD_SQL, INTERACTION_SQL, HEALTH_SQL, CROSSING_SQL):
        found = found.replace(f"({rows})", f"(SELECT * FROM ({rows}) WHERE {_condition(where)})")
    return found


def _named(report: str, scope: str) -> str:
    return f"{report}_of_{scope}"


QUERIES = {_named(r, scope): _query(r, where) for scope, where, reports in SCOPES for r in reports} | {f.__name__: f for f in (f07_period_counts, j21_deleted_and_renamed)}
ORACLE_SQL = {_named(r, scope): _sql(r, where) for scope, where, reports in SCOPES for r in reports}
ORACLE_SQL["f07_period_counts"] = f"""WITH s AS (SELECT * FROM ({SCAN_SQL})), n AS (SELECT max(created_at) AS now, epoch(date_trunc('day', make_timestamp((max(created_at) * 1000000)::BIGINT))) AS midnight FROM s)
SELECT count(*) FILTER (created_at >= midnight)::BIGINT AS scans_today, count(*) FILTER (created_at >= midnight - 6 * 86400)::BIGINT AS scans_7d, count(*) FILTER (created_at >= midnight - 29 * 86400)::BIGINT AS scans_30d, count(*)::BIGINT AS scans_all FROM s, n"""
ORACLE_SQL["j21_deleted_and_renamed"] = f"SELECT CASE booth_id WHEN 4 THEN 7 ELSE booth_id END AS booth_id, event_id, count(*)::BIGINT AS rows, sum(id)::BIGINT AS ids FROM ({INTERACTION_SQL}) WHERE NOT (booth_id = 3 AND event_id = 1) GROUP BY 1, 2"
