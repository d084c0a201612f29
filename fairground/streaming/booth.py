"""Structured Streaming forms of the booth's operators; each keeps the state of its batch form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairground.operators import decisions, folds, identity
from fairground.sources import shared


def _stateful(rows: DataFrame, keys: list[str], order: list[str], start, step, schema: str, idle_minutes: float | None = None) -> DataFrame:
    """step over every key's rows of each batch in order, the state kept as JSON between batches.

    Rows that come after a later one of their key was taken are dropped, as the booth's cameras do. With
    idle_minutes, a key without rows for so long is forgotten, so that the state stays as large as what is
    in sight: for queries that run on, since Spark then never runs out of batches to look for idle keys."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(_key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        kept, last = json.loads(state.get[0]) if state.exists else (start(), None)
        out = []
        for found in pd.concat(list(frames)).sort_values(order).to_dict("records"):
            row = {c: None if v != v else v for c, v in found.items()}  # nulls come as NaN
            if last is not None and row[order[0]] < last:
                continue
            last = row[order[0]]
            kept, made = step(kept, row)
            out += made
        state.update((json.dumps([kept, last]),))
        if idle_minutes is not None:
            state.setTimeoutDuration(int(idle_minutes * 60_000))
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", timeout)


def tripwire(readings: DataFrame, idle_minutes: float | None = None) -> DataFrame:
    """Crossings as they are confirmed; rows of a track are taken in the order of a batch's times."""
    return _stateful(readings, ["camera_id", "track_id"], ["ts"], folds.tripwire_start, folds.tripwire_step, folds.CROSSING, idle_minutes)


def throttled(rows: DataFrame, key: str, ts: str, interval: float) -> DataFrame:
    """key and ts of the rows that come at least interval after the last one taken."""

    def step(last, row):
        taken = last is None or row[ts] - last >= interval
        return (row[ts], [{key: row[key], ts: row[ts]}]) if taken else (last, [])

    return _stateful(rows.select(key, ts), [key], [ts], lambda: None, step, f"{key} long, {ts} double")


def product_holds(rows: DataFrame, idle_minutes: float | None = None) -> DataFrame:
    """Holds as they are confirmed and as they end."""
    return _stateful(rows, ["camera_id", "product"], ["ts"], folds.placed_start, folds.placed_step, folds.HOLD, idle_minutes)


def scan_switches(rows: DataFrame, idle_minutes: float | None = None) -> DataFrame:
    """The product that a kiosk shows, whenever it changes."""
    return _stateful(rows, ["camera_id"], ["ts", "scan_id"], decisions.scan_start, decisions.scan_step, decisions.SCAN, idle_minutes)


def evidence(samples: DataFrame, idle_minutes: float | None = None) -> DataFrame:
    """What is believed of a person after every sample."""
    return _stateful(samples, ["user_id"], ["ts", "id"], identity.evidence_start, identity.evidence_step, identity.SMOOTHED, idle_minutes)


def into_tables(rows: DataFrame, path: str, tables: dict, checkpoint: str):
    """A running query that puts every delivery into several tables (name to a function of its rows)."""
    return rows.writeStream.foreachBatch(lambda batch, _: shared.fan_out(batch, path, tables)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotent(rows: DataFrame, key: str, event_time: str, late: str = "1 hour") -> DataFrame:
    """One row for each key within the time that rows may be late; rows without a key all stay."""
    timed = rows.withWatermark(event_time, late)
    own = F.coalesce(F.col(key).cast("string"), F.expr("uuid()"))
    return timed.withColumn("key_", own).dropDuplicatesWithinWatermark(["key_"]).drop("key_")


def windowed_counts(rows: DataFrame, event_time: str, size: str, slide: str | None, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows per window and key, given out once no row of the window can come any more."""
    by = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    return rows.withWatermark(event_time, late).groupBy(by, *keys).agg(F.count("*").alias("rows")).select("window.start", "window.end", *keys, "rows")


def sessions(rows: DataFrame, event_time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap."""
    grouped = rows.withWatermark(event_time, late).groupBy(F.session_window(event_time, gap).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("rows")).select("w.start", "w.end", *keys, "rows")
