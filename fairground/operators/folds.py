"""Operators whose state depends on which earlier rows they took: folds over a key's rows in order.

Each has a plain step over one row and the state so far. Batches run it over the sorted rows of a key
as they arrive, holding one state; streams keep the same state per key (fairground.streaming)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Run step(state, row) -> (state, outputs) over every key's rows in order.

    The rows are dealt out by key and sorted within their partition; a key's rows pass by one after
    another, so a key with very many rows needs no more memory than another."""
    names = rows.columns

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, start()
                state, made = step(state, row)
                out += made
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(names).mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def throttle(rows: DataFrame, key: str, ts: str, tie: str, interval: float) -> DataFrame:
    """A key's rows that come at least interval after the last row taken (not a tumbling window)."""
    def step(last, row):
        if row[ts] is None:
            return last, []
        if last is None or row[ts] - last >= interval:
            return row[ts], [row]
        return last, []

    schema = ", ".join(f"{c} {dict(bigint='long').get(t, t)}" for c, t in rows.dtypes)
    return fold(rows, [key], [ts, tie], lambda: None, step, schema)


#: Dead zone of the line, least age of a track, least height of its box, readings that confirm a new
#: side, seconds between two events of a track (fixed values).
AMBIGUOUS, LEAST_AGE, LEAST_HEIGHT, READINGS, COOLDOWN = 0.015, 0.3, 0.05, 2, 1.5


def tripwire_start() -> dict:
    return {"side": None, "pending": 0, "last": None}


def tripwire_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """row: camera_id, track_id, ts, signed distance (null within no line), age, height, inside (the
    side that counts as inside, 1 or -1), and touches (whether the line cuts the box; without it, no).
    A reading in the dead zone changes nothing, unless the box touches the line: then its side counts
    however near. A new side must be read READINGS times in a row; a crossing within the cooldown moves
    the side but is no event."""
    d = row["distance"]
    unclear = d is None or (abs(d) < AMBIGUOUS and not row.get("touches"))
    if unclear or row["age"] < LEAST_AGE or row["height"] < LEAST_HEIGHT:
        return state, []
    side = 1 if d >= 0 else -1
    if state["side"] is None:
        return {**state, "side": side, "pending": 0}, []
    if side == state["side"]:
        return {**state, "pending": 0}, []
    pending = state["pending"] + 1
    if pending < READINGS:
        return {**state, "pending": pending}, []
    if state["last"] is not None and row["ts"] - state["last"] < COOLDOWN:
        return {"side": side, "pending": 0, "last": state["last"]}, []
    event = {"camera_id": row["camera_id"], "track_id": row["track_id"], "ts": row["ts"], "direction": "in" if side == row["inside"] else "out"}
    return {"side": side, "pending": 0, "last": row["ts"]}, [event]


CROSSING = "camera_id long, track_id long, ts double, direction string"


def tripwire(rows: DataFrame, tie: str | None = None) -> DataFrame:
    """tie: a column that orders readings of one time."""
    return fold(rows, ["camera_id", "track_id"], ["ts", tie] if tie else ["ts"], tripwire_start, tripwire_step, CROSSING)


#: Seconds of holding that confirm interest, of absence that end it (fixed values).
CONFIRM_AFTER, ABSENT_AFTER = 2.0, 3.0


def hold_start() -> dict:
    return {"holder": None, "since": None, "last": None, "confirmed": False}


def hold_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """row: camera_id, product, ts, moved (from its resting place), holder (a track touching it or
    null). Held from the first moved row with a holder; confirmed once after CONFIRM_AFTER; another holder
    who moves it ends one hold and begins the next, who only touches it doesn't; released when it rests and nobody touches it, or after absence."""
    out = []

    def end(at: float) -> None:
        if state["confirmed"]:
            out.append(_hold(row, "finalized", state, at))

    if state["holder"] is not None and row["ts"] - state["last"] > ABSENT_AFTER:
        end(state["last"])
        state = hold_start()
    if state["holder"] is None:
        if row["moved"] and row["holder"] is not None:
            state = {"holder": row["holder"], "since": row["ts"], "last": row["ts"], "confirmed": False}
        return state, out
    if row["holder"] is None and not row["moved"]:
        end(row["ts"])
        return hold_start(), out
    if row["moved"] and row["holder"] is not None and row["holder"] != state["holder"]:
        end(row["ts"])
        return {"holder": row["holder"], "since": row["ts"], "last": row["ts"], "confirmed": False}, out
    state = {**state, "last": row["ts"]}
    if not state["confirmed"] and row["ts"] - state["since"] >= CONFIRM_AFTER:
        state = {**state, "confirmed": True}
        out.append(_hold(row, "confirmed", state, row["ts"]))
    return state, out


def _hold(row: dict, event: str, state: dict, at: float) -> dict:
    return {"camera_id": row["camera_id"], "product": row["product"], "event": event, "holder": state["holder"], "start_ts": state["since"], "ts": at}


HOLD = "camera_id long, product long, event string, holder long, start_ts double, ts double"

#: Pixels from its resting place from which on a product has moved, and seconds at rest after which it is
#: settled (fixed values).
MOVED_PX, SETTLED_AFTER = 20.0, 10.0


def placed_start() -> dict:
    return {"rest": None, "since": None, "seen": None, "settled": False, "hold": hold_start()}


def placed_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """row: camera_id, product, ts, cx, cy (the middle of its box), holder. hold_step with the resting place
    kept here: where a product is first seen, is put down, or lies after it was moved by nobody in sight,
    and with every step of who holds it. A product that has lain there long enough is `settled`, once."""
    now, at = row["ts"], (row["cx"], row["cy"])
    first = state["rest"] is None or now - state["seen"] > ABSENT_AFTER
    moved = not first and ((at[0] - state["rest"][0]) ** 2 + (at[1] - state["rest"][1]) ** 2) ** 0.5 > MOVED_PX
    was_held = state["hold"]["holder"] is not None
    hold, out = hold_step(state["hold"], {**row, "moved": moved, "holder": None if first else row["holder"]})
    held = hold["holder"] is not None
    state = {**state, "hold": hold, "seen": now}
    if held:
        return {**state, "rest": at if moved and row["holder"] is not None else state["rest"], "since": None, "settled": False}, out
    if first or moved or was_held:
        return {**state, "rest": at, "since": now, "settled": False}, out
    if not state["settled"] and now - state["since"] >= SETTLED_AFTER:
        state["settled"] = True
        out.append({"camera_id": row["camera_id"], "product": row["product"], "event": "settled", "holder": None, "start_ts": state["since"], "ts": now})
    return state, out


def placed_products(rows: DataFrame, tie: str | None = None) -> DataFrame:
    return fold(rows, ["camera_id", "product"], ["ts", tie] if tie else ["ts"], placed_start, placed_step, HOLD)


def product_holds(rows: DataFrame, tie: str | None = None) -> DataFrame:
    return fold(rows, ["camera_id", "product"], ["ts", tie] if tie else ["ts"], hold_start, hold_step, HOLD)
