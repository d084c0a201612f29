"""Streams whose state ends by time: rows put in order once the watermark has passed them, cameras that go offline by a timer
of their own, keys forgotten after a while, and events in two phases joined from two streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, TimestampType

from fairground.sources.shared import shared_path

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keep_state_on_disk(spark: SparkSession) -> None:
    """State with timers needs a store that holds more than fits in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _millis(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64") // 1000


class _Reorder(StatefulProcessor):
    """Rows wait in a list until the watermark is past the earliest; one timer a key, at the earliest that waits."""

    def __init__(self, schema: StructType, event_time: str, order: list[str]) -> None:
        self.schema, self.event_time, self.order = schema, event_time, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.given = handle.getValueState("given", "n long")

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.waiting.get()), columns=self.schema.names)

    def _wait(self, rows: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(rows):
            self.waiting.put([tuple(None if v is pd.NaT or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in rows.itertuples(index=False, name=None)])
            self.handle.registerTimer(int(_millis(rows[self.event_time]).min()) + 1)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues):
        self._wait(pd.concat([self._held().astype(object), *[r.astype(object) for r in rows]], ignore_index=True))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rows = self._held()
        ready = _millis(rows[self.event_time]) < timerValues.getCurrentWatermarkInMs()
        out = rows[ready].sort_values(self.order).reset_index(drop=True)
        first = self.given.get()[0] if self.given.exists() else 0
        self.given.update((first + len(out),))
        self._wait(rows[~ready])
        out["place"] = range(first, first + len(out))
        yield out

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, out: StructType | str, mode: str) -> DataFrame:
    _keep_state_on_disk(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode=mode)


def reordered(rows: DataFrame, key: str, event_time: str, tie: str, late: str) -> DataFrame:
    """rows and place: every key's rows in the order of event_time (then tie), numbered from 0, however they come within the
    time that they may be late. A row comes out once the watermark has passed it, and never again; one that comes
    later than that is dropped. The state is what waits, and a number per key."""
    timed = rows.where(F.col(event_time).isNotNull()).withWatermark(event_time, late)
    out = StructType.fromJson(rows.schema.jsonValue()).add("place", "long")
    return _stateful(timed, key, _Reorder(rows.schema, event_time, [event_time, tie]), out, "EventTime")


class _Presence(StatefulProcessor):
    """The last row's time while a key is online, nothing while it is offline."""

    def __init__(self, key: str, event_time: str, silence_ms: int) -> None:
        self.key, self.event_time, self.silence = key, event_time, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def _frame(self, key, events: list) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(events), "status": pd.Series([e[0] for e in events], dtype=object), "at": pd.to_datetime([e[1] for e in events], unit="ms")})

    def handleInputRows(self, key, rows, timerValues):
        last, events = self.last.get()[0] if self.last.exists() else None, []
        for now in sorted(ms for r in rows for ms in _millis(r[self.event_time]).tolist()):
            if last is not None and now - last > self.silence:
                events.append(("OFFLINE", last + self.silence))
                last = None
            if last is None:
                events.append(("ONLINE", now))
            last = now if last is None else max(now, last)
        self._expect(last)
        yield self._frame(key, events)

    def _expect(self, last: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last,))
        self.handle.registerTimer(last + self.silence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = self.last.get()[0] + self.silence
        self.last.clear()  # an offline key takes no room
        yield self._frame(key, [("OFFLINE", at)])

    def close(self) -> None:
        pass


def presence(rows: DataFrame, key: str, event_time: str, silence_seconds: float, late: str) -> DataFrame:
    """key, status, at: ONLINE when a key is first heard of, OFFLINE once after so many seconds of silence, given out by a timer
    as soon as the watermark is there and not by the next row. A key that is offline has no state."""
    timed = rows.where(F.col(event_time).isNotNull() & F.col(key).isNotNull()).withWatermark(event_time, late)
    out = StructType().add(key, rows.schema[key].dataType).add("status", "string").add("at", TimestampType())
    return _stateful(timed.select(key, event_time), key, _Presence(key, event_time, round(silence_seconds * 1000)), out, "EventTime")


class _Once(StatefulProcessor):
    """Whether a key was seen, forgotten after the time to live."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        first = next(iter(rows), None)
        for _ in rows:  # the rest is read and left
            pass
        if first is not None and len(first) and not self.seen.exists():
            self.seen.update((True,))
            yield first.iloc[:1]

    def close(self) -> None:
        pass


def once(rows: DataFrame, key: str, remembered_seconds: float) -> DataFrame:
    """One row for each key, and no other until the key has been forgotten, so long after it came: the state is what came
    lately. Rows without a key are all one key's, null. For queries that run on, or batch by batch: the time is the
    clock's, so that Spark never runs out of batches to look for what is over."""
    return _stateful(rows, key, _Once(round(remembered_seconds * 1000)), rows.schema, "ProcessingTime")


def finalised(confirmed: DataFrame, ended: DataFrame, key: str, longest: str, late: str) -> DataFrame:
    """confirmed: key, confirmed_at and what the event is attributed to; ended: key, ended_at. The events with ended_at and status:
    `finalized` as soon as its end has come, within `longest` after it was confirmed; `confirmed`, without an
    end, once no end can come any more. Both streams have a watermark, so that either side is forgotten in time."""
    begun = confirmed.withWatermark("confirmed_at", late).alias("c")
    over = ended.select(F.col(key).alias("ended_key"), "ended_at").withWatermark("ended_at", late).alias("e")
    within = F.expr(f"c.`{key}` = e.ended_key AND e.ended_at >= c.confirmed_at AND e.ended_at <= c.confirmed_at + INTERVAL {longest}")
    status = F.when(F.col("ended_at").isNotNull(), "finalized").otherwise("confirmed")
    return begun.join(over, within, "left_outer").drop("ended_key").withColumn("status", status)


def limited(rows: DataFrame, key: str, ts: str, tie: str, most: int, seconds: float) -> DataFrame:
    """Rows with `accepted`: at most so many of a key within any time so long, by those accepted; the state of a key is the times of
    the last `most` that were."""
    from fairground.streaming.booth import _stateful as stepped

    schema = ", ".join(f"{c} {dict(bigint='long').get(t, t)}" for c, t in rows.dtypes)
    return stepped(rows, [key], [ts, tie], list, limit_step(ts, most, seconds), f"{schema}, accepted boolean")


def limit_step(ts: str, most: int, seconds: float) -> Callable:
    """state: times of rows accepted within the time, the oldest first. The same step runs in batches and streams."""
    def step(state: list, row: dict) -> tuple[list, list[dict]]:
        state = [t for t in state if row[ts] - t < seconds]
        free = len(state) < most
        return [*state, row[ts]] if free else state, [{**row, "accepted": free}]

    return step


def drained(rows: DataFrame, name: str, batches_of: int | None = None) -> DataFrame:
    """Runs a stream over all that is there now, into a table of the shared folder, and reads it back: for streams over
    finished logs."""
    spark = rows.sparkSession
    out = shared_path(spark, name)
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
