"""Streams over files that come one after another: order, silence, forgetting, two phases."""

import time
from datetime import datetime, timedelta

import pytest

from fairground.streaming import timers

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def source(spark, path, schema, parts):
    """A stream of one file for each part, in order."""
    stamps = iter(range(len(parts)))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{next(stamps):03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def progress(spark, rows, path):
    """All rows that come out, and the state rows after each batch."""
    query = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.schema(rows.schema).parquet(f"{path}/out"), sizes


@pytest.fixture(autouse=True)
def few_state_stores(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_reordered(spark, tmp_path):
    schema = "camera string, ts timestamp, id long"
    parts = [
        [("a", at(10), 1), ("a", at(4), 2), ("b", at(9), 3)],
        [("a", at(6), 4), ("a", at(10), 0), ("b", at(8), 5), ("a", None, 9)],  # late, within the ten seconds
        [("a", at(40), 6)],
        [("a", at(3), 7), ("a", at(41), 8)],  # the first is later, but nothing after it has come out yet
        [("c", at(100), 10)],
        [("a", at(5), 12)],  # too late

        [("c", at(101), 11)],
    ]
    out, sizes = progress(spark, timers.reordered(source(spark, tmp_path / "in", schema, parts), "camera", "ts", "id", "10 seconds"), tmp_path)
    got = {}
    for r in out.orderBy("camera", "place").collect():
        got.setdefault(r.camera, []).append((r.place, r.id))
    assert {k: [i for _, i in v] for k, v in got.items()} == {"a": [7, 2, 4, 0, 1, 6, 8], "b": [5, 3]}
    assert [p for p, _ in got["a"]] == list(range(7))
    assert sizes


def test_presence_goes_offline_by_a_timer(spark, tmp_path):
    schema = "camera long, ts timestamp"
    parts = [[(1, at(0)), (1, at(3)), (2, at(1))], [(1, at(4)), (2, at(2))], [(3, at(30))], [(3, at(33)), (1, at(34)), (3, at(50)), (None, at(50))], [(4, at(200))], [(4, at(201))]]
    out, sizes = progress(spark, timers.presence(source(spark, tmp_path / "in", schema, parts), "camera", "ts", 5.0, "2 seconds"), tmp_path)
    got = sorted((r.camera, (r.at - T0).total_seconds(), r.status) for r in out.collect())
    assert got == [(1, 0, "ONLINE"), (1, 9, "OFFLINE"), (1, 34, "ONLINE"), (1, 39, "OFFLINE"), (2, 1, "ONLINE"), (2, 7, "OFFLINE"), (3, 30, "ONLINE"), (3, 38, "OFFLINE"), (3, 50, "ONLINE"), (3, 55, "OFFLINE"), (4, 200, "ONLINE")]
    assert sizes[-1] < max(sizes)  # who is offline has no state


def test_once_forgets(spark, tmp_path):
    schema = "key string, v long"
    rows = timers.once(source(spark, tmp_path / "in", schema, [[("a", 1), ("a", 1), ("b", 2)]]), "key", 15.0)

    def run(number, part):
        """A batch of its own; the time to live is that of the clock, so that Spark would look for what is over for ever."""
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start()
        query.awaitTermination(60)
        query.stop()
        return sorted((r.key, r.v) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect())

    began = time.monotonic()
    assert run(900, None) == [("a", 1), ("b", 2)]
    again = run(901, [("a", 3)])
    if time.monotonic() - began < 14:
        assert again == [("a", 1), ("b", 2)]
    time.sleep(16)
    assert run(902, [("a", 4), ("c", 5)])[-1] == ("c", 5) and ("a", 4) in run(903, None)


def test_finalised(spark, tmp_path):
    held = source(spark, tmp_path / "held", "hold long, confirmed_at timestamp, product string", [[(1, at(0), "x"), (2, at(1), "y"), (3, at(2), "z")], [(4, at(20), "w")], [(5, at(200), "v")], [(6, at(210), "u")]])
    ends = source(spark, tmp_path / "ends", "hold long, ended_at timestamp", [[(1, at(5))], [(2, at(18)), (4, at(60)), (9, at(3))], [(7, at(205))], [(7, at(211))]])
    out, sizes = progress(spark, timers.finalised(held, ends, "hold", "30 seconds", "20 seconds"), tmp_path)
    got = sorted((r.hold, r.product, r.status, r.ended_at and (r.ended_at - T0).total_seconds()) for r in out.collect())
    # an end beyond the longest hold isn't this hold's; the last ones still wait for theirs
    assert got == [(1, "x", "finalized", 5), (2, "y", "finalized", 18), (3, "z", "confirmed", None), (4, "w", "confirmed", None)]
    assert sizes[-1] < max(sizes)


def test_limited_is_the_plain_window(spark, tmp_path):
    from fairground.operators.folds import fold

    rows = [(k % 3, float(i) * (0.3 + k % 2), i * 10 + k) for k in range(6) for i in range(40)]
    schema = "address long, ts double, id long"
    table = spark.createDataFrame(rows, schema)
    batch = fold(table, ["address"], ["ts", "id"], list, timers.limit_step("ts", 5, 3.0), f"{schema}, accepted boolean").collect()
    parts = [[r for r in rows if 10 * i <= r[1] < 10 * i + 10] for i in range(6)]
    out, _ = progress(spark, timers.limited(source(spark, tmp_path / "in", schema, parts), "address", "ts", "id", 5, 3.0), tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch))
    taken = {}
    for address, ts, _id, accepted in sorted(map(tuple, batch), key=lambda r: (r[1], r[2])):
        before = [t for t in taken.get(address, []) if ts - t < 3.0]
        assert accepted == (len(before) < 5)
        if accepted:
            taken.setdefault(address, []).append(ts)
