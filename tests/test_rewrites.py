"""Logs changed by parts: what isn't touched keeps its files; what fails changes nothing. Scopes of reports."""

import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fairground.functions import scope
from fairground.sources import rewrites

SCHEMA = "id long, booth string, ts double"


def files(path):
    return {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_only_touched_parts_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = [(i, ["a", "b", "c/d", None][i % 4], float(i)) for i in range(40)]
    rewrites.write(spark.createDataFrame(rows, SCHEMA), path, "booth")
    now = lambda: sorted((tuple(r) for r in rewrites.read(spark, path, SCHEMA).collect()), key=lambda r: r[0])
    assert now() == rows
    before, reader = files(tmp_path / "log"), rewrites.read(spark, path, SCHEMA)
    assert rewrites.delete(spark, path, SCHEMA, "booth", (F.col("booth") == "a") & (F.col("id") < 20)) == 1
    rows = [r for r in rows if not (r[1] == "a" and r[0] < 20)]
    after = files(tmp_path / "log")
    assert now() == rows and all(after[f] == t for f, t in before.items())  # no file was changed
    assert reader.count() == 40  # who reads an old version isn't disturbed
    assert rewrites.delete(spark, path, SCHEMA, "booth", F.col("booth") == "nowhere") == 0 and files(tmp_path / "log") == after
    # a booth joined to another: both are written again, the rest isn't
    assert rewrites.rename(spark, path, SCHEMA, "booth", "booth", "b", "c/d") == 1
    rows = [(i, "c/d" if b == "b" else b, t) for i, b, t in rows]
    assert now() == rows
    assert rewrites.delete(spark, path, SCHEMA, "booth", F.col("booth") == "c/d") == 1
    rows = [r for r in rows if r[1] != "c/d"]
    assert now() == rows and {r[1] for r in rows} == {"a", None}
    rewrites.write(spark.createDataFrame(rows[:3], SCHEMA), path, "booth")
    assert now() == rows[:3]
    assert rewrites.read(spark, f"{path}-none", SCHEMA).count() == 0


def test_a_crash_between_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    rows = [(i, "ab"[i % 2], float(i)) for i in range(10)]
    rewrites.write(spark.createDataFrame(rows, SCHEMA), path, "booth")

    def crash(*_):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(rewrites, "_publish", crash)
    with pytest.raises(RuntimeError):
        rewrites.delete(spark, path, SCHEMA, "booth", F.col("booth") == "a")
    monkeypatch.undo()
    assert sorted(map(tuple, rewrites.read(spark, path, SCHEMA).collect())) == rows  # what was written is nobody's
    assert rewrites.delete(spark, path, SCHEMA, "booth", F.col("booth") == "a") == 1
    assert sorted(map(tuple, rewrites.read(spark, path, SCHEMA).collect())) == [r for r in rows if r[1] == "b"]


def test_scope_of_a_day_with_a_clock_change(spark, monkeypatch):
    zone = spark.conf.get("spark.sql.session.timeZone")
    monkeypatch.setenv("TZ", "Europe/Berlin")
    time.tzset()
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for day in ("1995-03-26", "1995-09-24", "2024-01-09"):
            start = time.mktime(datetime.strptime(day, "%Y-%m-%d").timetuple())
            rows = [(1, start - 1), (2, start), (3, start + 86399), (4, start + 86400), (5, None)]
            table = spark.createDataFrame([(i, t, i % 2, None) for i, t in rows], "id long, ts double, booth_id long, camera_id long")
            assert sorted(r.id for r in scope.scope(table, date=day).collect()) == [2, 3]
            assert [r.id for r in scope.scope(table, date=day, booth_id=1).collect()] == [3]
            assert scope.scope(table, camera_id=1).count() == 0 and scope.scope(table, booth_id="").count() == 5
        with pytest.raises(ValueError, match="event_id"):
            scope.scope(table, event_id=1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        monkeypatch.undo()
        time.tzset()
