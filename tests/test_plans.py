"""Every query with SQL against DuckDB at the smallest scale; operators on cases with known results."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from fairground.operators import folds, sinks
from fairground.operators.balance import running_balance
from fairground.functions.scope import not_merged, period_start
from fairground.plans import catalog
from fairground.sources import documents, shared
from fairground.streaming import booth as live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(frame: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        # whole numbers with nulls among them come as floats from one side only
        return f"{float(v):.5f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    mine = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert plain(mine) == plain(duck.sql(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(mine.columns)


def readings(track, values, start=0.0, gap=1.0):
    return [{"camera_id": 1, "track_id": track, "ts": start + i * gap, "distance": d, "age": 1.0, "height": 0.5, "inside": 1} for i, d in enumerate(values)]


def run(step, state, rows):
    out = []
    for row in rows:
        state, made = step(state, row)
        out += made
    return out


def test_tripwire_cases():
    go = lambda values, gap=1.0: [(e["direction"], e["ts"]) for e in run(folds.tripwire_step, folds.tripwire_start(), readings(1, values, gap=gap))]
    assert go([-0.2, 0.2, 0.2]) == [("in", 2.0)]
    assert go([-0.2, 0.2, -0.2, 0.2]) == []
    assert go([-0.2, 0.2, 0.001, 0.2]) == [("in", 3.0)]  # the dead zone doesn't cancel what is pending
    touching = [{**r, "touches": abs(r["distance"]) < 0.1} for r in readings(1, [-0.2, 0.01, 0.01])]
    assert [(e["direction"], e["ts"]) for e in run(folds.tripwire_step, folds.tripwire_start(), touching)] == [("in", 2.0)]  # the box is on the line
    assert go([-0.2, 0.01, 0.01]) == []
    assert go([-0.2, 0.2, 0.2, -0.2, -0.2, 0.2, 0.2], gap=0.5) == [("in", 1.0), ("in", 3.0)]  # suppressed, but the side moved


def test_tripwire_stream_is_batch(spark, tmp_path):
    rows = [r for t in range(20) for r in readings(t, [(-1) ** ((i // 3 + t) % 2) * 0.2 for i in range(30)])]
    schema = "camera_id long, track_id long, ts double, distance double, age double, height double, inside int"
    table = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    batch = folds.tripwire(table).collect()
    for part in range(3):
        table.where(f"ts >= {part * 10} AND ts < {part * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.tripwire(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert batch and sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch))


def test_hold_cases():
    rows = lambda spec: [{"camera_id": 1, "product": 1, "ts": t, "moved": m, "holder": h} for t, m, h in spec]
    go = lambda spec: [(e["event"], e["holder"], e["ts"]) for e in run(folds.hold_step, folds.hold_start(), rows(spec))]
    assert go([(0, True, 7), (1.9, True, 7), (2.5, False, None)]) == []
    assert go([(0, True, 7), (2.0, True, 7), (3.0, False, None)]) == [("confirmed", 7, 2.0), ("finalized", 7, 3.0)]
    assert go([(0, True, 7), (2.0, True, 7), (2.5, True, 8), (4.6, True, 8)]) == [("confirmed", 7, 2.0), ("finalized", 7, 2.5), ("confirmed", 8, 4.6)]
    assert go([(0, True, 7), (2.0, True, 7), (2.5, False, 8), (4.0, False, 7), (5.0, False, None)]) == [("confirmed", 7, 2.0), ("finalized", 7, 5.0)]  # touched by another, not moved
    assert go([(0, True, 7), (2.0, True, 7), (9.0, False, None)]) == [("confirmed", 7, 2.0), ("finalized", 7, 2.0)]


def test_resting_places():
    rows = lambda spec: [{"camera_id": 1, "product": 1, "ts": float(t), "cx": float(x), "cy": 0.0, "holder": h} for t, x, h in spec]
    go = lambda spec: [(e["event"], e["holder"], e["ts"]) for e in run(folds.placed_step, folds.placed_start(), rows(spec))]
    assert go([(0, 0, 7), (1, 15, 7), (2, 5, 7), (3, 10, 7)]) == []  # touched, but where it rests
    assert go([(0, 0, 7), (1, 30, 7), (2, 60, 7), (3, 90, 7), (4, 91, None)]) == [("confirmed", 7, 3.0), ("finalized", 7, 4.0)]
    assert go([(0, 0, None), *[(t, 0, None) for t in range(2, 13, 2)], (13, 40, None), (15, 40, None), (17, 40, None), (19, 40, None), (21, 40, None), (23, 40, None)]) == [("settled", None, 10.0), ("settled", None, 23.0)]
    assert go([(0, 0, None), (9, 50, 7), (10, 80, 7), (11, 110, 7)]) == []  # gone for too long: seen anew at 9, held from 10


def test_holds_stream_is_batch(spark, tmp_path):
    rows = [(1, p, float(t), float((t // 5 + p) % 3 * 30), 0.0, 7 if t % 11 < 6 else None) for p in range(8) for t in range(60)]
    schema = "camera_id long, product long, ts double, cx double, cy double, holder long"
    table = spark.createDataFrame(rows, schema)
    for part in range(3):
        table.where(f"ts >= {part * 20} AND ts < {part * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.product_holds(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    batch = folds.placed_products(table).collect()
    assert batch and sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch))


def test_fan_out(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "id % 3 AS kind")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.into_tables(stream, str(tmp_path / "out"), {"all": lambda x: x, "odd": lambda x: x.where("kind = 1")}, str(tmp_path / "state")).awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "out/all")).count() == 10 and spark.read.parquet(str(tmp_path / "out/odd")).count() == 3


def test_documents(spark):
    docs = spark.createDataFrame([('{"_note": {"name": "x"}, "a": {"name": "A", "price": "1"}}',), ('[{"key": "b", "name": "B"}]',), ('{"products": {"c": {"name": "C"}}}',), ("broken",), (None,)], "document string")
    assert sorted((r.key, r.name) for r in documents.catalog(docs).collect()) == [("a", "A"), ("b", "B"), ("c", "C")]
    good, refused = documents.registered_products(spark.createDataFrame([('{"products": [{"id": "1", "name": "x"}, {"id": "2", "size": "9"}, {"id": "3"}, {"id": "3"}]}',)], "document string"))
    assert [r.id for r in good.collect()] == ["1"] and sorted(map(tuple, refused.collect())) == [("2", "unknown field"), ("3", "duplicate id")]


def test_sheets(spark, tmp_path):
    full, empty = spark.createDataFrame([(1, "a,b"), (2, None)], "x long, y string"), spark.createDataFrame([], "x long")
    for kind in ("csv", "json"):
        found = shared.write_sheets({"full": full, "empty": empty}, str(tmp_path / kind), kind)
        assert sorted(map(tuple, found["full"].collect())) == [(1, "a,b"), (2, None)] and [r.note for r in found["empty"].collect()] == ["no data"]


def test_balance_floors_at_each_step(spark):
    rows = spark.createDataFrame([(1, i, float(i), d) for i, d in enumerate(["out", "out", "in", "in", "out"])], "booth_id long, id long, ts double, direction string")
    assert [r.balance for r in running_balance(rows, ["booth_id"]).orderBy("id").collect()] == [0, 0, 1, 2, 1]


def test_sinks(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 3)], "key string, x long")
    assert sinks.idempotent(rows, "key").count() == 3
    merged = sinks.resolve_merges(spark.createDataFrame([(i + 1, i) for i in range(9)], "loser long, winner long"))
    assert {r.winner for r in merged.collect()} == {0}
    ended = sinks.finalise(spark.createDataFrame([(1, "p", None), (2, "q", None)], "id long, who string, end double"), spark.createDataFrame([(1, 5.0)], "id long, end double"), "id", ["end"])
    assert sorted(map(tuple, ended.collect())) == [(1, "p", 5.0), (2, "q", None)]
    with pytest.raises(ValueError):
        sinks.delete_scope(rows)
    assert sinks.delete_scope(rows, confirm_all=True).count() == 0


def test_periods(spark):
    from datetime import datetime

    now = datetime(2024, 1, 30, 15, 0)
    midnight = datetime(2024, 1, 30).timestamp()
    assert period_start("today", now) == midnight and period_start("7d", now) == midnight - 6 * 86400 and period_start("all", now) == 0
    assert period_start("today", now, datetime(2024, 1, 30, 9)) == midnight + 9 * 3600 and period_start("today", now, datetime(2024, 1, 29, 9)) == midnight
    names = spark.createDataFrame([("Merged:1",), ("x",)], "id string")
    assert [r.id for r in names.where(not_merged("id")).collect()] == ["x"]
