"""Debounced decisions on cases with known results; greedy pairs against a brute-force version."""

import random

from fairground.functions import geometry as G
from fairground.operators import decisions as D
from fairground.operators import runs as R


def run(step, state, rows):
    out = []
    for row in rows:
        state, made = step(state, row)
        out += made
    return out


def test_greedy_pairs_are_brute_force(spark):
    rng = random.Random(3)
    rows = [(1, f, r, c, round(rng.random(), 1)) for f in range(30) for r in range(5) for c in range(4) if rng.random() < 0.7]
    want = []
    for frame in range(30):
        rows_taken, cols_taken = set(), set()
        for _, f, r, c, iou in sorted((x for x in rows if x[1] == frame), key=lambda x: (x[4], x[2], x[3]), reverse=True):
            if r not in rows_taken and c not in cols_taken:
                rows_taken.add(r)
                cols_taken.add(c)
                want.append((1, f, r, c, iou))
    table = spark.createDataFrame(rows, "camera_id long, frame long, row long, col long, iou double")
    assert sorted(map(tuple, D.greedy_pairs(table).collect())) == sorted(want)


def test_scan_switch():
    scans = [("matched", 1), ("matched", 1), ("matched", 2), ("matched", 1), ("matched", 2), ("unstable", None), ("matched", 2), ("unknown", None), ("unknown", None), ("matched", 3)]
    rows = [{"camera_id": 1, "scan_id": i, "status": s, "product_id": p} for i, (s, p) in enumerate(scans)]
    assert [(e["scan_id"], e["product_id"]) for e in run(D.scan_step, D.scan_start(), rows)] == [(0, 1), (6, 2), (8, None), (9, 3)]


def test_presence_needs_frames_and_seconds(spark):
    def go(gap, ratios):
        table = spark.createDataFrame([(1, i, i * gap, r) for i, r in enumerate(ratios)], "camera_id long, id long, ts double, ratio double")
        return [r.state for r in R.presence(table, "camera_id", "ts", "id", "ratio").orderBy("ts").collect()]

    assert go(0.1, [0.2] * 9 + [0.1] + [0.2] * 9) == []
    assert go(0.1, [0.2] * 10) == ["PRESENT"]
    assert go(0.01, [0.2] * 40) == []
    assert go(0.1, [0.2] * 10 + [0.0] * 12) == ["PRESENT", "EMPTY"]


def test_hysteresis(spark):
    rows = [(1, i, float(i), v) for i, v in enumerate([70, 70, 50, 70, 70, 70, 30, 70, 30, 30, 30, 30])] + [(1, 99, None, 70)]
    table = spark.createDataFrame(rows, "k long, id long, ts double, v long")
    assert sorted((r.ts, r.state) for r in R.hysteresis(table, "k", "ts", "id", "v", 60, 40, 2.0).collect()) == [(5.0, "paused"), (10.0, "resumed")]


def test_device_changes():
    polls = [["a"], ["a", "b"], ["a"], None, ["a", "b"], ["a"], ["a"], ["a"]]
    rows = [{"machine": 1, "ts": float(i), "devices": d} for i, d in enumerate(polls)]
    assert [(e["ts"], e["added"], e["removed"]) for e in run(D.device_step, D.device_start(), rows)] == [(1.0, "b", ""), (6.0, "", "b")]


def test_interactions(spark):
    rows = [(1, 1, i, float(i), o, x, 0.0) for i, (o, x) in enumerate([(0.0, 0.0), (0.1, 0.0), (0.1, 10.0), (0.1, 16.0), (0.0, 16.0), (0.0, 16.0), (0.0, 16.0)])]
    table = spark.createDataFrame(rows, "person long, product long, id long, ts double, iou double, cx double, cy double")
    got = [r.status for r in R.interactions(table, "id").orderBy("ts").collect()]
    assert got == ["UNKNOWN", "POSSIBLE_INTERACTION", "POSSIBLE_INTERACTION", "CONFIRMED_INTERACTION", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_confirmation(spark):
    rows = [(1, 1, i, ts, x, 0.0, x + 2, 2.0, n) for i, (ts, x, n) in enumerate([(0.0, 0.0, 2), (1.0, 0.1, 2), (2.0, 9.0, 2), (3.0, 0.0, 4), (9.0, 0.0, 2)])]
    table = spark.createDataFrame(rows, "camera_id long, product long, id long, ts double, x1 double, y1 double, x2 double, y2 double, needed int")
    found = R.supported(table, ["camera_id", "product"], "ts", "id", G.iou).orderBy("ts").collect()
    assert [r.support + 1 >= r.needed for r in found] == [False, True, False, False, False]


def test_agreement():
    row = lambda ts, camera, **found: {"booth_id": 1, "ts": ts, "camera_id": camera, "found": list(found.items())}
    go = lambda rows: [(e["ts"], e["product"], e["reason"], e["confidence"]) for e in run(D.agreement_step, D.agreement_start(), rows)]
    assert go([row(10.0, 1, a=0.5), row(10.5, 2, a=0.9)]) == [(10.5, "a", "multi_camera_agreement", 0.9)]
    assert go([row(10.0 + i / 2, 1, a=0.5) for i in range(4)]) == [(11.5, "a", "single_camera_stable", 0.5)]
    assert go([row(10.0, 1, a=0.5), row(11.0, 2, a=0.9)]) == []
    both = [row(10.0, 1, a=0.5), row(10.1, 2, a=0.9), row(10.2, 1, b=0.5), row(10.3, 2, b=0.5), row(10.8, 1, b=0.5), row(11.2, 2, b=0.5), row(11.7, 1, b=0.5), row(12.2, 2, b=0.6)]
    assert go(both) == [(10.1, "a", "multi_camera_agreement", 0.9), (12.2, "b", "multi_camera_agreement", 0.6)]
