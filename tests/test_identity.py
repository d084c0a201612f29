"""Assignment, trackers and identities: against brute force, on scenes and on cases with known results."""

import itertools
import math
import random

import numpy as np

from fairground.operators import identity as I
from fairground.operators import tracking as T


def run(step, state, rows):
    out = []
    for row in rows:
        state, made = step(state, row)
        out += made
    return out


def test_assignment_is_the_best():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        gain = rng.integers(0, 9, (n, m)).astype(float)
        pairs = T.assign(gain)
        assert len(pairs) == min(n, m) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        wide = gain if n <= m else gain.T
        best = max(sum(wide[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert sum(gain[r, c] for r, c in pairs) == best


def test_optimal_pairs(spark):
    rows = [(1, 1, 1, 1, 0.6), (1, 1, 1, 2, 0.5), (1, 1, 2, 1, 0.5), (1, 2, 7, 9, 0.3)]
    table = spark.createDataFrame(rows, "camera_id long, frame long, row long, col long, iou double")
    assert sorted((r.frame, r.row, r.col) for r in T.optimal_pairs(table).collect()) == [(1, 1, 2), (1, 2, 1), (2, 7, 9)]


def scene(seed, people=6, seconds=40, rate=3):
    """People who cross a hall on paths of their own; boxes jitter, are missed, and some are none."""
    rng = random.Random(seed)
    paths = [(rng.uniform(0, 900), rng.uniform(0, 500), rng.uniform(-12, 12), rng.uniform(-8, 8)) for _ in range(people)]
    rows, number = [], 0
    for i in range(seconds * rate):
        ts = i / rate
        for p, (x, y, vx, vy) in enumerate(paths):
            if rng.random() < 0.08:
                continue
            cx, cy = x + vx * ts + rng.gauss(0, 1.5), y + vy * ts + rng.gauss(0, 1.5)
            rows.append((seed, ts, number, cx, cy, cx + 60, cy + 160, 0.9 if rng.random() > 0.1 else 0.3, p))
            number += 1
        if rng.random() < 0.05:
            cx, cy = rng.uniform(0, 900), rng.uniform(0, 500)
            rows.append((seed, ts, number, cx, cy, cx + 60, cy + 160, 0.75, -1))
            number += 1
    return rows


def test_trackers_keep_identities(spark):
    rows = [r for seed in range(6) for r in scene(seed)]
    table = spark.createDataFrame(rows, "camera_id long, ts double, id long, x1 double, y1 double, x2 double, y2 double, score double, true long")
    table = table.withColumn("id", table.id + table.camera_id * 100000)
    for how in (T.BOOTH, T.SERVER, T.PRODUCT):
        found = T.tracked(table.drop("true"), how).withColumnRenamed("camera_id", "scene")
        scores = T.identity_scores(table.where(table["true"] >= 0).select(table.camera_id.alias("scene"), "ts", "id", table["true"]), found).collect()
        assert len(scores) == 6 and sum(s.idf1 for s in scores) / 6 >= 0.85, (how, scores)


def test_identity_scores(spark):
    truth = [(1, float(t), t * 2 + p, p) for t in range(4) for p in range(2)]
    found = [(1, 0, 10), (1, 2, 10), (1, 4, 11), (1, 6, 11), (1, 1, 20), (1, 5, 20), (1, 7, 20)]
    got = T.identity_scores(spark.createDataFrame(truth, "scene long, ts double, id long, true long"), spark.createDataFrame(found, "scene long, id long, track long")).first()
    # of the first, two frames of four are one track's; of the second, three are found
    assert (got.switches, got.fragments, got.idf1) == (1, 1, round(2 * 5 / 15, 6))


def test_identity_assignment():
    track = lambda n, ts, angle, camera=1, clothing=1, body=1: {"booth_id": 1, "track": n, "camera_id": camera, "ts": ts, "look": [math.cos(angle), math.sin(angle)] if angle is not None else None, "clothing": clothing, "body": body}
    go = lambda rows: [(e["person"], e["status"]) for e in run(I.assign_step, (1, []), rows)]
    assert go([track(1, 0.0, 0.0), track(2, 5.0, 0.1), track(3, 9.0, 1.5, clothing=2)]) == [("PERSON-0001", "NEW"), ("PERSON-0001", "MATCH"), ("PERSON-0002", "NEW")]
    assert go([track(1, 0.0, 0.0), track(2, 1000.0, 0.0)])[1] == ("PERSON-0002", "NEW")  # forgotten
    assert go([track(1, 0.0, 0.0), track(2, 5.0, 0.0, clothing=None, body=None)])[1] == ("PERSON-0002", "UNCERTAIN")  # one signal never suffices
    one = run(I.assign_step, (1, []), [track(1, 0.0, 0.0), track(2, 5.0, 0.0, clothing=None, body=None)])[1]
    assert (one["score"], one["linked"]) == (0.79, "PERSON-0001")
    assert go([track(1, 0.0, 0.0), track(2, 5.0, 1.2)])[1][1] == "UNCERTAIN"


def plain_assign_step(state, row):
    """The whole rule, one person after another."""
    number, persons = state
    persons = [p for p in persons if row["ts"] - p["ts"] <= I.FORGET]
    scores = [I._score(row, p) for p in persons]
    best = max(range(len(scores)), key=lambda i: (scores[i], -i), default=None)
    score = round(scores[best], 6) if best is not None else 0.0
    if best is not None and score >= I.SURE:
        name, status, linked = persons[best]["name"], "MATCH", None
        persons = [{**p, "ts": row["ts"], "camera_id": row["camera_id"]} if i == best else p for i, p in enumerate(persons)]
    else:
        name, status = f"PERSON-{number:04d}", "UNCERTAIN" if score >= I.PERHAPS else "NEW"
        linked = persons[best]["name"] if status == "UNCERTAIN" else None
        number += 1
        persons = [*persons, {**{c: row[c] for c in ("look", "clothing", "body", "ts", "camera_id")}, "name": name}]
    return (number, persons), [{"booth_id": row["booth_id"], "track": row["track"], "person": name, "status": status, "score": score, "linked": linked}]


def test_assignment_compares_all_at_once(monkeypatch):
    """The same persons, scores and links as one after another; few of them are scored on their own."""
    asked, score = [], I._score
    monkeypatch.setattr(I, "_score", lambda *a: asked.append(0) or score(*a))
    for seed in range(12):
        rng = random.Random(seed)
        rows, ts = [], 0.0
        for i in range(400):
            ts += rng.choice([0.0, 1.0, 2.5, 40.0 if seed % 2 else 7.0])
            angle = rng.randrange(40) / 6
            look = None if rng.random() < 0.1 else [] if rng.random() < 0.02 else [math.cos(angle), math.sin(angle)]
            rows.append({"booth_id": 1, "track": i, "camera_id": rng.randrange(3), "ts": ts, "look": look, "clothing": rng.choice([None, 0, 1, 2]), "body": rng.choice([None, "a", "b"])})
        plain = run(plain_assign_step, (1, []), rows)
        before = len(asked)
        asked.clear()
        assert run(I.assign_step, (1, []), rows) == plain and {e["status"] for e in plain} == {"MATCH", "NEW", "UNCERTAIN"}
        assert len(asked) < before / 5
        asked.clear()


def test_evidence():
    rows = [{"user_id": 1, "ts": float(t), "id": t, "logit": x, "face": True, "weight": 1.0} for t, x in [(0, 9.0), (1, 9.0), (2, -9.0), (3, -9.0), (4, -9.0), (20, 1.0)]]
    got = [(e["label"], round(e["evidence"], 6)) for e in run(I.evidence_step, {"e": 0.0, "n": 0, "faces": 0, "label": None, "ts": None}, rows)]
    assert got[0] == ("UNKNOWN", 2.5) and got[1] == ("MALE", 4.875) and got[2][0] == "MALE" and got[3][0] == "UNKNOWN" and got[4][0] == "FEMALE" and got[5] == ("UNKNOWN", 1.0)


    sample = lambda t, x, face, weight=1.0: {"user_id": 1, "ts": float(t), "id": t, "logit": x, "face": face, "weight": weight}
    go = lambda rows: [(e["label"], round(e["evidence"], 6)) for e in run(I.evidence_step, I.evidence_start(), rows)]
    assert go([sample(0, 1.0, True), sample(1, 1.5, False)]) == [("UNKNOWN", 1.0), ("UNKNOWN", 2.45)]  # one face isn't two
    assert go([sample(0, 2.0, True), sample(1, 9.0, False, 0.0), sample(2, 2.0, True)]) == [("UNKNOWN", 2.0), ("UNKNOWN", 2.0), ("MALE", 3.9)]
    assert go([sample(t, 1.5, False) for t in range(4)])[-2:] == [("UNKNOWN", 4.27875), ("MALE", 5.564812)]


def test_tracks_begin_and_end():
    def frames(how, found):
        """found: (ts, x, score) of a box of ten pixels, or (ts,) for a frame without."""
        rows = [{"camera_id": 1, "ts": float(f[0]), "found": [{"id": i, "x1": f[1], "y1": 0.0, "x2": f[1] + 10, "y2": 10.0, "score": f[2]}] if len(f) > 1 else []} for i, f in enumerate(found)]
        return [(e["ts"], e["track"], e["confirmed"]) for e in run(T.frame_step(how), (1, []), rows)]

    assert frames(T.BOOTH, [(t, 0.0, 0.6) for t in range(3)]) == [(0.0, 1, False), (1.0, 1, True), (2.0, 1, True)]  # 0.6 begins a track, tentatively
    assert frames(T.BOOTH, [(0, 0.0, 0.7), (1,), (2, 0.0, 0.7)]) == [(0.0, 1, True), (2.0, 1, True)]
    assert frames(T.BOOTH, [(0, 0.0, 0.9), (1, 5.0, 0.9), (2, 5.0, 0.9), (3, 0.0, 0.9)])[-1][1] == 1  # turned round: the last box counts too
    seen = [(t, 0.0, 0.9) for t in range(3)]
    assert [x[1] for x in frames(T.SERVER, [*seen, *[(t,) for t in range(3, 33)], (33, 0.0, 0.9)])] == [1] * 4
    assert [x[1] for x in frames(T.SERVER, [*seen, *[(t,) for t in range(3, 200)], (200, 0.0, 0.9)])] == [1, 1, 1, 2]
    small = [{"camera_id": 1, "ts": 0.0, "found": [{"id": 1, "x1": 0.0, "y1": 0.0, "x2": 7.0, "y2": 9.0, "score": 0.9}]}]
    assert run(T.frame_step(T.SERVER), (1, []), small) == []


def test_streaks_and_merges(spark):
    reasons = ["low", "low", None, "low", "low", "low", "gender", "gender", "hair", "hair", "hair", "face", "colour", "face", "face"]
    checks = spark.createDataFrame([(1, float(i), i, r) for i, r in enumerate(reasons)], "track long, ts double, id long, reason string")
    assert sorted((r.id, r.reason) for r in I.splits(checks).collect()) == [(5, "low"), (7, "gender"), (14, "face")]
    persons = spark.createDataFrame([(1, 1, 5.0, True), (1, 2, 1.0, True), (1, 3, 2.0, False), (1, 4, 3.0, False)], "booth_id long, person long, first_seen double, confirmed boolean")
    pairs = spark.createDataFrame([(1, 1, 2, 0.65), (1, 1, 3, 0.3), (1, 2, 3, 0.31), (1, 3, 4, 0.9), (1, 1, 4, 0.1), (1, 2, 4, 0.2)], "booth_id long, a long, b long, sim double")
    assert [(r.loser, r.winner) for r in I.merges(pairs, persons).collect()] == [(1, 2)]
