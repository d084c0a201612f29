"""What a reviewer found: cases in which results were wrong, or work grew with the square of the input."""

from functools import reduce

import numpy as np
import pyarrow as pa

from fairground.operators import decisions, identity, rounds, vectors
from fairground.plans import identity as identity_plans
from fairground.plans import reports


def test_a_frame_as_sharp_as_its_gate_passes(spark):
    """A quarter of 134.27 and 203.71 at one quarter of the way is 37.9075, once rounded."""
    for low, high, sharp in ((134.27, 203.71, 37.9075), (174.15, 253.43, 48.4925)):
        rows = [(1, v) for v in (sharp, sharp, low, high)] + [(2, 9.0), (3, 1.0), (4, None), (5, 3.0), (5, 70.0), (5, None)]
        found = reports.sharp_frames(spark.createDataFrame(rows, "user_id long, value double")).collect()
        assert sorted(map(tuple, found)) == [(1, 4, sharp), (2, 1, 8.0), (5, 1, 13.3125)]


def looks(n=600, dim=8, seed=2):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    v[n // 2 :] = v[: n // 2]  # every look twice, under another product
    return [(i, i % 7 + (i >= n // 2) * 100, i % 3, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]


def test_best_looks_are_found_by_blocks(spark, monkeypatch):
    """Of several blocks of each side; equal looks have equal dots to the last bit; no pair of rows goes through a shuffle."""
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rows = looks()
    table = spark.createDataFrame(rows, "other long, product long, camera long, v array<double>")
    asked = table.where("other % 5 = 0").selectExpr("other AS query", "v")
    frame = vectors.best_looks(asked, table.selectExpr("other", "product", "v AS g"))
    assert "SortMergeJoin" not in (plan := frame._jdf.queryExecution().toString()) and "BroadcastHashJoin" not in plan
    got = {(r["query"], r["product"]): r["score"] for r in frame.collect()}
    v = {i: x for i, _, _, x in rows}
    dot = lambda a, b: reduce(lambda s, xy: s + xy[0] * xy[1], zip(a, b, strict=True), 0.0)
    want = {}
    for q in range(0, 600, 5):
        for i, p, _, x in rows:
            if i != q:
                want[q, p] = max(want.get((q, p), -2.0), dot(v[q], x))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert got[0, 300 % 7 + 100] == dot(v[0], v[0])
    assert vectors.best_looks(asked.limit(0), table.selectExpr("other", "product", "v AS g")).count() == 0
    assert vectors.best_looks(asked, table.selectExpr("other", "product", "v AS g").limit(0)).count() == 0


def test_best_and_mean_looks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rows = looks(240)
    stored = [(i, p, c, True, v) for i, p, c, v in rows] + [(None, p, c, False, rows[p % 7][3]) for p in {r[1] for r in rows} for c in range(3)] + [(900, 55, 1, True, [0.0] * 8)]
    asked = [(i, c, v) for i, _, c, v in rows if i % 20 == 0] + [(900, 2, [1.0] + [0.0] * 7)]
    got = vectors.best_and_mean_looks(spark.createDataFrame(asked, "query long, own long, v array<double>"), spark.createDataFrame(stored, "other long, label long, camera long, single boolean, g array<double>"), 2, 0.35).collect()
    unit = lambda x: x / n if (n := np.linalg.norm(x)) > 1e-12 else x * 0
    want = {}
    for q, own, v in asked:
        for i, p, c, single, g in stored:
            if i != q:
                a, b = np.array(v), np.array(g)
                sim = unit(a) @ unit(b) if own == c else 0.65 * unit(a[:-2]) @ unit(b[:-2]) + 0.35 * unit(a[-2:]) @ unit(b[-2:])
                e = want.setdefault((q, p), [-9.0, -9.0, 0])
                e[not single] = max(e[not single], sim)
                e[2] += single
    plain = lambda x: -9.0 if x is None else x
    found = {(r["query"], r["label"]): (plain(r["best"]), plain(r["mean"]), r["n"]) for r in got}
    assert found.keys() == want.keys()
    assert all(np.allclose(found[k], want[k], atol=1e-12) for k in want)
    empty = spark.createDataFrame(stored, "other long, label long, camera long, single boolean, g array<double>").limit(0)
    assert vectors.best_and_mean_looks(spark.createDataFrame(asked, "query long, own long, v array<double>"), empty, 2, 0.35).count() == 0


def all_greedy(a, b, least):
    """Every pair, one after another."""
    made, pairs = {}, []
    for i, x in a:
        for j, y in b:
            w, h = (max(0.0, min(x[k + 2], y[k + 2]) - max(x[k], y[k])) for k in (0, 1))
            union = sum((z[2] - z[0]) * (z[3] - z[1]) for z in (x, y)) - w * h
            pairs.append((round(w * h / union, 9) if union > 0 else 0.0, i, j))
    for iou, i, j in sorted(pairs, reverse=True):
        if iou >= least and i not in made and j not in {v[0] for v in made.values()}:
            made[i] = (j, iou)
    return {(i, j, iou) for i, (j, iou) in made.items()}


def test_greedy_boxes_without_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(4)
    box = lambda x, y, w, h: [float(x), float(y), float(x + w), float(y + h)]
    frames = {
        1: [[(int(i), box(*r.uniform(0, 9, 2), *r.uniform(0.5, 4, 2))) for i in r.permutation(90)] for _ in "ab"],
        2: [[(i, box(r.integers(0, 3), r.integers(0, 2), 3, 3)) for i in range(120)] for _ in "ab"],  # equal overlaps by the hundred
        3: [[(i, box(1, 1, 2, 2)) for i in range(n)] for n in (70, 50)],
        4: [[(1, box(0, 0, 1, 1))], [(7, box(5, 5, 1, 1)), (8, box(0, 0, 0, 0))]],
    }
    for held, looked in ((decisions.HELD, decisions.LOOKED_AT), (60, 50)):
        monkeypatch.setattr(decisions, "HELD", held)
        monkeypatch.setattr(decisions, "LOOKED_AT", looked)
        for a, b in frames.values():
            of = lambda rows: (np.array([x for _, x in rows]), np.array([i for i, _ in rows]))
            assert set(decisions.greedy_frame(*of(a), *of(b), 0.2)) == all_greedy(a, b, 0.2)
    sides = [spark.createDataFrame([(1, f, i, *x) for f, ab in frames.items() for i, x in ab[n]] + [(None, 1, 5, 0.0, 0.0, 9.0, 9.0)], "camera_id long, frame long, id long, x1 double, y1 double, x2 double, y2 double") for n in (0, 1)]
    got = {tuple(x) for x in decisions.greedy_boxes(*sides, 0.5).collect()}
    assert got == {(1, f, *m) for f, (a, b) in frames.items() for m in all_greedy(a, b, 0.5)}


def test_exclusions_shuffle_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(identity, "BLOCK", 10)
    monkeypatch.setattr(identity, "BATCH", 40)
    r = np.random.default_rng(5)
    seen = [(int(c), int(p), int(w)) for c, p, w in zip(r.integers(0, 3, 400), r.integers(0, 30, 400), r.integers(0, 60, 400) ** 2, strict=True)]
    want = {(a, b) for c, p, a in seen for d, q, b in seen if (c, p) == (d, q) and a < b}
    for kind, cast in (("long", int), ("string", str)):
        rows = [(c, p, cast(w)) for c, p, w in seen] + [(None, 1, cast(1)), (0, None, cast(2)), (0, 1, None)]
        frame = identity.exclusions(spark.createDataFrame(rows * 2, f"camera_id long, pass long, person {kind}"))
        got = sorted(map(tuple, frame.collect()))
        assert got == sorted(tuple(sorted((cast(a), cast(b)))) for a, b in want)
        assert "SortMergeJoin" not in (plan := frame._jdf.queryExecution().toString()) and "BroadcastHashJoin" not in plan
    assert identity.exclusions(spark.createDataFrame([], "camera_id long, pass long, person long")).count() == 0


def test_interest_events_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(identity_plans, "PER_TASK", 10)
    rows = [(p, 0, float(t), 100 * p + i) for p in range(20) for i, t in enumerate((0, 1, 5 + p % 3, 20))] + [(1, 2, 2.0, 9001), (1, 2, 5.5, 9002)]
    frame = identity_plans.interest_events(spark.createDataFrame(rows, "person long, product long, at double, event_id long"))
    assert frame.rdd.getNumPartitions() == 9  # grows with the rows
    got = sorted(tuple(r) for r in frame.where("person <= 1").collect())
    assert [x for x in got if x[0] == 0] == sorted(brute([r for r in rows if r[0] == 0]))
    assert [x for x in got if x[0] == 1] == sorted(brute([r for r in rows if r[0] == 1]))


def brute(rows):
    out, starts = [], {}
    for p, product, at, i in sorted(rows, key=lambda r: (r[2], r[3])):
        again = min((t for _, _, t, _ in rows if t > at + 3), default=None)
        later = [t for _, q, t, j in rows if q == product and (t, j) > (at, i)]
        out.append((p, product, "STARTED" if starts.get(product, True) else "UPDATED", at))
        ends = again is not None and (not later or min(later) > again)
        if ends:
            out.append((p, product, "ENDED", again))
        starts[product] = ends
    return out


def test_similarities_of_a_batch_are_those_of_its_pairs():
    r = np.random.default_rng(6)
    kind = pa.list_(pa.struct([("ts", pa.float64()), ("cam", pa.int64()), ("v", pa.list_(pa.float64()))]))

    def person(most, dim, zeros=0.2):
        made = [{"ts": float(i), "cam": int(r.integers(0, 3)), "v": (r.normal(size=dim) * (r.random() > zeros)).tolist()} for i in range(r.integers(0 if dim < 8 else 1, most + 1))]
        for x in made:
            if r.random() < zeros:
                x["v"] = x["v"][: dim // 2] + [0.0] * (dim - dim // 2)  # without colours
        return made

    n = 70
    sides = {f"{end}_{what}": [person(most, dim) for _ in range(n)] for end in "ab" for what, most, dim in (("looks", 8, 10), ("faces", 6, 4))}
    batch = pa.record_batch({c: pa.array(x, kind) for c, x in sides.items()}).slice(5, 60)
    mat = lambda rows, dim: (np.array([x["v"] for x in rows]).reshape(-1, dim), np.array([x["cam"] for x in rows]))
    for colours in (4, 0):
        got = [c.tolist() for c in rounds.similarities(batch, colours)]
        for k in range(60):
            a, b, fa, fb = (mat(sides[c][k + 5], d) for c, d in (("a_looks", 10), ("b_looks", 10), ("a_faces", 4), ("b_faces", 4)))
            face = rounds._agreement(fa[0], fb[0]) if len(fa[0]) and len(fb[0]) else None
            want = [*rounds.similarity(*a, *b, colours), face]
            assert np.allclose([c[k] for c in got], [np.nan if w is None else w for w in want], atol=2e-6, equal_nan=True)


def test_exclusions_write_no_row_for_every_block(spark, monkeypatch):
    """A block is written once and read by all that meet it; marks of few cameras and passes at a time."""
    monkeypatch.setattr(identity, "BLOCK", 7)
    monkeypatch.setattr(identity, "MASKS", 40)
    monkeypatch.setattr(identity, "HOLDERS", 3)
    r = np.random.default_rng(9)
    seen = [(f"c{c}", int(p), int(w)) for c, p, w in zip(r.integers(0, 3, 300), r.integers(0, 40, 300), r.integers(0, 70, 300), strict=True)]
    frame = identity.exclusions(spark.createDataFrame(seen, "camera_id string, pass long, person int"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in plan
    got = sorted(map(tuple, frame.collect()))
    assert got == sorted({(a, b) for c, p, a in seen for d, q, b in seen if (c, p) == (d, q) and a < b})
