"""The vector index against all pairs, its versions, and the frames of bursts against the greedy loop."""

import numpy as np
import pytest

from fairground.operators import vector_index as index

ROWS, ASKED, FRAMES = "id long, product long, v array<double>", "id long, v array<double>", "burst long, frame long, v array<double>"


def unit(v):
    return v / np.linalg.norm(v)


def gallery(n=900, dim=8, seed=1):
    """Clusters, many of them tight, with equal vectors within and across products."""
    r = np.random.default_rng(seed)
    middles = r.normal(size=(12, dim))
    rows = [(i, int(r.integers(0, 9)), (middles[i % 12] + r.normal(size=dim) * (0.02 if i % 3 else 0.5)).tolist()) for i in range(n)]
    rows += [(n + i, int(i % 2), rows[4][2]) for i in range(60)] + [(n + 100 + i, 3, rows[8][2]) for i in range(3)]
    return rows


def plain(rows, asked, products):
    out = set()
    for q, x in asked:
        best = {}
        for i, p, v in rows:
            if i != q:
                s = round(float(np.clip(unit(np.array(x)) @ unit(np.array(v)), -1, 1)), 6)
                best[p] = min(best.get(p, (9, 0)), (-s, i))
        for rank, (s, p, i) in enumerate(sorted((s, p, i) for p, (s, i) in best.items())[:products], 1):
            out.add((q, rank, p, i, -s + 0.0))
    return out


def test_nearest_is_exact_and_looks_at_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 64)  # several blocks a cell and of queries
    rows = gallery()
    made = index.rebuild(spark.createDataFrame(rows, ROWS), f"file://{tmp_path}/index", 8)
    asked = [(i, v) for i, _, v in rows if i % 5 == 0] + [(-1, [1.0] * 8), (-2, rows[4][2])]
    for products in (1, 2):
        found = index.nearest(made, spark.createDataFrame(asked, ASKED), products).collect()
        got = {(r["query"], r["rank"], r["product"], r["other"], r["score"] + 0.0) for r in found}
        assert got == plain(rows, asked, products)
    effort = {r["query"]: r["computed"] for r in index.nearest(made, spark.createDataFrame(asked, ASKED), 1).collect()}
    held = made.cells.groupBy().sum("rows").first()[0]
    assert np.mean([effort[i] for i, _ in asked if i % 3]) < 0.6 * held  # of tight clusters
    assert set(plain(rows, asked, 20)) == {(r["query"], r["rank"], r["product"], r["other"], r["score"] + 0.0) for r in index.nearest(made, spark.createDataFrame(asked, ASKED), 20).collect()}


def test_versions_and_odd_vectors(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(ValueError, match="no index"):
        index.latest(spark, path)
    odd = [(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, None), (3, 1, [1.0]), (4, 1, [0.0, 0.0]), (5, 1, [float("nan"), 1.0]), (6, 1, [float("inf"), 1.0]), (7, None, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (8, 2, [2.0, 0.0]), (9, 2, [0.0, 3.0])]
    old = index.rebuild(spark.createDataFrame(odd, ROWS), path, 2)
    ask = lambda made, q: sorted((r["rank"], r["product"], r["other"], r["score"]) for r in index.nearest(made, spark.createDataFrame(q, ASKED), 2).collect())
    assert old.version == 1 and ask(old, [(0, [5.0, 0.0])]) == [(1, 1, 1, 1.0), (2, 2, 8, 1.0)]
    assert ask(old, [(1, [1.0, 0.0])]) == [(1, 2, 8, 1.0)]  # itself left out
    assert ask(old, [(0, None), (1, [0.0, 0.0]), (2, [1.0])]) == []
    new = index.rebuild(spark.createDataFrame([(9, 2, [0.0, 3.0])], ROWS), path, 2)
    assert new.version == 2 and index.latest(spark, path).version == 2
    assert ask(new, [(0, [5.0, 0.0])]) == [(1, 2, 9, 0.0)] and ask(old, [(0, [5.0, 0.0])]) == [(1, 1, 1, 1.0), (2, 2, 8, 1.0)]
    # files of a version that was never published are nobody's
    spark.createDataFrame(odd[:1], ROWS).write.parquet(f"{path}/3/rows")
    assert index.latest(spark, path).version == 2
    empty = index.rebuild(spark.createDataFrame([], ROWS), f"{path}-empty", 2)
    assert ask(empty, [(0, [1.0, 0.0])]) == []


def greedy(frames, cosine=0.98):
    kept, out = {}, {}
    for burst, frame, v in sorted(frames, key=lambda f: (f[0] is not None, f[0] or 0, f[1], f[2] or [])):
        if (burst, frame) in out:
            continue
        if v is None or not np.any(v):
            out[burst, frame] = "invalid"
            continue
        u = unit(np.array(v))
        same = any(round(float(u @ k), 9) >= cosine for k in kept.get(burst, []))
        out[burst, frame] = "duplicate" if same else "kept"
        if not same:
            kept.setdefault(burst, []).append(u)
    return out


def test_bursts_against_the_greedy_loop(spark):
    r = np.random.default_rng(3)
    frames = []
    for burst in range(6):
        v = r.normal(size=6)
        for frame in range(60):
            v = v + r.normal(size=6) * (0.02, 0.1, 0.3)[burst % 3]  # a slow turn: chains of likeness
            frames.append((burst, frame, v.tolist()))
    frames += [(6, i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(50)] + [(None, 1, frames[0][2]), (None, 2, frames[1][2]), (7, 1, None), (7, 2, [0.0] * 6), (7, 3, [1.0] * 6)]
    got = index.kept_frames(spark.createDataFrame(frames, FRAMES), 6).collect()
    assert {(x.burst, x.frame): x.status for x in got} == greedy(frames)
    assert 2 <= max(x["round"] for x in got) < 60
    assert index.kept_frames(spark.createDataFrame([], FRAMES), 6).count() == 0
    lonely = [(1, 1, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (1, 2, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    assert {x.status for x in index.kept_frames(spark.createDataFrame(lonely, FRAMES), 6).collect()} == {"kept"}
