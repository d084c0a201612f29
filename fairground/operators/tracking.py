"""Assignment of boxes and tracks over the frames of a camera.

Candidates are joined and scored as columns; what is left is a helper of a frame's size: the best
one-to-one assignment of a small matrix, and a step that carries a camera's few open tracks along."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairground.operators.folds import fold


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of the one-to-one assignment with the largest sum of gains, all of the smaller side
    assigned: by shortest augmenting paths over dual prices."""
    if not gain.size:
        return []
    flipped = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flipped else gain).astype(float)
    n, m = cost.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for r in range(n):
        reach, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        at, via, spent = r, -1, 0.0
        while True:
            slack = spent + cost[at] - row_price[at] - col_price
            closer = ~done & (slack < reach)
            reach[closer], came[closer] = slack[closer], via
            open_ = np.flatnonzero(~done)
            via = int(open_[np.argmin(reach[open_])])
            spent, done[via] = reach[via], True
            if owner[via] < 0:
                break
            at = owner[via]
        row_price[r] += spent
        for c in np.flatnonzero(done):
            if owner[c] >= 0:
                row_price[owner[c]] += spent - reach[c]
            col_price[c] -= spent - reach[c]
        while via >= 0:  # shift the owners along the path
            before = came[via]
            owner[via] = r if before < 0 else owner[before]
            via = before
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return sorted((c, r) if flipped else (r, c) for r, c in pairs)


def optimal_pairs(candidates: DataFrame) -> DataFrame:
    """candidates: camera_id, frame, row, col, iou, those good enough to be matched. Per frame the
    one-to-one pairs with the largest overlap in all. A frame's candidates meet in one task; frames are
    as many as the log is long."""
    schema = "camera_id long, frame long, row long, col long, iou double"

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.sort(frame["row"].unique()), np.sort(frame["col"].unique())
        gain = np.zeros((len(rows), len(cols)))
        gain[np.searchsorted(rows, frame["row"]), np.searchsorted(cols, frame["col"])] = frame["iou"]
        kept = [(frame["camera_id"].iloc[0], frame["frame"].iloc[0], rows[r], cols[c], gain[r, c]) for r, c in assign(gain) if gain[r, c] > 0]
        return pd.DataFrame(kept, columns=["camera_id", "frame", "row", "col", "iou"])

    return candidates.select("camera_id", "frame", "row", "col", "iou").groupBy("camera_id", "frame").applyInPandas(best, schema)


@dataclass(frozen=True)
class Tracking:
    """How tracks are matched, born, confirmed and dropped."""

    optimal: bool = True
    #: Overlaps of sure detections, and of those of low score that rescue a track.
    least_iou: float = 0.2
    rescue_iou: float = 0.2
    high: float = 0.5
    low: float = 0.1
    #: Score that begins a track, and that confirms it at once.
    birth: float = 0.5
    certain: float = 0.7
    confirm_hits: int = 2
    #: Seconds, and frames of the camera, after which an unseen track is gone.
    max_age: float = 3.5
    max_missed: int | None = None
    least_area: float = 0.0
    #: Whether the last box seen counts beside the one expected.
    last_box: bool = True


#: The booth's tracker, the server's, and the one for products (fixed values).
BOOTH = Tracking()
SERVER = Tracking(optimal=False, least_iou=0.3, rescue_iou=0.4, birth=0.6, certain=np.inf, confirm_hits=3, max_age=np.inf, max_missed=30, least_area=64.0, last_box=False)
PRODUCT = Tracking(optimal=False, least_iou=0.4, rescue_iou=0.4, high=0.0, low=0.0, birth=0.0, certain=np.inf, confirm_hits=2, max_age=3.0, last_box=False)
#: Share of a surprise that corrects the velocity.
GAIN = 0.35

TRACKED = "camera_id long, ts double, id long, track long, confirmed boolean"


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(-1)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(-1)
    return both / np.maximum(area(a)[:, None] + area(b)[None] - both, 1e-12)


def _matched(overlap: np.ndarray, least: float, how: Tracking) -> list[tuple[int, int]]:
    """Pairs of a box and a track that overlap enough; the best of all together, or one after another."""
    if not overlap.size:
        return []
    if how.optimal:
        return [(r, c) for r, c in assign(overlap) if overlap[r, c] >= least]
    pairs, order = [], np.argsort(-overlap, axis=None, kind="stable")
    for r, c in zip(*np.unravel_index(order, overlap.shape), strict=True):
        if overlap[r, c] < least:
            break
        if all(r != a and c != b for a, b in pairs):
            pairs.append((int(r), int(c)))
    return pairs


def frame_step(how: Tracking):
    """The step of a fold over a camera's frames: row has camera_id, ts and found, the frame's detections
    (id, x1, y1, x2, y2, score). The state is the next number and the open tracks, each with its box,
    velocity, hits and time."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
        number, tracks = state
        now, out = row["ts"], []
        tracks = [t for t in tracks if now - t["ts"] <= how.max_age and (how.max_missed is None or t["missed"] <= how.max_missed)]
        found = sorted(row["found"], key=lambda d: d["id"])
        found = [d for d in found if (d["x2"] - d["x1"]) * (d["y2"] - d["y1"]) >= how.least_area]
        left = list(range(len(tracks)))
        for strong in (True, False):
            taken = [d for d in found if (d["score"] >= how.high) == strong and d["score"] >= how.low]
            boxes = np.array([[d["x1"], d["y1"], d["x2"], d["y2"]] for d in taken], dtype=float).reshape(-1, 4)
            expected = np.array([tracks[i]["box"] + tracks[i]["speed"] * (now - tracks[i]["ts"]) for i in left]).reshape(-1, 4)
            overlap = _iou(boxes, expected)
            if how.last_box and left:
                overlap = np.maximum(overlap, _iou(boxes, np.array([tracks[i]["box"] for i in left])))
            pairs = dict(_matched(overlap, how.least_iou if strong else how.rescue_iou, how))
            for d, (detection, box) in enumerate(zip(taken, boxes, strict=True)):
                if d in pairs:
                    t = tracks[left[pairs[d]]]
                    seconds = max(now - t["ts"], 1e-3)
                    speed = t["speed"] + GAIN * (box - expected[pairs[d]]) / seconds
                    t |= {"box": box, "speed": speed, "ts": now, "hits": t["hits"] + 1, "missed": 0}
                elif strong and detection["score"] >= how.birth:
                    t = {"track": number, "box": box, "speed": np.zeros(4), "ts": now, "hits": how.confirm_hits if detection["score"] >= how.certain else 1, "missed": 0}
                    number += 1
                    tracks.append(t)
                else:
                    continue
                out.append({"camera_id": row["camera_id"], "ts": now, "id": detection["id"], "track": t["track"], "confirmed": t["hits"] >= how.confirm_hits})
            left = [i for k, i in enumerate(left) if k not in pairs.values()]
        # who wasn't seen before being confirmed is forgotten
        tracks = [{**t, "missed": t["missed"] + (t["ts"] != now)} for t in tracks]
        return (number, [t for t in tracks if t["ts"] == now or t["hits"] >= how.confirm_hits]), out

    return step


def tracked(detections: DataFrame, how: Tracking) -> DataFrame:
    """detections: camera_id, ts, id, x1, y1, x2, y2, score. Every detection that belongs to a track, with
    the track's number in its camera, and whether the track was confirmed by then."""
    box = F.struct("id", "x1", "y1", "x2", "y2", "score")
    frames = detections.groupBy("camera_id", "ts").agg(F.collect_list(box).alias("found"))
    return fold(frames, ["camera_id"], ["ts"], lambda: (1, []), frame_step(how), TRACKED)


def identity_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """truth: scene, ts, id, true; found: scene, ts, id, track (the same detections). Per scene IDF1, how
    often a true one's track changes, and how often it is broken off.

    Frames shared by every pair of a true one and a track are counted by Spark; only those counts, of
    one scene at a time, meet in the assignment that IDF1 asks for."""
    both = truth.join(found.select("scene", "id", "track"), ["scene", "id"], "left")
    shared = both.where("track IS NOT NULL").groupBy("scene", "true", "track").agg(F.count("*").alias("frames"))

    def matched(scene: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.sort(scene["true"].unique()), np.sort(scene["track"].unique())
        gain = np.zeros((len(rows), len(cols)))
        gain[np.searchsorted(rows, scene["true"]), np.searchsorted(cols, scene["track"])] = scene["frames"]
        return pd.DataFrame({"scene": scene["scene"].iloc[:1], "idtp": [int(sum(gain[r, c] for r, c in assign(gain)))]})

    from pyspark.sql.window import Window as W

    by = W.partitionBy("scene", "true").orderBy("ts", "id")
    seen = F.last("track", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    steps = both.withColumn("before", seen).withColumn("gap", F.lag("track").over(by).isNull() & seen.isNotNull() & F.col("track").isNotNull())
    per = steps.groupBy("scene").agg(
        F.count("*").alias("n_true"), F.count("track").alias("n_found"), F.count_if(F.col("before") != F.col("track")).alias("switches"), F.count_if("gap").alias("fragments"),
    )
    best = shared.groupBy("scene").applyInPandas(matched, "scene long, idtp long")
    rows = per.join(best, "scene", "left").withColumn("idtp", F.coalesce("idtp", F.lit(0)))
    return rows.select("scene", "switches", "fragments", F.round(2 * F.col("idtp") / (F.col("n_true") + F.col("n_found")), 6).alias("idf1"))
