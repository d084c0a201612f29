"""Who is who across cameras: the rules that compare candidates, as columns, and the one decision that
depends on all earlier ones, as a fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.operators.folds import fold

#: Bounds of contradictions: faces, colours within and across cameras, parts, hair (fixed values).
FACE_VETO, FACE_SURE, COLOUR_OWN, COLOUR_CROSS, PARTS, HAIR = 0.22, 0.40, 0.30, 0.62, 0.55, 0.35
#: Stitching within a camera: seconds, heights apart, least and most ratio of heights, least score.
STITCH_SECONDS, STITCH_HEIGHTS, STITCH_RATIO, STITCH_SCORE = 4.0, 1.2, (0.5, 2.0), 0.30
#: Least similarity and least gap to the runner-up of faces and of looks.
FACE_MATCH, LOOK_MATCH = (0.40, 0.06), (0.55, 0.08)
#: How often in a row a contradiction must come to split a track off, by kind.
STREAKS = {"low": 3, "gender": 2, "face": 2, "colour": 3}
#: Merging: similarity that suffices, and the gap and similarity that suffice for mutual bests.
MERGE, MERGE_GAP, MERGE_MUTUAL = 0.72, 0.25, 0.60
#: Seconds a walk between two cameras may take if nothing is known of them.
WINDOW = (0.0, 30.0)
#: Weights of the signals, and from which score on they match for sure and perhaps; seconds after which a
#: person is forgotten.
WEIGHTS = {"reid": 0.40, "clothing": 0.20, "body": 0.10, "temporal": 0.05, "spatial": 0.05}
SURE, PERHAPS, FORGET = 0.80, 0.62, 900.0


def contradiction(banned: Column, face: Column, gender_a: Column, gender_b: Column, colour: Column, parts: Column, hair: Column, new_camera: Column) -> Column:
    """The first reason why two can't be one person, null if there is none; a sure face overrules what
    comes after it. What isn't known (null) says nothing; gender UNKNOWN neither."""
    known = (gender_a != "UNKNOWN") & (gender_b != "UNKNOWN")
    least = F.when(new_camera, COLOUR_CROSS).otherwise(COLOUR_OWN)
    return (
        F.when(banned, "banned").when(face < FACE_VETO, "face").when(face >= FACE_SURE, None).when(known & (gender_a != gender_b), "gender")
        .when(colour < least, "colour").when(new_camera & (parts < PARTS), "parts").when(new_camera & (hair < HAIR), "hair")
    )


def stitches(lost: DataFrame, new: DataFrame) -> DataFrame:
    """lost: camera_id, track, ts, x, y, height; new: the same. The lost track that each new one of the same
    camera continues, if any: a range join by buckets of STITCH_SECONDS, so that only neighbours meet."""
    bucket = F.floor(F.col("ts") / STITCH_SECONDS)
    named = lambda df, end: df.select("camera_id", "bucket", *[F.col(c).alias(f"{end}_{c}") for c in ("track", "ts", "x", "y", "height")])
    old = named(lost.withColumn("bucket", F.explode(F.array(bucket, bucket + 1))), "old")
    fresh = named(new.withColumn("bucket", bucket), "new")
    gap, taller = F.col("new_ts") - F.col("old_ts"), F.greatest("new_height", "old_height")
    apart = F.hypot(F.col("new_x") - F.col("old_x"), F.col("new_y") - F.col("old_y")) / taller
    ratio = F.col("new_height") / F.col("old_height")
    score = F.round(1 - apart / STITCH_HEIGHTS * 0.5 - gap / STITCH_SECONDS * 0.5, 6)
    met = fresh.join(old, ["camera_id", "bucket"]).where(gap.between(0, STITCH_SECONDS) & (apart <= STITCH_HEIGHTS) & ratio.between(*STITCH_RATIO) & (F.col("old_track") != F.col("new_track")))
    met = met.withColumn("score", score).where(F.col("score") >= STITCH_SCORE)
    best = F.row_number().over(W.partitionBy("camera_id", "new_track", "new_ts").orderBy(F.desc("score"), F.desc("old_ts"), "old_track"))
    return met.withColumn("rank", best).where("rank = 1").select("camera_id", F.col("new_track").alias("track"), "new_ts", F.col("old_track").alias("continues"), "score")


def best_match(candidates: DataFrame, least: float, gap: float, floor: float = -1.0) -> DataFrame:
    """candidates: query, person, score. The best person of each query, if good enough and so much better
    than the runner-up (at least floor); the smaller of equals is first."""
    by = W.partitionBy("query").orderBy(F.desc("score"), "person")
    top = candidates.withColumn("next", F.lead("score").over(by)).withColumn("rank", F.row_number().over(by)).where("rank = 1")
    ahead = F.col("score") - F.greatest(F.coalesce("next", F.lit(floor)), F.lit(floor))
    return top.where((F.col("score") >= least) & (F.round(ahead, 9) >= gap)).select("query", "person", "score")


def splits(checks: DataFrame) -> DataFrame:
    """checks: track, ts, id, reason (null: none). Where a track is split off: the row at which one of the
    STREAKS is full, by islands of rows with the same reason."""
    by = W.partitionBy("track").orderBy("ts", "id")
    reason = F.coalesce("reason", F.lit(""))
    rows = checks.withColumn("r", reason).withColumn("begins", (F.coalesce(F.lag("r").over(by), F.lit("")) != F.col("r")).cast("int"))
    rows = rows.withColumn("island", F.sum("begins").over(by))
    rows = rows.withColumn("run", F.row_number().over(W.partitionBy("track", "island").orderBy("ts", "id")))
    full = F.lit(False)
    for name, n in STREAKS.items():
        full = full | ((F.col("r") == name) & (F.col("run") == n))
    return rows.where(full).select("track", "ts", "id", "reason")


#: Persons and rows of a block, about, pairs of a batch that is given out, marks of persons looked at at once, and most
#: tasks that hold blocks.
BLOCK, BLOCK_ROWS, BATCH, MASKS, HOLDERS = 8192, 1 << 22, 1 << 20, 1 << 26, 256


def _packed(rows: pa.Table) -> pa.Table:
    """A block as one row: its persons, and by camera and pass which of them, as places from begin on."""
    (who, person), (cameras, c), (times, t) = (np.unique(rows[x].to_numpy(), return_inverse=True) for x in ("person", "camera_id", "pass"))
    order = np.argsort(c * len(times) + t, kind="stable")
    _, begin = np.unique((c * len(times) + t)[order], return_index=True)
    kind = lambda x: rows.schema.field(x).type
    values = [pa.array(who, kind("person")), pa.array(cameras[c[order[begin]]], kind("camera_id")), pa.array(times[t[order[begin]]], kind("pass")), pa.array(begin, pa.int32()), pa.array(person[order], pa.int32())]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in values]
    return pa.table([rows["block"].slice(0, 1), *lists], names=["block", "persons", "cameras", "passes", "begin", "places"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row is a pair of blocks: a bit for every two persons, set pass by pass."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield from _pairs(*({c: batch.column(f"{end}_{c}")[k].values for c in ("persons", "cameras", "passes", "begin", "places")} for end in "ab"), batch.column("i")[k] == batch.column("j")[k])


def _pairs(left: dict, right: dict, same: bool) -> Iterator[pa.RecordBatch]:
    kind, (left, right) = left["persons"].type, ({c: x.to_numpy(zero_copy_only=False) for c, x in side.items()} for side in (left, right))
    (_, c), (times, t) = (np.unique(np.concatenate([left[x], right[x]]), return_inverse=True) for x in ("cameras", "passes"))
    at, n = c * len(times) + t, len(left["begin"])
    a, b = left["persons"], right["persons"]
    common, *found = np.intersect1d(at[:n], at[n:], assume_unique=True, return_indices=True)
    (ca, who_a), (cb, who_b) = (_members(side, x) for side, x in zip((left, right), found, strict=True))
    # a row of bits for each camera and pass, who of b was there; a person of a met who was where it was
    met, step = np.zeros((len(a), -(-len(b) // 64)), dtype=np.uint64), max(1, MASKS // len(b))
    for lo in range(0, len(common), step):
        there = np.zeros((min(step, len(common) - lo), met.shape[1] * 64), dtype=bool)
        of_a, of_b = (slice(*np.searchsorted(c, [lo, lo + step])) for c in (ca, cb))
        there[cb[of_b] - lo, who_b[of_b]] = True
        there = np.packbits(there, axis=1).view(np.uint64)
        order = np.argsort(who_a[of_a], kind="stable")
        who, begin = np.unique(who_a[of_a][order], return_index=True)
        for person, cells in zip(who, np.split((ca[of_a] - lo)[order], begin[1:]), strict=True):
            met[person] |= np.bitwise_or.reduce(there[cells], axis=0)
    step = max(1, BATCH // len(b))
    for lo in range(0, len(a), step):
        # persons are in order, so that of a block with itself all above the diagonal are
        some = np.unpackbits(met[lo : lo + step].view(np.uint8), axis=1, count=len(b)).view(bool)
        some = np.triu(some, lo + 1) if same else some
        x, y = np.repeat(a[lo : lo + step], np.count_nonzero(some, axis=1)), np.broadcast_to(b, some.shape)[some]
        if not same:
            x, y = np.minimum(x, y), np.maximum(x, y)
        yield pa.record_batch([pa.array(x, kind), pa.array(y, kind)], names=["a", "b"])


def _members(side: dict, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of these of its cameras and passes, in order: which of them, and who, person by person."""
    many = np.diff(np.append(side["begin"], len(side["places"])))
    number = np.full(len(many), -1)
    number[cells] = np.arange(len(cells))
    number = np.repeat(number, many)
    return number[number >= 0], side["places"][number >= 0]


def exclusions(seen: DataFrame) -> DataFrame:
    """seen: camera_id, pass, person. Pairs on screen at once, which never match.

    They may be as many as the square of the persons, and none goes through a shuffle: persons are dealt into blocks, a
    block is packed into one row, and a task reads two blocks where they were written, once each, and gives every pair of
    theirs out once. What is written grows with the rows alone."""
    rows = seen.select("camera_id", "pass", "person").dropna()
    persons, many = rows.agg(F.approx_count_distinct("person"), F.approx_count_distinct(F.xxhash64("camera_id", "pass", "person"))).first()
    n = max(1, -(-persons // BLOCK), -(-many // BLOCK_ROWS))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = rows.distinct().withColumn("block", F.pmod(F.xxhash64("person"), F.lit(n)).cast("int")).repartition(n, "block")
    packed = f"block int, persons array<{kinds['person']}>, cameras array<{kinds['camera_id']}>, passes array<{kinds['pass']}>, begin array<int>, places array<int>"
    blocks = dealt.groupBy("block").applyInArrow(_packed, packed).repartitionById(min(n, HOLDERS), F.col("block") % min(n, HOLDERS))
    left, right = (blocks.select(F.col("block").alias(i), *[F.col(c).alias(f"{end}_{c}") for c in blocks.columns[1:]]) for i, end in (("i", "a"), ("j", "b")))
    return left.join(right.hint("shuffle_replicate_nl"), F.col("i") <= F.col("j")).mapInArrow(_together, f"a {kinds['person']}, b {kinds['person']}")


def merges(pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """pairs: booth_id, a, b, sim; persons: booth_id, person, first_seen, confirmed. Which persons are one:
    similar enough (less is asked if one isn't confirmed), or each other's best by far. The earlier wins."""
    both = pairs.select("booth_id", "a", "b", "sim").union(pairs.select("booth_id", F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    by = W.partitionBy("booth_id", "a").orderBy(F.desc("sim"), "b")
    ranked = both.withColumn("rank", F.row_number().over(by)).withColumn("next", F.coalesce(F.lead("sim").over(by), F.lit(-1.0)))
    first = ranked.where("rank = 1").select("booth_id", "a", "b", "sim", (F.col("sim") - F.col("next")).alias("ahead"))
    other = first.select("booth_id", F.col("a").alias("b"), F.col("b").alias("a"), F.col("ahead").alias("ahead_b"))
    mutual = first.join(other, ["booth_id", "a", "b"]).where((F.least("ahead", "ahead_b") >= MERGE_GAP) & (F.col("sim") >= MERGE_MUTUAL)).where("a < b").select("booth_id", "a", "b", F.lit(True).alias("mutual"))
    person = lambda end: persons.select("booth_id", F.col("person").alias(end), F.col("first_seen").alias(f"{end}_seen"), F.col("confirmed").alias(f"{end}_sure"))
    rows = pairs.join(person("a"), ["booth_id", "a"]).join(person("b"), ["booth_id", "b"]).join(mutual, ["booth_id", "a", "b"], "left")
    least = F.when(F.col("a_sure") & F.col("b_sure"), MERGE).otherwise(0.5)
    kept = rows.where((F.col("a_sure") | F.col("b_sure")) & ((F.col("sim") >= least) | F.coalesce("mutual", F.lit(False))))
    earlier = (F.col("a_seen") < F.col("b_seen")) | ((F.col("a_seen") == F.col("b_seen")) & (F.col("a") < F.col("b")))
    return kept.select("booth_id", F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("loser"), F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("winner"), "sim")


ASSIGNED = "booth_id long, track long, person string, status string, score double, linked string"


def _score(track: dict, person: dict) -> float:
    """The weighted mean of what is known of both; with less than two signals of looks never sure."""
    ends = [("reid", sum(a * b for a, b in zip(track["look"], person["look"], strict=True)) if track["look"] and person["look"] else None)]
    ends += [(c, None if track[c] is None or person[c] is None else float(track[c] == person[c])) for c in ("clothing", "body")]
    gap = track["ts"] - person["ts"]
    temporal = 1.0 if track["camera_id"] == person["camera_id"] else max(0.0, 1 - gap / FORGET) if gap > 0 else 0.0
    if temporal <= 0:
        return 0.0
    signals = [*ends, ("temporal", temporal), ("spatial", 1.0 if track["camera_id"] == person["camera_id"] else 0.6)]
    known = [(WEIGHTS[c], max(0.0, x)) for c, x in signals if x is not None]
    mean = sum(w * x for w, x in known) / sum(w for w, _ in known)
    return mean if sum(x is not None for _, x in ends) >= 2 else min(mean, SURE - 0.01)


class _Seen:
    """Persons seen lately, in the order of their names, and columns of what _score reads of them, by which all are
    compared at once; the columns only grow, or lose who is forgotten."""

    COLUMNS = {"ts": float, "camera_id": object, "clothing": object, "body": object}

    def __init__(self) -> None:
        self.persons, self.looks = [], None
        self.columns = {c: np.empty(16, dtype=kind) for c, kind in self.COLUMNS.items()}

    def forget(self, ts: float) -> None:
        n = len(self.persons)
        if not n:
            return
        kept = ts - self.columns["ts"][:n] <= FORGET
        if not kept.all():
            at = np.flatnonzero(kept)
            self.persons = [self.persons[i] for i in at]
            for column in (*self.columns.values(), *([] if self.looks is None else [self.looks])):
                column[: len(at)] = column[at]

    def add(self, person: dict) -> None:
        n, look = len(self.persons), person["look"]
        self.persons.append(person)
        if n == len(self.columns["ts"]):
            self.columns = {c: np.concatenate([x, np.empty_like(x)]) for c, x in self.columns.items()}
            self.looks = None if self.looks is None else np.concatenate([self.looks, np.empty_like(self.looks)])
        for c, x in self.columns.items():
            x[n] = person[c]
        if look and self.looks is None:
            self.looks = np.full((len(self.columns["ts"]), len(look)), np.nan)
        if self.looks is not None:
            self.looks[n] = look or np.nan

    def met(self, at: int, row: dict) -> None:
        self.persons[at] = {**self.persons[at], "ts": row["ts"], "camera_id": row["camera_id"]}
        self.columns["ts"][at], self.columns["camera_id"][at] = row["ts"], row["camera_id"]

    def best(self, row: dict) -> tuple[int | None, float]:
        """Who has the highest _score, the first of equals. All columns at once tell who comes near it; sums are rounded
        otherwise there, so that _score itself decides among those."""
        n = len(self.persons)
        if not n:
            return None, 0.0
        same = self.columns["camera_id"][:n] == row["camera_id"]
        gap = row["ts"] - self.columns["ts"][:n]
        temporal = np.where(same, 1.0, np.where(gap > 0, 1 - gap / FORGET, 0.0))
        total = WEIGHTS["temporal"] * temporal + WEIGHTS["spatial"] * np.where(same, 1.0, 0.6)
        weight, signals = np.full(n, WEIGHTS["temporal"] + WEIGHTS["spatial"]), np.zeros(n, dtype=int)
        if row["look"] and self.looks is not None:
            alike = self.looks[:n] @ np.asarray(row["look"], dtype=float)
            known = ~np.isnan(alike)
            total += np.where(alike > 0, WEIGHTS["reid"] * alike, 0.0)
            weight += WEIGHTS["reid"] * known
            signals += known
        for c in ("clothing", "body"):
            if row[c] is not None:
                known = self.columns[c][:n] != None  # noqa: E711  of every element
                total += WEIGHTS[c] * (self.columns[c][:n] == row[c])
                weight += WEIGHTS[c] * known
                signals += known
        mean = total / weight
        scores = np.where(temporal > 0, np.where(signals >= 2, mean, np.minimum(mean, SURE - 0.01)), 0.0)
        near = np.flatnonzero(scores >= scores.max() - 1e-9)
        exact = [_score(row, self.persons[i]) for i in near]
        at = max(range(len(near)), key=lambda i: (exact[i], -i))
        return int(near[at]), exact[at]


def assign_step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
    """row: booth_id, track, camera_id, ts, look (unit vector or null), clothing, body. MATCH takes the best
    person's name, UNCERTAIN and NEW a new one, UNCERTAIN linked to whom it may be; only persons seen lately are remembered."""
    number, seen = state[0], state[1] or _Seen()
    seen.forget(row["ts"])
    best, score = seen.best(row)
    score = round(score, 6)
    if best is not None and score >= SURE:
        name, status, linked = seen.persons[best]["name"], "MATCH", None
        seen.met(best, row)
    else:
        name, status = f"PERSON-{number:04d}", "UNCERTAIN" if score >= PERHAPS else "NEW"
        linked = seen.persons[best]["name"] if status == "UNCERTAIN" else None
        number += 1
        seen.add({**{c: row[c] for c in ("look", "clothing", "body", "ts", "camera_id")}, "name": name})
    return (number, seen), [{"booth_id": row["booth_id"], "track": row["track"], "person": name, "status": status, "score": score, "linked": linked}]


def assigned(tracks: DataFrame) -> DataFrame:
    return fold(tracks, ["booth_id"], ["ts", "track"], lambda: (1, []), assign_step, ASSIGNED)


#: Evidence of a face and of a body at most, what is left of it by each sample, what decides (with how many
#: samples), which share keeps a decision, and seconds after which all is forgotten (fixed values).
FACE_MOST, BODY_MOST, DECAY, DECIDE, DECIDE_BODY, KEEP, STALE = 2.5, 1.5, 0.95, (2.0, 2), (2.5, 4), 0.5, 8.0
SMOOTHED = "user_id long, ts double, id long, evidence double, label string"


def evidence_start() -> dict:
    return {"e": 0.0, "n": 0, "faces": 0, "label": None, "ts": None}


def evidence_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """row: user_id, ts, id, logit (positive for one label), face (else body), weight (of a body; 0 says nothing).
    Two faces make the evidence that of faces, which decides sooner."""
    if state["ts"] is not None and row["ts"] - state["ts"] > STALE:
        state = evidence_start()
    counts = row["face"] or row["weight"] > 0
    push = max(-FACE_MOST, min(FACE_MOST, row["logit"])) if row["face"] else max(-BODY_MOST, min(BODY_MOST, row["logit"])) * row["weight"]
    e = state["e"] * DECAY + push if counts else state["e"]
    n, faces = state["n"] + counts, state["faces"] + row["face"]
    least, samples = DECIDE if faces >= DECIDE[1] else DECIDE_BODY
    label, own = state["label"], "MALE" if e > 0 else "FEMALE"
    if n >= samples and abs(e) >= least:
        label = own
    elif n < samples or label != own or abs(e) < KEEP * least:
        label = None
    out = {"user_id": row["user_id"], "ts": row["ts"], "id": row["id"], "evidence": e, "label": label or "UNKNOWN"}
    return {"e": e, "n": n, "faces": faces, "label": label, "ts": row["ts"]}, [out]


def smoothed(samples: DataFrame) -> DataFrame:
    return fold(samples, ["user_id"], ["ts", "id"], evidence_start, evidence_step, SMOOTHED)
