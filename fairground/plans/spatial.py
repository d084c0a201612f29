"""Spatial, similarity and evaluation analytics (inventory ids J11, J12, T02, T06, T23, T26, T27, T30, L04-L06, V01, V03-V07, E01, E04, E06, Q36, Q37)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.functions import geometry as G
from fairground.operators import decisions, folds, runs, vectors
from fairground.sources import bindings as B
from fairground.sources.bindings import EVENT_SQL, POSITION_SQL, table

#: Zones in the order in which they are tried: name, x, y, width, height, degrees; and a homography.
ZONES = [("entrance", 0.0, 0.0, 3.0, 2.0, 0.0), ("shelf", 2.0, 1.0, 4.0, 2.0, 30.0), ("desk", 5.0, 3.0, 4.0, 3.0, 0.0)]
HOMOGRAPHY = [[1.1, 0.02, 0.5], [0.01, 0.95, -0.2], [0.001, 0.002, 1.0]]


def j11_zone_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first zone that holds a position: a handful of zones are a condition, not a join."""
    inside = [F.when(G.in_rectangle(F.col("x"), F.col("y"), *z[1:]), F.lit(z[0])) for z in ZONES]
    return B.positions(spark, sf_dir).select("id", F.coalesce(*inside).alias("zone"))


def j12_near_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones within two metres of a position, by their edges as they stand without rotation."""
    near = F.array(*[F.struct(F.lit(z[0]).alias("zone"), F.round(G.edge_distance(F.col("x"), F.col("y"), *z[1:5]), 6).alias("distance")) for z in ZONES])
    return B.positions(spark, sf_dir).select("id", F.inline(F.filter(near, lambda s: s["distance"] <= 2.0)))


#: Metres a second that nobody walks, and what is left of the confidence in such a jump (fixed values).
TOO_FAST, JUMPED = 3.0, 0.2


def position_step(last: tuple | None, row: dict) -> tuple[tuple | None, list[dict]]:
    """row: person, id, at, wx, wy, confidence. A jump from the last accepted position is told with little
    confidence, and isn't accepted."""
    out = {"id": row["id"], "wx": row["wx"], "wy": row["wy"], "confidence": row["confidence"]}
    if last is not None:
        seconds = max(1e-3, row["at"] - last[0])
        if ((row["wx"] - last[1]) ** 2 + (row["wy"] - last[2]) ** 2) ** 0.5 / seconds > TOO_FAST:
            return last, [{**out, "confidence": round(row["confidence"] * JUMPED, 3)}]
    return (row["at"], row["wx"], row["wy"]), [out]


def t26_world_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the floor, and how far they can be trusted: less out of bounds, little after a jump. An
    hour of the log counts as a second here."""
    wx, wy = G.project(F.col("x"), F.col("y"), HOMOGRAPHY)
    rows = B.positions(spark, sf_dir).select("id", "person", F.round((F.col("ts") - 1704067200) / 3600, 6).alias("at"), F.round(wx, 3).alias("wx"), F.round(wy, 3).alias("wy"))
    fine = F.col("wx").between(-0.5, 9.5) & F.col("wy").between(-0.5, 5.5)
    rows = rows.withColumn("confidence", F.when(fine, 0.9).otherwise(0.45))
    return folds.fold(rows, ["person"], ["at", "id"], lambda: None, position_step, "id long, wx double, wy double, confidence double")


#: Seconds of the log from which on layers of heat count here.
HEAT_SINCE = 2000.0


def t27_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = B.positions(spark, sf_dir).groupBy(G.cell(F.col("y"), 0.5).alias("row"), G.cell(F.col("x"), 0.5).alias("col")).agg(F.count("*").alias("traffic"))
    return per.select("row", "col", "traffic", F.round(F.col("traffic") / F.max("traffic").over(W.partitionBy()), 6).alias("share"))


def heat_layers(rows: DataFrame, size: float, since: float | None = None) -> DataFrame:
    """rows: person, x, y, at, id, interest. layer, row, col, weight and share of the layer's most: how many were there (traffic), for how
    many seconds, of steps under five, which count where they end (dwell), and what they cared for (interest); of rows from since on."""
    before = F.lag("at").over(W.partitionBy("person").orderBy("at", "id"))
    step = F.col("at") - before
    rows = rows.withColumn("dwell", F.when((step > 0) & (step < 5), step).otherwise(0.0))
    if since is not None:
        rows = rows.where(F.col("at") >= since)
    layers = [F.struct(F.lit(name).alias("layer"), w.alias("w")) for name, w in (("traffic", F.lit(1.0)), ("dwell", F.col("dwell")), ("interest", F.coalesce("interest", F.lit(0.0))))]
    per = rows.select(G.cell(F.col("y"), size).alias("row"), G.cell(F.col("x"), size).alias("col"), F.inline(F.array(*layers))).where("row IS NOT NULL AND col IS NOT NULL")
    per = per.groupBy("layer", "row", "col").agg(F.round(F.sum("w"), 6).alias("weight")).where("weight > 0")
    most = per.groupBy("layer").agg(F.max("weight").alias("most"))
    return per.join(F.broadcast(most), "layer").select("layer", "row", "col", "weight", F.round(F.col("weight") / F.col("most"), 6).alias("share"))


def t27_heat_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers of the last half of the log; ten minutes count as a second."""
    rows = B.positions(spark, sf_dir).withColumn("at", F.round((F.col("ts") - 1704067200) / 600, 6)).withColumn("interest", (F.col("id") % 7) / 4)
    return heat_layers(rows.select("person", "x", "y", "at", "id", "interest"), 0.5, HEAT_SINCE)


def l04_top_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t27_heatmap(spark, sf_dir).orderBy(F.desc("traffic"), F.desc(F.col("row") * 20 + F.col("col"))).limit(5).select("row", "col", "traffic")


#: Weights of the signals of interest, seconds of looking and of standing that count and that are full,
#: metres that are near, scores of high and possible interest, signals that high needs (fixed values).
INTEREST = {"gaze": 0.30, "head_pose": 0.15, "distance": 0.15, "look_duration": 0.15, "stop": 0.10, "approach": 0.10, "interaction": 0.05}
LOOKS, STANDS, NEAR, HIGH, POSSIBLE, SIGNALS = (1.5, 10.0), (2.0, 15.0), 1.5, 0.70, 0.40, 3


def interest(signals: dict) -> tuple:
    """Score and number of the signals that are there (not null), by their weights, renormalised; null and 0
    without any."""
    weight = sum((F.when(x.isNotNull(), INTEREST[c]).otherwise(0.0) for c, x in signals.items()), F.lit(0.0))
    total = sum((F.coalesce(x * INTEREST[c], F.lit(0.0)) for c, x in signals.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight), sum((x.isNotNull().cast("int") for x in signals.values()), F.lit(0))


def t23_interest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High needs three signals; without any the interest is unknown."""
    look, dwell, metres = F.col("value") / 10, F.col("k") / 5, F.pmod(F.col("value"), F.lit(3.0))
    observed = F.col("k") % 6 != 0
    signals = {
        "look_duration": F.when(look >= LOOKS[0], F.least(F.lit(1.0), look / LOOKS[1])), "stop": F.when(dwell >= STANDS[0], F.least(F.lit(1.0), dwell / STANDS[1])),
        "distance": F.when(observed, F.greatest(F.lit(0.0), 1 - metres / NEAR)), "approach": F.when(observed & (F.col("event_type") == "click"), 1.0),
        "head_pose": F.when(observed & (F.col("user_id") % 4 != 0), F.col("user_id") % 10 / 9), "gaze": F.when(observed & (F.col("user_id") % 3 != 0), F.col("k") / 100), "interaction": F.when(F.col("event_type") == "purchase", 1.0),
    }
    score, n = interest(signals)
    rows = B.events(spark, sf_dir).select("event_id", F.round(score, 6).alias("s"), n.alias("signals"))
    level = F.when(F.col("s").isNull(), "UNKNOWN").when((F.col("s") >= HIGH) & (F.col("signals") >= SIGNALS), "HIGH").when(F.col("s") >= POSSIBLE, "POSSIBLE").otherwise("LOW")
    return rows.select("event_id", F.coalesce("s", F.lit(0.0)).alias("score"), level.alias("level"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foot points right and left of an upright line, of boxes some of which reach over it."""
    x, half = F.col("k") / 100, F.col("value") / 2000
    touches = G.touches_line(x - half, F.lit(0.2), x + half, F.lit(0.8), (0.5, 1.0, 0.5, 0.0))
    return B.events(spark, sf_dir).select((F.col("user_id") % 5).alias("camera_id"), F.col("user_id").alias("track_id"), "ts", ((F.col("k") - 50) / 100.0).alias("distance"), (F.col("k") % 10 / 5.0).alias("age"), (F.col("value") / 100).alias("height"), F.lit(1).alias("inside"), touches.alias("touches"), "event_id")


def t02_tripwire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.tripwire(_readings(spark, sf_dir), "event_id")


def t06_product_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of a camera for every ten users; ten minutes of the log count as a second here."""
    seconds = (F.col("ts") - 1704067200) / 600
    rows = B.events(spark, sf_dir).select(
        F.floor(F.col("user_id") / 10).alias("camera_id"), (F.col("k") % 4).alias("product"), seconds.alias("ts"), "event_id",
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("cx"), F.lit(0.0).alias("cy"), F.when(F.col("value") < 60, F.col("user_id") % 2).alias("holder"),
    )
    return folds.placed_products(rows, "event_id")


def t30_load_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.hysteresis(B.events(spark, sf_dir), "user_id", "ts", "event_id", "value", 60.0, 40.0, 3600.0).select("user_id", F.round("ts", 6).alias("ts"), "state")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.valid(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), "v", 64)


def v01_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with the mean of its label's."""
    rows = vectors.valid(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), "v", 64)
    means = vectors.mean_vectors(rows, "label", "v")
    return rows.join(means, "label").select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("mean")), 6).alias("cosine"))


def v03_burst_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries, five frames to a burst, against all other vectors."""
    rows = _vectors(spark, sf_dir)
    live = rows.where("vec_id % 20 = 0").select(F.floor(F.col("vec_id") / 100).alias("burst_id"), F.col("vec_id").alias("frame_no"), "v")
    return vectors.burst_match(live, rows.where("label IS NOT NULL").select(F.col("vec_id").alias("template"), F.col("label").cast("long").alias("product"), "v"))


def l06_best_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best samples of a track; of equal ones, the earlier."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return B.events(spark, sf_dir).withColumn("rank", rank).where("rank <= 8").select("user_id", "event_id", "rank")


def v07_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised mean of each label's eight first vectors."""
    rows = vectors.valid(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), "v", 64)
    first = rows.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("vec_id"))).where("rank <= 8")
    means = vectors.mean_vectors(first, "label", "v")
    return means.select("label", F.round(F.get(vectors.normalised(F.col("mean")), 0), 6).alias("x0"), F.round(F.get(vectors.normalised(F.col("mean")), 63), 6).alias("x63"))


#: Overlap from which on a predicted box is right (fixed value).
RIGHT_IOU = 0.5


def e01_detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By camera, precision, recall and F1 of predicted boxes, matched one to one with the true ones of
    their frame, the best overlap first."""
    from fairground.plans import tracking

    pairs = tracking.greedy_boxes(spark, sf_dir, RIGHT_IOU).groupBy("camera_id").agg(F.count("*").alias("tp"))
    boxes = lambda truth, name: tracking._boxes(spark, sf_dir, truth).groupBy("camera_id").agg(F.count("*").alias(name))
    rows = boxes(True, "n_true").join(boxes(False, "n_told"), "camera_id", "full").join(pairs, "camera_id", "left").na.fill(0)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, told, true = F.col("tp"), F.col("n_told"), F.col("n_true")
    return rows.select("camera_id", share(tp, told).alias("precision"), share(tp, true).alias("recall"), share(2 * tp, told + true).alias("f1"), "tp", (told - tp).alias("fp"), (true - tp).alias("fn"))


def e04_pairwise_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs joined rightly, wrongly and not at all, from the sizes of groups; no pair is made."""
    rows = B.events(spark, sf_dir).select(F.col("user_id").alias("true"), ((F.col("user_id") * 7 + F.col("k") % 3) % 97).alias("pred"))
    both = rows.groupBy("true", "pred").agg(F.count("*").alias("n"))
    pairs = lambda df: df.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).withColumn("one", F.lit(1))
    sums = lambda key: pairs(both.groupBy(key).agg(F.sum("n").alias("n")))
    joined = pairs(both).withColumnRenamed("pairs", "correct").join(sums("pred").withColumnRenamed("pairs", "p"), "one").join(sums("true").withColumnRenamed("pairs", "t"), "one")
    return joined.select("correct", (F.col("p") - F.col("correct")).alias("wrong"), (F.col("t") - F.col("correct")).alias("missed"))


def e06_wilson_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = B.events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("good"))
    z, n, p = 1.96, F.col("n"), F.col("good") / F.col("n")
    return per.select("user_id", F.round((p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6).alias("lower"))


def q36_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready unless a critical component failed; others don't matter."""
    rows = B.health_events(spark, sf_dir).where("component IN (0, 1) OR status = 'ok'")
    return rows.groupBy("booth_id", "component").agg(F.every((F.col("status") == "ok") | (F.col("component") > 1)).alias("ok")).groupBy("booth_id").agg(F.every("ok").alias("overall_ok"))


#: Samples of a track that vote (fixed value).
VOTES = 30


def q37_attribute_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value with most confidence over a track's first VOTES samples, the one voted for first of equals,
    and its share."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    voted = B.events(spark, sf_dir).withColumn("place", place).where(F.col("place") <= VOTES)
    per = voted.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("w"), F.min("place").alias("first"))
    out = per.groupBy("user_id").agg(F.max_by("event_type", F.struct("w", -F.col("first"))).alias("winner"), F.max("w").alias("most"), F.sum("w").alias("all"))
    return out.select("user_id", "winner", F.round(F.col("most") / F.col("all"), 3).alias("confidence"))


QUERIES = {f.__name__: f for f in (
    j11_zone_of, j12_near_zones, t26_world_position, t27_heatmap, t27_heat_layers, l04_top_cells, t23_interest_score, t02_tripwire, t06_product_holds, t30_load_alerts, v01_cosine, v03_burst_consensus, l06_best_per_track,
    v07_representative, e01_detection_scores, e04_pairwise_merges, e06_wilson_bound, q36_readiness, q37_attribute_vote,
)}

_INSIDE = "\n  ".join(
    f"WHEN abs((x - {z[1] + z[3] / 2}) * cos(radians({-z[5]})) - (y - {z[2] + z[4] / 2}) * sin(radians({-z[5]}))) <= {z[3] / 2} AND abs((x - {z[1] + z[3] / 2}) * sin(radians({-z[5]})) + (y - {z[2] + z[4] / 2}) * cos(radians({-z[5]}))) <= {z[4] / 2} THEN '{z[0]}'"
    for z in ZONES
)
_H = HOMOGRAPHY
_MEANS = "SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ({})) GROUP BY 1, 2) GROUP BY 1"
_VECTORS = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"
_HEAT = f"SELECT trunc(y / 0.5)::INT AS row, trunc(x / 0.5)::INT AS col, count(*)::BIGINT AS traffic FROM ({POSITION_SQL}) GROUP BY 1, 2"
_NORM = "sqrt(list_dot_product(mean, mean))"
ORACLE_SQL = {
    "t02_tripwire": f"""WITH RECURSIVE d AS (SELECT *, (k - 50) / 100.0::DOUBLE AS distance, k / 100 - value / 2000 AS x1, k / 100 + value / 2000 AS x2, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ({EVENT_SQL})),
  r AS (SELECT *, CASE WHEN (abs(distance) < {folds.AMBIGUOUS}::DOUBLE AND NOT (x1 < 0.5 AND x2 > 0.5)) OR k % 10 / 5.0::DOUBLE < {folds.LEAST_AGE}::DOUBLE OR value / 100 < {folds.LEAST_HEIGHT}::DOUBLE THEN NULL WHEN distance >= 0 THEN 1 ELSE -1 END AS reads FROM d),
  s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::DOUBLE AS ts, NULL::INT AS side, 0 AS pending, NULL::DOUBLE AS last, false AS event FROM r UNION ALL
    SELECT user_id, i, ts, CASE WHEN turns OR side IS NULL THEN coalesce(reads, side) ELSE side END, CASE WHEN reads IS NULL THEN pending WHEN turns OR side IS NULL OR reads = side THEN 0 ELSE pending + 1 END, CASE WHEN turns AND NOT soon THEN ts ELSE last END, turns AND NOT soon FROM (
      SELECT *, coalesce(reads <> side AND pending + 1 >= {folds.READINGS}, false) AS turns, coalesce(ts - last < {folds.COOLDOWN}::DOUBLE, false) AS soon FROM (
        SELECT r.user_id, r.i, r.ts, r.reads, s.side, s.pending, s.last FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)))
  SELECT user_id % 5 AS camera_id, user_id AS track_id, ts, CASE WHEN side = 1 THEN 'in' ELSE 'out' END AS direction FROM s WHERE event""",
    "j11_zone_of": f"SELECT id, CASE {_INSIDE} END AS zone FROM ({POSITION_SQL})",
    "j12_near_zones": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT id, '{z[0]}' AS zone, round(sqrt(pow(greatest({z[1]} - x, 0, x - {z[1] + z[3]}), 2) + pow(greatest({z[2]} - y, 0, y - {z[2] + z[4]}), 2)), 6) AS distance FROM ({POSITION_SQL})" for z in ZONES
    ) + ") WHERE distance <= 2.0",
    "t26_world_position": f"""WITH RECURSIVE p AS (SELECT id, person, round((ts - 1704067200) / 3600, 6) AS t, round((x * {_H[0][0]}::DOUBLE + y * {_H[0][1]}::DOUBLE + {_H[0][2]}) / (x * {_H[2][0]}::DOUBLE + y * {_H[2][1]}::DOUBLE + {_H[2][2]}), 3) AS wx,
  round((x * {_H[1][0]}::DOUBLE + y * {_H[1][1]}::DOUBLE + {_H[1][2]}) / (x * {_H[2][0]}::DOUBLE + y * {_H[2][1]}::DOUBLE + {_H[2][2]}), 3) AS wy FROM ({POSITION_SQL})),
  r AS (SELECT *, CASE WHEN wx BETWEEN -0.5 AND 9.5 AND wy BETWEEN -0.5 AND 5.5 THEN 0.9 ELSE 0.45 END::DOUBLE AS c, row_number() OVER (PARTITION BY person ORDER BY t, id) AS i FROM p),
  f AS (SELECT person, i, id, wx, wy, c AS confidence, t AS lt, wx AS lx, wy AS ly FROM r WHERE i = 1 UNION ALL
    SELECT r.person, r.i, r.id, r.wx, r.wy, CASE WHEN j THEN round(c * 0.2::DOUBLE, 3) ELSE c END, CASE WHEN j THEN lt ELSE t END, CASE WHEN j THEN lx ELSE r.wx END, CASE WHEN j THEN ly ELSE r.wy END
    FROM (SELECT r.*, f.lt, f.lx, f.ly, sqrt(pow(r.wx - lx, 2) + pow(r.wy - ly, 2)) / greatest(0.001::DOUBLE, r.t - lt) > 3.0 AS j FROM f JOIN r ON r.person = f.person AND r.i = f.i + 1) r)
  SELECT id, wx, wy, confidence FROM f""",
    "t27_heatmap": f"SELECT row, col, traffic, round(traffic / max(traffic) OVER (), 6) AS share FROM ({_HEAT})",
    "t27_heat_layers": f"""WITH r AS (SELECT person, trunc(y / 0.5)::INT AS row, trunc(x / 0.5)::INT AS col, round((ts - 1704067200) / 600, 6) AS m, id, id % 7 / 4 AS interest FROM ({POSITION_SQL})), d AS (SELECT *, m - lag(m) OVER (PARTITION BY person ORDER BY m, id) AS step FROM r),
  l AS (SELECT row, col, unnest([{{'layer': 'traffic', 'w': 1.0::DOUBLE}}, {{'layer': 'dwell', 'w': CASE WHEN step > 0 AND step < 5 THEN step ELSE 0 END}}, {{'layer': 'interest', 'w': interest}}], recursive := true) FROM d WHERE m >= {HEAT_SINCE}),
  p AS (SELECT layer, row, col, round(sum(w), 6) AS weight FROM l GROUP BY ALL HAVING round(sum(w), 6) > 0) SELECT layer, row, col, weight, round(weight / max(weight) OVER (PARTITION BY layer), 6) AS share FROM p""",
    "l04_top_cells": f"SELECT row, col, traffic FROM ({_HEAT}) ORDER BY traffic DESC, row * 20 + col DESC LIMIT 5",
    "t23_interest_score": f"""WITH e AS (SELECT *, value / 10 AS look, k / 5 AS dwell, k % 6 <> 0 AS seen FROM ({EVENT_SQL})), s AS (SELECT event_id, list_filter([
    {{'w': 0.15::DOUBLE, 's': CASE WHEN look >= 1.5 THEN least(1.0::DOUBLE, look / 10) END}}, {{'w': 0.10::DOUBLE, 's': CASE WHEN dwell >= 2 THEN least(1.0::DOUBLE, dwell / 15) END}}, {{'w': 0.15::DOUBLE, 's': CASE WHEN seen THEN greatest(0.0::DOUBLE, 1 - (value % 3.0) / 1.5) END}},
    {{'w': 0.10::DOUBLE, 's': CASE WHEN seen AND event_type = 'click' THEN 1.0::DOUBLE END}}, {{'w': 0.15::DOUBLE, 's': CASE WHEN seen AND user_id % 4 <> 0 THEN user_id % 10 / 9 END}}, {{'w': 0.30::DOUBLE, 's': CASE WHEN seen AND user_id % 3 <> 0 THEN k / 100 END}},
    {{'w': 0.05::DOUBLE, 's': CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE END}}], lambda x: x.s IS NOT NULL) AS l FROM e),
  t AS (SELECT event_id, len(l) AS n, round(list_sum(list_transform(l, lambda x: x.s * x.w)) / list_sum(list_transform(l, lambda x: x.w)), 6) AS s FROM s)
  SELECT event_id, coalesce(s, 0.0::DOUBLE) AS score, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN s >= 0.7 AND n >= 3 THEN 'HIGH' WHEN s >= 0.4 THEN 'POSSIBLE' ELSE 'LOW' END AS level FROM t""",
    "v01_cosine": f"SELECT vec_id, round(list_cosine_similarity(v, mean), 6) AS cosine FROM ({_VECTORS}) JOIN ({_MEANS.format(_VECTORS)}) USING (label)",
    "v03_burst_consensus": f"""WITH e AS ({_VECTORS}), s AS (SELECT q.vec_id // 100 AS burst_id, q.vec_id AS frame, g.label::BIGINT AS product, max(list_cosine_similarity(q.v, g.v)) AS sim
  FROM e q JOIN e g ON q.vec_id % 20 = 0 AND g.vec_id <> q.vec_id AND g.label IS NOT NULL GROUP BY 1, 2, 3), w AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY sim DESC, product) = 1 AS wins FROM s),
  p AS (SELECT burst_id, product, count(*) AS n, quantile_cont(sim, 0.5) AS med, list_sort(list(sim)) AS sims, count(*) FILTER (wins) AS wins, count(*) FILTER (sim >= {vectors.SUPPORT}) AS supports FROM w GROUP BY 1, 2),
  c AS (SELECT *, 0.5::DOUBLE * med + 0.5::DOUBLE * list_avg(sims[floor(n * {vectors.TRIM})::INT + 1 : n - floor(n * {vectors.TRIM})::INT]) AS score FROM p),
  r AS (SELECT *, lead(score) OVER o AS next, row_number() OVER o AS rank FROM c WINDOW o AS (PARTITION BY burst_id ORDER BY score DESC, product))
  SELECT burst_id, product, round(score, 6) AS score, round(wins / n, 6) AS agreement, round(supports / n, 6) AS support, CASE WHEN n < {vectors.FRAMES} THEN 'unstable' WHEN score < {vectors.SUPPORT} THEN 'unknown'
  WHEN score - coalesce(next, -1) < {vectors.GAP} OR wins / n < {vectors.AGREEMENT} OR supports / n < {vectors.SUPPORTED} THEN 'ambiguous' ELSE 'matched' END AS status FROM r WHERE rank = 1""",
    "l06_best_per_track": f"SELECT user_id, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM ({EVENT_SQL})) WHERE rank <= 8",
    "v07_representative": f"""SELECT label, round(mean[1] / {_NORM}, 6) AS x0, round(mean[64] / {_NORM}, 6) AS x63
  FROM ({_MEANS.format(f'SELECT * FROM ({_VECTORS}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 8')})""",
    "t30_load_alerts": f"""WITH k AS (SELECT *, CASE WHEN value >= 60 THEN 1 WHEN value <= 40 THEN -1 ELSE 0 END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ({EVENT_SQL})), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, kind ORDER BY i) AS island FROM k),
  n AS (SELECT *, ts - first(ts) OVER (PARTITION BY user_id, kind, island ORDER BY i) AS held FROM g), q AS (SELECT user_id, kind, island, min(i) AS i FROM n WHERE kind <> 0 AND held >= 3600 GROUP BY 1, 2, 3), t AS (SELECT *, lag(kind, 1, -1) OVER (PARTITION BY user_id ORDER BY i) AS before FROM q)
  SELECT user_id, round(ts, 6) AS ts, CASE t.kind WHEN 1 THEN 'paused' ELSE 'resumed' END AS state FROM t JOIN k USING (user_id, i) WHERE before <> t.kind""",
    "e04_pairwise_merges": f"""WITH r AS (SELECT user_id AS t, (user_id * 7 + k % 3) % 97 AS p FROM ({EVENT_SQL})), c AS (SELECT sum(n * (n - 1) // 2) AS c FROM (SELECT count(*) AS n FROM r GROUP BY t, p))
  SELECT c::BIGINT AS correct, ((SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM r GROUP BY p)) - c)::BIGINT AS wrong, ((SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM r GROUP BY t)) - c)::BIGINT AS missed FROM c""",
    "e06_wilson_bound": f"""SELECT user_id, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lower
  FROM (SELECT user_id, count(*)::DOUBLE AS n, count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE AS p FROM ({EVENT_SQL}) GROUP BY 1)""",
    "q36_readiness": f"SELECT booth_id, bool_and(status = 'ok' OR component > 1) AS overall_ok FROM ({B.HEALTH_SQL}) WHERE component IN (0, 1) OR status = 'ok' GROUP BY 1",
    "q37_attribute_vote": f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM ({EVENT_SQL})), w AS (SELECT user_id, event_type, round(sum(value), 6) AS w, min(place) AS first FROM p WHERE place <= {VOTES} GROUP BY 1, 2)
  SELECT user_id, arg_max(event_type, (w, -first)) AS winner, round(max(w) / sum(w), 3) AS confidence FROM w GROUP BY 1""",
}
