"""Matching of boxes, tracking scores and debounced decisions (inventory ids J13, J14, Q40, T07-T09, T25, T28, T29, T32, V06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.functions import geometry as G
from fairground.operators import decisions as D
from fairground.operators import runs, vectors
from fairground.sources import bindings as B
from fairground.sources.bindings import EVENT_SQL, table

#: Similarities of known and possible products, least gap to the runner-up (fixed values).
KNOWN, POSSIBLE, MARGIN = 0.75, 0.55, 0.05
#: Overlap of a match.
MATCH_IOU = 0.2


def _boxes(spark: SparkSession, sf_dir: str, truth: bool) -> DataFrame:
    """Views are the true boxes of an hour's frame, clicks the predicted ones; of three by three."""
    rows = B.events(spark, sf_dir).where(F.col("event_type") == ("view" if truth else "click"))
    return rows.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("camera_id"), F.floor(F.col("ts") / 3600).cast("long").alias("frame"), F.col("user_id").alias("track"), F.pmod(F.col("value"), F.lit(7.0)).alias("x"), ((F.col("k") % 12) / 2).alias("y"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = []
    for truth, end in ((True, "row"), (False, "col")):
        sides.append(_boxes(spark, sf_dir, truth).select("camera_id", "frame", F.col("id").alias(end), F.col("track").alias(f"{end}_track"), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y")))
    box = lambda end: (F.col(f"{end}_x"), F.col(f"{end}_y"), F.col(f"{end}_x") + 3, F.col(f"{end}_y") + 3)
    return sides[0].join(sides[1], ["camera_id", "frame"]).withColumn("iou", F.round(G.iou(box("row"), box("col")), 9)).where(F.col("iou") >= MATCH_IOU)


def j13_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of a camera's frame: an equi-join by frame, then the condition."""
    return _overlaps(spark, sf_dir).select("camera_id", "frame", "row", "col", "iou")


def j14_greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_boxes(spark, sf_dir, MATCH_IOU)


def greedy_boxes(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    true, told = (_boxes(spark, sf_dir, truth).select("camera_id", "frame", "id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 3).alias("x2"), (F.col("y") + 3).alias("y2")) for truth in (True, False))
    return D.greedy_boxes(true, told, least)


def q40_tracking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By camera: misses, false positives, identity switches and accuracy of the matched tracks."""
    truth, pred = _boxes(spark, sf_dir, True), _boxes(spark, sf_dir, False)
    pairs = j14_greedy_pairs(spark, sf_dir)
    pairs = pairs.join(truth.select(F.col("id").alias("row"), F.col("track").alias("true")), "row").join(pred.select(F.col("id").alias("col"), F.col("track").alias("pred")), "col")
    before = F.lag("pred").over(W.partitionBy("camera_id", "true").orderBy("frame", "row"))
    matched = pairs.withColumn("before", before).groupBy("camera_id").agg(F.count("*").alias("matched"), F.count_if(F.col("before") != F.col("pred")).alias("switches"))
    count = lambda df, name: df.groupBy("camera_id").agg(F.count("*").alias(name))
    rows = count(truth, "num_gt").join(count(pred, "num_pred"), "camera_id", "full").join(matched, "camera_id", "left").na.fill(0)
    misses, wrong = F.col("num_gt") - F.col("matched"), F.col("num_pred") - F.col("matched")
    mota = F.when(F.col("num_gt") > 0, 1.0 - (misses + wrong + F.col("switches")) / F.col("num_gt")).otherwise(0.0)
    share = lambda n: F.round(F.coalesce(F.try_divide("matched", n), F.lit(0.0)), 4)
    return rows.select("camera_id", "num_gt", misses.alias("misses"), wrong.alias("false_positives"), "switches", F.round(mota, 4).alias("mota"), share("num_pred").alias("precision"), share("num_gt").alias("recall"))


def t07_camera_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour of the log counts as a second here, so that cameras meet."""
    seconds = (F.col("ts") - 1704067200) / 3600
    rows = B.events(spark, sf_dir).select((F.col("user_id") % 10).alias("booth_id"), seconds.alias("ts"), (F.col("user_id") % 3).alias("camera_id"), F.create_map((F.col("k") % 2).cast("string"), F.col("value") / 500).alias("found"))
    return D.agreements(rows)


def t08_product_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches confirmed by others nearby; small boxes need more of them and more confidence."""
    px, confidence = F.col("k") + 20.0, F.least(F.col("value") / 100, F.lit(1.0))
    x, y = F.pmod(F.col("value"), F.lit(7.0)), (F.col("k") % 12) / 2
    penalty = runs.distance_penalty(px)
    rows = B.events(spark, sf_dir).where(confidence >= 0.45 + penalty * (runs.FAR_CONFIDENCE - 0.45))
    rows = rows.select((F.col("user_id") % 5).alias("camera_id"), (F.col("k") % 4).alias("product"), F.round((F.col("ts") - 1704067200) / 3600, 6).alias("ts"), x.alias("x1"), y.alias("y1"), (x + 3).alias("x2"), (y + 3).alias("y2"), (2 + F.bround(penalty * runs.FAR_ROWS)).cast("int").alias("needed"), "event_id")
    found = runs.supported(rows, ["camera_id", "product"], "ts", "event_id", G.iou)
    return found.select("event_id", (F.col("support") + 1 >= F.col("needed")).alias("confirmed"))


def t09_scan_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "unknown").when(F.col("value") < 5, "unstable").otherwise("matched")
    rows = B.events(spark, sf_dir).select((F.col("user_id")).alias("camera_id"), F.col("event_id").alias("scan_id"), "ts", status.alias("status"), (F.col("k") % 3).alias("product_id"))
    return D.scan_switches(rows)


def t25_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.events(spark, sf_dir).select(F.col("user_id").alias("person"), (F.col("k") % 3).alias("product"), "ts", F.when(F.col("event_type") == "error", 0.0).otherwise(0.5).alias("iou"), F.col("value").alias("cx"), F.col("k").cast("double").alias("cy"), "event_id")
    return runs.interactions(rows, "event_id").select("event_id", "status")


def t28_camera_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's first sight by each further camera, and the camera whose first sight came before;
    the seconds between both are an addition."""
    rows = B.events(spark, sf_dir).select("user_id", (F.col("k") % 4).alias("camera_id"), "ts", "event_id")
    first = rows.groupBy("user_id", "camera_id").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    by = W.partitionBy("user_id").orderBy("at")
    found = first.select("user_id", F.lag("camera_id").over(by).alias("from_camera"), F.col("camera_id").alias("to_camera"), "at", F.lag("at").over(by).alias("left"))
    return found.where("from_camera IS NOT NULL").select("user_id", "from_camera", "to_camera", F.round(F.col("at.ts") - F.col("left.ts"), 6).alias("transit_sec"))


def t29_device_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("event_type") != "error", F.transform(F.sequence(F.lit(0), (F.col("k") % 4).cast("int")), lambda i: F.concat(F.lit("cam"), i)))
    return D.device_changes(B.events(spark, sf_dir).select(F.col("user_id").alias("machine"), "ts", "event_id", names.alias("devices")), "event_id")


def t32_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow waves of changed pixels with a little noise."""
    wave = 0.08 + 0.08 * F.sin(F.col("ts") / 200000) + F.col("k") / 5000
    rows = B.events(spark, sf_dir).select(F.floor(F.col("user_id") / 10).alias("camera_id"), "ts", "event_id", F.round(wave, 6).alias("ratio"))
    return runs.presence(rows, "camera_id", "ts", "event_id", "ratio").select("camera_id", F.round("ts", 6).alias("ts"), "state")


def v06_product_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best look of every label against the stated queries, in blocks of the gallery; known,
    possible or unknown by likeness and by the gap to the runner-up."""
    rows = vectors.valid(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), "v", 64)
    rows = rows.withColumn("v", vectors.normalised(F.col("v")))
    gallery = rows.where("label IS NOT NULL").select(F.col("vec_id").alias("other"), F.col("label").alias("product"), F.col("v").alias("g"))
    met = vectors.best_looks(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "v"), gallery)
    per = met.select(F.col("query").alias("vec_id"), F.col("product").cast("int").alias("label"), F.round("score", 6).alias("score"))
    by = W.partitionBy("vec_id").orderBy(F.desc("score"), F.desc("label"))
    top = per.withColumn("next", F.coalesce(F.lead("score").over(by), F.lit(0.0))).withColumn("rank", F.row_number().over(by)).where("rank = 1")
    sure = (F.col("score") >= KNOWN) & (F.col("score") - F.col("next") >= MARGIN)
    status = F.when(F.col("score") < POSSIBLE, "UNKNOWN").when(sure, "KNOWN").otherwise("POSSIBLE")
    return top.select("vec_id", status.alias("status"), F.when(F.col("score") >= POSSIBLE, F.col("label")).alias("label"), F.round("score", 3).alias("score"), F.round("next", 3).alias("runner_up"))


QUERIES = {f.__name__: f for f in (
    j13_iou_pairs, j14_greedy_pairs, q40_tracking_scores, t07_camera_agreement, t08_product_confirmation, t09_scan_switches, t25_interactions, t28_camera_transitions, t29_device_changes, t32_presence, v06_product_classify,
)}

_BOX_SQL = f"SELECT event_id AS id, user_id % 5 AS camera_id, floor(ts / 3600)::BIGINT AS frame, value % 7.0 AS x, (k % 12) / 2 AS y, event_type FROM ({EVENT_SQL}) WHERE event_type IN ('view', 'click')"
_USER = "PARTITION BY user_id ORDER BY ts, event_id"
_SPAN = "PARTITION BY camera_id, product ORDER BY ts, event_id"
_IOU_SQL = f"""WITH b AS ({_BOX_SQL}), p AS (SELECT a.camera_id, a.frame, a.id AS row, b.id AS col, greatest(3 - abs(a.x - b.x), 0) * greatest(3 - abs(a.y - b.y), 0) AS i
  FROM b a JOIN b ON a.camera_id = b.camera_id AND a.frame = b.frame AND a.event_type = 'view' AND b.event_type = 'click')
  SELECT camera_id, frame, row, col, round(i / (18 - i), 9) AS iou FROM p WHERE round(i / (18 - i), 9) >= {MATCH_IOU}"""
#: Pairs by falling overlap, each row and column of a frame once: the frames' candidates one after another.
_GREEDY_SQL = f"""c AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame ORDER BY iou DESC, row DESC, col DESC) AS i FROM ({_IOU_SQL})),
  g AS (SELECT DISTINCT camera_id, frame, 0::BIGINT AS i, 0::BIGINT AS row, 0::BIGINT AS col, 0.0::DOUBLE AS iou, []::BIGINT[] AS rows, []::BIGINT[] AS cols, false AS taken FROM c UNION ALL
    SELECT camera_id, frame, i, row, col, iou, CASE WHEN free THEN list_append(rows, row) ELSE rows END, CASE WHEN free THEN list_append(cols, col) ELSE cols END, free FROM (
      SELECT c.camera_id, c.frame, c.i, c.row, c.col, c.iou, g.rows, g.cols, NOT list_contains(g.rows, c.row) AND NOT list_contains(g.cols, c.col) AS free FROM g JOIN c ON c.camera_id = g.camera_id AND c.frame = g.frame AND c.i = g.i + 1))"""
ORACLE_SQL = {
    "j14_greedy_pairs": f"WITH RECURSIVE {_GREEDY_SQL} SELECT camera_id, frame, row, col, iou FROM g WHERE taken",
    "q40_tracking_scores": f"""WITH RECURSIVE {_GREEDY_SQL}, b AS (SELECT b.*, user_id AS track FROM ({_BOX_SQL}) b JOIN events ON event_id = id),
  m AS (SELECT g.camera_id, p.track AS pred, lag(p.track) OVER (PARTITION BY g.camera_id, t.track ORDER BY g.frame, g.row) AS before FROM g JOIN b t ON t.id = g.row JOIN b p ON p.id = g.col WHERE taken),
  s AS (SELECT camera_id, count(*) AS matched, count(*) FILTER (before <> pred) AS switches FROM m GROUP BY 1),
  n AS (SELECT camera_id, count(*) FILTER (event_type = 'view') AS num_gt, count(*) FILTER (event_type = 'click') AS num_pred FROM b GROUP BY 1),
  r AS (SELECT n.*, coalesce(matched, 0) AS matched, coalesce(switches, 0)::BIGINT AS switches FROM n LEFT JOIN s USING (camera_id))
  SELECT camera_id, num_gt, (num_gt - matched)::BIGINT AS misses, (num_pred - matched)::BIGINT AS false_positives, switches, round(CASE WHEN num_gt > 0 THEN 1.0::DOUBLE - (num_gt + num_pred - 2 * matched + switches) / num_gt ELSE 0.0 END, 4) AS mota,
    round(coalesce(matched / nullif(num_pred, 0), 0.0::DOUBLE), 4) AS precision, round(coalesce(matched / nullif(num_gt, 0), 0.0::DOUBLE), 4) AS recall FROM r""",
    "t09_scan_switches": f"""WITH RECURSIVE r AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'matched' END AS status, CASE WHEN event_type <> 'error' THEN k % 3 END AS product, row_number() OVER ({_USER}) AS i FROM ({EVENT_SQL}) WHERE event_type = 'error' OR value >= 5),
  s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, NULL::BIGINT AS shown, NULL::VARCHAR AS asked, 0 AS times, false AS told FROM r UNION ALL
    SELECT user_id, i, event_id, CASE WHEN told THEN product ELSE shown END, CASE WHEN NOT same AND NOT told THEN wish END, CASE WHEN NOT same AND NOT told THEN times ELSE 0 END, told FROM (
      SELECT *, NOT same AND (shown IS NULL OR times >= {D.SWITCH_SCANS}) AS told FROM (
        SELECT r.user_id, r.i, r.event_id, r.product, s.shown, coalesce(r.product = s.shown, false) AS same, r.status || coalesce(r.product, -1) AS wish, CASE WHEN s.asked = r.status || coalesce(r.product, -1) THEN s.times + 1 ELSE 1 END AS times
        FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)))
  SELECT user_id AS camera_id, event_id AS scan_id, shown AS product_id, shown IS NOT NULL AS matched FROM s WHERE told""",
    "t08_product_confirmation": f"""WITH p AS (SELECT *, 1 - (least(greatest(k + 20.0::DOUBLE, 24), 80) - 24) / 56.0::DOUBLE AS far FROM ({EVENT_SQL})),
  r AS (SELECT event_id, user_id % 5 AS camera_id, k % 4 AS product, round((ts - 1704067200) / 3600, 6) AS ts, value % 7.0 AS x, (k % 12) / 2 AS y, 2 + round_even(far * 2, 0)::INT AS needed FROM p WHERE least(value / 100, 1.0) >= 0.45::DOUBLE + far * (0.75::DOUBLE - 0.45::DOUBLE)),
  b AS (SELECT *, list({{'t': ts, 'x': x, 'y': y}}) OVER ({_SPAN} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS back FROM r),
  n AS (SELECT *, list_transform(back, lambda h: CASE WHEN ts - h.t <= 4 THEN greatest(3 - abs(x - h.x), 0) * greatest(3 - abs(y - h.y), 0) ELSE 0 END) AS hits FROM b)
  SELECT event_id, coalesce(len(list_filter(hits, lambda i: i / (18 - i) >= 0.2::DOUBLE)), 0) + 1 >= needed AS confirmed FROM n""",
    "t25_interactions": f"""WITH r AS (SELECT *, k % 3 AS product, event_type <> 'error' AS touch FROM ({EVENT_SQL})), s AS (SELECT *, sum(CASE WHEN touch THEN 1 ELSE -1 END) OVER w AS s FROM r WINDOW w AS (PARTITION BY user_id, product ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id, product ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS n FROM s), p AS (SELECT *, sum((n = 0)::INT) OVER (PARTITION BY user_id, product ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rests FROM c),
  d AS (SELECT *, sqrt(pow(value - first(value) OVER w, 2) + pow(k - first(k) OVER w, 2)) AS apart FROM p WINDOW w AS (PARTITION BY user_id, product, rests ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id, CASE WHEN n >= 3 AND max(apart) OVER (PARTITION BY user_id, product, rests ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 15 THEN 'CONFIRMED_INTERACTION' WHEN touch THEN 'POSSIBLE_INTERACTION' ELSE 'UNKNOWN' END AS status FROM d""",
    "t32_presence": f"""WITH r AS (SELECT *, user_id // 10 AS camera_id, round(0.08::DOUBLE + 0.08::DOUBLE * sin(ts / 200000) + k / 5000, 6) AS ratio FROM ({EVENT_SQL})),
  k AS (SELECT *, CASE WHEN ratio >= 0.12 THEN 1 WHEN ratio <= 0.04 THEN -1 ELSE 0 END AS kind, row_number() OVER (PARTITION BY camera_id ORDER BY ts, event_id) AS i FROM r),
  g AS (SELECT *, i - row_number() OVER (PARTITION BY camera_id, kind ORDER BY i) AS island FROM k), n AS (SELECT *, row_number() OVER w AS n, first(ts) OVER w AS since FROM g WINDOW w AS (PARTITION BY camera_id, kind, island ORDER BY i)),
  q AS (SELECT camera_id, kind, island, min(i) AS i FROM n WHERE kind <> 0 AND ts - since >= 0.6 AND n >= CASE kind WHEN 1 THEN 10 ELSE 12 END GROUP BY 1, 2, 3), t AS (SELECT *, lag(kind, 1, -1) OVER (PARTITION BY camera_id ORDER BY i) AS before FROM q)
  SELECT camera_id, round(ts, 6) AS ts, CASE t.kind WHEN 1 THEN 'PRESENT' ELSE 'EMPTY' END AS state FROM t JOIN k USING (camera_id, i) WHERE before <> t.kind""",
    "j13_iou_pairs": _IOU_SQL,
    "t28_camera_transitions": f"""WITH f AS (SELECT user_id, k % 4 AS camera_id, min((ts, event_id)) AS seen, min(ts) AS ts FROM ({EVENT_SQL}) GROUP BY 1, 2),
  l AS (SELECT user_id, lag(camera_id) OVER w AS from_camera, camera_id AS to_camera, round(ts - lag(ts) OVER w, 6) AS transit_sec FROM f WINDOW w AS (PARTITION BY user_id ORDER BY seen))
  SELECT * FROM l WHERE from_camera IS NOT NULL""",
    "v06_product_classify": f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id, g.label, round(max(list_cosine_similarity(q.v, g.v)), 6) AS score
  FROM e q JOIN e g ON q.vec_id % 20 = 0 AND g.vec_id <> q.vec_id AND g.label IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT *, coalesce(lead(score) OVER w, 0) AS next, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, label DESC))
  SELECT vec_id, CASE WHEN score < {POSSIBLE} THEN 'UNKNOWN' WHEN score >= {KNOWN} AND score - next >= {MARGIN} THEN 'KNOWN' ELSE 'POSSIBLE' END AS status,
  CASE WHEN score >= {POSSIBLE} THEN label END AS label, round(score, 3) AS score, round(next, 3) AS runner_up FROM r WHERE rank = 1""",
}
