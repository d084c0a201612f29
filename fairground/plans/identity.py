"""Tracks, identities and galleries (inventory ids J15, J16, J19, J20, J24, T12-T18, T20, T24, Q42, V05, V10, E03, E05, E07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.functions import geometry as G
from fairground.operators import identity as I
from fairground.operators import tracking as T
from fairground.operators import vectors
from fairground.operators.folds import throttle
from fairground.plans import spatial, tracking
from fairground.sources import bindings as B
from fairground.sources.bindings import EVENT_SQL, table

#: Floors and gap of a gallery match, and the floor with one product only (fixed values).
GALLERY, ALONE = (0.45, 0.10), 0.65
#: Walking speeds and the pause that a walk between cameras may take (fixed values).
FASTEST, SLOWEST, PAUSE = 2.0, 0.35, 5.0
#: Share of the colours in a likeness across cameras, and how many components they are.
COLOUR_SHARE, COLOURS = 0.35, 16
#: Rows of a task that sorts them by person.
PER_TASK = 250_000


def _minutes():
    """Ten minutes of the log count as a second here, so that rows meet."""
    return (F.col("ts") - 1704067200) / 600


def j15_optimal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.optimal_pairs(tracking.j13_iou_pairs(spark, sf_dir))


def j16_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person who holds a product: whose box touches it or holds its middle, by overlap, the later of equals."""
    person, product = (tracking._boxes(spark, sf_dir, truth).select("camera_id", "frame", *[F.col(c).alias(f"{end}_{c}") for c in ("id", "x", "y")]) for truth, end in ((True, "p"), (False, "q")))
    box = lambda end: (F.col(f"{end}_x"), F.col(f"{end}_y"), F.col(f"{end}_x") + 3, F.col(f"{end}_y") + 3)
    met = product.join(person, ["camera_id", "frame"]).withColumn("iou", F.round(G.iou(box("p"), box("q")), 9))
    inside = (F.col("q_x") + 1.5).between(F.col("p_x"), F.col("p_x") + 3) & (F.col("q_y") + 1.5).between(F.col("p_y"), F.col("p_y") + 3)
    return met.where((F.col("iou") >= 0.02) | inside).groupBy("q_id").agg(F.max_by("p_id", F.struct("iou", "p_id")).alias("holder")).select(F.col("q_id").alias("product"), "holder")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.events(spark, sf_dir).select((F.col("user_id") % 60).alias("a"), ((F.col("user_id") * 7 + F.col("k") % 3) % 60).alias("b")).distinct()


def j19_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near two cameras are: joined, one camera apart, or neither."""
    edges = _edges(spark, sf_dir)
    asked = B.events(spark, sf_dir).select((F.col("user_id") % 60).alias("a"), (F.col("k") % 60).alias("b")).distinct()
    onward = edges.select(F.col("a").alias("via"), "b")
    two = edges.select("a", F.col("b").alias("via")).join(onward, "via").select("a", "b").distinct()
    near = edges.withColumn("near", F.lit(1.0)).union(two.withColumn("near", F.lit(0.6))).groupBy("a", "b").agg(F.max("near").alias("near"))
    return asked.join(near, ["a", "b"], "left").select("a", "b", F.coalesce("near", F.lit(0.15)).alias("nearness"))


def j20_transition_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a person can have walked from the camera before in the time it took; pairs of cameras without
    a window have WINDOW, the same camera any time."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = B.events(spark, sf_dir).withColumn("camera", F.col("k") % 6).withColumn("at", _minutes())
    rows = rows.select("event_id", "camera", F.lag("camera").over(by).alias("before"), (F.col("at") - F.lag("at").over(by)).alias("elapsed")).where("before IS NOT NULL")
    windows = spark.range(36).select((F.col("id") % 6).alias("a"), F.floor(F.col("id") / 6).alias("b")).where("a < b AND (a + b) % 2 = 1")
    windows = windows.select("a", "b", (F.col("b") - F.col("a")).cast("double").alias("low"), (F.col("b") * 40.0).alias("high"))
    rows = rows.withColumn("a", F.least("camera", "before")).withColumn("b", F.greatest("camera", "before")).join(F.broadcast(windows), ["a", "b"], "left")
    low, high = F.coalesce("low", F.lit(I.WINDOW[0])), F.coalesce("high", F.lit(I.WINDOW[1]))
    return rows.select("event_id", F.when(F.col("camera") == F.col("before"), F.lit(True)).otherwise(F.col("elapsed").between(low, high)).alias("possible"))


def j24_layout_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that a walk between two cameras of a layout can take, from their distance in metres."""
    scale = F.when(F.col("n_regionkey") % 2 == 1, 0.3048).otherwise(1.0)
    cameras = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") % 4 * 3.5 * scale).alias("x"), (F.col("n_nationkey") % 3 * 2.0 * scale).alias("y"))
    a, b = (cameras.select("n_regionkey", *[F.col(c).alias(f"{end}_{c}") for c in ("n_nationkey", "x", "y")]) for end in "ab")
    d = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    pairs = a.join(b, "n_regionkey").where("a_n_nationkey < b_n_nationkey").withColumn("d", d)
    return pairs.select(F.col("a_n_nationkey").alias("a"), F.col("b_n_nationkey").alias("b"), F.round(F.when(F.col("d") > 0, F.col("d") / FASTEST).otherwise(0.0), 6).alias("min_sec"), F.round(F.col("d") / SLOWEST + PAUSE, 6).alias("max_sec"))


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that walk slowly from side to side; a camera for every ten users."""
    at, user = F.floor(_minutes()), F.col("user_id")
    x = user % 10 * 12 + 2 * F.sin(at / 40)
    return B.events(spark, sf_dir).select(F.floor(user / 10).alias("camera_id"), at.cast("double").alias("ts"), F.col("event_id").alias("id"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 8).alias("x2"), F.lit(20.0).alias("y2"), (F.col("value") / 50).alias("score"), user.alias("true"))


def t12_booth_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tracked(_detections(spark, sf_dir), T.BOOTH)


def t13_server_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tracked(_detections(spark, sf_dir), T.SERVER)


def t14_product_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tracked(_detections(spark, sf_dir), T.PRODUCT)


def e03_tracking_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDF1, switches and fragments of the server's tracker, by camera."""
    rows = _detections(spark, sf_dir).withColumnRenamed("camera_id", "scene")
    return T.identity_scores(rows.select("scene", "ts", "id", "true"), t13_server_tracker(spark, sf_dir).withColumnRenamed("camera_id", "scene"))


def t15_category_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's category so far: the one with most weight since it was last unseen for long, if the weight
    and the lead over the next suffice."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = B.events(spark, sf_dir).withColumn("at", _minutes())
    rows = rows.withColumn("stale", F.coalesce(F.col("at") - F.lag("at").over(by) > 8.0, F.lit(True)).cast("int")).withColumn("part", F.sum("stale").over(by))
    upto = W.partitionBy("user_id", "part").orderBy("ts", "event_id")
    kinds = ["view", "click", "purchase"]
    votes = [F.struct(F.round(F.coalesce(F.sum(F.when(F.col("event_type") == c, F.col("value"))).over(upto), F.lit(0.0)), 6).alias("w"), F.lit(c).alias("c")) for c in kinds]
    ranked = F.reverse(F.array_sort(F.array(*votes)))
    rows = rows.select("event_id", ranked.alias("v"))
    first, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    return rows.select("event_id", F.when((first["w"] >= 20.0) & (first["w"] - second["w"] >= 5.0), first["c"]).otherwise("unknown").alias("category"))


def t16_identity_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A booth for every ten users; a look is one of five directions with a little of another."""
    angle = (F.col("user_id") % 5 + F.col("k") / 400) * 1.2
    look = F.when(F.col("event_type") != "error", F.array(F.cos(angle), F.sin(angle)))
    rows = B.events(spark, sf_dir).select(
        F.floor(F.col("user_id") / 10).alias("booth_id"), F.col("event_id").alias("track"), (F.col("k") % 3).alias("camera_id"), _minutes().alias("ts"), look.alias("look"),
        F.when(F.col("k") % 4 != 0, F.col("user_id") % 3).alias("clothing"), F.when(F.col("k") % 5 != 0, F.col("user_id") % 2).alias("body"),
    )
    return I.assigned(rows)


def t17a_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda m: F.col("user_id") * m % 97 / 97 + F.col("k") / 1000
    gender = lambda c: F.when(c % 3 == 0, "MALE").when(c % 3 == 1, "FEMALE").otherwise("UNKNOWN")
    reason = I.contradiction(F.col("k") == 9, F.when(F.col("k") % 2 == 0, F.round(share(3), 6)), gender(F.col("user_id")), gender(F.col("k")), F.round(share(5), 6), F.round(share(7), 6), F.when(F.col("k") % 5 != 0, F.round(share(11), 6)), F.col("event_type") == "click")
    return B.events(spark, sf_dir).select("event_id", reason.alias("reason"))


def t17b_stitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.events(spark, sf_dir).select((F.col("user_id") % 9).alias("camera_id"), F.col("event_id").alias("track"), F.round(_minutes(), 6).alias("ts"), F.pmod(F.col("value"), F.lit(7.0)).alias("x"), (F.col("k") % 12 / 2).alias("y"), (F.col("k") % 5 + 1.0).alias("height"), "event_type")
    return I.stitches(rows.where("event_type = 'view'").drop("event_type"), rows.where("event_type = 'click'").drop("event_type")).drop("new_ts")


def t17c_face_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces seen within the time that a walk may take."""
    rows = B.events(spark, sf_dir).where("event_type <> 'error'").groupBy(F.col("user_id").alias("query"), (F.col("k") % 6).alias("person")).agg(F.round(F.max("value") / 200, 6).alias("score"))
    return I.best_match(rows, *I.FACE_MATCH)


def t17d_look_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.events(spark, sf_dir).groupBy(F.col("user_id").alias("query"), (F.col("k") % 9).alias("person")).agg(F.round(F.avg("value") / 60, 6).alias("score"))
    return I.best_match(rows, *I.LOOK_MATCH, floor=0.0)


def t17e_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("value") < 8, "low").when(F.col("k") < 25, "gender").when(F.col("k") < 40, "face").when(F.col("k") < 70, "colour").when(F.col("k") < 75, "hair")
    return I.splits(B.events(spark, sf_dir).select(F.col("user_id").alias("track"), "ts", F.col("event_id").alias("id"), reason.alias("reason"))).select("track", "id", "reason")


def t17f_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of a booth against one another; a booth has ten."""
    persons = B.events(spark, sf_dir).groupBy(F.col("user_id").alias("person")).agg(F.round(F.min("ts"), 6).alias("first_seen"), (F.count("*") > 60).alias("confirmed")).withColumn("booth_id", F.floor(F.col("person") / 10))
    a, b = (persons.select("booth_id", F.col("person").alias(c)) for c in "ab")
    pairs = a.join(b, "booth_id").where("a < b").withColumn("sim", F.round((F.col("a") * 31 + F.col("b") * 17) % 100 / 110, 6))
    return I.merges(pairs, persons)


def t17g_sampler_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of looks: boxes high enough, tracks old enough, and not too many of a track."""
    rows = B.events(spark, sf_dir).where("k >= 12 AND value >= 5").withColumn("at", _minutes()).select("user_id", "event_id", "at")
    return throttle(rows, "user_id", "at", "event_id", 0.75).select("user_id", "event_id")


def t18_co_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = B.events(spark, sf_dir).select((F.col("k") % 6).alias("camera_id"), F.floor(F.col("ts") / 3600).alias("pass"), F.col("user_id").alias("person"))
    return I.exclusions(seen)


def t20_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.events(spark, sf_dir).select("user_id", (_minutes() / 10).alias("ts"), F.col("event_id").alias("id"), ((F.col("k") - 40) / 20).alias("logit"), (F.col("event_type") != "error").alias("face"), F.lit(0.8).alias("weight"))
    return I.smoothed(rows)


def t24_interest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's interest in a product starts, and ends once the person is seen again and the product
    hasn't been with them for three seconds; who isn't seen again ends nothing."""
    rows = B.events(spark, sf_dir).select(F.col("user_id").alias("person"), (F.col("k") % 4).alias("product"), F.round(_minutes(), 6).alias("at"), "event_id")
    return interest_events(rows)


def interest_events(rows: DataFrame) -> DataFrame:
    """rows: person, product, at, event_id. Persons are dealt into tasks of about PER_TASK rows."""
    rows = rows.repartition(max(1, -(-rows.count() // PER_TASK)), "person")
    # from the latest on, so that the frame only grows
    back = -F.round(F.col("at") * 1_000_000).cast("long")
    again = F.min("at").over(W.partitionBy("person").orderBy(back).rangeBetween(W.unboundedPreceding, -3_000_001))
    by = W.partitionBy("person", "product").orderBy("at", "event_id")
    rows = rows.withColumn("again", again).withColumn("before", F.lag("at").over(by)).withColumn("next", F.lead("at").over(by))
    # the pair is over if the person came again, without the product, before it did
    rows = rows.withColumn("ends", F.col("again").isNotNull() & (F.col("next").isNull() | (F.col("next") > F.col("again"))))
    rows = rows.withColumn("starts", F.coalesce(F.lag("ends").over(by), F.lit(True)))
    begun = F.struct(F.when(F.col("starts"), "STARTED").otherwise("UPDATED").alias("event"), F.col("at").alias("ts"))
    ended = F.when(F.col("ends"), F.struct(F.lit("ENDED").alias("event"), F.col("again").alias("ts")))
    return rows.select("person", "product", F.inline(F.array_compact(F.array(begun, ended))))


def q42_interest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every product that was held last: confirmed, over, or perhaps held."""
    events = spatial.t06_product_holds(spark, sf_dir).groupBy("camera_id", "product").agg(F.max_by("event", F.struct("ts", F.col("event") != "confirmed")).alias("last"))
    products = B.events(spark, sf_dir).select(F.floor(F.col("user_id") / 10).alias("camera_id"), (F.col("k") % 4).alias("product")).distinct()
    state = F.when(F.col("last") == "confirmed", "INTEREST_CONFIRMED").when(F.col("last").isNotNull(), "NOT_INTERACTING").otherwise("POSSIBLE_INTERACTION")
    return products.join(events, ["camera_id", "product"], "left").select("camera_id", "product", state.alias("state"))


def v05_gallery_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries against all labelled vectors but themselves, after the mean of all is taken off;
    the product is null unless it is good and clear enough."""
    rows = vectors.valid(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), "v", 64)
    mean = vectors.mean_vectors(rows.withColumn("all", F.lit(1)), "all", "v").select("mean")
    rows = rows.join(F.broadcast(mean)).withColumn("v", vectors.normalised(F.zip_with("v", "mean", lambda x, m: x - m)))
    gallery = rows.where("label IS NOT NULL").select(F.col("vec_id").alias("other"), F.col("label").alias("product"), F.col("v").alias("g"))
    met = vectors.best_looks(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "v"), gallery)
    per = met.select(F.col("query").alias("vec_id"), F.col("product").cast("int").alias("product"), F.round("score", 6).alias("score"))
    by = W.partitionBy("vec_id").orderBy(F.desc("score"), "product")
    top = per.withColumn("next", F.lead("score").over(by)).withColumn("rank", F.row_number().over(by)).where("rank = 1")
    sure = F.when(F.col("next").isNull(), F.col("score") >= ALONE).otherwise((F.col("score") >= GALLERY[0]) & (F.round(F.col("score") - F.col("next"), 6) >= GALLERY[1]))
    return top.select("vec_id", F.when(sure, F.col("product")).alias("product"), "score")


def v10_person_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries against persons (labels) with looks from three cameras: half by the best look, half
    by the best of the cameras' mean looks, which the query has part in as any other look. Across cameras, colours have a weight of their own."""
    rows = vectors.valid(table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("vec_id", "label", (F.col("vec_id") % 3).alias("camera"), F.col("embedding").cast("array<double>").alias("v")), "v", 64)
    unit = rows.withColumn("v", vectors.normalised(F.col("v")))
    means = vectors.mean_vectors(unit.withColumn("key", F.struct("label", "camera")), "key", "v").select("key.label", "key.camera", F.col("mean").alias("g"))
    look = lambda rows, other, single, v: rows.select(other.cast("long").alias("other"), F.col("label").cast("long").alias("label"), F.col("camera").cast("long").alias("camera"), F.lit(single).alias("single"), F.col(v).alias("g"))
    stored = look(unit, F.col("vec_id"), True, "v").union(look(means, F.lit(None), False, "g"))
    asked = unit.where("vec_id % 20 = 0").select(F.col("vec_id").cast("long").alias("query"), F.col("camera").cast("long").alias("own"), "v")
    per = vectors.best_and_mean_looks(asked, stored, COLOURS, COLOUR_SHARE).withColumnRenamed("query", "vec_id").withColumn("label", F.col("label").cast("int"))
    return per.select("vec_id", "label", F.round(F.when(F.col("n") < 2, F.col("best")).otherwise(0.5 * F.col("best") + 0.5 * F.col("mean")), 6).alias("similarity"))


def e05_balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By size of the face: accuracy of each class, both weighing the same."""
    rows = B.events(spark, sf_dir).select((F.col("k") / 25).cast("int").alias("bucket"), (F.col("user_id") % 2 == 0).alias("real"), (F.col("value") + F.col("user_id") % 2 * -8 > 25).alias("told"))
    per = rows.groupBy("bucket").agg(F.avg(F.when(F.col("real"), F.col("told").cast("int"))).alias("tpr"), F.avg(F.when(~F.col("real"), (~F.col("told")).cast("int"))).alias("tnr"), F.count("*").alias("n"))
    return per.select("bucket", "n", F.round((F.coalesce("tpr", "tnr") + F.coalesce("tnr", "tpr")) / 2, 6).alias("balanced_accuracy"))


def e07_prequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over the last 200 predictions, each made before its label was learnt; competence once there
    are forty, ready once they are right often enough and each class has come twenty times."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    last = by.rowsBetween(-199, W.currentRow)
    rows = B.events(spark, sf_dir).withColumn("right", (F.col("k") % 4 != 0).cast("int")).withColumn("male", (F.col("event_type") == "view").cast("int"))
    rows = rows.select("event_id", F.avg("right").over(last).alias("acc"), F.count("*").over(last).alias("n"), F.sum("male").over(by).alias("m"), F.sum(1 - F.col("male")).over(by).alias("f"))
    acc = F.when(F.col("n") >= 40, F.col("acc"))
    ready = F.coalesce((F.col("m") >= 20) & (F.col("f") >= 20) & (acc >= 0.62), F.lit(False))
    competence = F.when(acc.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (acc - 0.5))), 6))
    return rows.select("event_id", F.round(acc, 6).alias("accuracy"), competence.alias("competence"), ready.alias("ready"))


QUERIES = {f.__name__: f for f in (
    j15_optimal_pairs, j16_holders, j19_reachability, j20_transition_windows, j24_layout_windows, t12_booth_tracker, t13_server_tracker, t14_product_tracker, e03_tracking_identity, t15_category_vote, t16_identity_assignment,
    t17a_contradictions, t17b_stitches, t17c_face_match, t17d_look_match, t17e_splits, t17f_merges, t17g_sampler_gate, t18_co_visibility, t20_evidence, t24_interest_events, q42_interest_states, v05_gallery_identify,
    v10_person_similarity, e05_balanced_accuracy, e07_prequential,
)}

_E = f"({EVENT_SQL})"
_AT = "(ts - 1704067200) / 600"
_BY = "PARTITION BY user_id ORDER BY ts, event_id"
_V = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"


def _best(rows: str, least: float, gap: float, floor: float) -> str:
    return f"""WITH c AS ({rows}), r AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS rank FROM c WINDOW w AS (PARTITION BY query ORDER BY score DESC, person))
  SELECT query, person, score FROM r WHERE rank = 1 AND score >= {least} AND round(score - greatest(coalesce(next, {floor}), {floor})::DOUBLE, 9) >= {gap}"""


ORACLE_SQL = {
    "j16_holders": f"""WITH b AS ({tracking._BOX_SQL}), p AS (SELECT q.id AS product, p.id, greatest(3 - abs(p.x - q.x), 0) * greatest(3 - abs(p.y - q.y), 0) AS i, q.x + 1.5 BETWEEN p.x AND p.x + 3 AND q.y + 1.5 BETWEEN p.y AND p.y + 3 AS held
  FROM b q JOIN b p ON q.camera_id = p.camera_id AND q.frame = p.frame AND q.event_type = 'click' AND p.event_type = 'view')
  SELECT product, arg_max(id, (round(i / (18 - i), 9), id)) AS holder FROM p WHERE round(i / (18 - i), 9) >= 0.02 OR held GROUP BY 1""",
    "j19_reachability": f"""WITH e AS (SELECT DISTINCT user_id % 60 AS a, (user_id * 7 + k % 3) % 60 AS b FROM {_E}), q AS (SELECT DISTINCT user_id % 60 AS a, k % 60 AS b FROM {_E}), t AS (SELECT DISTINCT x.a, y.b FROM e x JOIN e y ON x.b = y.a)
  SELECT q.a, q.b, CASE WHEN e.a IS NOT NULL THEN 1.0 WHEN t.a IS NOT NULL THEN 0.6 ELSE 0.15 END::DOUBLE AS nearness FROM q LEFT JOIN e ON q.a = e.a AND q.b = e.b LEFT JOIN t ON q.a = t.a AND q.b = t.b""",
    "j20_transition_windows": f"""WITH r AS (SELECT event_id, k % 6 AS c, lag(k % 6) OVER ({_BY}) AS p, {_AT} - lag({_AT}) OVER ({_BY}) AS s FROM {_E})
  SELECT event_id, CASE WHEN c = p THEN true WHEN (c + p) % 2 = 1 THEN s BETWEEN abs(c - p) AND greatest(c, p) * 40.0 ELSE s BETWEEN 0 AND 30 END AS possible FROM r WHERE p IS NOT NULL""",
    "j24_layout_windows": """WITH c AS (SELECT n_regionkey AS r, n_nationkey AS k, n_nationkey % 4 * 3.5::DOUBLE * s AS x, n_nationkey % 3 * 2.0::DOUBLE * s AS y FROM (SELECT *, CASE WHEN n_regionkey % 2 = 1 THEN 0.3048 ELSE 1.0 END::DOUBLE AS s FROM nation)),
  p AS (SELECT a.k AS a, b.k AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM c a JOIN c b ON a.r = b.r AND a.k < b.k) SELECT a, b, round(d / 2.0::DOUBLE, 6) AS min_sec, round(d / 0.35::DOUBLE + 5, 6) AS max_sec FROM p""",
    "t15_category_vote": f"""WITH s AS (SELECT *, coalesce({_AT} - lag({_AT}) OVER ({_BY}) > 8, true)::INT AS stale FROM {_E}), p AS (SELECT *, sum(stale) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS part FROM s),
  v AS (SELECT event_id, list_reverse_sort([{", ".join(f"{{'w': round(coalesce(sum(value) FILTER (event_type = '{c}') OVER u, 0), 6), 'c': '{c}'}}" for c in ("view", "click", "purchase"))}]) AS v FROM p WINDOW u AS (PARTITION BY user_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id, CASE WHEN v[1].w >= 20 AND v[1].w - v[2].w >= 5 THEN v[1].c ELSE 'unknown' END AS category FROM v""",
    "t17a_contradictions": f"""WITH r AS (SELECT *, {", ".join(f"round(user_id * {m} % 97 / 97 + k / 1000, 6) AS s{m}" for m in (3, 5, 7, 11))}, event_type = 'click' AS fresh FROM {_E})
  SELECT event_id, CASE WHEN k = 9 THEN 'banned' WHEN k % 2 = 0 AND s3 < {I.FACE_VETO} THEN 'face' WHEN k % 2 = 0 AND s3 >= {I.FACE_SURE} THEN NULL WHEN user_id % 3 < 2 AND k % 3 < 2 AND user_id % 3 <> k % 3 THEN 'gender'
  WHEN s5 < CASE WHEN fresh THEN {I.COLOUR_CROSS} ELSE {I.COLOUR_OWN} END THEN 'colour' WHEN fresh AND s7 < {I.PARTS} THEN 'parts' WHEN fresh AND k % 5 <> 0 AND s11 < {I.HAIR} THEN 'hair' END AS reason FROM r""",
    "t17b_stitches": f"""WITH r AS (SELECT user_id % 9 AS c, event_id AS t, round({_AT}, 6) AS ts, value % 7.0 AS x, k % 12 / 2 AS y, k % 5 + 1.0::DOUBLE AS h, event_type FROM {_E}),
  p AS (SELECT n.c AS camera_id, n.t AS track, o.t AS continues, o.ts AS ots, n.ts - o.ts AS gap, sqrt((n.x - o.x) * (n.x - o.x) + (n.y - o.y) * (n.y - o.y)) / greatest(n.h, o.h) AS apart, n.h / o.h AS ratio
    FROM r n JOIN r o ON n.c = o.c AND n.event_type = 'click' AND o.event_type = 'view'),
  q AS (SELECT *, round(1 - apart / {I.STITCH_HEIGHTS}::DOUBLE * 0.5::DOUBLE - gap / 4.0::DOUBLE * 0.5::DOUBLE, 6) AS score FROM p WHERE gap BETWEEN 0 AND 4 AND apart <= {I.STITCH_HEIGHTS}::DOUBLE AND ratio BETWEEN 0.5 AND 2.0)
  SELECT camera_id, track, continues, score FROM q WHERE score >= {I.STITCH_SCORE} QUALIFY row_number() OVER (PARTITION BY camera_id, track ORDER BY score DESC, ots DESC, continues) = 1""",
    "t17c_face_match": _best(f"SELECT user_id AS query, k % 6 AS person, round(max(value) / 200, 6) AS score FROM {_E} WHERE event_type <> 'error' GROUP BY 1, 2", *I.FACE_MATCH, -1),
    "t17d_look_match": _best(f"SELECT user_id AS query, k % 9 AS person, round(avg(value) / 60, 6) AS score FROM {_E} GROUP BY 1, 2", *I.LOOK_MATCH, 0),
    "t17e_splits": f"""WITH r AS (SELECT *, CASE WHEN value < 8 THEN 'low' WHEN k < 25 THEN 'gender' WHEN k < 40 THEN 'face' WHEN k < 70 THEN 'colour' WHEN k < 75 THEN 'hair' ELSE '' END AS r, row_number() OVER ({_BY}) AS i FROM {_E}),
  g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, r ORDER BY i) AS island FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, r, island ORDER BY i) AS run FROM g)
  SELECT user_id AS track, event_id AS id, r AS reason FROM n WHERE {" OR ".join(f"(r = '{c}' AND run = {n})" for c, n in I.STREAKS.items())}""",
    "t17f_merges": f"""WITH p AS (SELECT user_id, user_id // 10 AS booth, round(min(ts), 6) AS seen, count(*) > 60 AS sure FROM {_E} GROUP BY 1), s AS (SELECT a.booth, a.user_id AS a, b.user_id AS b, round((a.user_id * 31 + b.user_id * 17) % 100 / 110, 6) AS sim, a.seen AS sa, b.seen AS sb, a.sure AS ca, b.sure AS cb
    FROM p a JOIN p b ON a.booth = b.booth AND a.user_id < b.user_id), d AS (SELECT booth, a, b, sim FROM s UNION ALL SELECT booth, b, a, sim FROM s),
  f AS (SELECT *, sim - coalesce(lead(sim) OVER w, -1) AS ahead, row_number() OVER w AS rank FROM d WINDOW w AS (PARTITION BY booth, a ORDER BY sim DESC, b)),
  m AS (SELECT x.a, x.b FROM f x JOIN f y ON x.a = y.b AND x.b = y.a WHERE x.rank = 1 AND y.rank = 1 AND least(x.ahead, y.ahead) >= {I.MERGE_GAP} AND x.sim >= {I.MERGE_MUTUAL})
  SELECT booth AS booth_id, CASE WHEN sa <= sb THEN s.b ELSE s.a END AS loser, CASE WHEN sa <= sb THEN s.a ELSE s.b END AS winner, sim FROM s LEFT JOIN m ON s.a = m.a AND s.b = m.b
  WHERE (ca OR cb) AND (sim >= CASE WHEN ca AND cb THEN {I.MERGE} ELSE 0.5 END OR m.a IS NOT NULL)""",
    "t17g_sampler_gate": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_AT} AS m, row_number() OVER ({_BY}) AS i FROM {_E} WHERE k >= 12 AND value >= 5), t AS (SELECT user_id, i, event_id, m AS taken_at, true AS taken FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN e.m - taken_at >= 0.75::DOUBLE THEN e.m ELSE taken_at END, e.m - taken_at >= 0.75::DOUBLE FROM t JOIN e ON e.user_id = t.user_id AND e.i = t.i + 1)
  SELECT user_id, event_id FROM t WHERE taken""",
    "t20_evidence": f"""WITH RECURSIVE r AS (SELECT user_id, event_id AS id, {_AT} / 10 AS ts, (k - 40) / 20 AS x, event_type <> 'error' AS face, row_number() OVER ({_BY}) AS i FROM {_E}),
  s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS id, NULL::DOUBLE AS ts, 0.0::DOUBLE AS e, 0 AS n, 0 AS faces, NULL::VARCHAR AS label FROM r UNION ALL
    SELECT user_id, i, id, ts, e, n, faces, CASE WHEN n >= samples AND abs(e) >= least THEN own WHEN n < samples OR label IS DISTINCT FROM own OR abs(e) < {I.KEEP}::DOUBLE * least THEN NULL ELSE label END FROM (
      SELECT *, CASE WHEN faces >= {I.DECIDE[1]} THEN {I.DECIDE[0]} ELSE {I.DECIDE_BODY[0]} END::DOUBLE AS least, CASE WHEN faces >= {I.DECIDE[1]} THEN {I.DECIDE[1]} ELSE {I.DECIDE_BODY[1]} END AS samples, CASE WHEN e > 0 THEN 'MALE' ELSE 'FEMALE' END AS own FROM (
        SELECT user_id, i, id, ts, CASE WHEN stale THEN 0.0 ELSE e END::DOUBLE * {I.DECAY}::DOUBLE + push AS e, CASE WHEN stale THEN 0 ELSE n END + 1 AS n, CASE WHEN stale THEN 0 ELSE faces END + face::INT AS faces, CASE WHEN NOT stale THEN label END AS label FROM (
          SELECT r.*, s.e, s.n, s.faces, s.label, coalesce(r.ts - s.ts > {I.STALE}, false) AS stale,
            CASE WHEN r.face THEN greatest(-{I.FACE_MOST}::DOUBLE, least({I.FACE_MOST}::DOUBLE, r.x)) ELSE greatest(-{I.BODY_MOST}::DOUBLE, least({I.BODY_MOST}::DOUBLE, r.x)) * 0.8::DOUBLE END AS push
          FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1))))
  SELECT user_id, ts, id, e AS evidence, coalesce(label, 'UNKNOWN') AS label FROM s WHERE i > 0""",
    "t18_co_visibility": f"WITH s AS (SELECT DISTINCT k % 6 AS c, floor(ts / 3600) AS p, user_id AS u FROM {_E}) SELECT DISTINCT x.u AS a, y.u AS b FROM s x JOIN s y ON x.c = y.c AND x.p = y.p AND x.u < y.u",
    "t24_interest_events": f"""WITH r AS (SELECT user_id AS person, k % 4 AS product, round({_AT}, 6) AS t, event_id FROM {_E}), a AS (SELECT *, min(t) OVER (PARTITION BY person ORDER BY round(t * 1000000)::BIGINT RANGE BETWEEN 3000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS again, lead(t) OVER (PARTITION BY person, product ORDER BY t, event_id) AS next FROM r),
  e AS (SELECT *, again IS NOT NULL AND (next IS NULL OR next > again) AS ends FROM a), s AS (SELECT *, coalesce(lag(ends) OVER (PARTITION BY person, product ORDER BY t, event_id), true) AS starts FROM e)
  SELECT person, product, CASE WHEN starts THEN 'STARTED' ELSE 'UPDATED' END AS event, t AS ts FROM s UNION ALL SELECT person, product, 'ENDED', again FROM s WHERE ends""",
    "v05_gallery_identify": f"""WITH e AS ({_V}), m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY 1)),
  c AS (SELECT vec_id, label, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS v FROM e, m), p AS (SELECT q.vec_id, g.label AS product, round(max(list_cosine_similarity(q.v, g.v)), 6) AS score FROM c q JOIN c g ON q.vec_id % 20 = 0 AND g.vec_id <> q.vec_id AND g.label IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, product))
  SELECT vec_id, CASE WHEN CASE WHEN next IS NULL THEN score >= {ALONE} ELSE score >= {GALLERY[0]} AND round(score - next, 6) >= {GALLERY[1]} END THEN product END AS product, score FROM r WHERE rank = 1""",
    "v10_person_similarity": f"""WITH u AS (SELECT vec_id, label, vec_id % 3 AS cam, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM ({_V}) WHERE label IS NOT NULL), l AS (SELECT * FROM u),
  n AS (SELECT label, cam, list(x ORDER BY i) AS v FROM (SELECT label, cam, i, avg(x) AS x FROM (SELECT label, cam, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM l) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  g AS (SELECT label, cam, v, true AS single, vec_id AS other FROM l UNION ALL SELECT label, cam, v, false, NULL FROM n),
  s AS (SELECT q.vec_id, g.label, single, CASE WHEN q.cam = g.cam THEN list_cosine_similarity(q.v, g.v) ELSE 0.65::DOUBLE * list_cosine_similarity(q.v[1:48], g.v[1:48]) + 0.35::DOUBLE * list_cosine_similarity(q.v[49:64], g.v[49:64]) END AS sim FROM u q JOIN g ON q.vec_id % 20 = 0 AND g.other IS DISTINCT FROM q.vec_id),
  p AS (SELECT vec_id, label, max(sim) FILTER (single) AS best, max(sim) FILTER (NOT single) AS mean, count(*) FILTER (single) AS n FROM s GROUP BY 1, 2) SELECT vec_id, label, round(CASE WHEN n < 2 THEN best ELSE 0.5::DOUBLE * best + 0.5::DOUBLE * mean END, 6) AS similarity FROM p""",
    "e05_balanced_accuracy": f"""WITH r AS (SELECT trunc(k / 25)::INT AS bucket, user_id % 2 = 0 AS real, value - user_id % 2 * 8 > 25 AS told FROM {_E}), p AS (SELECT bucket, count(*)::BIGINT AS n, avg(told::INT) FILTER (real) AS tpr, avg((NOT told)::INT) FILTER (NOT real) AS tnr FROM r GROUP BY 1)
  SELECT bucket, n, round((coalesce(tpr, tnr) + coalesce(tnr, tpr)) / 2, 6) AS balanced_accuracy FROM p""",
    "e07_prequential": f"""WITH r AS (SELECT event_id, avg((k % 4 <> 0)::INT) OVER l AS acc, count(*) OVER l AS n, sum((event_type = 'view')::INT) OVER u AS m, sum((event_type <> 'view')::INT) OVER u AS f FROM {_E}
  WINDOW l AS ({_BY} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), u AS ({_BY} ROWS UNBOUNDED PRECEDING)), a AS (SELECT *, CASE WHEN n >= 40 THEN acc END AS a FROM r)
  SELECT event_id, round(a, 6) AS accuracy, CASE WHEN a IS NOT NULL THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * (a - 0.5::DOUBLE))), 6) END AS competence, coalesce(m >= 20 AND f >= 20 AND a >= 0.62, false) AS ready FROM a""",
}
