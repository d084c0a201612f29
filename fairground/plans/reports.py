"""Sinks, exports, document sources, filters and report leftovers (inventory ids S03, S08, S09, S11-S19, S23, F05-F19, J02, J08, J09, J22, Q38, Q39,
Q41, Q48-Q55, Q57, L03, L05, L07, L08, L10-L12, N07, N14, N15, E02, T04, T05, T11, T21, T33, V08, V09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fairground.functions.scope import half_up
from fairground.operators import scans, sinks
from fairground.plans import kiosk
from fairground.sources import bindings as B
from fairground.sources import documents, shared
from fairground.sources.bindings import EVENT_SQL, HOLD_SQL, INTERACTION_SQL, PRODUCT_SQL, SCAN_SQL, table

#: The period of the reports, in seconds since 1970.
SINCE = 1705276800.0
#: Names of colours and their red, green and blue (fixed values).
PALETTE = {
    "black": (20, 20, 20), "white": (240, 240, 240), "gray": (128, 128, 128), "red": (200, 30, 30), "orange": (230, 140, 30), "yellow": (235, 215, 50), "green": (40, 160, 60),
    "blue": (40, 70, 190), "navy": (25, 30, 90), "purple": (120, 50, 160), "pink": (235, 150, 190), "brown": (110, 70, 40), "beige": (210, 190, 150),
}
#: Parts of names of cameras that are none (fixed values).
VIRTUAL = ["virtual camera", "obs virtual", "manycam", "droidcam", "snap camera"]

# ---------------------------------------------------------------------------------------------
# sinks


def s03_append_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries appended to one log, a folder for each kind of event."""
    path, rows = shared.shared_path(spark, "event-log"), B.events(spark, sf_dir)
    for half in (0, 1):
        shared.append(rows.where(F.col("event_id") % 2 == half), path, "event_type")
    log = spark.read.schema(rows.schema).parquet(path)
    return log.groupBy("event_type").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 6).alias("value"))


def s08_session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's first entry opens a session, the first exit after it closes it, and what was seen while it
    was active adds its camera."""
    rows = B.events(spark, sf_dir)
    opened = rows.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("entered_at"))
    closed = rows.where("event_type = 'purchase'").join(opened, "user_id").where("ts > entered_at").groupBy("user_id").agg(F.min("ts").alias("exited_at"))
    sessions = opened.join(closed, "user_id", "left")
    seen = rows.join(sessions, "user_id").where("ts >= entered_at AND (exited_at IS NULL OR ts <= exited_at)")
    per = seen.groupBy("user_id", "entered_at", "exited_at").agg(F.array_join(F.sort_array(F.collect_set(F.col("k") % 6)), ",").alias("cameras_seen"))
    dwell = F.round(F.col("exited_at") - F.col("entered_at"), 6)
    return per.select("user_id", F.round("entered_at", 6).alias("entered_at"), F.round("exited_at", 6).alias("exited_at"), dwell.alias("dwell_seconds"), "cameras_seen", F.when(F.col("exited_at").isNull(), "active").otherwise("closed").alias("status"))


def s09_pipeline_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery of events into the event log, the camera transitions and the persons."""
    path = shared.shared_path(spark, "pipeline")
    tables = {
        "events": lambda rows: rows,
        "transitions": lambda rows: rows.where("event_type = 'click'").select("user_id", "ts", "k"),
        "persons": lambda rows: sinks.upsert_merged(rows.withColumn("last_seen", F.col("ts")), ["user_id"], ["ts", "event_id"], least=["ts"], greatest=["last_seen"], overwritten=["k"]),
    }
    shared.fan_out(B.events(spark, sf_dir), path, tables)
    return shared.sheet_counts({name: spark.read.parquet(f"{path}/{name}") for name in tables}).select(F.col("sheet").alias("table"), "rows")


def s11_batch_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's detections come as one row and are appended as a row each."""
    frames = B.events(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("camera_id"), F.floor(F.col("ts") / 3600).alias("frame")).agg(F.collect_list(F.struct("event_id", "value")).alias("found"))
    path = shared.shared_path(spark, "detections")
    shared.append(frames.select("camera_id", "frame", F.inline("found")), path)
    return spark.read.parquet(path).groupBy("camera_id").agg(F.count("*").alias("detections"), F.countDistinct("frame").alias("frames"))


def s12_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 rows of the audit level."""
    return B.events(spark, sf_dir).where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", F.round("ts", 6).alias("ts"), "user_id")


# ---------------------------------------------------------------------------------------------
# exports and documents


def booth_sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    none = B.persons(spark, sf_dir).where("booth_id < 0")
    return {"interactions": B.interactions(spark, sf_dir), "health": B.health_events(spark, sf_dir), "crossings": B.crossings(spark, sf_dir), "persons": B.persons(spark, sf_dir), "presence": none}


def s13_export_booth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of each raw log, written and read back; an empty one holds the note that it is."""
    return shared.sheet_counts(shared.write_sheets(booth_sheets(spark, sf_dir), shared.shared_path(spark, "export")))


def kiosk_sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Summary, products, days, the 24 hours and every scan with its outcome."""
    hours = spark.range(24).select(F.col("id").alias("hour")).join(kiosk.q28_hourly(spark, sf_dir), "hour", "left").select("hour", F.coalesce("scans", F.lit(0)).alias("scans"))
    return {"summary": kiosk.q31_overview(spark, sf_dir), "products": kiosk.q30_product_rows(spark, sf_dir), "daily": kiosk.q29_daily(spark, sf_dir), "hourly": hours, "scans": kiosk.j04_scans_with_names(spark, sf_dir)}


def s14_export_kiosk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.sheet_counts(shared.write_sheets(kiosk_sheets(spark, sf_dir), shared.shared_path(spark, "export")))


def s15_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions as lines of JSON, written and read back, by camera."""
    sheets = shared.write_sheets({"interactions": B.interactions(spark, sf_dir)}, shared.shared_path(spark, "export"), "json")
    return sheets["interactions"].groupBy("camera_id").agg(F.count("*").alias("rows"), F.round(F.sum("confidence"), 6).alias("confidence"))


def _catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a hundred products each: an object by key, a list, or either under `products`."""
    key = F.col("p_partkey").cast("string")
    per = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("n")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.struct(F.col("p_name").alias("name"), F.col("p_retailprice").cast("string").alias("price")))))).alias("by_key"),
        F.to_json(F.collect_list(F.struct(key.alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("string").alias("price")))).alias("listed"),
    )
    noted = F.concat(F.lit('{"_comment": {"name": "not a product"}, '), F.substr("by_key", F.lit(2)))
    under = F.concat(F.lit('{"products": '), F.col("listed"), F.lit("}"))
    return per.select(F.when(F.col("n") % 3 == 0, noted).when(F.col("n") % 3 == 1, F.col("listed")).otherwise(under).alias("document"))


def s16_json_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.catalog(_catalog_documents(spark, sf_dir)).select("key", "name", "price")


def s17_registered_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused of registered products, and how many are taken from each province."""
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("n"), F.create_map(
        F.lit("id"), (F.col("p_partkey") - F.when(F.col("p_partkey") % 40 == 0, 1).otherwise(0)).cast("string"), F.lit("name"), F.col("p_name"), F.lit("province"), F.col("p_brand"),
        F.when(F.col("p_partkey") % 33 == 5, "colour").otherwise("producer"), F.lit("x")).alias("p"))
    docs = rows.groupBy("n").agg(F.concat(F.lit('{"products": '), F.to_json(F.collect_list("p")), F.lit("}")).alias("document"))
    good, refused = documents.registered_products(docs)
    taken = good.groupBy(F.col("province").alias("id")).agg(F.concat(F.lit("taken "), F.count("*")).alias("reason"))
    return refused.union(taken.select("id", "reason"))


def s18_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between the cameras of a region, a document for each."""
    nation = table(spark, sf_dir, "nation")
    a, b = (nation.select("n_regionkey", F.col("n_nationkey").alias(c)) for c in "ab")
    pairs = a.join(b, "n_regionkey").where("a < b").select("n_regionkey", F.struct(F.col("a").cast("string").alias("from"), F.col("b").cast("string").alias("to"), (F.col("b") - F.col("a")).cast("double").alias("min_seconds"), (F.col("b") * 2.5).alias("max_seconds")).alias("t"))
    docs = pairs.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list("t").alias("transitions"))).alias("document"))
    return documents.transitions(docs)


def s19_soak_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames a second and restarts by camera, from a log of comma-separated values."""
    lines = B.events(spark, sf_dir).select(F.to_csv(F.struct("ts", (F.col("user_id") % 5).alias("cam"), F.col("value").alias("fps"), F.col("k").alias("kills"))).alias("line"))
    rows = documents.csv_rows(lines, "line", "t double, cam int, fps double, kills long")
    return rows.groupBy("cam").agg(F.count("*").alias("samples"), F.round(F.avg("fps"), 6).alias("fps"), F.sum("kills").alias("kills"))


def s23_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of gauges: name and value."""
    rows = B.events(spark, sf_dir)
    per = rows.groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("v"))
    stacked = per.select(F.expr("stack(2, concat('frames_total.', event_type), n, concat('latency_ms.', event_type), v) AS (metric, value)"))
    whole = rows.agg(F.countDistinct("user_id").cast("double").alias("value")).select(F.lit("cameras").alias("metric"), "value")
    return stacked.union(whole).select("metric", F.round("value", 6).alias("value"))


def q53_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "error", F.lit(" ")).when(F.col("k") < 3, None).otherwise(F.col("event_type"))
    rows = B.events(spark, sf_dir).select(F.when(F.col("k") != 50, F.col("event_id").cast("string")).alias("path"), label.alias("label"))
    return documents.label_report(rows, F.col("path"), F.col("label"))


# ---------------------------------------------------------------------------------------------
# filters


def f05_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.events(spark, sf_dir).where(F.col("ts") >= SINCE).groupBy("event_type").agg(F.count("*").alias("rows"))


def f06_type_and_since(spark: SparkSession, sf_dir: str, event_type: str | None = "click", since: float | None = SINCE) -> DataFrame:
    """What isn't given doesn't filter."""
    rows = B.events(spark, sf_dir)
    for wanted, condition in ((event_type, F.col("event_type") == event_type), (since, F.col("ts") >= since)):
        rows = rows if wanted is None else rows.where(condition)
    return rows.select("event_id", "user_id", F.round("value", 6).alias("value"))


def f08_catalog_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of classes that the catalog doesn't have are dropped."""
    rows = B.scans(spark, sf_dir)
    known = B.kiosk_products(spark, sf_dir).where("category IS NOT NULL").select(F.col("id").alias("product_id"))
    return rows.join(known, "product_id", "left_semi").groupBy("product_id").agg(F.count("*").alias("detections"))


def contains_any(query: str, *fields):
    """Whether one of the fields holds the query, whatever the case; an empty query is in all."""
    hit = F.lit(query == "")
    for field in fields:
        hit = hit | F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(query.lower()))
    return hit


def f09_substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.kiosk_products(spark, sf_dir).where(contains_any("El", F.col("name"), F.col("category"))).select("id", "name")


def f10_client_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an event and a booth on a calendar day, as the browser filters them."""
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")
    return B.interactions(spark, sf_dir).where((F.col("event_id") == 1) & (F.col("booth_id") == 4)).groupBy(day.alias("day")).agg(F.count("*").alias("rows"))


def f11_confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections large enough, high or low by confidence; what is under both is dropped."""
    confidence = F.col("value") / 500
    band = F.when(confidence >= 0.5, "high").when(confidence >= 0.1, "low")
    return B.events(spark, sf_dir).where("k >= 20").groupBy(band.alias("band")).agg(F.count("*").alias("rows")).where("band IS NOT NULL")


def f12_confidence_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    badge = F.when(F.col("confidence") >= 0.75, "good").when(F.col("confidence") >= 0.5, "mid").otherwise("low")
    return B.interactions(spark, sf_dir).select("id", badge.alias("badge"), half_up(F.col("confidence") * 100).alias("percent"))


def f13_duration_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presences of a second at least."""
    per = B.events(spark, sf_dir).groupBy("user_id", (F.col("k") % 4).alias("camera_id")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per.where(F.col("b") - F.col("a") >= 1.0).select("user_id", "camera_id", F.round(F.col("b") - F.col("a"), 6).alias("duration_sec"))


def f15_embedding_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("version", F.col("vec_id") % 3)
    return rows.where("version = 2").groupBy("label").agg(F.count("*").alias("vectors"))


def f17_sharpness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a burst that are sharp beside its best quarter."""
    return sharp_frames(B.events(spark, sf_dir).select("user_id", "value"))


def sharp_frames(rows: DataFrame) -> DataFrame:
    """rows: user_id, value. The upper quartile, between two values, is rounded once, as SQL engines with a fused
    multiply-add do: a frame's sharpness may be its burst's gate to the last bit."""
    burst = W.partitionBy("user_id")
    rows = rows.withColumn("place", F.row_number().over(burst.orderBy(F.col("value").asc_nulls_last())) - 1).withColumn("at", (F.count("value").over(burst) - 1) * 0.75)
    held = lambda place: F.max(F.when(F.col("place") == place, F.col("value"))).over(burst)
    rows = rows.withColumn("lo", held(F.floor("at"))).withColumn("hi", held(F.ceil("at"))).withColumn("part", F.col("at") - F.floor("at"))
    lo, part = F.col("lo"), F.col("part")
    half, quarter = lo * F.when(part < 0.5, 0.5).otherwise(0.0), lo * F.when(part == 0.0, 0.5).when(part == 0.5, 0.5).otherwise(0.25)
    rows = rows.withColumn("low", half + quarter).withColumn("low_rest", F.greatest(half, quarter) - F.col("low") + F.least(half, quarter)).withColumn("high", F.col("hi") * part)
    rows = rows.withColumn("sum", F.col("low") + F.col("high")).withColumn("b", F.col("sum") - F.col("low"))
    rest = (F.col("low") - (F.col("sum") - F.col("b"))) + (F.col("high") - F.col("b"))
    rows = rows.withColumn("gate", F.greatest(F.lit(8.0), 0.25 * (F.col("sum") + (rest + F.col("low_rest")))))
    return rows.where("value >= gate").groupBy("user_id").agg(F.count("*").alias("frames"), F.round(F.first("gate"), 6).alias("gate"))


def f19_virtual_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of devices that are software; every fifth name is made one here."""
    made = F.element_at(F.array(*[F.lit(v) for v in VIRTUAL]), (F.col("p_partkey") % len(VIRTUAL) + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.initcap(made), F.lit(" 2"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(name).rlike("|".join(VIRTUAL)).alias("is_virtual"))


# ---------------------------------------------------------------------------------------------
# joins and lists


def j02_booth_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One booth with its event, if it has one."""
    booth = table(spark, sf_dir, "supplier").where("s_suppkey = 7")
    return booth.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name")


def j08_session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their booth's name; a booth that isn't known is called by its id."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("booth"), "n_name")
    rows = B.events(spark, sf_dir).groupBy((F.col("user_id") % 40).alias("booth")).agg(F.count("*").alias("sessions"))
    return rows.join(names, "booth", "left").select("booth", F.coalesce("n_name", F.col("booth").cast("string")).alias("name"), "sessions")


def j09_person_with_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person with the tracks in the order of their start."""
    tracks = B.events(spark, sf_dir).groupBy(F.col("user_id").alias("person"), (F.col("k") % 5).alias("track")).agg(F.min("ts").alias("start"))
    per = tracks.groupBy("person").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "track"))), lambda t: t["track"].cast("string")), ",").alias("tracks"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), "c_name")
    return people.join(per, "person", "left").select("person", "c_name", F.coalesce("tracks", F.lit("")).alias("tracks"))


def j22_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog has without a gallery, and the gallery without a catalog."""
    catalog = B.kiosk_products(spark, sf_dir).select("id")
    gallery = B.events(spark, sf_dir).select((F.col("k") * 3 - 20).alias("id")).distinct()
    missing, orphan = catalog.join(gallery, "id", "left_anti"), gallery.join(catalog, "id", "left_anti")
    return missing.select("id", F.lit("missing").alias("state")).union(orphan.select("id", F.lit("orphan").alias("state")))


def q38_mean_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's mean colour, truncated, over the samples that have one."""
    rows = _colours(spark, sf_dir).where("r + g + b > 0")
    return rows.groupBy("user_id").agg(*[F.avg(c).cast("int").alias(c) for c in "rgb"])


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.events(spark, sf_dir).select("event_id", "user_id", (F.col("k") * 2).cast("int").alias("r"), F.pmod(F.col("value") * 3, F.lit(250)).cast("int").alias("g"), (F.col("user_id") * 37 % 250).cast("int").alias("b"))


def q39_dominant_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest nearest named colour of a track, and its share; the first named of equals."""
    far = [(F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b) for r, g, b in PALETTE.values()]
    nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far)]))["i"]
    counted = _colours(spark, sf_dir).groupBy("user_id", nearest.alias("i")).agg(F.count("*").alias("n"))
    per = counted.groupBy("user_id").agg(F.max_by("i", F.struct("n", -F.col("i"))).alias("i"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return per.select("user_id", F.get(F.array(*[F.lit(c) for c in PALETTE]), F.col("i")).alias("colour"), F.round(F.col("n") / F.col("all"), 6).alias("share"))


def q41_live_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct people by category: the identity, or camera and track without one; the earliest category
    that is known counts."""
    rows = _sightings(spark, sf_dir)
    known = F.when(F.col("category") != "unknown", F.struct("ts", "event_id", "category"))
    per = rows.groupBy("who").agg(F.coalesce(F.min(known)["category"], F.lit("unknown")).alias("category"))
    return per.groupBy("category").agg(F.count("*").alias("people"))


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("P"), F.col("user_id"))).otherwise(F.concat_ws(":", F.lit("local"), F.col("k") % 3, F.col("user_id")))
    category = F.when(F.col("event_type") == "view", "male").when(F.col("event_type") == "click", "female").otherwise("unknown")
    return B.events(spark, sf_dir).select("event_id", "ts", "user_id", "k", "value", who.alias("who"), category.alias("category"))


def t05_session_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by identity, or by camera and track where there is none."""
    return _sightings(spark, sf_dir).groupBy(F.col("who").alias("person_key")).agg(F.count("*").alias("rows"))


def t04_session_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sessions after identities were merged: those of one identity become one, from the earliest
    entry on, with all cameras. 3k+2 was merged into 3k+1, 3k+1 into 3k."""
    rows = B.events(spark, sf_dir).where("event_type IN ('signup', 'view')")
    ids = rows.select(F.col("user_id").alias("loser")).distinct().where("loser % 3 <> 0")
    merged = sinks.resolve_merges(ids.withColumn("winner", F.col("loser") - 1))
    keyed = rows.join(merged, F.col("user_id") == F.col("loser"), "left").withColumn("person", F.coalesce("winner", "user_id"))
    return keyed.groupBy("person").agg(F.round(F.min("ts"), 6).alias("entered_at"), F.array_join(F.sort_array(F.collect_set(F.col("k") % 4)), ",").alias("cameras_seen"), (F.countDistinct("user_id") - 1).alias("closed_duplicates"))


def t11_track_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track ends once it isn't seen for three hours here; each end gives one summary, and a track of
    three samples is told early."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = B.events(spark, sf_dir).withColumn("starts", F.coalesce(F.col("ts") - F.lag("ts").over(by) > 10800, F.lit(True)).cast("int"))
    rows = rows.withColumn("track", F.sum("starts").over(by))
    return rows.groupBy("user_id", "track").agg(F.count("*").alias("samples"), F.round(F.min("ts"), 6).alias("first_seen"), F.round(F.max("ts"), 6).alias("last_seen"), (F.count("*") >= 3).alias("eager"))


def t21_counting_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that count: seen three times at least, with a category."""
    per = _sightings(spark, sf_dir).groupBy("who").agg(F.count("*").alias("n"), F.count_if(F.col("category") != "unknown").alias("known"))
    return per.agg(F.count("*").alias("identities"), F.count_if((F.col("n") >= 3) & (F.col("known") > 0)).alias("counted"), F.count_if((F.col("n") >= 3) & (F.col("known") == 0)).alias("without_category"))


def t33_health_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only changes of a component's status are logged, its first one too; of a user's own component here."""
    rows = B.events(spark, sf_dir).withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("ok"))
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.withColumn("before", F.lag("status").over(by)).where("before IS NULL OR before <> status").select("user_id", F.round("ts", 6).alias("ts"), "status")


def q48_first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest products; of equals, those seen first."""
    per = B.interactions(spark, sf_dir).groupBy("product_name").agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("first"))
    return per.orderBy(F.desc("n"), "first").limit(10).select("product_name", "n")


def q49_gallery_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next position in each product's gallery, and its images as listed."""
    rows = B.events(spark, sf_dir).select((F.col("user_id") % 50).alias("product_id"), F.col("event_id").alias("id"), F.when(F.col("k") > 5, F.col("k") % 9).alias("sort_order"))
    per = rows.groupBy("product_id").agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("next_position"), F.count("*").alias("images"))
    first = rows.where("sort_order IS NOT NULL").groupBy("product_id").agg(F.min(F.struct("sort_order", "id"))["id"].alias("first_image"))
    return per.join(first, "product_id", "left")


def q50_frame_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of a product's images that are there, by id; here a row in eleven is one."""
    rows = B.events(spark, sf_dir).where("k >= 90").select("user_id", "event_id")
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda i: F.concat(F.lit("img/"), i)), ";").alias("frames"))


def q51_active_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each booth's layout is active, all others not."""
    rows = B.events(spark, sf_dir).select((F.col("user_id") % 200).alias("booth_id"), "event_id", "ts")
    by = W.partitionBy("booth_id")
    rows = rows.withColumn("version", F.row_number().over(by.orderBy("ts", "event_id")))
    return rows.select("booth_id", "event_id", "version", (F.col("version") == F.count("*").over(by)).alias("active"))


def q52_layout_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of layouts: sizes that aren't positive, objects without an id, with one twice, of no known type."""
    rows = B.events(spark, sf_dir).select((F.col("user_id") % 300).alias("layout"), F.when(F.col("k") != 7, F.col("k")).alias("object_id"), (F.col("value") - 5).alias("width"), F.col("event_type").alias("kind"))
    twice = F.count("object_id") - F.countDistinct("object_id")
    return rows.groupBy("layout").agg(F.count_if(F.col("width") <= 0).alias("bad_size"), F.count_if(F.col("object_id").isNull()).alias("without_id"), twice.alias("repeated_id"), F.count_if(~F.col("kind").isin("view", "click", "purchase", "signup")).alias("unknown_type"))


def q54_abstain_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and accuracy of what is answered at several least confidences, by kind of picture."""
    rows = B.events(spark, sf_dir).select((F.col("user_id") % 4).alias("kind"), (F.col("k") % 3 != 0).alias("right"), (F.col("value") / 100).alias("confidence"))
    rows = rows.withColumn("least", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 0.8)])))
    answered = F.col("confidence") >= F.col("least")
    per = rows.groupBy("kind", "least").agg(F.count("*").alias("n"), F.count_if(answered).alias("a"), F.count_if(answered & F.col("right")).alias("r"), F.count_if("right").alias("all_right"))
    return per.select("kind", "least", F.round(F.col("all_right") / F.col("n"), 6).alias("acc_all"), F.round(F.col("a") / F.col("n"), 6).alias("coverage"), F.round(F.col("r") / F.greatest("a", F.lit(1)), 6).alias("acc_answered"))


def q55_catalog_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.kiosk_products(spark, sf_dir).where("category IS NOT NULL").orderBy("id").select("id", "name", "category")


def q57_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of settings: the last value of each key holds, one that ends in a deletion has its default."""
    rows = B.events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.round("value", 2)))
    held = sinks.upsert(rows, ["user_id"], ["ts", "event_id"], ["value"])
    return held.select(F.col("user_id").alias("key"), F.coalesce("value", F.lit(-1.0)).alias("value"))


def l03_recent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 people seen, and the oldest 2000 movements, as two pages."""
    rows = B.events(spark, sf_dir)
    people = rows.groupBy("user_id").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "user_id").limit(500).select(F.lit("persons").alias("page"), F.col("user_id").alias("id"))
    moves = rows.orderBy("ts", "event_id").limit(2000).select(F.lit("movement").alias("page"), F.col("event_id").alias("id"))
    return people.union(moves)


def l05_top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best products of a scan, by product where they tie."""
    per = B.events(spark, sf_dir).groupBy("user_id", (F.col("k") % 8).alias("product")).agg(F.round(F.max("value"), 1).alias("score"))
    return per.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "product"))).where("rank <= 3")


def l07_best_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best detection of each class in a frame; of equals, the first."""
    rows = B.events(spark, sf_dir).withColumn("frame", F.floor(F.col("ts") / 86400))
    per = rows.groupBy("frame", "event_type").agg(F.max(F.struct(F.round("value", 0).alias("score"), (-F.col("event_id")).alias("i"))).alias("best"))
    return per.select("frame", "event_type", "best.score", (-F.col("best.i")).alias("event_id"))


def l08_best_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best shots of each track."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return B.events(spark, sf_dir).withColumn("rank", rank).where("rank <= 3").groupBy("user_id").agg(F.count("*").alias("shots"), F.round(F.min("value"), 6).alias("worst"))


def l10_name_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the different product names in the order of the language, by ranges."""
    names = B.kiosk_products(spark, sf_dir).select("name").distinct()
    return scans.numbered(names.withColumn("sorted", F.collate("name", "th")), ["sorted", "name"], "place").select("name", "place")


def l11_alert_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.events(spark, sf_dir).where("event_type = 'error' AND value > 20").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


def l12_recent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last twelve values of each key: older ones drop out."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return B.events(spark, sf_dir).withColumn("rank", rank).where("rank <= 12").groupBy("user_id").agg(F.count("*").alias("held"), F.round(F.avg("value"), 6).alias("mean"))


def n07_approaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the distance fell by more than five centimetres since the point before."""
    before = F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return B.events(spark, sf_dir).select("event_id", F.coalesce(before - F.col("value") > 0.05, F.lit(False)).alias("approaching"))


def n14_trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and the mean without the lowest and highest fifth."""
    by = W.partitionBy("user_id")
    rows = B.events(spark, sf_dir).withColumn("rank", F.row_number().over(by.orderBy("value", "event_id"))).withColumn("n", F.count("*").over(by))
    cut = F.floor(F.col("n") * 0.2)
    kept = F.when((F.col("rank") > cut) & (F.col("rank") <= F.col("n") - cut), F.col("value"))
    return rows.groupBy("user_id").agg(F.round(F.avg(kept), 6).alias("trimmed_mean"), F.round(F.percentile("value", 0.5), 6).alias("median"))


def n15_id_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the matched id of a true one changes, over matched frames only."""
    rows = B.events(spark, sf_dir).where("event_type <> 'error'").withColumn("pred", F.col("k") % 3)
    before = F.lag("pred").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.withColumn("before", before).groupBy("user_id").agg(F.count_if(F.col("before") != F.col("pred")).alias("switches"))


def e02_counting_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = B.events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("true_count"), F.count_if(F.col("event_type") == "purchase").alias("counted"))
    error = F.abs(F.col("counted") - F.col("true_count"))
    return per.select("user_id", error.alias("error"), F.round(F.when(F.col("true_count") == 0, 0.0).otherwise(error * 100 / F.col("true_count")), 6).alias("percent"))


def v08_running_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's running mean of samples, each with its weight; the weights' sum stays at most 100.

    What has been blended counts with the sum so far until the cap is reached, and with the cap from
    then on, so the sample before last is discounted by 100 / (100 + w) and so on: sums over windows
    until the cap, and a product of discounts after it."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    w = F.col("k") % 5 + 1
    rows = B.events(spark, sf_dir).select("user_id", "ts", "event_id", "value", w.cast("double").alias("w"))
    rows = rows.withColumn("before", F.coalesce(F.sum("w").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    held = F.least("before", F.lit(100.0))
    rows = rows.withColumn("keep", held / (held + F.col("w"))).withColumn("share", F.col("w") / (held + F.col("w")))
    later = by.rowsBetween(1, W.unboundedFollowing)
    # what of a sample is left at the end: its share, times what every later sample keeps
    rows = rows.withColumn("left", F.coalesce(F.exp(F.sum(F.log(F.when(F.col("keep") > 0, F.col("keep")))).over(later)), F.lit(1.0)))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("share") * F.col("left")), 6).alias("blend"), F.round(F.least(F.sum("w"), F.lit(100.0)), 6).alias("weight"))


def v09_soft_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half by height, half by sharpness, each full at three and six times its least."""
    # in hundredths of the value and whole per cent of the height, so that only the last division is inexact
    height, blur = F.least(F.lit(36), F.col("k")) * 400, F.least(F.lit(4800), F.round(F.col("value") * 100).cast("long")) * 3
    return B.events(spark, sf_dir).select("event_id", ((height + blur) / F.lit(28800.0)).alias("quality"))


QUERIES = {f.__name__: f for f in (
    s03_append_logs, s08_session_log, s09_pipeline_fan_out, s11_batch_detections, s12_audit_log, s13_export_booth, s14_export_kiosk, s15_export_json, s16_json_catalog, s17_registered_products, s18_topology, s19_soak_log,
    s23_metrics, q53_label_report, f05_since, f06_type_and_since, f08_catalog_guard, f09_substring_search, f10_client_filter, f11_confidence_bands, f12_confidence_badge, f13_duration_floor, f15_embedding_version,
    f17_sharpness_gate, f19_virtual_cameras, j02_booth_by_id, j08_session_names, j09_person_with_tracks, j22_reconcile, q38_mean_colour, q39_dominant_colour, q41_live_people, t05_session_keys, t04_session_rekey,
    t11_track_flush, t21_counting_gate, t33_health_log, q48_first_seen_order, q49_gallery_order, q50_frame_sequence, q51_active_layout, q52_layout_checks, q54_abstain_curve, q55_catalog_lists, q57_settings, l03_recent_pages,
    l05_top_candidates, l07_best_per_class, l08_best_shots, l10_name_order, l11_alert_ring, l12_recent_values, n07_approaching, n14_trimmed_mean, n15_id_switches, e02_counting_error, v08_running_blend, v09_soft_quality,
)}

_E = f"({EVENT_SQL})"
_BY = "PARTITION BY user_id ORDER BY ts, event_id"
_WHO = "CASE WHEN user_id % 4 <> 0 THEN 'P' || user_id ELSE 'local:' || (k % 3) || ':' || user_id END"
_SEEN = f"(SELECT *, {_WHO} AS who, CASE event_type WHEN 'view' THEN 'male' WHEN 'click' THEN 'female' ELSE 'unknown' END AS category FROM {_E})"
_RGB = f"(SELECT event_id, user_id, (k * 2)::INT AS r, trunc((value * 3) % 250)::INT AS g, (user_id * 37 % 250)::INT AS b FROM {_E})"
_NEAR = "list_min([" + ", ".join(f"{{'d': (r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {b}) * (b - {b}), 'i': {i}}}" for i, (r, g, b) in enumerate(PALETTE.values())) + "]).i"
_CSV = "list_aggregate(list_sort(list(DISTINCT {})), 'string_agg', ',')"
ORACLE_SQL = {
    "s03_append_logs": f"SELECT event_type, count(*)::BIGINT AS rows, round(sum(value), 6) AS value FROM {_E} GROUP BY 1",
    "s08_session_log": f"""WITH o AS (SELECT user_id, min(ts) AS a FROM {_E} WHERE event_type = 'signup' GROUP BY 1), s AS (SELECT o.user_id, a, (SELECT min(ts) FROM {_E} c WHERE c.user_id = o.user_id AND event_type = 'purchase' AND ts > a) AS b FROM o)
  SELECT user_id, round(a, 6) AS entered_at, round(b, 6) AS exited_at, round(b - a, 6) AS dwell_seconds, {_CSV.format('k % 6')} AS cameras_seen, CASE WHEN b IS NULL THEN 'active' ELSE 'closed' END AS status
  FROM s JOIN {_E} e USING (user_id) WHERE ts >= a AND (b IS NULL OR ts <= b) GROUP BY user_id, a, b""",
    "s09_pipeline_fan_out": f"""SELECT 'events' AS "table", count(*)::BIGINT AS rows FROM {_E} UNION ALL SELECT 'transitions', count(*)::BIGINT FROM {_E} WHERE event_type = 'click' UNION ALL SELECT 'persons', count(DISTINCT user_id)::BIGINT FROM {_E}""",
    "s11_batch_detections": f"SELECT user_id % 5 AS camera_id, count(*)::BIGINT AS detections, count(DISTINCT floor(ts / 3600))::BIGINT AS frames FROM {_E} GROUP BY 1",
    "s12_audit_log": f"SELECT event_id, round(ts, 6) AS ts, user_id FROM {_E} e WHERE event_type = 'error' ORDER BY e.ts DESC, event_id DESC LIMIT 100",
    "s13_export_booth": f"""SELECT 'interactions' AS sheet, count(*)::BIGINT AS rows, false AS empty FROM ({INTERACTION_SQL}) UNION ALL SELECT 'health', count(*), false FROM ({B.HEALTH_SQL}) UNION ALL SELECT 'crossings', count(*), false FROM ({B.CROSSING_SQL})
  UNION ALL SELECT 'persons', count(*), false FROM ({B.PERSON_SQL}) UNION ALL SELECT 'presence', 1, true""",
    "s14_export_kiosk": f"""SELECT 'summary' AS sheet, 1::BIGINT AS rows, false AS empty UNION ALL SELECT 'products', count(*), false FROM part UNION ALL SELECT 'daily', count(*), false FROM ({kiosk.ORACLE_SQL['q29_daily']})
  UNION ALL SELECT 'hourly', 24, false UNION ALL SELECT 'scans', count(*), false FROM events""",
    "s15_export_json": f"SELECT camera_id, count(*)::BIGINT AS rows, round(sum(confidence), 6) AS confidence FROM ({INTERACTION_SQL}) GROUP BY 1",
    "s16_json_catalog": "SELECT p_partkey::VARCHAR AS key, p_name AS name, p_retailprice::VARCHAR AS price FROM part",
    "s17_registered_products": """WITH p AS (SELECT p_partkey - CASE WHEN p_partkey % 40 = 0 THEN 1 ELSE 0 END AS id, p_brand, p_partkey % 33 = 5 AS odd FROM part), c AS (SELECT id, count(*) AS n, bool_or(odd) AS odd FROM p GROUP BY 1)
  SELECT id::VARCHAR AS id, CASE WHEN n > 1 THEN 'duplicate id' ELSE 'unknown field' END AS reason FROM c WHERE n > 1 OR odd
  UNION ALL SELECT p_brand, 'taken ' || count(*) FROM p JOIN c USING (id) WHERE n = 1 AND NOT c.odd GROUP BY 1""",
    "s18_topology": "SELECT a.n_nationkey::VARCHAR AS from_camera, b.n_nationkey::VARCHAR AS to_camera, (b.n_nationkey - a.n_nationkey)::DOUBLE AS min_seconds, b.n_nationkey * 2.5::DOUBLE AS max_seconds FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "s19_soak_log": f"SELECT (user_id % 5)::INT AS cam, count(*)::BIGINT AS samples, round(avg(value), 6) AS fps, sum(k)::BIGINT AS kills FROM {_E} GROUP BY 1",
    "s23_metrics": f"""WITH g AS (SELECT event_type, count(*)::DOUBLE AS n, avg(value) AS v FROM {_E} GROUP BY 1) SELECT 'frames_total.' || event_type AS metric, round(n, 6) AS value FROM g UNION ALL SELECT 'latency_ms.' || event_type, round(v, 6) FROM g
  UNION ALL SELECT 'cameras', count(DISTINCT user_id)::DOUBLE FROM {_E}""",
    "q53_label_report": f"""WITH r AS (SELECT CASE WHEN k <> 50 THEN event_id END AS path, CASE WHEN event_type = 'error' THEN NULL WHEN k < 3 THEN NULL ELSE event_type END AS label FROM {_E})
  SELECT count(*)::BIGINT AS rows, count(*) FILTER (label IS NULL)::BIGINT AS empty_labels, count(*) FILTER (label IS NOT NULL AND path IS NOT NULL)::BIGINT AS usable, {_CSV.format('label')} AS classes FROM r""",
    "f05_since": f"SELECT event_type, count(*)::BIGINT AS rows FROM {_E} WHERE ts >= {SINCE} GROUP BY 1",
    "f06_type_and_since": f"SELECT event_id, user_id, round(value, 6) AS value FROM {_E} WHERE event_type = 'click' AND ts >= {SINCE}",
    "f08_catalog_guard": f"SELECT product_id, count(*)::BIGINT AS detections FROM ({SCAN_SQL}) WHERE product_id IN (SELECT id FROM ({PRODUCT_SQL}) WHERE category IS NOT NULL) GROUP BY 1",
    "f09_substring_search": f"SELECT id, name FROM ({PRODUCT_SQL}) WHERE contains(lower(coalesce(name, '')), 'el') OR contains(lower(coalesce(category, '')), 'el')",
    "f10_client_filter": f"SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*)::BIGINT AS rows FROM ({INTERACTION_SQL}) WHERE event_id = 1 AND booth_id = 4 GROUP BY 1",
    "f11_confidence_bands": f"SELECT CASE WHEN value / 500 >= 0.5 THEN 'high' ELSE 'low' END AS band, count(*)::BIGINT AS rows FROM {_E} WHERE k >= 20 AND value / 500 >= 0.1 GROUP BY 1",
    "f12_confidence_badge": f"SELECT id, CASE WHEN confidence >= 0.75 THEN 'good' WHEN confidence >= 0.5 THEN 'mid' ELSE 'low' END AS badge, floor(confidence * 100 + 0.5)::BIGINT AS percent FROM ({INTERACTION_SQL})",
    "f13_duration_floor": f"SELECT user_id, k % 4 AS camera_id, round(max(ts) - min(ts), 6) AS duration_sec FROM {_E} GROUP BY 1, 2 HAVING max(ts) - min(ts) >= 1.0",
    "f15_embedding_version": "SELECT label, count(*)::BIGINT AS vectors FROM embeddings WHERE vec_id % 3 = 2 GROUP BY 1",
    "f17_sharpness_gate": f"""WITH g AS (SELECT user_id, greatest(8.0::DOUBLE, 0.25::DOUBLE * quantile_cont(value, 0.75)) AS gate FROM {_E} GROUP BY 1)
  SELECT user_id, count(*)::BIGINT AS frames, round(any_value(gate), 6) AS gate FROM {_E} JOIN g USING (user_id) WHERE value >= gate GROUP BY 1""",
    "f19_virtual_cameras": "SELECT p_partkey, p_partkey % 5 = 0 AS is_virtual FROM part",
    "j02_booth_by_id": "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 7",
    "j08_session_names": f"SELECT user_id % 40 AS booth, coalesce(any_value(n_name), (user_id % 40)::VARCHAR) AS name, count(*)::BIGINT AS sessions FROM {_E} LEFT JOIN nation ON n_nationkey = user_id % 40 GROUP BY 1",
    "j09_person_with_tracks": f"""WITH t AS (SELECT user_id, k % 5 AS track, min(ts) AS start FROM {_E} GROUP BY 1, 2), p AS (SELECT user_id, string_agg(track::VARCHAR, ',' ORDER BY start, track) AS tracks FROM t GROUP BY 1)
  SELECT c_custkey AS person, c_name, coalesce(tracks, '') AS tracks FROM customer LEFT JOIN p ON c_custkey = user_id""",
    "j22_reconcile": f"""WITH g AS (SELECT DISTINCT k * 3 - 20 AS id FROM {_E}) SELECT id, 'missing' AS state FROM ({PRODUCT_SQL}) WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT id, 'orphan' FROM g WHERE id NOT IN (SELECT p_partkey FROM part)""",
    "q38_mean_colour": f"SELECT user_id, trunc(avg(r))::INT AS r, trunc(avg(g))::INT AS g, trunc(avg(b))::INT AS b FROM {_RGB} WHERE r + g + b > 0 GROUP BY 1",
    "q39_dominant_colour": f"""WITH n AS (SELECT user_id, {_NEAR} AS i, count(*) AS n FROM {_RGB} GROUP BY 1, 2), p AS (SELECT user_id, arg_max(i, (n, -i)) AS i, max(n) AS n, sum(n) AS a FROM n GROUP BY 1)
  SELECT user_id, ['{"', '".join(PALETTE)}'][i + 1] AS colour, round(n / a, 6) AS share FROM p""",
    "q41_live_people": f"""WITH p AS (SELECT who, coalesce(arg_min(category, (ts, event_id)) FILTER (category <> 'unknown'), 'unknown') AS category FROM {_SEEN} GROUP BY 1) SELECT category, count(*)::BIGINT AS people FROM p GROUP BY 1""",
    "t05_session_keys": f"SELECT who AS person_key, count(*)::BIGINT AS rows FROM {_SEEN} GROUP BY 1",
    "t04_session_rekey": f"SELECT user_id - user_id % 3 AS person, round(min(ts), 6) AS entered_at, {_CSV.format('k % 4')} AS cameras_seen, (count(DISTINCT user_id) - 1)::BIGINT AS closed_duplicates FROM {_E} WHERE event_type IN ('signup', 'view') GROUP BY 1",
    "t11_track_flush": f"""WITH s AS (SELECT *, coalesce(ts - lag(ts) OVER ({_BY}) > 10800, true)::INT AS starts FROM {_E}), t AS (SELECT *, sum(starts) OVER ({_BY} ROWS UNBOUNDED PRECEDING)::BIGINT AS track FROM s)
  SELECT user_id, track, count(*)::BIGINT AS samples, round(min(ts), 6) AS first_seen, round(max(ts), 6) AS last_seen, count(*) >= 3 AS eager FROM t GROUP BY 1, 2""",
    "t21_counting_gate": f"""WITH p AS (SELECT count(*) AS n, count(*) FILTER (category <> 'unknown') AS known FROM {_SEEN} GROUP BY who) SELECT count(*)::BIGINT AS identities, count(*) FILTER (n >= 3 AND known > 0)::BIGINT AS counted,
  count(*) FILTER (n >= 3 AND known = 0)::BIGINT AS without_category FROM p""",
    "t33_health_log": f"""WITH s AS (SELECT *, CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status FROM {_E}), l AS (SELECT *, lag(status) OVER ({_BY}) AS before FROM s)
  SELECT user_id, round(ts, 6) AS ts, status FROM l WHERE before IS NULL OR before <> status""",
    "q48_first_seen_order": f"SELECT product_name, count(*)::BIGINT AS n FROM ({INTERACTION_SQL}) GROUP BY 1 ORDER BY n DESC, min((ts, id)) LIMIT 10",
    "q49_gallery_order": f"""WITH r AS (SELECT user_id % 50 AS product_id, event_id AS id, CASE WHEN k > 5 THEN k % 9 END AS s FROM {_E})
  SELECT product_id, coalesce(max(s), -1) + 1 AS next_position, count(*)::BIGINT AS images, arg_min(id, (s, id)) FILTER (s IS NOT NULL) AS first_image FROM r GROUP BY 1""",
    "q50_frame_sequence": f"SELECT user_id, string_agg('img/' || event_id, ';' ORDER BY event_id) AS frames FROM {_E} WHERE k >= 90 GROUP BY 1",
    "q51_active_layout": f"""WITH v AS (SELECT user_id % 200 AS booth_id, event_id, row_number() OVER (PARTITION BY user_id % 200 ORDER BY ts, event_id)::INT AS version, count(*) OVER (PARTITION BY user_id % 200) AS n FROM {_E})
  SELECT booth_id, event_id, version, version = n AS active FROM v""",
    "q52_layout_checks": f"""WITH r AS (SELECT user_id % 300 AS layout, CASE WHEN k <> 7 THEN k END AS o, value - 5 AS width, event_type FROM {_E}) SELECT layout, count(*) FILTER (width <= 0)::BIGINT AS bad_size,
  count(*) FILTER (o IS NULL)::BIGINT AS without_id, (count(o) - count(DISTINCT o))::BIGINT AS repeated_id, count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'signup'))::BIGINT AS unknown_type FROM r GROUP BY 1""",
    "q54_abstain_curve": f"""WITH r AS (SELECT user_id % 4 AS kind, k % 3 <> 0 AS ok, value / 100 AS c, unnest([0.0, 0.5, 0.8]::DOUBLE[]) AS least FROM {_E})
  SELECT kind, least, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS acc_all, round(count(*) FILTER (c >= least) / count(*)::DOUBLE, 6) AS coverage,
  round(count(*) FILTER (ok AND c >= least) / greatest(count(*) FILTER (c >= least), 1)::DOUBLE, 6) AS acc_answered FROM r GROUP BY 1, 2""",
    "q55_catalog_lists": f"SELECT id, name, category FROM ({PRODUCT_SQL}) WHERE category IS NOT NULL ORDER BY id",
    "q57_settings": f"SELECT user_id AS key, coalesce(CASE WHEN arg_max(event_type, (ts, event_id)) <> 'error' THEN round(arg_max(value, (ts, event_id)), 2) END, -1.0::DOUBLE) AS value FROM {_E} GROUP BY 1",
    "l03_recent_pages": f"""(SELECT 'persons' AS page, user_id AS id FROM {_E} GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 500) UNION ALL (SELECT 'movement', event_id FROM {_E} ORDER BY ts, event_id LIMIT 2000)""",
    "l05_top_candidates": f"""WITH p AS (SELECT user_id, k % 8 AS product, round(max(value), 1) AS score FROM {_E} GROUP BY 1, 2) SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product))::INT AS rank FROM p QUALIFY rank <= 3""",
    "l07_best_per_class": f"SELECT floor(ts / 86400)::BIGINT AS frame, event_type, max(round(value, 0)) AS score, arg_max(event_id, (round(value, 0), -event_id)) AS event_id FROM {_E} GROUP BY 1, 2",
    "l08_best_shots": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM {_E}) SELECT user_id, count(*)::BIGINT AS shots, round(min(value), 6) AS worst FROM r WHERE rank <= 3 GROUP BY 1""",
    "l10_name_order": f"SELECT name, row_number() OVER (ORDER BY name COLLATE th, name) AS place FROM (SELECT DISTINCT name FROM ({PRODUCT_SQL}))",
    "l11_alert_ring": f"SELECT event_id, user_id FROM {_E} WHERE event_type = 'error' AND value > 20 ORDER BY ts DESC, event_id DESC LIMIT 50",
    "l12_recent_values": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM {_E}) SELECT user_id, count(*)::BIGINT AS held, round(avg(value), 6) AS mean FROM r WHERE rank <= 12 GROUP BY 1""",
    "n07_approaching": f"SELECT event_id, coalesce(lag(value) OVER ({_BY}) - value > 0.05, false) AS approaching FROM {_E}",
    "n14_trimmed_mean": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM {_E})
  SELECT user_id, round(avg(value) FILTER (rank > floor(n * 0.2) AND rank <= n - floor(n * 0.2)), 6) AS trimmed_mean, round(quantile_cont(value, 0.5), 6) AS median FROM r GROUP BY 1""",
    "n15_id_switches": f"""WITH r AS (SELECT user_id, k % 3 AS pred, lag(k % 3) OVER ({_BY}) AS before FROM {_E} WHERE event_type <> 'error') SELECT user_id, count(*) FILTER (before <> pred)::BIGINT AS switches FROM r GROUP BY 1""",
    "e02_counting_error": f"""WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS t, count(*) FILTER (event_type = 'purchase') AS c FROM {_E} GROUP BY 1)
  SELECT user_id, abs(c - t)::BIGINT AS error, round(CASE WHEN t = 0 THEN 0 ELSE abs(c - t) * 100 / t::DOUBLE END, 6)::DOUBLE AS percent FROM p""",
    "v08_running_blend": f"""WITH RECURSIVE r AS (SELECT user_id, value, (k % 5 + 1)::DOUBLE AS w, row_number() OVER ({_BY}) AS i FROM {_E}),
  f AS (SELECT user_id, i, value AS blend, w AS weight FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, (f.blend * f.weight + r.value * r.w) / (f.weight + r.w), least(f.weight + r.w, 100.0::DOUBLE) FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
  SELECT user_id, round(arg_max(blend, i), 6) AS blend, round(arg_max(weight, i), 6) AS weight FROM f GROUP BY 1""",
    "v09_soft_quality": f"SELECT event_id, (least(36, k) * 400 + least(4800, round(value * 100)::BIGINT) * 3) / 28800.0::DOUBLE AS quality FROM {_E}",
}
