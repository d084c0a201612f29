"""Logs of which rows can be deleted or changed: only the parts that hold such rows are written anew, beside the old ones, and a row
added to the log of versions makes the change visible as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSIONS = "version long, part string, at string"


def _part(by: str) -> Column:
    """A name for a folder, whatever the value is; nulls have one too."""
    return F.md5(F.coalesce(F.col(by).cast("string"), F.lit("null:")).cast("binary"))


def _latest(spark: SparkSession, path: str) -> dict[str, str]:
    """Where the newest version of every part is; parts of which nothing is left are nowhere."""
    try:
        log = spark.read.schema(_VERSIONS).parquet(f"{path}/versions")
        rows = log.groupBy("part").agg(F.max_by("at", "version").alias("at"), F.max("version").alias("version")).collect()
    except AnalysisException:  # nothing was written yet
        return {}
    return {r["part"]: r["at"] for r in rows if r["at"]}


def _publish(spark: SparkSession, path: str, places: dict[str, str | None]) -> None:
    try:
        last = spark.read.schema(_VERSIONS).parquet(f"{path}/versions").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        last = 0
    rows = spark.createDataFrame([(last + 1, part, at) for part, at in sorted(places.items())], _VERSIONS)
    rows.coalesce(1).write.mode("append").parquet(f"{path}/versions")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows as they are now. Who has read a version keeps it: no file is ever changed."""
    places = sorted(_latest(spark, path).values())
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def write(rows: DataFrame, path: str, by: str) -> None:
    """A log in parts by the values of a column, instead of whatever it held. Few values have many rows; each part's list of
    places comes to the driver, none of its rows."""
    spark, old = rows.sparkSession, _latest(rows.sparkSession, path)
    new = _write(rows, path, by)
    if old or new:
        _publish(spark, path, {**dict.fromkeys(old), **new})


def _write(rows: DataFrame, path: str, by: str) -> dict[str, str]:
    at = f"{path}/data/{uuid.uuid4().hex}"
    rows.withColumn("part_", _part(by)).write.partitionBy("part_").parquet(at)
    written = rows.sparkSession.read.schema("part_ string").option("basePath", at).parquet(at).select("part_").distinct().collect()
    return {r["part_"]: f"{at}/part_={r['part_']}" for r in written}


def change(spark: SparkSession, path: str, schema: str, by: str, touched: Column, changed: Callable[[DataFrame], DataFrame]) -> int:
    """Give the rows of all parts that hold a touched one to `changed`, and put what it returns in their place; returns how
    many parts that are. A part that gets rows it had none of keeps those it has. What fails before the end leaves all as it was."""
    places = _latest(spark, path)
    rows = read(spark, path, schema)
    hit = [r["part_"] for r in rows.where(touched).select(_part(by).alias("part_")).distinct().collect()]
    if not hit:
        return 0
    old = spark.read.schema(schema).parquet(*sorted(places[p] for p in hit))
    new = changed(old)
    # rows that move to a part that wasn't touched: it is written again with them
    moved = [r["part_"] for r in new.select(_part(by).alias("part_")).distinct().collect() if r["part_"] in places and r["part_"] not in hit]
    if moved:
        new = new.unionByName(spark.read.schema(schema).parquet(*sorted(places[p] for p in moved)))
    _publish(spark, path, {**dict.fromkeys(hit), **_write(new, path, by)})
    return len(hit)


def delete(spark: SparkSession, path: str, schema: str, by: str, gone: Column) -> int:
    """Rows for which the condition holds go; those for which it is null stay."""
    sure = F.coalesce(gone, F.lit(False))
    return change(spark, path, schema, by, sure, lambda rows: rows.where(~sure))


def rename(spark: SparkSession, path: str, schema: str, by: str, column: str, old, new) -> int:
    """One value of a column becomes another."""
    return change(spark, path, schema, by, F.col(column) == old, lambda rows: rows.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)).cast(dict(rows.dtypes)[column])))
