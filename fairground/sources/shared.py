"""Tables in the folder that driver and executors share: append-only logs and what is exported."""

from __future__ import annotations

import atexit
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list = []
_STORED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir (local mode alone has a default), removed at exit."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file:///tmp/checkpoints"
    path = f"{where.rstrip('/')}/fairground/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # noqa: S112  the JVM, or this path, may be gone by now
            continue
    _MADE.clear()


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table of its own in the shared folder, read back: cuts the lineage, outlives executors."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    _STORED[kept := rows.sparkSession.read.schema(rows.schema).parquet(path)] = path
    return kept


def discard(rows: DataFrame) -> None:
    """Remove what stored() has written, once nothing reads it any more; other rows are left alone."""
    path = _STORED.pop(rows, None)
    if path is not None:
        _delete(rows.sparkSession, path)


def append(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Add rows to a log; files are only ever added, so readers see whole appends."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def fan_out(rows: DataFrame, path: str, tables: dict) -> None:
    """One delivery into several tables, each a function of the rows; made for foreachBatch as well.

    The delivery is written once and read back, so that every table is made of the same rows."""
    staged = f"{path}/delivery-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    kept = rows.sparkSession.read.schema(rows.schema).parquet(staged)
    for name, make in tables.items():
        append(make(kept), f"{path}/{name}")


def write_sheets(sheets: dict[str, DataFrame], path: str, kind: str = "csv") -> dict[str, DataFrame]:
    """Every sheet as a folder of files of its own, read back; a sheet without rows says so in one row."""
    out, spark = {}, None
    for name, rows in sheets.items():
        spark = rows.sparkSession
        if rows.isEmpty():
            rows = spark.createDataFrame([("no data",)], "note string")
        writer, at = rows.write, f"{path}/{name}"
        (writer.option("header", True).csv(at) if kind == "csv" else writer.json(at))
        out[name] = (spark.read.option("header", True).schema(rows.schema).csv(at) if kind == "csv" else spark.read.schema(rows.schema).json(at))
    return out


def sheet_counts(sheets: dict[str, DataFrame]) -> DataFrame:
    """sheet, rows, empty of every sheet."""
    counted = None
    for name, rows in sheets.items():
        empty = F.lit(rows.columns == ["note"])
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("sheet"), "rows", empty.alias("empty"))
        counted = one if counted is None else counted.union(one)
    return counted
