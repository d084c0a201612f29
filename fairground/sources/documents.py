"""JSON and CSV documents as tables: product catalogs, topologies, label lists. Parsed by Spark's readers'
functions, one document a row, so that any number of documents is read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRODUCT = "struct<name:string,price:string,description:string>"
#: Fields that a product of the registered kind may have (fixed values).
GI_FIELDS = ["id", "name", "class_name", "gi_reference", "province", "producer", "category", "description", "image_url"]


def catalog(docs: DataFrame, column: str = "document") -> DataFrame:
    """key and the product's fields: from an object of products by key, a list of products with a key,
    or either under `products`. Keys that begin with `_` are notes; documents that can't be read give
    nothing."""
    text = F.coalesce(F.get_json_object(column, "$.products"), F.col(column))
    by_key = F.map_entries(F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("{")), text), f"map<string,{PRODUCT}>"))
    listed = F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("[")), text), f"array<struct<key:string,{PRODUCT[7:]}>")
    as_entries = F.transform(listed, lambda p: F.struct(p["key"].alias("key"), F.struct(p["name"].alias("name"), p["price"].alias("price"), p["description"].alias("description")).alias("value")))
    rows = docs.select(F.inline(F.coalesce(by_key, as_entries)))
    return rows.where(F.col("key").isNotNull() & ~F.startswith("key", F.lit("_"))).select("key", "value.name", "value.price", "value.description")


def registered_products(docs: DataFrame, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """The products of all documents (id and fields), and what is refused: id and reason, an id that comes
    more than once or a field that isn't known."""
    listed = F.from_json(F.get_json_object(column, "$.products"), "array<map<string,string>>")
    rows = docs.select(F.explode(listed).alias("p")).select(F.col("p")["id"].alias("id"), "p")
    unknown = F.size(F.array_except(F.map_keys("p"), F.array(*[F.lit(f) for f in GI_FIELDS]))) > 0
    counted = rows.groupBy("id").agg(F.count("*").alias("times"), F.bool_or(unknown).alias("unknown"))
    refused = counted.where("times > 1 OR unknown").select("id", F.when(F.col("times") > 1, "duplicate id").otherwise("unknown field").alias("reason"))
    good = rows.join(refused, "id", "left_anti").select("id", *[F.col("p")[f].alias(f) for f in GI_FIELDS[1:]])
    return good, refused


def transitions(docs: DataFrame, column: str = "document") -> DataFrame:
    """from_camera, to_camera, min_seconds, max_seconds of the topologies."""
    kind = "array<struct<`from`:string,`to`:string,min_seconds:double,max_seconds:double>>"
    rows = docs.select(F.inline(F.from_json(F.get_json_object(column, "$.transitions"), kind)))
    return rows.select(F.col("from").alias("from_camera"), F.col("to").alias("to_camera"), "min_seconds", "max_seconds")


def csv_rows(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Lines of comma-separated values; fields that can't be read are null."""
    return lines.select(F.from_csv(column, schema).alias("r")).select("r.*")


def label_report(rows: DataFrame, path: Column, label: Column) -> DataFrame:
    """rows, empty_labels, usable, classes: how far a list of labelled files can be used."""
    empty = F.coalesce(F.trim(label), F.lit("")) == ""
    usable = ~empty & path.isNotNull()
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(empty).alias("empty_labels"), F.count_if(usable).alias("usable"),
        F.array_join(F.sort_array(F.collect_set(F.when(~empty, F.trim(label)))), ",").alias("classes"),
    )
