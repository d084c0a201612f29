"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm import decontam, langid, near_dedup, packing, pii
from fairground.llm.common import named, scratch, whole

#: Calibrated probability below which a language counts as not recognised.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language isn't recognised: null or without a letter, or of too low a score.
    Repeated rows go or stay together, columns may have any names, an empty table stays empty."""
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    rows = docs.select(whole(docs).alias("row"), docs["text"])
    found = langid.predict(rows, model, keep=["row"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id (of equal ids
    and words, one row). Documents without an id or words aren't of any group; an empty table stays empty."""
    return near_dedup.deduplicated(docs, k=5, similarity=0.75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold an item of the benchmark. Repeated rows go or stay together, null and empty
    texts stay, and all of an empty table or with an empty benchmark."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, containment=0.75)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated ones too; personal data in their texts is generalised, and n_chars
    follows. Null and empty texts and an empty table stay as they are."""
    names = {c.lower() for c in docs.columns}
    out = next(f"sanitised_{i}" for i in range(len(names) + 1) if f"sanitised_{i}" not in names)
    clean = pii.sanitise(docs, "text", out)
    changed = {"text": F.col(out), "n_chars": F.when(F.col(out).isNull(), F.col("n_chars")).otherwise(F.length(out))}
    return clean.select(*[changed[c].cast(kind).alias(c) if c in changed else named(clean, c) for c, kind in docs.dtypes])


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 2048 tokens. Null and empty texts are one token, repeated
    rows are packed as often as they occur, an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("packing", windows),
]

#: Models, hashing and tokens aren't SQL; tests hold run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
