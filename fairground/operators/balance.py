"""Running balance of entries and exits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def running_balance(crossings: DataFrame, keys: list[str]) -> DataFrame:
    """crossings with delta and balance: people inside after each row, never below 0.

    Flooring at each step equals the plain sum less the smallest sum so far, if that is below 0."""
    upto = W.partitionBy(*keys).orderBy("ts", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = crossings.withColumn("delta", F.when(F.col("direction") == "in", 1).otherwise(-1))
    rows = rows.withColumn("sum_", F.sum("delta").over(upto))
    return rows.withColumn("balance", F.col("sum_") - F.least(F.lit(0), F.min("sum_").over(upto))).drop("sum_")
