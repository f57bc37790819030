"""Numbers in an order, without one task for all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.sources.staging import staged


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their number within by, from 1, in an order that tells all rows of one by apart.

    Rows are sorted by ranges; a row's number is its number in its range and the rows of its by in the ranges before. A by
    that holds a third of all rows is dealt over as many ranges as others.
    """
    ranges = staged(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(*by, "_range").agg(F.count("*").alias("_n"))  # a row for each range and by in it
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    within = ranges.withColumn("_own", F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "_range"]]
    starts = starts.select(*(F.col(c).alias(f"_{c}") for c in [*by, "_range"]), "_start")
    return within.join(starts, same).select(*rows.columns, (F.col("_start") + F.col("_own")).alias(name))
