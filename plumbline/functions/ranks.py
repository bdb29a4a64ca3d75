"""A global row number without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import scratch_folder

#: Rows that a range holds, about.
RANGE_ROWS = 1 << 20
_ROW_BITS = 33


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a column `name`: the row's number, from 1, in the given order, nulls first. Rows equal in all of `order` are
    numbered in any order, but each once.

    Rows are written once as they come and once dealt out by ranges of all order columns and sorted within, so a number is a
    range's offset plus a place in it. Equal rows may lie in several ranges: what they were read as breaks ties. Ranges follow the number of
    rows; only their sizes, one number for each of at most RANGE_ROWS rows, reach the driver.
    """
    spark = df.sparkSession
    given, ranged = scratch_folder(spark, "unranked"), scratch_folder(spark, "ranked")
    df.withColumn("__tie", F.monotonically_increasing_id()).write.parquet(given)
    rows = spark.read.parquet(given)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // RANGE_ROWS)
    keys = [*order, "__tie"]
    rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__tie").write.parquet(ranged)
    placed = spark.read.parquet(ranged).withColumn("__range", F.shiftright("__at", _ROW_BITS))
    sizes, before, so_far = sorted(map(tuple, placed.groupBy("__range").count().collect())), [], 0
    for k, n in sizes:
        before.append((k, so_far))
        so_far += n
    offsets = spark.createDataFrame(before, "__range long, __before long")
    number = F.col("__before") + F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    return placed.join(F.broadcast(offsets), "__range").withColumn(name, number).drop("__range", "__before", "__at")
