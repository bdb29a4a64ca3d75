"""Labelled sound events: their metadata, read once, and an index of the labels' tokens for looking up phrases.

A label asked for finds the events that have it exactly (in any case); only if there are none, those with it as whole words in a label. A
label's rarest token decides whose labels are compared with it, so no label is held against all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import file_stamp, whole_folder

METADATA = "file string, label array<string>, onset double, offset double"
#: Words of any script, and single characters that are neither of a word nor space.
_TOKEN = r"(?U)\w+|[^\w\s]"

#: Pairs of a label asked for and an event that one task tells apart.
PAIRS = 1 << 20


def metadata(spark: SparkSession, path: str, folder: str, schema: str = METADATA) -> DataFrame:
    """The events of a file with one JSON array, with a number each, as event. They are parsed once: what was read is kept below `folder`
    under the file's name, length and time, and read from there until the file changes."""
    kept = f"{folder}/{file_stamp(spark, path)}"
    if not whole_folder(spark, kept):
        rows = spark.read.option("multiLine", True).schema(schema).json(path)
        rows.withColumn("event", F.monotonically_increasing_id()).write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)))


def label_index(events: DataFrame) -> DataFrame:
    """(token, label): each different label of events (label array<string>) under each of its tokens."""
    labels = events.select(F.explode("label").alias("label")).distinct()
    return labels.select(F.explode(tokens(F.col("label"))).alias("token"), "label")


def matching_labels(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(asked, label): labels that asked's labels (label) name, exactly or else as whole words. A label without any token names none."""
    wanted = asked.select(F.col("label").alias("asked")).distinct()
    labels = index.select("label").distinct()
    exact = wanted.join(labels, F.lower("asked") == F.lower("label"))
    rest = wanted.join(exact.select("asked").distinct(), "asked", "left_anti").select("asked", F.explode(tokens(F.col("asked"))).alias("token"))
    common = index.groupBy("token").agg(F.count("*").alias("n"))
    rarest = rest.join(common, "token", "left").groupBy("asked").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    literal = F.concat(F.lit(r"(?iuU)\b\Q"), F.replace("asked", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    whole = rarest.join(index, "token").where(F.regexp_like("label", literal)).select("asked", "label")
    return exact.unionByName(whole)


def lookup(asked: DataFrame, events: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(asked, event) of asked's labels (label) and events (event, label array<string>); each pair once. How many pairs there will be is counted
    first, from how often each label occurs, and so many tasks are made that none has more than about PAIRS to tell apart. Labels found are the side that a task holds; events stream past them."""
    found = matching_labels(asked, index if index is not None else label_index(events))
    each = events.select("event", F.explode("label").alias("label"))
    often = each.groupBy("label").agg(F.count("*").alias("n"))
    pairs = often.join(found.groupBy("label").agg(F.count("*").alias("m")), "label").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + pairs // PAIRS)  # a number of one's own isn't made less for small rows
    return each.join(found.hint("shuffle_hash"), "label").select("asked", "event").repartition(tasks, "asked", "event").distinct()


def available_labels(events: DataFrame) -> DataFrame:
    """(label): all labels, once each, in order."""
    return events.select(F.explode("label").alias("label")).distinct().orderBy("label")
