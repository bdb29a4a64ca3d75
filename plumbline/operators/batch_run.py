"""A batch run as a transaction: calls run in attempts, and what an attempt did is seen only through its manifest.

    <folder>/attempts/<n>/files/...    what the tools wrote
    <folder>/attempts/<n>/results      what they answered
    <folder>/manifests/<n>             one row a step of the attempt: its status, answer and files

A manifest is written last and counts when it is whole, so an attempt that was cut off at any point, its files included, was never
there. Manifests are the run's summary, and the next attempt takes up only what they lack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import folder_names, whole_folder
from .schedules import run_batches, statuses

RESULT = "status string, text string, files array<string>, message string"
MANIFEST = f"id string, step int, tool string, parameters string, {RESULT}, attempt int"
_CALL = "id string, step int, tool string, parameters string, batch long, output_path string"


def attempts(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of all attempts, whole or not."""
    return sorted(int(n) for n in folder_names(spark, f"{folder}/attempts") if n.isdigit())


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """MANIFEST: the latest row of every step that an attempt with a whole manifest has."""
    paths = [p for n in attempts(spark, folder) if whole_folder(spark, p := f"{folder}/manifests/{n}")]
    rows = spark.read.schema(MANIFEST).parquet(*paths) if paths else spark.createDataFrame([], MANIFEST)
    return rows.groupBy("id", "step").agg(F.max_by(F.struct("*"), "attempt").alias("row")).select("row.*")


def lacking(steps: DataFrame, done: DataFrame, retry: bool = False) -> DataFrame:
    """The steps that no attempt has finished; with retry, failed ones too. A malformed step is finished, a skipped one isn't."""
    finished = done.where(F.col("status").isin("success", "error", *([] if retry else ["failure"])))
    return steps.join(finished.select("id", "step"), ["id", "step"], "left_anti")


def run(steps: DataFrame, tools: Callable[[list[dict]], list[dict]], folder: str, only_tool: str | None = None, size: int = 100, retry: bool = False) -> int | None:
    """One attempt at steps (id, step, tool, parameters, well_formed; (id, step) are distinct) and its number, or None if nothing is lacking.

    tools gets about `size` calls of one tool as dicts (id, step, tool, parameters, output_path) and returns as many dicts (text,
    files, message), or raises, which fails these calls. Files belong below the attempt's folder, at output_path by custom; a call
    that names a file that isn't there has failed.
    """
    spark = steps.sparkSession
    todo = statuses(lacking(steps, manifest(spark, folder), retry), only_tool)
    if todo.isEmpty():
        return None
    number = max(attempts(spark, folder), default=0) + 1
    here = f"{folder}/attempts/{number}"
    todo.select("id", "step", "tool", "parameters", "status").write.parquet(f"{here}/steps")
    todo = spark.read.parquet(f"{here}/steps")
    ready = todo.where("status = 'ready'").drop("status")
    shares = 1 + ready.count() // size
    where = F.concat(F.lit(f"{here}/files/"), "id", F.lit("/step"), F.col("step").cast("string"), F.lit("_"), "tool")
    calls = ready.withColumns({"batch": F.pmod(F.xxhash64("id", "step"), F.lit(shares)), "output_path": where})
    run_batches(calls.select("id", "step", "tool", "parameters", "batch", "output_path"), tools, f"{_CALL}, {RESULT}").write.parquet(f"{here}/results")
    publish(spark, folder, number)
    return number


def publish(spark: SparkSession, folder: str, number: int) -> None:
    """Write an attempt's manifest."""
    here = f"{folder}/attempts/{number}"
    results = spark.read.parquet(f"{here}/results").select("id", "step", *[c.split()[0] for c in RESULT.split(", ")])
    named = results.select("id", "step", F.explode("files").alias("file"))
    gone = named.select("id", "step").distinct()
    if folder_names(spark, f"{here}/files"):  # names alone are read
        plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
        there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{here}/files").select(plain("path").alias("file"))
        gone = named.withColumn("file", plain("file")).join(there, "file", "left_anti").select("id", "step").distinct()
    checked = results.join(gone.withColumn("gone", F.lit(True)), ["id", "step"], "left")
    failed = F.coalesce("gone", F.lit(False)) & (F.col("status") == "success")
    checked = checked.withColumns({"status": F.when(failed, "failure").otherwise(F.col("status")), "message": F.when(failed, "a file is missing").otherwise(F.col("message"))}).drop("gone")
    steps = spark.read.parquet(f"{here}/steps")
    why = F.when(F.col("status") == "error", F.when(F.col("tool").isNull(), "no tool").otherwise("malformed")).when(F.col("status") == "skipped", "another tool was asked for")
    rest = steps.where("status <> 'ready'").withColumns({"text": F.lit(None).cast("string"), "files": F.lit(None).cast("array<string>"), "message": why})
    done = steps.where("status = 'ready'").drop("status").join(checked, ["id", "step"], "left").withColumn("status", F.coalesce("status", F.lit("failure")))
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    out = done.unionByName(rest).withColumn("attempt", F.lit(number)).select(*columns)
    out.write.parquet(f"{folder}/manifests/{number}")


def summary(steps: DataFrame, done: DataFrame) -> DataFrame:
    """(id, tool_chain array<string>, results array<struct<step, tool, status, text, files, message, attempt>>): every problem with its steps in
    order; one that no attempt has reached is pending."""
    rows = steps.select("id", "step", "tool").join(done.drop("tool", "parameters"), ["id", "step"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    ordered = F.sort_array(F.collect_list(F.struct("step", "tool", "status", "text", "files", "message", "attempt")))
    return rows.groupBy("id").agg(ordered.alias("results")).select("id", F.col("results")["tool"].alias("tool_chain"), "results")
