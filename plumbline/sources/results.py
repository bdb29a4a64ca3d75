"""Saving tools' results: which files a result becomes, and writing them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_problem(record: Column, problem: Column) -> Column:
    """A JSON object's text with the problem as its last member."""
    body = F.rtrim(F.regexp_replace(record, r"\}\s*$", ""))
    return F.concat(body, F.when(F.trim(body) == "{", "").otherwise(", "), F.lit('"_problem": '), F.coalesce(problem, F.lit("null")), F.lit("}"))


def result_files(results: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, name, source, content): the files of results (id, tool, transcript, clip_path, output_path, separated_files
    map<string,string>, record, problem); record is the whole result as a JSON object, existing (path) lists the audios.

    The first of these that a result has decides: a transcript becomes a text; a clip is copied; an output is copied if it is a
    WAV that exists; separated files are copied, each under its stem, beside the record; anything else, an output of another
    kind too, becomes the record with its problem. A copy has a source and no content; ids and tools are not null.
    """
    kind = (
        F.when(F.col("transcript").isNotNull(), "text").when(F.col("clip_path").isNotNull(), "clip").when(F.col("output_path").isNotNull(), "output")
        .when(F.col("separated_files").isNotNull(), "separated").otherwise("record")
    )
    there = existing.select(F.col("path").alias("output_path"), F.lit(True).alias("there")).distinct()
    known = results.withColumn("kind", kind).join(there, "output_path", "left")
    known = known.withColumn("kind", F.when((F.col("kind") == "output") & ~(F.col("there").isNotNull() & F.lower("output_path").endswith(".wav")), "record").otherwise(F.col("kind")))
    base, none = F.concat(F.lit("tool_result_"), F.col("tool")), F.lit(None).cast("string")
    ending = lambda path: F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    file = lambda name, source, content: F.struct(name.alias("name"), source.alias("source"), content.alias("content"))
    copy = lambda path: file(F.concat(base, ending(path)), path, none)
    record = F.array(file(F.concat(base, F.lit(".json")), none, _with_problem(F.col("record"), F.col("problem"))))
    stems = F.transform(F.map_entries("separated_files"), lambda e: file(F.concat(base, F.lit("_"), e["key"], ending(e["value"])), e["value"], none))
    files = (
        F.when(F.col("kind") == "text", F.array(file(F.concat(base, F.lit(".txt")), none, F.col("transcript")))).when(F.col("kind") == "clip", F.array(copy(F.col("clip_path"))))
        .when(F.col("kind") == "output", F.array(copy(F.col("output_path")))).when(F.col("kind") == "separated", F.concat(stems, record)).otherwise(record)
    )
    return known.select("id", F.explode(files).alias("f")).select("id", "f.*")


def save(files: DataFrame, folder: str) -> DataFrame:
    """Write result_files under folder/id/name, in tasks, and return (id, name, status, message) when it runs.

    Sources and folder are paths or URIs that all executors reach. Copies go from file system to file system in pieces. A file
    that can't be written is a row with status failure; a task that runs twice writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                path = f"{root}/{row['id']}/{row['name']}"
                try:
                    to.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    if row["source"] is None:
                        with to.open_output_stream(path) as stream:
                            stream.write(row["content"].encode())
                    else:
                        of, source = fs.FileSystem.from_uri(row["source"])
                        fs.copy_files(source, path, source_filesystem=of, destination_filesystem=to)
                    out.append((row["id"], row["name"], "success", None))
                except (OSError, ValueError) as error:
                    out.append((row["id"], row["name"], "failure", str(error)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], names=["id", "name", "status", "message"])

    return files.withColumn("id", F.col("id").cast("string")).mapInArrow(run, "id string, name string, status string, message string")
