"""Readers and writers of evaluation records: JSON arrays, JSON lines, schedules, training logs, folders of tool results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QA_SCHEMA = "question string, choice array<string>, answer string, id string, audio_url string, question_type string, _json_path string, audio_path string"
PREDICTION_SCHEMA = """index int, prompt string, `load tool chain results` boolean, id string, question string, choices array<string>, answer string,
prediction string, correct boolean, uncertainty struct<num_samples: int, sampled_predictions: array<string>, predictive_entropy: double,
length_normalized_entropy: double, discrete_semantic_entropy: double, answer_distribution: map<string, int>, semantic_entropy: double,
semantic_clusters: array<array<string>>, p_true: double, p_true_raw_response: string>"""


def json_arrays(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """Files that each hold one JSON array of objects (or one object), concatenated, with their file as _json_path unless the
    schema names it."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(paths)
    return df if "_json_path" in df.columns and not schema else df.withColumn("_json_path", F.coalesce("_json_path", F.col("_metadata.file_path")) if "_json_path" in df.columns else F.col("_metadata.file_path"))


def sampled_arrays(spark: SparkSession, folder: str, n: int, seed: int, schema: str | None = None, pattern: str = "*.json") -> DataFrame:
    """json_arrays() of n files (or all) of a folder, drawn without replacement by their names, so the draw is the same wherever the
    folder lies. Only the chosen files are read; their n paths reach the driver. A folder without such files is an error."""
    from ..operators.sampling import sample

    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.substring_index("path", "/", -1).alias("name"))
    chosen = [r["path"] for r in sample(listed, "name", n, seed).select("path").collect()]
    if not chosen:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    rows = json_arrays(spark, chosen, schema)
    return rows if "_json_path" in rows.columns else rows.withColumn("_json_path", F.col("_metadata.file_path"))


def checked_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As json_arrays, but a file whose top level is no list fails the query that reads it."""
    text = spark.read.text(path, wholetext=True)
    value = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_as_struct(schema)}>>")).otherwise(F.raise_error(F.lit("the top level must be a list")))
    return text.select(F.explode(value).alias("x")).select("x.*")


def _as_struct(schema: str) -> str:
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(schema).fields
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)


def schedules(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, value): each schedule file as one text, for schedules.entries."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(paths)


def training_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, step, max_steps, loss, token_acc, epoch, learning_rate, grad_norm) of */logging.jsonl: a run is its folder; lines
    without a loss are left out; "255/939" becomes two numbers."""
    schema = "loss double, token_acc double, epoch double, learning_rate double, grad_norm double, `global_step/max_steps` string"
    rows = spark.read.schema(schema).json(pattern).withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    steps = F.split("global_step/max_steps", "/")
    return rows.where("loss is not null").select("run", steps[0].cast("int").alias("step"), steps[1].cast("int").alias("max_steps"), "loss", "token_acc", "epoch", "learning_rate", "grad_norm")


#: What a tool's result is said to be; {audio} and {text} stand for the result, {target} for the target's description.
RESULT_PHRASES = {
    "extract_target": "{target}-isolated auxiliary audio: {audio}",
    "remove_target": "auxiliary audio with {target} removed: {audio}",
    "asr": "transcription of the audio: {text}",
    "human_voice_enhance": "human voice enhanced audio: {audio}",
    "pitch_shift": "pitch-shifted audio: {audio}",
    "time_stretch": "time-stretched audio: {audio}",
}


def result_phrase(tool: Column, target: Column, text: Column, audio_token: str) -> Column:
    """What is said of a tool's result. A tool without a phrase, a missing target or a missing transcription is an error."""
    phrase = F.create_map(*[F.lit(x) for kv in RESULT_PHRASES.items() for x in kv])[tool]
    fail = lambda why: F.raise_error(F.lit(why))
    said = F.replace(phrase, F.lit("{audio}"), F.lit(audio_token))
    said = F.when(F.contains(phrase, F.lit("{text}")), F.coalesce(F.replace(said, F.lit("{text}"), text), fail("a transcription is missing"))).otherwise(said)
    said = F.when(F.contains(phrase, F.lit("{target}")), F.coalesce(F.replace(said, F.lit("{target}"), target), fail("a target's description is missing"))).otherwise(said)
    return F.when(phrase.isNull(), fail("no phrase for this tool's result")).otherwise(said)


def tool_results(spark: SparkSession, folder: str, audio_token: str, only: str | None = None, skip_missing: bool = False) -> DataFrame:
    """(folder, prompt, audio_paths) of folders with tool_input_<n>.json and, for each, tool_result_<n>.txt or .wav.

    Results are joined to inputs by number and told in that order, which is the step's. An input without a result is an
    error, or left out with skip_missing; so is a tool without a phrase.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.select("path", "content", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"tool_(input|result)_(\d+)\.(json|txt|wav)$", 1).alias("kind"), F.regexp_extract("path", r"_(\d+)\.\w+$", 1).try_cast("int").alias("n"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("type"))
    inputs = named.where("kind = 'input'").select("folder", "n", F.from_json(F.col("content").cast("string"), "tool string, parameters map<string, string>").alias("call"))
    results = named.where("kind = 'result'").groupBy("folder", "n").agg(F.max(F.when(F.col("type") == "txt", F.col("content").cast("string"))).alias("text"), F.max(F.when(F.col("type") == "wav", F.col("path"))).alias("audio"))
    both = inputs.join(results, ["folder", "n"], "left").where(F.lit(only).isNull() | (F.col("call.tool") == F.lit(only)))
    missing = F.col("text").isNull() & F.col("audio").isNull()
    if skip_missing:
        both = both.where(~missing)
    told = F.when(missing, F.raise_error(F.lit("a tool input has no result"))).otherwise(result_phrase(F.col("call.tool"), F.col("call.parameters")["target_description"], F.col("text"), audio_token))
    ordered = both.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("n", told.alias("said"), "audio"))).alias("x"))
    return ordered.select("folder", F.array_join(F.transform("x", lambda r: r["said"]), "").alias("prompt"), F.array_compact(F.transform("x", lambda r: r["audio"])).alias("audio_paths"))


def pool(spark: SparkSession, folders: list[str], excluded: DataFrame | None = None, pattern: str = "*.wav") -> DataFrame:
    """(path, stem) of audio files, without those whose stem, as it is or without a leading A_, is among excluded.stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folders).select("path", F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("stem"))
    return files if excluded is None else without_stems(files, excluded)


def without_stems(files: DataFrame, excluded: DataFrame) -> DataFrame:
    both = excluded.select(F.explode(F.array("stem", F.regexp_replace("stem", "^A_", ""))).alias("stem")).distinct()
    return files.join(both, "stem", "left_anti")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """One folder of JSON lines for each tool or turn."""
    df.write.mode("overwrite").partitionBy(*keys).json(path)


def append_results(df: DataFrame, path: str) -> None:
    """A checkpoint of finished results: only what is new is written."""
    df.write.mode("append").json(path)


def array_text(rows: Column, order: Column) -> Column:
    """An aggregate: a group's rows (structs) as one pretty JSON array in order; Unicode stays as it is."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.to_json(rows).alias("j"))))
    return F.concat(F.lit("[\n  "), F.array_join(F.transform(listed, lambda r: r["j"]), ",\n  "), F.lit("\n]"))


def write_arrays(df: DataFrame, path: str, by: str, order: str) -> None:
    """One file with one JSON array for each value of `by`, in a folder of its own. A file's rows must fit a task: choose `by` so."""
    rows = F.struct(*[c for c in df.columns if c != by])
    texts = df.groupBy(by).agg(array_text(rows, F.col(order)).alias("value"))
    texts.write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, for files that only this session reads: under spark.checkpoint.dir, or,
    for a local session, the temporary folder. It goes when the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    path = f"{base}/plumbline-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def whole_folder(spark: SparkSession, path: str) -> bool:
    """Whether Spark has written a folder to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def file_stamp(spark: SparkSession, path: str) -> str:
    """A name for a file as it is now: of its path, length and time of change."""
    import hashlib

    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    return hashlib.md5(f"{path}:{status.getLen()}:{status.getModificationTime()}".encode()).hexdigest()


def output_name(base: str, with_results: bool) -> str:
    return f"{base}_{'with' if with_results else 'no'}_tool_chain_results"
