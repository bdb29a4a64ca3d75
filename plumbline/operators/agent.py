"""The running agent: a model that calls tools step by step, for all samples at once.

Each round asks the model for one turn of every live sample, reads it, runs the calls, and appends the round's turns to the run's
folder: what was said, what came of it, and the sample's state after it. Nothing written is touched again. A round's transcript is
the start plus the turns so far of the samples that still run, and only those samples' rows move. A round counts once it is
whole: a run that was cut off goes on behind its last whole round, and does not ask the model again for answers that were
written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_parse import read_turn
from ..sources.records import whole_folder
from . import models
from .prompts import audio_outputs, audio_tag, result_message

MESSAGES = "array<struct<role: string, content: string>>"
#: What a run may end with.
REASONS = ("model_signaled_done", "unparseable_output", "disallowed_tool", "repeated_call", "unknown_audio_id", "tool_execution_failed", "max_steps_reached")
_STATE = ("sample", "budget", "ids", "audios", "last_id", "fresh", "signatures")


def start(samples: DataFrame) -> DataFrame:
    """The state before the first turn, of samples (sample, messages, audios array<struct<id, path>>, budget) with distinct sample values.
    The last audio is what a call reads that names none."""
    audios = F.coalesce("audios", F.array().cast("array<struct<id: string, path: string>>"))
    return samples.select(
        "sample", F.col("messages").cast(MESSAGES).alias("messages"), F.col("budget").cast("int").alias("budget"), F.map_from_entries(audios).alias("ids"), audios["path"].alias("audios"),
        F.try_element_at(audios["id"], F.lit(-1)).alias("last_id"), F.size(audios).alias("fresh"), F.array().cast("array<string>").alias("signatures"),
    )


def _said(turns: DataFrame) -> DataFrame:
    """(sample, round, at, role, content) of turns: the model's message and, after a call that ran, the tool's."""
    told = F.array(F.struct(F.lit(0).alias("at"), F.lit("assistant").alias("role"), F.col("text").alias("content")), F.struct(F.lit(1).alias("at"), F.lit("tool").alias("role"), F.col("told").alias("content")))
    return turns.select("sample", "round", F.explode(told).alias("m")).select("sample", "round", "m.*").where("content is not null")


def transcripts(begun: DataFrame, turns: DataFrame | None) -> DataFrame:
    """(sample, messages): what begun's samples have seen and said so far."""
    first = begun.select("sample", F.lit(0).alias("round"), F.posexplode("messages").alias("at", "m")).select("sample", "round", "at", "m.role", "m.content")
    every = first if turns is None else first.unionByName(_said(turns.join(begun.select("sample"), "sample", "left_semi")))
    ordered = F.sort_array(F.collect_list(F.struct("round", "at", "role", "content")))
    return every.groupBy("sample").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def _read(answered: DataFrame, tools: list[str]) -> DataFrame:
    """answered (state, text) with the call that the text holds, its input, and why the run ends before it, if it does."""
    out = answered.withColumn("turn", read_turn(F.coalesce("text", F.lit(""))))
    call = F.col("turn")
    signature = F.concat_ws("\x00", call["tool"], call["parameters"])
    wanted = F.coalesce(call["audio_id"], F.col("last_id"))
    reason = (
        F.when(call["done"].isNull(), "unparseable_output").when(call["done"], "model_signaled_done").when(call["tool"].isNull(), "unparseable_output").when(~call["tool"].isin(*tools), "disallowed_tool")
        .when(F.array_contains("signatures", signature), "repeated_call").when(F.col("ids")[wanted].isNull(), "unknown_audio_id")
    )
    named = call["tool"].isNotNull() & ~F.coalesce(call["done"], F.lit(False))
    return out.withColumns({"signature": signature, "input_id": F.when(named, wanted), "audio": F.col("ids")[wanted], "early": reason, "tool": F.when(named, call["tool"]), "parameters": F.when(named, call["parameters"])})


def _outcome(read: DataFrame, results: DataFrame, number: int) -> DataFrame:
    """A round's turns: what was said, what came of it, and the state after it."""
    got = results.select("sample", F.struct("status", "output_path", "clip_path", "separated_files", "transcript", "message", "result").alias("got"))
    both = read.join(got, "sample", "left")
    got, ran = F.col("got"), F.col("early").isNull()
    ok = ran & F.coalesce(got["status"] == "success", F.lit(False))
    made = F.when(ok, audio_outputs(got["separated_files"], got["output_path"], got["clip_path"])).otherwise(F.create_map().cast("map<string,string>"))
    numbers = F.sequence(F.col("fresh"), F.col("fresh") + F.size("ids"))
    number_free = F.element_at(F.filter(numbers, lambda n: ~F.map_contains_key("ids", F.concat(F.lit("audio_"), n))), 1)
    asked = F.col("turn")["output_id"]
    own = F.coalesce(asked, F.concat(F.lit("audio_"), number_free))
    both = both.withColumns({"made": made, "own": own, "ok": ok, "fresh": F.when(ok & asked.isNull(), number_free + 1).otherwise(F.col("fresh"))})
    name = lambda stem: F.when(stem.isin("", "target"), F.col("own")).otherwise(F.concat(F.col("own"), F.lit("_"), stem))
    both = both.withColumn("new", F.transform(F.map_entries("made"), lambda e: F.struct(name(e["key"]).alias("id"), e["value"].alias("path"))))
    some = F.size("new") > 0
    ids = F.map_concat(F.map_filter("ids", lambda k, _: ~F.array_contains(F.col("new")["id"], k)), F.map_from_entries("new"))
    text = F.coalesce(F.nullif(got["transcript"], F.lit("")), F.nullif(got["message"], F.lit("")), got["result"])
    tags = F.transform("new", lambda p: audio_tag(p["id"]))
    told = F.when(F.col("ok"), result_message(F.lit(number), F.col("tool"), tags, text))
    reason = F.coalesce("early", F.when(~F.col("ok"), "tool_execution_failed"), F.when(F.col("budget") <= number, "max_steps_reached"))
    error = F.when(F.col("early").isin(*REASONS[1:]), F.col("early")).when(F.col("early").isNull() & ~F.col("ok"), F.coalesce(got["message"], F.lit("no result")))
    return both.select(
        "sample", "text", "tool", "parameters", "input_id", F.when(ran, F.col("ok")).alias("success"), error.alias("error"), F.col("new")["id"].alias("produced"), told.alias("told"), reason.alias("reason"),
        "budget", F.when(some, ids).otherwise(F.col("ids")).alias("ids"), F.concat("audios", F.col("new")["path"]).alias("audios"), F.when(some, F.col("new")[0]["id"]).otherwise(F.col("last_id")).alias("last_id"),
        "fresh", F.when(ran, F.concat("signatures", F.array("signature"))).otherwise(F.col("signatures")).alias("signatures"),
    )


def run(samples: DataFrame, generate: Callable[[DataFrame], DataFrame], execute: Callable[[DataFrame], DataFrame], tools: list[str], folder: str) -> DataFrame:
    """Run all samples (see start) to their end and give their turns (see turns).

    generate gets (sample, messages, audios array<string>) and returns (sample, text); a sample without an answer is one that
    can't be read. execute gets (sample, step, tool, parameters, audio), parameters as JSON without what says where audio lies, and
    returns (sample, status, output_path, clip_path, separated_files map<string,string>, transcript, message, result); a call without
    status success, or without a row, ends its run. Both may be called again for a round that was cut off before its answers were written.
    """
    spark = samples.sparkSession
    if not whole_folder(spark, f"{folder}/start"):
        start(samples).write.mode("overwrite").parquet(f"{folder}/start")
    begun = spark.read.parquet(f"{folder}/start")
    rounds = begun.agg(F.coalesce(F.max("budget"), F.lit(0))).first()[0]
    for number in range(1, rounds + 1):
        if whole_folder(spark, f"{folder}/turns/round={number}"):
            continue
        said = turns(spark, folder, number - 1) if number > 1 else None
        live = begun.select(*_STATE).where("budget > 0") if said is None else said.where((F.col("round") == number - 1) & F.col("reason").isNull()).select(*_STATE)
        if live.isEmpty():
            break
        if not whole_folder(spark, f"{folder}/answers/round={number}"):
            spoken = transcripts(begun.join(live.select("sample"), "sample", "left_semi"), said)
            requests = live.select("sample", "audios").join(spoken, "sample").select("sample", "messages", "audios")
            generate(requests).select("sample", "text").write.mode("overwrite").parquet(f"{folder}/answers/round={number}")
        answers = spark.read.parquet(f"{folder}/answers/round={number}")
        read = _read(live.join(answers, "sample", "left"), tools)
        calls = read.where("early is null").select("sample", F.lit(number).alias("step"), "tool", F.col("turn.given").alias("parameters"), "audio")
        _outcome(read, execute(calls), number).write.mode("overwrite").parquet(f"{folder}/turns/round={number}")
    return turns(spark, folder, rounds)


TURNS = "sample {kind}, text string, tool string, parameters string, input_id string, success boolean, error string, produced array<string>, told string, reason string, budget int, ids map<string,string>, audios array<string>, last_id string, fresh int, signatures array<string>, round int"


def turns(spark: SparkSession, folder: str, last: int) -> DataFrame:
    """The turns of the whole rounds up to `last`: (sample, round, text, tool, parameters, input_id, success, error, produced, told, reason, and
    the state after it)."""
    kind = dict(spark.read.parquet(f"{folder}/start").dtypes)["sample"]
    paths = [p for n in range(1, last + 1) if whole_folder(spark, p := f"{folder}/turns/round={n}")]
    reader = spark.read.schema(TURNS.format(kind=kind))
    return reader.option("basePath", f"{folder}/turns").parquet(*paths) if paths else spark.createDataFrame([], TURNS.format(kind=kind))


def outcomes(begun: DataFrame, done: DataFrame) -> DataFrame:
    """(sample, stop_reason, n_turns, attempted, successful, final_audio) of all begun samples; one without a budget has no turns."""
    ordered = lambda value, keep: F.transform(F.filter(F.sort_array(F.collect_list(F.struct("round", value.alias("v"), keep.alias("k")))), lambda x: x["k"]), lambda x: x["v"])
    tried = F.col("success").isNotNull()
    last = F.max_by(F.struct("reason", "ids", "last_id"), "round")
    each = done.groupBy("sample").agg(last.alias("last"), F.count("*").alias("n"), ordered(F.col("tool"), tried).alias("attempted"), ordered(F.col("tool"), F.coalesce("success", F.lit(False))).alias("successful"))
    none = F.array().cast("array<string>")
    both = begun.select("sample", F.col("ids").alias("first"), F.col("last_id").alias("first_id")).join(each, "sample", "left")
    final = F.when(F.col("last").isNull(), F.col("first")[F.col("first_id")]).otherwise(F.col("last.ids")[F.col("last.last_id")])
    return both.select("sample", F.coalesce("last.reason", F.lit(REASONS[-1])).alias("stop_reason"), F.coalesce("n", F.lit(0)).alias("n_turns"), F.coalesce("attempted", none).alias("attempted"), F.coalesce("successful", none).alias("successful"), final.alias("final_audio"))


def chat_prompt(messages: Column) -> Column:
    """Messages as a model's chat, up to where it speaks."""
    from .prompts import ASSISTANT, END

    said = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit(END)))
    return F.concat(F.array_join(said, ""), F.lit(ASSISTANT))


def with_model(load: Callable[[], models.Generator], batch: int = 32) -> Callable[[DataFrame], DataFrame]:
    """A model as run's generate; a batch that fails gives no answers."""

    def generate(requests: DataFrame) -> DataFrame:
        asked = requests.select(F.col("sample").alias("id"), chat_prompt(F.col("messages")).alias("prompt"), "audios")
        return models.generate(asked, load, batch).select(F.col("id").alias("sample"), F.when(F.col("status") == "success", F.col("answer")).alias("text"))

    return generate
