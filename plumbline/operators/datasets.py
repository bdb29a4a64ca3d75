"""Training and benchmark rows from chains: prompts, multi-turn messages, single-turn solutions, recovery turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import replace_first
from .prompts import DONE_MESSAGE, audio_tag, call_message, quoted, result_message
from .schedules import SEGMENT_PARAMETERS, WHOLE_PARAMETERS

#: Fixed value: what stands for an audio in training rows.
TRAINING_TOKEN = "<audio>"


def call_text(tool: Column, params: Column) -> Column:
    return F.to_json(F.struct(tool.alias("tool_name"), params.alias("parameters")))


def single_turn_rows(chains: DataFrame, tools_block: str) -> DataFrame:
    """RL rows (id, messages, audios, solution) from chains (id, question, audio, calls array<struct<tool, params>>); the
    block of tools must not be empty."""
    if not tools_block:
        raise ValueError("the tools' description is required")
    user = F.concat(F.lit(tools_block + "\n"), "question")
    solution = F.to_json(F.struct(F.transform("calls", lambda c: F.struct(c["tool"].alias("tool_name"), c["params"].alias("parameters"))).alias("tool_calls")))
    return chains.select("id", F.array(F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"), F.array("audio").alias("audios"), solution.alias("solution"))


def parameters_text(params: Column) -> Column:
    """A call's parameters (map<string,string>) as the JSON that a model says: numbers and truth values are bare where the tools' parameters have such types."""
    bare = sorted({name for _, name, kind, _, _ in SEGMENT_PARAMETERS + WHOLE_PARAMETERS if kind in ("number", "integer", "boolean")})
    plain = lambda e: e["key"].isin(*bare) & e["value"].rlike(r"^(-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?|true|false)$")
    said = F.transform(F.map_entries(params), lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.when(e["value"].isNull(), "null").when(plain(e), e["value"]).otherwise(quoted(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(said, ", "), F.lit("}"))


def multi_turn_rows(samples: DataFrame, system: Column, token: str = TRAINING_TOKEN) -> DataFrame:
    """Training rows (id, messages array<struct<role, content>>, audios) from samples as builders.build() makes them, with a question.

    The first mention of either path in the question becomes a tag, the source's first. Each call is an assistant's turn, its
    output a tool's, and the end one of its own. audios has one path for each tag, in the order source, target, outputs.
    """
    tag = lambda name: audio_tag(F.lit(name), token)
    asked = replace_first(replace_first(F.col("question"), F.col("source_audio"), tag("audio_0")), F.col("target_audio"), tag("audio_1"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = F.flatten(F.transform("tool_calls", lambda c, i: F.array(
        message("assistant", call_message(c["tool_name"], parameters_text(c["parameters"]), c["output_audio_id"])),
        message("tool", result_message(i + 1, c["tool_name"], F.array(audio_tag(c["output_audio_id"], token)), F.lit(None).cast("string"))),
    )))
    messages = F.concat(F.array(message("system", system), message("user", asked)), turns, F.array(message("assistant", F.lit(DONE_MESSAGE))))
    path = lambda name: F.element_at("audio_id_map", name)
    audios = F.concat(F.array(path("audio_0"), path("audio_1")), F.transform("tool_calls", lambda c: F.element_at("audio_id_map", c["output_audio_id"])))
    return samples.select("id", messages.alias("messages"), audios.alias("audios"))


def one_tool_schedule(items: DataFrame, tool: str) -> DataFrame:
    """Every item with one call of one tool over its whole audio."""
    call = F.struct(F.lit(tool).alias("tool"), F.struct(F.col("audio_path"), F.lit("00:00:00.000").alias("audio_begin")).alias("parameters"))
    return items.withColumn("calls", F.array(call))


def run_turns(plan: DataFrame, items: DataFrame, run: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(id, audio, failed, turns_done) after running a plan (id, turn, tool, params) turn by turn on items (id, audio).

    run gets a turn's calls (id, tool, params, audio) and returns (id, output, status). A failed item keeps its last good
    audio and takes no further turns. Every turn's state is written to `folder`, so each turn's plan is short and a lost
    executor costs one turn at most.
    """
    spark: SparkSession = plan.sparkSession
    state = items.select("id", "audio", F.lit(False).alias("failed"), F.lit(0).alias("turns_done"))
    for turn in range(1, (plan.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0]) + 1):
        calls = plan.where(F.col("turn") == turn).join(state.where("not failed").select("id", "audio"), "id")
        got = run(calls.select("id", "tool", "params", "audio")).select("id", "output", "status")
        joined = state.join(got, "id", "left")
        ok = F.col("status") == "success"
        state = joined.select(
            "id", F.when(ok, F.col("output")).otherwise(F.col("audio")).alias("audio"), (F.col("failed") | F.coalesce(~ok, F.lit(False))).alias("failed"), (F.col("turns_done") + F.coalesce(ok.cast("int"), F.lit(0))).alias("turns_done")
        )
        state.write.mode("overwrite").parquet(f"{folder}/turn_{turn}")
        state = spark.read.parquet(f"{folder}/turn_{turn}")
    return state
