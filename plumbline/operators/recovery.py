"""Disturb-and-recover samples: audios disturbed by drawn chains of operations, and the calls that undo them, last one first.

All items take a step at once through hooks that get a DataFrame of calls; every step's state is written, so plans stay short and
a lost executor costs one step at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .builders import run_chains
from .disturb import STRATEGIES, disturb, recover
from .sampling import chain

PARAMS = "struct<noise_type: string, snr_db: double, position: string, duration_sec: double, label: string, onset: double, rate: double, n_steps: int>"
DONE = f"array<struct<op: string, params: {PARAMS}, input_duration: double, output_duration: double, offset: double, audio: string>>"


def _attempt(left: DataFrame, attempt: int, least: int, most: int, seed: int, apply: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    ops = sorted(STRATEGIES)
    keyed = left.withColumn("key", F.concat_ws("/", F.col("id").cast("string"), F.lit(attempt)))
    state = keyed.select("id", "key", F.col("audio").alias("source"), F.col("duration").alias("source_duration"), "audio", F.col("duration").cast("double").alias("duration"), chain("key", ops, least, most, seed).alias("ops"), F.array().cast(DONE).alias("done"), F.lit(False).alias("failed"))
    for step in range(1, min(most, len(ops)) + 1):
        goes = ~F.col("failed") & (F.size("ops") >= step)
        now = state.where(goes).select("key", F.concat_ws("/", "key", F.lit(step)).alias("id"), F.get("ops", F.lit(step - 1)).alias("op"), "audio", "duration")
        calls = disturb(now, seed).select("key", F.lit(step).alias("step"), "op", F.col("params").cast(PARAMS).alias("params"), "audio", "duration")
        got = apply(calls).select("key", F.struct("output", F.col("duration").cast("double").alias("duration"), "onset", "offset", "status").alias("got"))
        both = state.join(calls.select("key", "op", "params"), "key", "left").join(got, "key", "left")
        got, ok = F.col("got"), goes & F.coalesce(F.col("got.status") == "success", F.lit(False))
        params = F.col("params").withField("onset", F.coalesce(got["onset"].cast("double"), F.col("params.onset")))
        made = F.struct("op", params.alias("params"), F.col("duration").alias("input_duration"), got["duration"].alias("output_duration"), got["offset"].cast("double").alias("offset"), got["output"].alias("audio"))
        both.select(
            "id", "key", "source", "source_duration", F.when(ok, got["output"]).otherwise(F.col("audio")).alias("audio"), F.when(ok, got["duration"]).otherwise(F.col("duration")).alias("duration"), "ops",
            F.when(ok, F.concat("done", F.array(made).cast(DONE))).otherwise(F.col("done")).alias("done"), (F.col("failed") | (goes & ~ok)).alias("failed"),
        ).write.mode("overwrite").parquet(f"{folder}/step_{step}")
        state = left.sparkSession.read.parquet(f"{folder}/step_{step}")
    return state


def disturbed(items: DataFrame, least: int, most: int, seed: int, attempts: int, apply: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """items (id, audio, duration; ids are distinct) after least to most distinct disturbances in a drawn order: (id, key, source, source_duration,
    audio, duration, ops, done, failed).

    apply gets a step's calls (key, step, op, params, audio, duration) and returns (key, output, duration, onset, offset, status); onset and
    offset, in seconds, are those of an inserted event. An item with a call without status success, or without a row, is drawn anew, `attempts`
    times in all; one that fails each time is given as failed. An item may draw no operation at all: its audio is then the source.
    Only counts reach the driver. apply must give a call the same result whenever it runs.
    """
    if attempts < 1 or not 0 <= least <= most:
        raise ValueError("an attempt at least, and 0 <= least <= most, are needed")
    left, parts = items.select("id", "audio", "duration"), []
    for attempt in range(attempts):
        state = _attempt(left, attempt, least, most, seed, apply, f"{folder}/attempt_{attempt}")
        parts.append(state.where("not failed"))
        failed = state.where("failed")
        left = failed.select("id", F.col("source").alias("audio"), F.col("source_duration").alias("duration"))
        if failed.isEmpty():
            break
    else:
        parts.append(failed)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def recovery_plan(done: DataFrame, seed: int) -> DataFrame:
    """(key, step, recovers_op, strategy, tool, parameters map<string,string>) of disturbed() items that didn't fail: the last
    disturbance is undone first, by a strategy that is drawn from those that apply."""
    each = done.where("not failed").select("key", F.size("done").alias("n"), F.posexplode("done").alias("at", "d"))
    ready = each.select("key", (F.col("n") - F.col("at")).alias("step"), F.concat_ws("/", "key", F.col("at") + 1).alias("id"), "d.op", "d.params", "d.input_duration", "d.output_duration", "d.offset")
    found = recover(ready, seed)
    return found.select("key", "step", F.col("op").alias("recovers_op"), "strategy", "tool", F.from_json(F.to_json("call"), "map<string,string>").alias("parameters"))


def build(items: DataFrame, least: int, most: int, seed: int, attempts: int, apply: Callable[[DataFrame], DataFrame], execute: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(id, source_audio, disturb_chain DONE, disturbed_audio, recovery_chain array<struct<recovers_op, strategy, tool, parameters>>, turn_results
    array<struct<turn, tool, parameters, output_path>>, recovered_audio, failed) of disturbed() items and their recovery.

    execute gets a turn's calls of all items (key, step, tool, audio, parameters) and returns (key, output, status). An item whose call fails
    keeps its last good audio, takes no further turns and is failed, as is one that could not be disturbed.
    """
    spark = items.sparkSession
    done = disturbed(items, least, most, seed, attempts, apply, f"{folder}/disturbed")
    recovery_plan(done, seed).write.mode("overwrite").parquet(f"{folder}/plan")
    plan = spark.read.parquet(f"{folder}/plan")
    steps = F.sort_array(F.collect_list(F.struct("step", "recovers_op", "strategy", "tool", "parameters_json")))
    whole = plan.withColumn("parameters_json", F.to_json("parameters")).groupBy("key").agg(steps.alias("steps"))

    def run(calls: DataFrame) -> DataFrame:
        ready = calls.join(plan.select("key", "step", "parameters"), ["key", "step"])
        return ready.select("key", "parameters").join(execute(ready).select("key", "output", "status"), "key")

    start = done.join(whole, "key", "left").select("key", "audio", F.coalesce(F.col("steps")["tool"], F.array().cast("array<string>")).alias("chain"))
    ended = run_chains(start, run, min(most, len(STRATEGIES)), f"{folder}/turns")
    ended = ended.select("key", F.col("audio").alias("recovered_audio"), "calls", F.col("failed").alias("stopped"))
    both = done.join(whole, "key", "left").join(ended, "key")
    read = lambda s: F.struct(s["recovers_op"].alias("recovers_op"), s["strategy"].alias("strategy"), s["tool"].alias("tool"), F.from_json(s["parameters_json"], "map<string,string>").alias("parameters"))
    none = F.array().cast("array<struct<recovers_op: string, strategy: string, tool: string, parameters: map<string,string>>>")
    turns = F.transform("calls", lambda c, i: F.struct((i + 1).alias("turn"), c["tool_name"].alias("tool"), c["parameters"].alias("parameters"), c["output"].alias("output_path")))
    return both.select(
        "id", F.col("source").alias("source_audio"), F.col("done").alias("disturb_chain"), F.col("audio").alias("disturbed_audio"), F.coalesce(F.transform("steps", read), none).alias("recovery_chain"),
        turns.alias("turn_results"), "recovered_audio", (F.col("failed") | F.col("stopped")).alias("failed"),
    )


def qa_entries(items: DataFrame, audio: Column) -> DataFrame:
    """items (id, question, choice, answer, question_type, _json_path) as a subset's entries: both path columns say where the new audio lies; what is
    missing has its default."""
    return items.select(
        F.coalesce("question", F.lit("")).alias("question"), F.coalesce("choice", F.array().cast("array<string>")).alias("choice"), F.coalesce("answer", F.lit("N/A")).alias("answer"), "id",
        audio.alias("audio_url"), "question_type", "_json_path", audio.alias("audio_path"),
    )
