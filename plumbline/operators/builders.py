"""Building samples by running drawn chains of tools, with retries and replacements.

A task's draws are hashes of seed, task and attempt, so a sample is the same on any cluster and in any order. Steps run for all
tasks at once; every step's state is written, so plans stay short and a lost executor costs one step at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from .sampling import chain, draw, held_out_tail

CALLS = "array<struct<tool_name: string, parameters: map<string,string>, output: string>>"


def run_chains(items: DataFrame, run: Callable[[DataFrame], DataFrame], longest: int, folder: str) -> DataFrame:
    """items (key, audio, chain array<string>) with the chain's last audio, calls (CALLS) and failed.

    run gets a step's calls (key, step, tool, audio) and returns (key, output, parameters map<string,string>, status). A call
    without status success, or without a row in the answer, fails its item, which takes no further steps. Keys are distinct.
    """
    state = items.withColumns({"calls": F.array().cast(CALLS), "failed": F.lit(False)})
    for step in range(1, longest + 1):
        goes = ~F.col("failed") & (F.size("chain") >= step)
        got = run(state.where(goes).select("key", F.lit(step).alias("step"), F.get("chain", F.lit(step - 1)).alias("tool"), "audio"))
        joined = state.join(got.select("key", "output", "parameters", "status"), "key", "left")
        ok = goes & F.coalesce(F.col("status") == "success", F.lit(False))
        given = F.coalesce("parameters", F.create_map().cast("map<string,string>")).alias("parameters")
        call = F.struct(F.get("chain", F.lit(step - 1)).alias("tool_name"), given, "output")
        joined.select(
            *items.drop("audio").columns, F.when(ok, F.col("output")).otherwise(F.col("audio")).alias("audio"),
            F.when(ok, F.concat("calls", F.array(call))).otherwise(F.col("calls")).alias("calls"), (F.col("failed") | (goes & ~ok)).alias("failed"),
        ).write.mode("overwrite").parquet(f"{folder}/step_{step}")
        state = items.sparkSession.read.parquet(f"{folder}/step_{step}")
    return state


def _sample(seed: int) -> list[Column]:
    """A built task as a dataset row. Step k reads audio_k (the first audio_0) and writes audio_(k + 1); audio_1 is the target."""
    written = lambda k: F.concat(F.lit("audio_"), k + 1)
    read = lambda k: F.when(k == 1, "audio_0").otherwise(F.concat(F.lit("audio_"), k))
    own = lambda c: F.map_filter(c["parameters"], lambda name, _: ~name.isin("audio_path", "audio_id"))
    calls = F.transform("calls", lambda c, i: F.struct(c["tool_name"].alias("tool_name"), F.map_concat(own(c), F.create_map(F.lit("audio_id"), read(i + 1))).alias("parameters"), written(i + 1).alias("output_audio_id")))
    outputs = F.col("calls")["output"]
    ids = F.concat(F.array(F.lit("audio_0"), F.lit("audio_1")), F.transform("calls", lambda _, i: written(i + 1)))
    return [
        F.col("task"), F.concat(F.lit("sample_"), F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("task").cast("string"))), 1, 12)).alias("id"), F.col("source").alias("source_audio"), F.col("audio").alias("target_audio"),
        F.size("calls").alias("num_steps"), calls.alias("tool_calls"), outputs.alias("step_outputs"), F.map_from_arrays(ids, F.concat(F.array("source", "audio"), outputs)).alias("audio_id_map"),
    ]


def build(n: int, sources: DataFrame, tools: list[str], least: int, most: int, seed: int, attempts: int, run: Callable[[DataFrame], DataFrame], folder: str, rounds: int = 50) -> DataFrame:
    """n samples (task, id, source_audio, target_audio, num_steps, tool_calls, step_outputs, audio_id_map): chains of least to most
    tools from audios drawn out of sources (place from 0 without gaps, audio).

    A failed task draws another source and chain, up to `attempts` times; one that fails every time is replaced by the next
    free task number. Where tasks are still missing after `rounds` of replacements, or there are no sources, that is an error.
    Only counts reach the driver. `run` is as for run_chains and must give a call the same result whenever it runs.
    """
    spark, n_sources = sources.sparkSession, sources.count()
    if not n_sources or not tools or least < 1:
        raise ValueError("sources, tools and one step at least are needed")
    done, first, missing = [], 0, n
    for _ in range(rounds):
        if not missing:
            break
        left = spark.range(first, first + missing).select(F.col("id").alias("task"))
        first += missing
        for attempt in range(attempts):
            path = f"{folder}/to_{first}_attempt_{attempt}"
            drawn = left.withColumn("key", F.concat_ws("/", "task", F.lit(attempt))).withColumn("place", F.floor(draw(seed, "key", F.lit("source")) * n_sources))
            items = drawn.join(sources.select("place", "audio"), "place").select("task", "key", F.col("audio").alias("source"), "audio", chain("key", tools, least, most, seed).alias("chain"))
            state = run_chains(items, run, min(most, len(tools)), path)
            done.append(state.where("not failed"))
            left = state.where("failed").select("task")
            missing = left.count()
            if not missing:
                break
    if missing:
        raise RuntimeError(f"{missing} of {n} samples could not be built in {rounds} rounds")
    built = spark.createDataFrame([], f"task long, source string, audio string, calls {CALLS}") if not done else None
    for part in done:
        part = part.select("task", "source", "audio", "calls")
        built = part if built is None else built.unionByName(part)
    return built.select(*_sample(seed))


def benchmark(n: int, pool: DataFrame, order: str, share: float, tools: list[str], least: int, most: int, seed: int, attempts: int, run: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """n samples as build() makes them, from the last `share` of the pool (audio and a column to order by, without repeats): what was
    trained on the first part of it never meets its audios. The seed should be one that no training samples have."""
    held = global_rank(held_out_tail(pool.select(order, "audio"), order, share), [order], "place")
    return build(n, held.select((F.col("place") - 1).alias("place"), "audio"), tools, least, most, seed, attempts, run, folder)


def applied_pairs(items: DataFrame, tools: dict[str, float], least: int, most: int, seed: int, run: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Each item (id, audio; ids are distinct) beside the same audio with tools applied, drawn by weight: (id, original_audio,
    tool_chain array<struct<tool, parameters, output_path>>, tool_applied_audio, failed).

    A chain may be empty: then both audios are the same. A failed item keeps what was applied before its failure.
    """
    start = items.select(F.col("id").alias("key"), F.col("audio").alias("original_audio"), "audio").withColumn("chain", chain("key", tools, least, most, seed))
    calls = F.transform("calls", lambda c: F.struct(c["tool_name"].alias("tool"), F.map_filter(c["parameters"], lambda name, _: name != "audio_path").alias("parameters"), c["output"].alias("output_path")))
    done = run_chains(start, run, min(most, len(tools)), folder)
    return done.select(F.col("key").alias("id"), "original_audio", calls.alias("tool_chain"), F.col("audio").alias("tool_applied_audio"), "failed")
