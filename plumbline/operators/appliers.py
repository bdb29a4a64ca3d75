"""Tools applied by configuration: a call's parameters are drawn as columns from a JSON text that says how.

A configuration is read where the rows are, so it may be one text for all rows or a column of its own; nothing is joined and no row
moves. Draws are hashes of seed, key and the parameter's name.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import format_timestamp, let
from .sampling import draw

#: The tools that can be applied, by what their calls say besides the drawn parameters: a clip its begin and end, a segment the
#: whole audio's, others nothing.
CLIP_TOOLS = ["clipping"]
SEGMENT_TOOLS = ["trim_silence", "amplitude_normalize", "loudness_normalize", "remove_dc_offset", "spectral_normalize", "pre_emphasis"]
PLAIN_TOOLS = ["denoise", "pitch_shift", "time_stretch"]
HEAVY_TOOLS = ["remove_target", "extract_target", "human_voice_enhance", "super_resolution"]
APPLIED = CLIP_TOOLS + PLAIN_TOOLS + SEGMENT_TOOLS + HEAVY_TOOLS
#: The heavy tools that must be told where to write.
TOLD_WHERE_TO_WRITE = ["human_voice_enhance", "super_resolution"]
#: A clip keeps this share of its audio where the configuration draws none, and this many seconds at least.
CLIP_FRACTION, LEAST_CLIP = "clip_fraction", 0.5
CLIP_SHARES = (0.4, 0.9)

#: How the tools that need no configuration draw their parameters.
SYNTHETIC = {
    "tools": {
        "clipping": {"enabled": True, "params": {"clip_fraction": {"kind": "uniform", "min": 0.5, "max": 0.9}}},
        "denoise": {"enabled": True, "params": {
            "algorithm": {"kind": "choice", "values": ["spectral_subtraction", "wiener", "echo_cancellation", "adaptive"]},
            "noise_factor": {"kind": "uniform", "min": 1.0, "max": 3.0, "round": 2, "only_if": {"param": "algorithm", "values": ["spectral_subtraction"]}},
            "sensitivity": {"kind": "uniform", "min": 0.2, "max": 0.8, "round": 2, "only_if": {"param": "algorithm", "values": ["adaptive"]}},
        }},
        "pre_emphasis": {"enabled": True, "params": {"coef": {"kind": "choice", "values": [0.9, 0.95, 0.97, 0.99]}}},
        "trim_silence": {"enabled": True, "params": {"threshold_db": {"kind": "choice", "values": [25, 30, 35, 40, 45]}}},
        "pitch_shift": {"enabled": True, "params": {"n_steps": {"kind": "choice", "values": [-4, 4]}}},
        "time_stretch": {"enabled": True, "params": {"rate": {"kind": "choice", "values": [0.8, 1.2]}}},
    }
}

_SPEC = "struct<kind: string, values: array<string>, min: double, max: double, round: int, value: string, only_if: struct<param: string, values: array<string>>>"
CONFIG = f"struct<tools: map<string, struct<enabled: boolean, weight: double, env: string, params: map<string, {_SPEC}>>>>"


def tool_specs(config: Column, tool: Column) -> Column:
    """The tool's parameters in the configuration's order, array<struct<key, value>>; null where the configuration hasn't the tool."""
    found = F.try_element_at(F.from_json(config, CONFIG)["tools"], tool)
    return F.when(found.isNotNull(), F.coalesce(F.map_entries(found["params"]), F.array().cast(f"array<struct<key: string, value: {_SPEC}>>")))


def drawn(specs: Column, seed: int, key: Column) -> Column:
    """Drawn parameters (map<string,string>, in order) of tool_specs(). Kinds: choice, uniform (with round), randint (both ends included),
    fixed. One with only_if is left out unless the parameter that it names was drawn before it as one of the values. An unknown kind is an error."""
    none = F.create_map().cast("map<string,string>")

    def value(s: Column, u: Column) -> Column:
        between = s["min"] + (s["max"] - s["min"]) * u
        unit = F.pow(F.lit(10.0), s["round"])
        return (
            F.when(s["kind"] == "choice", F.get(s["values"], F.floor(u * F.size(s["values"])).cast("int")))
            .when(s["kind"] == "uniform", F.when(s["round"].isNull(), between).otherwise(F.round(between * unit) / unit).cast("string"))
            .when(s["kind"] == "randint", F.floor(s["min"] + u * (s["max"] - s["min"] + 1)).cast("long").cast("string"))
            .when(s["kind"] == "fixed", s["value"])
            .otherwise(F.raise_error(F.concat(F.lit("unknown kind of parameter: "), F.coalesce(s["kind"], F.lit("none")))))
        )

    def step(before: Column, e: Column) -> Column:
        rule = e["value"]["only_if"]
        applies = rule.isNull() | F.coalesce(F.array_contains(rule["values"], F.try_element_at(before, rule["param"])), F.lit(False))
        return F.when(applies, F.map_concat(before, let(draw(seed, key, e["key"]), lambda u: F.create_map(e["key"], value(e["value"], u))))).otherwise(before)

    return F.aggregate(specs, none, step)


def with_parameters(items: DataFrame, config: Column | str | dict, seed: int) -> DataFrame:
    """items (key, tool, audio, duration in seconds) with `parameters` (map<string,string>, texts) of a call of the tool on the audio; null
    where the configuration or this module hasn't the tool. config: a column, a JSON text, or what it says.

    A clip begins at 0 and keeps the drawn share of the duration, half a second at least where there is so much. Heavy tools get
    what was drawn; where they write isn't a parameter (see TOLD_WHERE_TO_WRITE).
    """
    if not isinstance(config, Column):
        config = F.lit(config if isinstance(config, str) else json.dumps(config))
    tool, length = F.col("tool"), F.col("duration").cast("double")
    known = F.when(tool.isin(*APPLIED), tool_specs(config, tool))
    rows = items.withColumn("__drawn", drawn(known, seed, F.col("key")))
    got = F.col("__drawn")
    low, high = CLIP_SHARES
    share = F.coalesce(F.try_element_at(got, F.lit(CLIP_FRACTION)).cast("double"), low + (high - low) * draw(seed, "key", F.lit(CLIP_FRACTION)))
    end = F.when(tool.isin(*CLIP_TOOLS), F.greatest(F.least(length, F.lit(LEAST_CLIP)), length * share)).when(tool.isin(*SEGMENT_TOOLS), length)
    bounds = F.when(end.isNotNull(), F.create_map(F.lit("audio_begin"), format_timestamp(F.lit(0.0)), F.lit("audio_end"), format_timestamp(end))).otherwise(F.create_map().cast("map<string,string>"))
    said = F.when(tool.isin(*CLIP_TOOLS), F.create_map().cast("map<string,string>")).otherwise(F.map_filter(got, lambda name, _: ~name.isin("audio_path", "audio_begin", "audio_end")))
    call = F.map_concat(F.create_map(F.lit("audio_path"), F.col("audio")), bounds, said)
    return rows.withColumn("parameters", F.when(got.isNotNull(), call)).drop("__drawn")


def weights(config: str | dict, exists: Callable[[str], bool]) -> dict[str, float]:
    """Tools that may be drawn, with their weights: enabled ones that this module can apply, without an environment or with one that exists."""
    tools = (json.loads(config) if isinstance(config, str) else config).get("tools", {})
    usable = {name: t for name, t in tools.items() if t.get("enabled") and name in APPLIED and (not t.get("env") or exists(t["env"]))}
    return {name: float(t.get("weight", 1.0)) for name, t in sorted(usable.items())}


def runner(config: str | dict, seed: int, measure: Callable[[DataFrame], DataFrame], execute: Callable[[DataFrame], DataFrame], folder: str) -> Callable[[DataFrame], DataFrame]:
    """A `run` for builders.run_chains that draws each call's parameters and has `execute` run them.

    measure adds `duration` in seconds to calls (key, step, tool, audio). execute gets (key, step, tool, audio, parameters,
    output_path) and returns (key, output, status). output_path is where the result is wanted; a heavy tool that chooses that itself has
    null. A tool without an applier, or that the configuration hasn't, has no row in the answer and so fails.
    """

    def run(calls: DataFrame) -> DataFrame:
        chooses = F.col("tool").isin(*[t for t in HEAVY_TOOLS if t not in TOLD_WHERE_TO_WRITE])
        wanted = F.when(~chooses, F.concat(F.lit(f"{folder}/"), "item", F.lit("/step_"), F.col("step").cast("string"), F.lit("_"), "tool", F.lit(".wav")))
        timed = measure(calls).withColumnRenamed("key", "item").withColumn("key", F.concat_ws("/", "item", "step"))
        ready = with_parameters(timed, config, seed).where("parameters is not null").select(F.col("item").alias("key"), "step", "tool", "audio", "parameters", wanted.alias("output_path"))
        return ready.select("key", "parameters").join(execute(ready).select("key", "output", "status"), "key")

    return run
