"""Disturb-and-recover plans as columns: parameters of disturbances, and the calls that undo them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import format_timestamp
from .sampling import choice, draw, uniform

#: The labels of inserted events and the separation targets that undo them.
EVENT_TARGETS = {
    "Dog": "background sound", "Bird": "background sound", "Wind": "noise", "Rain": "noise",
    "Siren": "background sound", "Traffic noise": "noise", "Cat": "background sound", "Vehicle": "background sound",
}
DEFAULT_TARGET = "background sound"
#: Speeds, pitch steps and silence thresholds that are drawn from.
RATES, PITCH_STEPS, THRESHOLDS = [0.8, 0.9, 1.1, 1.25], [-5, -3, 3, 5], [20.0, 25.0, 30.0, 35.0]
#: An edge clip must keep this share of the audio.
KEPT_SHARE = 0.6
#: Each disturbance's recovery strategies and their tools.
STRATEGIES = {
    "add_noise": [("denoise_spectral_subtraction", "denoise"), ("denoise_wiener", "denoise"), ("denoise_adaptive", "denoise")],
    "pad_noise": [("clip_off_padding", "clipping"), ("trim_silence_heuristic", "trim_silence")],
    "insert_background_event": [("remove_target_by_label", "remove_target"), ("edge_clip", "clipping")],
    "change_speed": [("inverse_time_stretch", "time_stretch")],
    "change_pitch": [("inverse_pitch_shift", "pitch_shift")],
}


def target_of(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EVENT_TARGETS.items() for x in kv])
    return F.coalesce(table[label], F.lit(DEFAULT_TARGET))


def disturb(items: DataFrame, seed: int) -> DataFrame:
    """items (id, op, duration) with a struct `params` of all that a disturbance can have, null where its op hasn't it."""
    op, of = F.col("op"), lambda *names: F.col("op").isin(*names)
    salt = lambda name: ("id", F.lit(name))
    onset = uniform(seed, 0.0, F.greatest(F.lit(0.0), F.col("duration") - 0.2), *salt("timestamp"), digits=2)
    snr = (
        F.when(of("add_noise"), uniform(seed, 3.0, 15.0, *salt("snr"), digits=1))
        .when(of("pad_noise"), uniform(seed, 10.0, 25.0, *salt("snr"), digits=1))
        .when(of("insert_background_event"), uniform(seed, 0.0, 8.0, *salt("snr"), digits=1))
    )
    params = F.struct(
        F.when(of("add_noise", "pad_noise"), choice(seed, ["white", "pink"], *salt("noise_type"))).alias("noise_type"), snr.alias("snr_db"),
        F.when(of("pad_noise"), choice(seed, ["start", "end", "both"], *salt("position"))).alias("position"),
        F.when(of("pad_noise"), uniform(seed, 0.5, 2.0, *salt("duration"), digits=2)).alias("duration_sec"),
        F.when(of("insert_background_event"), choice(seed, list(EVENT_TARGETS), *salt("label"))).alias("label"),
        F.when(of("insert_background_event"), onset).alias("onset"),
        F.when(op == "change_speed", choice(seed, RATES, *salt("rate"))).alias("rate"),
        F.when(op == "change_pitch", choice(seed, PITCH_STEPS, *salt("n_steps"))).alias("n_steps"),
    )
    return items.withColumn("params", params)


def edge(onset: Column, offset: Column, duration: Column) -> tuple[Column, Column, Column]:
    """(begin, end, kept seconds) of the longer side of an event."""
    before = onset >= duration - offset
    return F.when(before, 0.0).otherwise(offset), F.when(before, onset).otherwise(duration), F.greatest(onset, duration - offset)


def recover(disturbed: DataFrame, seed: int) -> DataFrame:
    """disturbed (id, op, params, input_duration, output_duration, offset) with strategy, tool and recovery parameters. A
    strategy is drawn from those that apply: an edge clip only if it keeps KEPT_SHARE of the audio."""
    p, out = F.col("params"), F.col("output_duration")
    begin, end, kept = edge(p["onset"], F.col("offset"), out)
    applies = (out > 0) & (kept >= KEPT_SHARE * out)
    options = F.create_map(*[x for op, s in STRATEGIES.items() for x in (F.lit(op), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("tool")) for n, t in s]))])[F.col("op")]
    usable = F.filter(options, lambda s: (s["name"] != "edge_clip") | F.coalesce(applies, F.lit(False)))
    picked = disturbed.withColumn("pick", F.get(usable, F.floor(draw(seed, "id", F.lit("strategy")) * F.size(usable)).cast("int")))
    name = F.col("pick.name")
    pad = F.when(p["position"].isin("start", "both"), p["duration_sec"]).otherwise(0.0)
    clip, trim = name == "clip_off_padding", name == "trim_silence_heuristic"
    first = F.when(clip, pad).when(trim, 0.0).when(name == "edge_clip", begin)
    last = F.when(clip, pad + F.col("input_duration")).when(trim, out).when(name == "edge_clip", end)
    call = F.struct(
        F.when(name.startswith("denoise_"), F.substring_index(name, "denoise_", -1)).alias("algorithm"),
        F.when(name == "denoise_spectral_subtraction", uniform(seed, 1.5, 2.5, "id", F.lit("factor"), digits=2)).alias("noise_factor"),
        F.when(name == "denoise_adaptive", uniform(seed, 0.3, 0.7, "id", F.lit("sensitivity"), digits=2)).alias("sensitivity"),
        format_timestamp(first).alias("audio_begin"), format_timestamp(last).alias("audio_end"), F.when(trim, choice(seed, THRESHOLDS, "id", F.lit("threshold"))).alias("threshold_db"),
        F.when(name == "remove_target_by_label", target_of(p["label"])).alias("target_description"),
        F.when(name == "inverse_time_stretch", F.round(1.0 / p["rate"], 6)).alias("rate"), F.when(name == "inverse_pitch_shift", -p["n_steps"]).alias("n_steps"),
    )
    return picked.select(*disturbed.columns, name.alias("strategy"), F.col("pick.tool").alias("tool"), call.alias("call"))


def describe() -> list[str]:
    """One line for each disturbance and strategy."""
    return [line for op in sorted(STRATEGIES) for line in (op, *(f"  -> {tool} [{name}]" for name, tool in STRATEGIES[op]))]
