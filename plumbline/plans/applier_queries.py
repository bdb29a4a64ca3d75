"""Queries on tools applied by configuration, and on disturbed and recovered audios, each beside its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import appliers as A
from ..operators import recovery as Y
from ..sources import records as R
from . import views as V
from .data_queries import _U

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


#: All appliers, each kind of parameter, a rule that never holds, one without parameters, and one whose clip draws no share.
_CONFIG = {
    "tools": {
        "clipping": {"enabled": True, "params": {}},
        "denoise": {"enabled": True, "params": {
            "algorithm": {"kind": "choice", "values": ["spectral_subtraction", "wiener", "echo_cancellation", "adaptive"]},
            "noise_factor": {"kind": "uniform", "min": 1.0, "max": 3.0, "round": 2, "only_if": {"param": "algorithm", "values": ["spectral_subtraction"]}},
            "sensitivity": {"kind": "uniform", "min": 0.2, "max": 0.8, "round": 2, "only_if": {"param": "algorithm", "values": ["adaptive"]}},
        }},
        "pitch_shift": {"enabled": True, "params": {"n_steps": {"kind": "randint", "min": -6, "max": 6}}},
        "time_stretch": {"enabled": True, "params": {"rate": {"kind": "choice", "values": [0.7, 0.8, 0.9, 1.1, 1.25, 1.5]}}},
        "trim_silence": {"enabled": True, "params": {"threshold_db": {"kind": "choice", "values": [20, 25, 30, 35, 40, 45]}}},
        "amplitude_normalize": {"enabled": True, "params": {"target_level": {"kind": "uniform", "min": 0.6, "max": 0.95, "round": 2}, "method": {"kind": "choice", "values": ["peak", "rms"]}}},
        "loudness_normalize": {"enabled": True, "params": {"target_lufs": {"kind": "choice", "values": [-23.0, -20.0, -18.0, -16.0, -14.0]}}},
        "remove_dc_offset": {"enabled": True, "params": {}},
        "spectral_normalize": {"enabled": True, "params": {"strength": {"kind": "uniform", "min": 0.3, "max": 0.8, "round": 2}}},
        "pre_emphasis": {"enabled": True, "params": {"coef": {"kind": "choice", "values": [0.9, 0.95, 0.97, 0.99]}, "late": {"kind": "fixed", "value": 1, "only_if": {"param": "nothing", "values": ["x"]}}}},
        "remove_target": {"enabled": True, "params": {"target_description": {"kind": "choice", "values": ["vocals", "background sound", "background music", "noise"]}}},
        "extract_target": {"enabled": True, "params": {"target_description": {"kind": "choice", "values": ["vocals", "background sound", "background music", "noise"]}}},
        "human_voice_enhance": {"enabled": True, "params": {}},
        "super_resolution": {"enabled": True, "params": {"model_name": {"kind": "choice", "values": ["basic", "speech"]}, "ddim_steps": {"kind": "fixed", "value": 50}}},
    }
}


def _value_sql(name: str, spec: dict, seed: int) -> str:
    u = _U.format(text=f"'{seed}:' || id || ':{name}'")
    if spec["kind"] == "fixed":
        return f"'{spec['value']}'"
    if spec["kind"] == "choice":
        return f"{[str(v) for v in spec['values']]}[floor({u} * {len(spec['values'])})::INT + 1]"
    if spec["kind"] == "randint":
        return f"floor({spec['min']} + {u} * {spec['max'] - spec['min'] + 1})::BIGINT::VARCHAR"
    between = f"({spec['min']}::DOUBLE + ({spec['max']}::DOUBLE - {spec['min']}::DOUBLE) * {u})"
    return f"(round({between} * 100) / 100)::VARCHAR" if "round" in spec else f"{between}::VARCHAR"


def _tool_sql(tool: str, params: dict, seed: int, shares: tuple[float, float]) -> str:
    """A tool's call as text, over (id, duration)."""
    stamp = lambda x: f"(SELECT printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) FROM (SELECT greatest(0, floor((greatest(0.0, {x}) - 1e-6) * 1000))::BIGINT AS ms))"
    clip = f"greatest(least(duration, 0.5), duration * ({shares[0]}::DOUBLE + ({shares[1]}::DOUBLE - {shares[0]}::DOUBLE) * {_U.format(text=f"'{seed}:' || id || ':clip_fraction'")}))"
    end = {"clipping": clip}.get(tool, "duration" if tool in A.SEGMENT_TOOLS else None)
    parts = ["'audio_path=part_' || id"] + ([f"'audio_begin=00:00:00.000,audio_end=' || {stamp(end)}"] if end else [])
    for name, spec in params.items():
        value, rule = _value_sql(name, spec, seed), spec.get("only_if")
        if rule:
            holds = f"{_value_sql(rule['param'], params[rule['param']], seed)} IN ({str(rule['values'])[1:-1]})" if rule["param"] in params else "false"
            value = f"CASE WHEN {holds} THEN {value} END"
        parts += [] if name == "clip_fraction" else [f"'{name}=' || {value}"]
    return f"concat_ws(',', {', '.join(parts)})"


def _calls_sql(config: dict, tools: list[str], seed: int, shares: tuple[float, float]) -> str:
    of = " ".join(f"WHEN '{t}' THEN {_tool_sql(t, config['tools'][t]['params'], seed, shares)}" for t in tools if t in config["tools"])
    return f"SELECT id, tool, CASE tool {of} END AS call FROM (SELECT p_partkey AS id, {tools}[p_partkey % {len(tools)} + 1] AS tool, CASE WHEN p_partkey % 9 = 0 THEN 0.3 ELSE p_size + 0.25 END::DOUBLE AS duration FROM part)"


def _calls(spark, d, config, tools: list[str], seed: int):
    i = F.col("p_partkey")
    items = V.table(spark, d, "part").select(i.alias("key"), F.get(F.array(*map(F.lit, tools)), (i % len(tools)).cast("int")).alias("tool"), F.concat(F.lit("part_"), i).alias("audio"), F.when(i % 9 == 0, 0.3).otherwise(F.col("p_size") + 0.25).alias("duration"))
    flat = F.array_join(F.transform(F.map_entries("parameters"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return A.with_parameters(items, config, seed).select(F.col("key").alias("id"), "tool", flat.alias("call"))


@query(_calls_sql(_CONFIG, [*A.APPLIED, "no_such_tool"], 17, A.CLIP_SHARES))
def configured_appliers(spark, d):
    """Calls of all tools that a configuration can apply, with drawn parameters; audios under half a second; an unknown tool has no call."""
    return _calls(spark, d, json.dumps(_CONFIG), [*A.APPLIED, "no_such_tool"], 17)


@query(_calls_sql(A.SYNTHETIC, list(A.SYNTHETIC["tools"]) + ["asr"], 18, (0.5, 0.9)))
def synthetic_appliers(spark, d):
    """Calls of the tools that need no configuration; one that isn't applied has no call."""
    return _calls(spark, d, A.SYNTHETIC, list(A.SYNTHETIC["tools"]) + ["asr"], 18)


# Disturbed and recovered audios -----------------------------------------------------------------------------------------------


def _disturb_run(calls):
    """A stand-in for the disturbances; what begins with f fails."""
    p, out = F.col("params"), F.md5(F.concat_ws(":", "op", "audio"))
    length = F.when(F.col("op") == "pad_noise", F.col("duration") + p["duration_sec"]).when(F.col("op") == "change_speed", F.col("duration") / p["rate"]).otherwise(F.col("duration"))
    return calls.select("key", out.alias("output"), F.round(length, 4).alias("duration"), p["onset"].alias("onset"), F.least("duration", p["onset"] + 1.5).alias("offset"), F.when(out.startswith("f"), "failure").otherwise("success").alias("status"))


def _recover_run(calls):
    out = F.md5(F.concat_ws(":", "tool", "audio"))
    return calls.select("key", out.alias("output"), F.when(out.startswith("f"), "failure").otherwise("success").alias("status"))


_STAMP = "(SELECT printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) FROM (SELECT greatest(0, floor((greatest(0.0, {x}) - 1e-6) * 1000))::BIGINT AS ms WHERE {x} IS NOT NULL))"


def _step_sql(source: str, n: int) -> str:
    """source with what step n draws and makes: its operation, parameters, audio a{n}, duration d{n}, and the call that undoes it."""
    u = lambda name: _U.format(text=f"'21:' || key || '/{n}:{name}'")
    pick = lambda name, values: f"{values}[floor({u(name)} * {len(values)})::INT + 1]"
    d, strategy = f"d{n - 1}", f"s{n}"
    targets = ["background sound", "background sound", "noise", "noise", "background sound", "noise", "background sound", "background sound"]
    drawn = f"""SELECT *, CASE WHEN k >= {n} THEN ops[{n}] END AS op{n}, {pick("rate", [0.8, 0.9, 1.1, 1.25])} AS rate, {pick("n_steps", [-5, -3, 3, 5])} AS steps, {pick("position", ["start", "end", "both"])} AS place, round(0.5 + (2.0 - 0.5) * {u("duration")}, 2) AS pad,
      round(greatest(0.0, {d} - 0.2) * {u("timestamp")}, 2) AS onset, {pick("label", targets)} AS target, {u("strategy")} AS su FROM ({source})"""
    snr = f"CASE op{n} WHEN 'add_noise' THEN round(3.0 + (15.0 - 3.0) * {u('snr')}, 1) WHEN 'pad_noise' THEN round(10.0 + (25.0 - 10.0) * {u('snr')}, 1) WHEN 'insert_background_event' THEN round((8.0 - 0.0) * {u('snr')}, 1) END"
    made = f"""SELECT *, least({d}, onset + 1.5) AS off, CASE WHEN op{n} IS NOT NULL THEN md5(op{n} || ':' || a{n - 1}) END AS a{n}, round(CASE op{n} WHEN 'pad_noise' THEN {d} + pad WHEN 'change_speed' THEN {d} / rate ELSE {d} END::DOUBLE, 4) AS d{n},
      concat_ws('/', {snr}::DOUBLE::VARCHAR, CASE WHEN op{n} = 'pad_noise' THEN place || '/' || pad::DOUBLE::VARCHAR END) AS p{n} FROM ({drawn})"""
    options = f"""CASE op{n} WHEN 'add_noise' THEN ['denoise_spectral_subtraction', 'denoise_wiener', 'denoise_adaptive'] WHEN 'pad_noise' THEN ['clip_off_padding', 'trim_silence_heuristic'] WHEN 'change_speed' THEN ['inverse_time_stretch'] WHEN 'change_pitch' THEN ['inverse_pitch_shift']
      ELSE CASE WHEN d{n} > 0 AND greatest(onset, d{n} - off) >= 0.6 * d{n} THEN ['remove_target_by_label', 'edge_clip'] ELSE ['remove_target_by_label'] END END"""
    chosen = f"SELECT *, CASE WHEN op{n} IS NOT NULL THEN o[floor(su * len(o))::INT + 1] END AS {strategy}, CASE WHEN place = 'end' THEN 0.0 ELSE pad END AS skip, onset >= d{n} - off AS before_ FROM (SELECT *, {options} AS o FROM ({made}))"
    begin = f"CASE {strategy} WHEN 'clip_off_padding' THEN skip WHEN 'trim_silence_heuristic' THEN 0.0 WHEN 'edge_clip' THEN CASE WHEN before_ THEN 0.0 ELSE off END END::DOUBLE"
    end = f"CASE {strategy} WHEN 'clip_off_padding' THEN skip + {d} WHEN 'trim_silence_heuristic' THEN d{n} WHEN 'edge_clip' THEN CASE WHEN before_ THEN onset ELSE d{n} END END::DOUBLE"
    call = f"""concat_ws(',', CASE WHEN {strategy} LIKE 'denoise%' THEN 'algorithm=' || substr({strategy}, 9) END, CASE {strategy} WHEN 'denoise_spectral_subtraction' THEN 'noise_factor=' || round(1.5 + (2.5 - 1.5) * {u("factor")}, 2)::DOUBLE WHEN 'denoise_adaptive' THEN 'sensitivity=' || round(0.3::DOUBLE + (0.7::DOUBLE - 0.3::DOUBLE) * {u("sensitivity")}, 2) END,
      'audio_begin=' || {_STAMP.format(x="b")}, 'audio_end=' || {_STAMP.format(x="e")}, CASE {strategy} WHEN 'trim_silence_heuristic' THEN 'threshold_db=' || {pick("threshold", [20.0, 25.0, 30.0, 35.0])}::DOUBLE WHEN 'remove_target_by_label' THEN 'target_description=' || target WHEN 'inverse_time_stretch' THEN 'rate=' || round(1.0 / rate::DOUBLE, 6) WHEN 'inverse_pitch_shift' THEN 'n_steps=' || (-steps) END)"""
    tool = f"CASE WHEN {strategy} LIKE 'denoise%' THEN 'denoise' ELSE CASE {strategy} WHEN 'clip_off_padding' THEN 'clipping' WHEN 'edge_clip' THEN 'clipping' WHEN 'trim_silence_heuristic' THEN 'trim_silence' WHEN 'remove_target_by_label' THEN 'remove_target' WHEN 'inverse_time_stretch' THEN 'time_stretch' WHEN 'inverse_pitch_shift' THEN 'pitch_shift' END END"
    return f"SELECT * EXCLUDE (rate, steps, place, pad, onset, target, su, off, o, skip, before_, b, e), {call} AS c{n}, {tool} AS t{n} FROM (SELECT *, {begin} AS b, {end} AS e FROM ({chosen}))"


_DISTURBANCES = ["add_noise", "change_pitch", "change_speed", "insert_background_event", "pad_noise"]
_DRAWN_OPS = f"""SELECT *, floor({_U.format(text="'21:' || key || ':length'")} * 3)::INT AS k, list_sort([md5('21:' || key || ':' || x) || x for x in {_DISTURBANCES}]).list_transform(lambda y: substr(y, 33)) AS ops
  FROM (SELECT id, attempt, a0, d0, id || '/' || attempt AS key FROM (SELECT p_partkey AS id, 'part_' || p_partkey AS a0, (p_size + 1.0)::DOUBLE AS d0 FROM part), range(2) AS r(attempt))"""


@query(f"""WITH x AS ({_step_sql(_step_sql(_DRAWN_OPS, 1), 2)}), ok AS (SELECT *, coalesce(starts_with(a1, 'f'), false) AS f1, coalesce(starts_with(a2, 'f'), false) AS f2 FROM x),
kept AS (SELECT *, NOT f1 AND NOT f2 AS good FROM ok QUALIFY row_number() OVER (PARTITION BY id ORDER BY (NOT f1 AND NOT f2) DESC, CASE WHEN NOT f1 AND NOT f2 THEN attempt ELSE -attempt END) = 1),
n AS (SELECT *, CASE WHEN f1 THEN 0 WHEN f2 THEN 1 ELSE k END AS m FROM kept), aud AS (SELECT *, CASE m WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END AS da FROM n),
one AS (SELECT *, CASE WHEN good AND k > 0 THEN md5(CASE k WHEN 1 THEN t1 ELSE t2 END || ':' || da) END AS r1 FROM aud), two AS (SELECT *, CASE WHEN k = 2 AND NOT starts_with(r1, 'f') THEN md5(t1 || ':' || r1) END AS r2 FROM one),
g AS (SELECT *, CASE WHEN NOT starts_with(r1, 'f') THEN r1 END AS g1, CASE WHEN NOT starts_with(r2, 'f') THEN r2 END AS g2 FROM two)
SELECT id, a0 AS source_audio, concat_ws(';', CASE WHEN m > 0 THEN op1 || ':' || p1 || ':' || d0 || ':' || d1 END, CASE WHEN m > 1 THEN op2 || ':' || p2 || ':' || d1 || ':' || d2 END) AS disturbances, da AS disturbed_audio,
  CASE WHEN good THEN concat_ws(';', CASE WHEN k = 2 THEN op2 || ':' || s2 || ':' || t2 || ':' || c2 END, CASE WHEN k > 0 THEN op1 || ':' || s1 || ':' || t1 || ':' || c1 END) ELSE '' END AS recovery, concat_ws(',', g1, g2) AS outputs, coalesce(g2, g1, da) AS recovered_audio,
  NOT good OR coalesce(starts_with(coalesce(r2, r1), 'f'), false) AS failed FROM g""")
def disturbed_samples(spark, d):
    """Every part's audio disturbed by up to two operations, drawn anew once where one fails, and recovered turn by turn."""
    items = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("part_"), "p_partkey").alias("audio"), (F.col("p_size") + 1.0).alias("duration"))
    built = Y.build(items, 0, 2, 21, 2, _disturb_run, _recover_run, R.scratch_folder(spark, "disturbed"))
    text = lambda x: x.cast("string")
    drawn = lambda p: F.concat_ws("/", text(p["snr_db"]), p["position"], text(p["duration_sec"]))
    did = F.transform("disturb_chain", lambda c: F.concat_ws(":", c["op"], drawn(c["params"]), text(c["input_duration"]), text(c["output_duration"])))
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    undone = F.transform("recovery_chain", lambda c: F.concat_ws(":", c["recovers_op"], c["strategy"], c["tool"], flat(c["parameters"])))
    return built.select("id", "source_audio", F.array_join(did, ";").alias("disturbances"), "disturbed_audio", F.array_join(undone, ";").alias("recovery"), F.array_join(F.col("turn_results")["output_path"], ",").alias("outputs"), "recovered_audio", "failed")
