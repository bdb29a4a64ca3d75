"""Configured tools, and audios that are disturbed and recovered."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import appliers as A
from plumbline.operators import builders, recovery

CONFIG = {"tools": {
    "denoise": {"enabled": True, "weight": 2, "params": {"algorithm": {"kind": "choice", "values": ["a", "b"]}, "factor": {"kind": "uniform", "min": 1.0, "max": 3.0, "round": 2, "only_if": {"param": "algorithm", "values": ["a"]}}}},
    "pitch_shift": {"enabled": True, "params": {"n_steps": {"kind": "randint", "min": -2, "max": 2}}},
    "clipping": {"enabled": True, "params": {"clip_fraction": {"kind": "fixed", "value": 0.1}}},
    "super_resolution": {"enabled": True, "env": "/no/such", "params": {}},
    "asr": {"enabled": True, "params": {}},
    "trim_silence": {"enabled": False, "params": {}},
}}


def test_parameters(spark):
    tools = F.array(*map(F.lit, [*CONFIG["tools"], "absent"]))
    items = spark.range(700).select(F.col("id").alias("key"), F.get(tools, (F.col("id") % 7).cast("int")).alias("tool"), F.lit("x.wav").alias("audio"), F.when(F.col("id") < 350, 0.25).otherwise(20.0).alias("duration"))
    rows = A.with_parameters(items, CONFIG, 1).collect()
    by = lambda tool: [r for r in rows if r["tool"] == tool]
    assert all((r["parameters"] or {}).get("algorithm") in ("a", "b") and ("factor" in r["parameters"]) == (r["parameters"]["algorithm"] == "a") for r in by("denoise"))
    assert {r["parameters"].get("factor") is None for r in by("denoise")} == {True, False}
    assert {r["parameters"]["n_steps"] for r in by("pitch_shift")} == {"-2", "-1", "0", "1", "2"}
    assert {r["parameters"]["audio_end"] for r in by("clipping")} == {"00:00:00.249", "00:00:01.999"}  # half a second isn't there; a tenth
    assert by("super_resolution")[0]["parameters"] == {"audio_path": "x.wav"} and by("trim_silence")[0]["parameters"]["audio_end"] in ("00:00:00.249", "00:00:19.999")
    assert all(r["parameters"] is None for r in by("asr") + by("absent"))
    again = A.with_parameters(items.repartition(7), F.lit(json.dumps(CONFIG)), 1).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))  # draws don't depend on partitions, a column says the same as a text
    odd = {"tools": {"denoise": {"enabled": True, "params": {"x": {"kind": "odd"}}}}}
    with pytest.raises(PySparkException, match="unknown kind of parameter: odd"):
        A.with_parameters(items.where("tool = 'denoise'"), odd, 1).collect()
    assert A.with_parameters(items.limit(0), "no JSON", 1).count() == 0 and A.with_parameters(items.limit(3), "no JSON", 1).where("parameters is not null").count() == 0


def test_weights():
    assert A.weights(CONFIG, lambda env: False) == {"clipping": 1.0, "denoise": 2.0, "pitch_shift": 1.0}
    assert "super_resolution" in A.weights(json.dumps(CONFIG), lambda env: env == "/no/such") and A.weights({}, lambda env: True) == {}


def test_chains_of_configured_tools(spark, tmp_path):
    """Drawn parameters reach the tool; heavy tools that choose where they write aren't told; a tool without an applier fails."""
    config = {"tools": {t: {"enabled": True, "params": {}} for t in ("denoise", "remove_target", "super_resolution")}}
    measure = lambda calls: calls.withColumn("duration", F.lit(3.0))
    execute = lambda c: c.select("key", F.coalesce("output_path", F.concat("audio", F.lit("+"))).alias("output"), F.lit("success").alias("status"))
    items = spark.createDataFrame([("k", "a", ["denoise", "remove_target", "super_resolution"]), ("l", "b", ["denoise", "asr"])], "key string, audio string, chain array<string>")
    done = {r["key"]: r for r in builders.run_chains(items, A.runner(config, 1, measure, execute, "/out"), 3, str(tmp_path)).collect()}
    assert [c["output"] for c in done["k"]["calls"]] == ["/out/k/step_1_denoise.wav", "/out/k/step_1_denoise.wav+", "/out/k/step_3_super_resolution.wav"] and not done["k"]["failed"]
    assert done["k"]["calls"][1]["parameters"] == {"audio_path": "/out/k/step_1_denoise.wav"} and done["l"]["failed"] and len(done["l"]["calls"]) == 1


def test_disturbed_and_recovered(spark, tmp_path):
    """Item 3 fails once, item 4 always, item 5's recovery has no second answer."""
    seen = lambda c: F.split("key", "/")[c].cast("int")
    fails = (seen(0) == 4) | ((seen(0) == 3) & (seen(1) == 0))
    apply = lambda c: c.select("key", F.concat("audio", F.lit("-"), "op").alias("output"), "duration", F.lit(1.0).alias("onset"), F.lit(2.0).alias("offset"), F.when(fails, "failure").otherwise("success").alias("status"))
    execute = lambda c: c.where((seen(0) != 5) | (F.col("step") < 2)).select("key", F.concat("audio", F.lit("+"), "tool").alias("output"), F.lit("success").alias("status"))
    items = spark.createDataFrame([(i, f"s{i}", 10.0) for i in range(8)], "id int, audio string, duration double")
    rows = {r["id"]: r for r in recovery.build(items, 2, 4, 7, 2, apply, execute, str(tmp_path / "a")).collect()}
    assert sorted(rows) == list(range(8)) and [i for i, r in rows.items() if r["failed"]] in ([4, 5], [5, 4])
    for i, r in rows.items():
        ops = [c["op"] for c in r["disturb_chain"]]
        assert len(set(ops)) == len(ops) and r["disturbed_audio"] == "-".join([f"s{i}", *ops])
        if i == 4:
            assert not ops and r["recovery_chain"] == [] and r["recovered_audio"] == "s4"
            continue
        assert 2 <= len(ops) <= 4 and [c["recovers_op"] for c in r["recovery_chain"]] == ops[::-1]
        tools = [c["tool"] for c in r["recovery_chain"]][: 1 if i == 5 else None]
        assert r["recovered_audio"] == "+".join([r["disturbed_audio"], *tools]) and [t["turn"] for t in r["turn_results"]] == list(range(1, len(tools) + 1))
        assert [t["parameters"] for t in r["turn_results"]] == [c["parameters"] for c in r["recovery_chain"]][: len(tools)]
    none = recovery.build(items, 0, 0, 7, 1, apply, execute, str(tmp_path / "b")).collect()
    assert len(none) == 8 and all(r["recovered_audio"] == r["source_audio"] == r["disturbed_audio"] and not r["failed"] for r in none)
    assert recovery.build(items.limit(0), 1, 2, 7, 1, apply, execute, str(tmp_path / "c")).count() == 0
    with pytest.raises(ValueError):
        recovery.disturbed(items, 2, 1, 7, 1, apply, str(tmp_path / "d"))


def test_entries(spark):
    row = spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS question, CAST(NULL AS ARRAY<STRING>) AS choice, CAST(NULL AS STRING) AS answer, 'x' AS question_type, 'p' AS _json_path, 'new.wav' AS made")
    got = recovery.qa_entries(row, F.col("made")).first().asDict()
    assert got == {"question": "", "choice": [], "answer": "N/A", "id": 1, "audio_url": "new.wav", "question_type": "x", "_json_path": "p", "audio_path": "new.wav"}
