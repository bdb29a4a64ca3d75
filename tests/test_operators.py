"""Operators without SQL, and edge cases by hand."""

import io
import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import json_parse as J
from plumbline.functions import vectors as X
from plumbline.functions.ranks import global_rank
from plumbline.operators import chains as C
from plumbline.operators import builders, datasets, disturb, models, prompts, sampling, schedules
from plumbline.operators import predictions as P
from plumbline.operators import uncertainty as U
from plumbline.sources import records, wav
from plumbline.sources import results as results_sink
from plumbline.streaming import resume


def preds(spark, rows):
    return spark.createDataFrame(rows, "id int, idx int, correct boolean, p_true double")


def test_merge_rules(spark):
    a = preds(spark, [(1, 1, True, 0.5), (2, 2, True, None), (3, 3, True, None), (4, None, None, 0.5), (5, 5, True, 0.5)])
    b = preds(spark, [(1, 9, False, 0.6), (2, 9, False, 0.1), (3, 9, False, None), (4, 9, True, 0.61), (6, 6, None, 0.2)])
    got = {r["id"]: (r["kept_from"], r["reason"], r["correct"]) for r in P.merge(a, b).collect()}
    assert got == {1: ("file1", "cmp decision", True), 2: ("file2", "cmp decision", False), 3: ("file1", "cmp decision", True), 4: ("file2", "cmp decision", True), 5: ("file1", "only in file1", True), 6: ("file2", "only in file2", False)}
    same = P.merge(a, a).where("kept_from = 'file2'").count()
    assert same == 0
    assert preds(spark, []).agg(P.accuracy(F.col("correct"))).first()[0] == 0.0


def test_rewards_by_hand(spark):
    """Exact 1; one parameter of four off 0.825; a missing step with one of two parameters 0.325; malformed has no calls."""
    v = lambda d: json.dumps(d)
    truth = [("a", v({"n": 2, "m": "x"})), ("b", v({"r": 1.5, "q": "00:00:01.000"}))]
    cases = {1: truth, 2: [("a", v({"n": 3, "m": "x"})), truth[1]], 3: [("a", v({"n": 3, "m": "x"}))]}
    chain = lambda rows: spark.createDataFrame(rows, "id int, pos int, tool string, j string").select("id", "pos", "tool", F.from_json("j", "map<string, variant>").alias("params"))
    gt = chain([(i, k, t, j) for i in cases for k, (t, j) in enumerate(truth)])
    pred = chain([(i, k, t, j) for i, calls in cases.items() for k, (t, j) in enumerate(calls)])
    got = {r["id"]: r["score"] for r in C.position_scores(gt, pred).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.825, 3: 0.325})
    f1 = spark.range(1).select(C.name_f1(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))), C.name_f1(F.array().cast("array<string>"), F.array().cast("array<string>")), C.name_f1(F.array(F.lit("a")), F.array().cast("array<string>"))).first()
    assert list(f1) == pytest.approx([2 / 3, 1.0, 0.0])
    assert J.calls_of("not json") is None


def test_empty_truth_metrics(spark):
    empty = F.array().cast("array<string>")
    r = C.sequence_metrics(spark.range(1).select("id", empty.alias("gt"), empty.alias("pred"), empty.alias("done"))).first()
    assert (r["exact"], r["f1"], r["coverage"], r["any_used"], r["all_used"]) == (True, 0.0, 1.0, None, None)


def test_means_skip_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double")
    assert df.agg(C.mean_of_numbers(F.col("x"))).first()[0] == 2.0


def test_greedy_clusters(spark):
    texts = F.array(*map(F.lit, ["ab", "cd", "ax", "c"]))
    same = lambda a, b: F.substring(a, 1, 1) == F.substring(b, 1, 1)
    assert spark.range(1).select(U.greedy_clusters(texts, same)).first()[0] == [["ab", "ax"], ["cd", "c"]]


def test_entropy_bounds(spark):
    rows = [(i, i, t) for i, t in enumerate(["a", "b", "c", "d"])]
    df = spark.createDataFrame([(0, p, t) for _, p, t in rows], "id int, pos int, text string")
    assert U.discrete_entropy(df, F.array(*map(F.lit, "abcd"))).first()["entropy"] == pytest.approx(math.log(4))


def test_global_rank(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate([5, 3, None, 3, 9])], "x int, i int")
    assert [r["i"] for r in global_rank(df, ["x", "i"], "n").orderBy("n").collect()] == [2, 1, 3, 0, 4]
    assert global_rank(df.limit(0), ["x", "i"], "n").count() == 0


def test_sampling_properties(spark):
    df = spark.range(500)
    assert sampling.sample(df, "id", 1000, 1).count() == 500
    heavy = df.withColumn("w", F.when(F.col("id") < 50, 100.0).otherwise(0.1))
    assert sampling.weighted_sample(heavy, "id", F.col("w"), 50, 2).where("id < 50").count() > 40
    chains = sampling.chains(df, "id", ["a", "b"], 1, 9, 3)
    assert chains.groupBy("id", "tool").count().where("count > 1").count() == 0
    with pytest.raises(ValueError):
        sampling.draw_params({"x": {"kind": "odd"}}, 1, "id")


def test_recovery_inverts(spark):
    items = spark.range(200).select("id", F.lit("change_speed").alias("op"), F.lit(5.0).alias("duration"))
    d = disturb.disturb(items, 1).withColumns({"input_duration": F.col("duration"), "output_duration": F.col("duration"), "offset": F.lit(None).cast("double")})
    for r in disturb.recover(d, 1).collect():
        assert r["call"]["rate"] * r["params"]["rate"] == pytest.approx(1, abs=1e-5) and r["tool"] == "time_stretch"
    assert disturb.describe()[0] == "add_noise"


def test_schedule_entries(spark):
    text = json.dumps([[{"id": "1", "choice": []}, [{"tool": "denoise", "parameters": {"audio_path": "a"}}]], "bad"])
    got = schedules.entries(spark.createDataFrame([("f", text), ("g", "not json")], "source string, value string")).select("source", "entry", F.to_json("calls").alias("calls")).collect()
    assert len(got) == 3 and json.loads(got[0]["calls"])[0]["tool"] == "denoise"


def test_batch_failures_are_rows(spark):
    calls = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 3)], "tool string, batch int, id int")

    def run(batch):
        if batch[0]["tool"] == "b":
            raise RuntimeError("broken")
        return [{"message": "ok"} for _ in batch]

    got = {r["id"]: r["status"] for r in schedules.run_batches(calls, run, "tool string, batch int, id int, status string, message string").collect()}
    assert got == {1: "success", 2: "success", 3: "failure"}


def test_batches_keep_values_as_they_are(spark):
    """A tool gets whole numbers and nulls as such, a hundred calls at a time without a table of objects for each."""
    calls = spark.createDataFrame([("a", 1, 1 << 60, ["x"]), ("a", 1, None, None)], "tool string, batch int, id long, files array<string>")
    run = lambda rows: [{"said": f"{c['id']} {c['files']}", "score": None if c["id"] else float("nan")} for c in rows]
    got = schedules.run_batches(calls, run, "tool string, id long, status string, said string, score double, message string").collect()
    assert sorted((r["said"], r["id"], r["score"]) for r in got) == [(f"{1 << 60} ['x']", 1 << 60, None), ("None None", None, None)]


def test_vectors(spark):
    e = F.array().cast("array<double>")
    x = F.array(*map(F.lit, [1.0, -2.0, 3.0]))
    row = spark.range(1).select(X.rms(e), X.cosine(x, x), X.si_sdr(e, e), X.fit_length(x, F.lit(5)), X.match_length(x, F.lit(5)), X.normalise_peak(F.array(F.lit(0.0)), 0.9)).first()
    assert row[0] == 0.0 and row[1] == pytest.approx(1) and math.isnan(row[2]) and row[3] == [1, -2, 3, 1, -2] and row[4] == [1, -2, 3, 0, 0] and row[5] == [0.0]


def wav_bytes(x, rate=8000, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    return out.getvalue()


def test_wav(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav_bytes((np.sin(np.arange(8000)) * 20000).astype("<i2")))
    (tmp_path / "b.wav").write_bytes(b"junk")
    (tmp_path / "c.wav").write_bytes(wav_bytes(np.full(4000, 128, np.uint8), width=1))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r["path"][-5]: r for r in wav.read_segments(files, F.lit(0.25), F.lit(0.75)).collect()}
    assert got["a"]["status"] == "success" and len(got["a"]["samples"]) == 4000
    assert got["b"]["status"] == "failure" and got["c"]["status"] == "failure"
    clamped = {r["path"][-5]: r for r in wav.read_segments(files, F.lit(0.25), F.lit(0.75), clamp=True).collect()}
    assert len(clamped["c"]["samples"]) == 2000 and set(clamped["c"]["samples"]) == {0.0}
    assert {r["path"][-5]: r["seconds"] for r in wav.durations(files).collect()} == {"a": 1.0, "b": None, "c": 0.5}
    loud = spark.createDataFrame([([0.5, 2.0],)], "x array<float>").select(*[wav.encode_pcm16("x", F.lit(8000), F.lit(r)).alias(r) for r in ("scale", "clip", "ceiling")]).first()
    ends = [np.frombuffer(loud[r][44:], "<i2").tolist() for r in ("scale", "clip", "ceiling")]
    assert ends == [[8191, 32767], [16384, 32767], [8028, 32112]]


def test_sources(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "x.json").write_text(json.dumps([{"question": "é?", "choice": ["a", "b"], "id": "1"}, {"id": "2"}]))
    got = records.json_arrays(spark, str(tmp_path / "q"), records.QA_SCHEMA).collect()
    assert len(got) == 2 and got[0]["choice"] == ["a", "b"]
    assert records.checked_arrays(spark, str(tmp_path / "q"), "id string, question string").count() == 2
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="list"):
        records.checked_arrays(spark, str(tmp_path / "bad.json"), "id string").collect()
    (tmp_path / "logs" / "v1").mkdir(parents=True)
    (tmp_path / "logs" / "v1" / "logging.jsonl").write_text('{"loss": 0.5, "global_step/max_steps": "5/939"}\n\n{"done": true}\n')
    log = records.training_logs(spark, str(tmp_path / "logs" / "*" / "logging.jsonl")).collect()
    assert [(r["run"], r["step"], r["max_steps"]) for r in log] == [("v1", 5, 939)]
    folder = tmp_path / "t"
    folder.mkdir()
    for n, tool in ((10, "asr"), (2, "pitch_shift")):
        (folder / f"tool_input_{n}.json").write_text(json.dumps({"tool": tool, "parameters": {}}))
    (folder / "tool_result_10.txt").write_text("hello")
    (folder / "tool_result_2.wav").write_bytes(b"x")
    r = records.tool_results(spark, str(folder), "<audio>").first()
    assert r["prompt"] == "pitch-shifted audio: <audio>transcription of the audio: hello" and len(r["audio_paths"]) == 1
    (folder / "tool_input_3.json").write_text(json.dumps({"tool": "asr", "parameters": {}}))
    with pytest.raises(Exception, match="no result"):
        records.tool_results(spark, str(folder), "<audio>").collect()
    assert records.tool_results(spark, str(folder), "<audio>", skip_missing=True).count() == 1
    stems = spark.createDataFrame([("A_x",), ("y",)], "stem string")
    files = spark.createDataFrame([("x",), ("A_x",), ("A_y",), ("z",)], "stem string")
    assert {r[0] for r in records.without_stems(files, stems).collect()} == {"A_y", "z"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "é"), ("a", "x")], "tool string, v string")
    records.write_by(df, str(tmp_path / "by"), "tool")
    assert (tmp_path / "by" / "tool=a").exists()
    records.append_results(df, str(tmp_path / "out"))
    records.append_results(df, str(tmp_path / "out"))
    assert records.json_lines(spark, str(tmp_path / "out")).count() == 4
    assert [r["v"] for r in json.loads(df.agg(records.array_text(F.struct("*"), F.col("tool"))).first()[0])] == ["x", "é"]
    assert records.output_name("m", True) == "m_with_tool_chain_results"


def test_models(spark):
    items = spark.createDataFrame([(1, "q\nyes", [], "YES"), (2, "q\nno", [], "x"), (3, "q", [], "y")], "id int, prompt string, audios array<string>, answer string")
    done = spark.createDataFrame([(3,)], "id int")
    got = {r["id"]: r["correct"] for r in models.evaluate(items, done, models.Echo).collect()}
    assert got == {1: True, 2: False}


def test_turns(spark, tmp_path):
    plan = spark.createDataFrame([(1, 1, "t", "p"), (1, 2, "t", "p"), (2, 1, "bad", "p"), (2, 2, "t", "p")], "id int, turn int, tool string, params string")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, audio string")
    run = lambda calls: calls.select("id", F.concat("audio", F.lit("'")).alias("output"), F.when(F.col("tool") == "bad", "failure").otherwise("success").alias("status"))
    got = {r["id"]: (r["audio"], r["failed"], r["turns_done"]) for r in datasets.run_turns(plan, items, run, str(tmp_path)).collect()}
    assert got == {1: ("a''", False, 2), 2: ("b", True, 0), 3: ("c", False, 0)}


def test_prompts(spark):
    text = lambda c: spark.range(1).select(c).first()[0]
    assert text(prompts.fill("{{x}} {a} {b}", a=F.lit("{b}"), b="y")) == "{x} {b} y"
    assert text(prompts.lines(F.lit(None).cast("array<string>"))) == "" and text(prompts.system_turn(F.lit(""), final=True)) == prompts.FINAL_ROUND
    assert text(prompts.system_turn(F.lit("T"))).startswith("\nYou are an expert in audio analysis and question answering.\n\nYou are given") and '{{"example' in text(prompts.system_turn(F.lit("T")))
    assert text(prompts.call_message(F.lit('a"é'), F.lit("{}"), F.lit("x"))) == json.dumps({"tool_name": 'a"é', "parameters": {}, "output_audio_id": "x"}, ensure_ascii=False)
    texts = {r["tool"]: r["text"] for r in prompts.catalogue(schedules.registry(spark)).collect()}
    assert len(texts) == 16 and "- algorithm (string), required, allowed=['spectral_subtraction', 'wiener', 'echo_cancellation', 'adaptive']" in texts["denoise"]
    with pytest.raises(ValueError):
        datasets.single_turn_rows(spark.range(1), "")


def test_resume(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": 1}\n{"id": 2}\n')
    go = lambda: resume.start(spark, source, "id int", lambda df: df.withColumn("x", F.col("id") * 2), sink, checkpoint).awaitTermination(60)
    go()
    (tmp_path / "in" / "2.json").write_text('{"id": 3}\n')
    go()
    assert sorted(r["x"] for r in spark.read.json(sink).collect()) == [2, 4, 6]


def test_built_samples(spark, tmp_path):
    """A hook that fails the first attempt of odd tasks and drops the rows of task 4, which is replaced."""
    seen = lambda c: F.split("key", "/")[c].cast("int")
    run = lambda calls: calls.where(seen(0) != 4).select("key", F.concat("audio", F.lit("+"), "tool").alias("output"), F.create_map(F.lit("audio_path"), "audio").alias("parameters"), F.when((seen(0) % 2 == 1) & (seen(1) == 0), "failure").otherwise("success").alias("status"))
    sources = spark.createDataFrame([(0, "x"), (1, "y")], "place long, audio string")
    rows = builders.build(6, sources, ["a", "b"], 2, 5, 1, 3, run, str(tmp_path / "built")).orderBy("task").collect()
    assert [r["task"] for r in rows] == [0, 1, 2, 3, 5, 6] and len({r["id"] for r in rows}) == 6
    for r in rows:
        first, second = (c["tool_name"] for c in r["tool_calls"])
        assert {first, second} == {"a", "b"} and r["num_steps"] == 2 and r["source_audio"] in "xy" and r["target_audio"] == f"{r['source_audio']}+{first}+{second}" == r["step_outputs"][1]
        assert [c["parameters"] for c in r["tool_calls"]] == [{"audio_id": "audio_0"}, {"audio_id": "audio_2"}]
        assert r["audio_id_map"] == {"audio_0": r["source_audio"], "audio_1": r["target_audio"], "audio_2": r["step_outputs"][0], "audio_3": r["target_audio"]}
    assert builders.build(0, sources, ["a"], 1, 1, 1, 1, run, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        builders.build(1, sources.limit(0), ["a"], 1, 1, 1, 1, run, str(tmp_path / "empty"))
    with pytest.raises(RuntimeError):
        builders.build(1, sources, ["a"], 1, 1, 1, 1, lambda c: run(c).where("false"), str(tmp_path / "never"), rounds=2)


def test_saved_results(spark, tmp_path):
    audio = tmp_path / "in.WAV"
    audio.write_bytes(b"RIFF")
    schema = "id string, tool string, transcript string, clip_path string, output_path string, separated_files map<string,string>, record string, problem string"
    results = spark.createDataFrame([
        ("1", "asr", "é", str(audio), None, None, "{}", None), ("2", "t", None, None, str(audio), {"v": "/x"}, "{}", None), ("3", "t", None, None, str(tmp_path / "no.wav"), None, '{"a": {}}', '{"q": 1}'),
        ("4", "t", None, None, None, {"v": str(audio), "w": str(tmp_path / "no.wav")}, "{}", "1"), ("5", "t", None, None, None, {}, "{ }\n", None),
    ], schema)
    files = results_sink.result_files(results, spark.createDataFrame([(str(audio),)] * 2, "path string"))
    for _ in range(2):  # written again, the files are the same
        got = {(r["id"], r["name"]): r["status"] for r in results_sink.save(files, str(tmp_path / "out")).collect()}
        assert [k for k, s in got.items() if s == "failure"] == [("4", "tool_result_t_w.wav")] and len(got) == 7
    read = lambda i, name: (tmp_path / "out" / i / name).read_bytes()
    assert read("1", "tool_result_asr.txt") == "é".encode() and read("2", "tool_result_t.WAV") == read("4", "tool_result_t_v.WAV") == b"RIFF"
    assert json.loads(read("3", "tool_result_t.json")) == {"a": {}, "_problem": {"q": 1}} and json.loads(read("4", "tool_result_t.json")) == {"_problem": 1} and json.loads(read("5", "tool_result_t.json")) == {"_problem": None}
    assert results_sink.result_files(results.limit(0), files.select(F.lit("x").alias("path"))).count() == 0
