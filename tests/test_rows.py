"""Training rows, benchmarks and what validation says."""

import json
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalar
from plumbline.operators import builders, chains, datasets, sampling, schedules, uncertainty
from plumbline.sources import records


def test_multi_turn_rows(spark):
    sample = spark.sql("""SELECT 'x' AS id, 'Turn /a.wav into /b.wav, not /a.wav' AS question, '/a.wav' AS source_audio, '/b.wav' AS target_audio,
      array(named_struct('tool_name', 'pitch_shift', 'parameters', map('n_steps', '-4', 'audio_id', 'audio_0'), 'output_audio_id', 'audio_2'),
            named_struct('tool_name', 'asr', 'parameters', map('language', '12', 'rate', 'fast "x"', 'audio_id', 'audio_2'), 'output_audio_id', 'audio_3')) AS tool_calls, map('audio_0', '/a.wav', 'audio_1', '/b.wav', 'audio_2', '/c.wav', 'audio_3', '/b.wav') AS audio_id_map""")
    row = datasets.multi_turn_rows(sample, F.lit("S")).first()
    roles = [m["role"] for m in row["messages"]]
    assert roles == ["system", "user", "assistant", "tool", "assistant", "tool", "assistant"] and row["audios"] == ["/a.wav", "/b.wav", "/c.wav", "/b.wav"]
    said = [m["content"] for m in row["messages"]]
    assert said[1] == "Turn <audio_0><audio> into <audio_1><audio>, not /a.wav" and "".join(said).count("<audio>") == len(row["audios"])
    assert json.loads(said[2]) == {"tool_name": "pitch_shift", "parameters": {"n_steps": -4, "audio_id": "audio_0"}, "output_audio_id": "audio_2"}
    assert json.loads(said[4])["parameters"] == {"language": "12", "rate": 'fast "x"', "audio_id": "audio_2"}  # a text stays a text
    assert said[3] == "Output of step 1: <audio_2><audio>" and json.loads(said[6]) == {"done": True}
    none = datasets.multi_turn_rows(sample.withColumn("tool_calls", F.slice("tool_calls", 1, 0)), F.lit("S")).first()
    assert len(none["messages"]) == 3 and len(none["audios"]) == 2


def test_benchmark_is_held_out(spark, tmp_path):
    pool = spark.createDataFrame([(f"f{i:02}", f"/f{i:02}.wav") for i in range(20)], "name string, audio string")
    run = lambda calls: calls.select("key", F.concat("audio", F.lit("+")).alias("output"), F.create_map(F.lit("audio_path"), "audio").alias("parameters"), F.lit("success").alias("status"))
    got = builders.benchmark(30, pool, "name", 0.25, ["a", "b"], 1, 2, 3, 1, run, str(tmp_path / "b")).collect()
    assert len(got) == 30 and {r["source_audio"] for r in got} == {f"/f{i}.wav" for i in range(15, 20)}


def test_messages_agree_with_counts(spark):
    meta = {"question": "q", "choice": [], "answer": "a", "id": "1", "audio_path": "x"}
    calls = [
        {"tool": "denoise", "parameters": {"audio_path": "x", "audio_begin": 3, "audio_end": "00:00:01.5", "algorithm": "magic"}}, {"tool": None, "parameters": {}}, {"tool": "asr"},
        {"tool": "asr", "parameters": None}, None, {"tool": "clipping", "parameters": {"audio_path": "x", "audio_begin": "00:00:00.0", "audio_end": "00:00:01.0"}}, {}, True, {"tool": "denoise", "parameters": {"algorithm": ["wiener"]}},
    ]
    texts = [json.dumps([[meta, calls]]), json.dumps([[meta, calls[5:6]], None, 3, {}, [], [meta], [None, None]]), "[]", "no JSON", "{}", json.dumps([[{**meta, "choice": "a"}, []], [{}, [[]]]])]
    found = schedules.entries(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, value string"))
    schema = schedules.schedule_registry(spark)
    counts = {(r["source"], r["entry"]): r["errors"] for r in schedules.entry_errors(found, schema).collect()}
    said = {(r["source"], r["entry"]): r["messages"] for r in schedules.entry_messages(found, schema).collect()}
    assert said[("1", 0)] == [] and "entry[0]: tool_call[0](tool=denoise): 'audio_begin' must be a string in HH:MM:SS.mmm format, got number" in said[("0", 0)]
    assert "entry[0]: tool_call[8](tool=denoise): Parameter 'algorithm' has invalid value '[\"wiener\"]'. Allowed: ['spectral_subtraction', 'wiener', 'echo_cancellation', 'adaptive']" in said[("0", 0)]
    assert {k: len(v) for k, v in said.items()} == counts


def test_entries_in_no_fixed_order(spark):
    """Texts whose entries come in another order each time they are made, and a schedule without a name, are judged as they were read."""
    import random

    good = [{"question": "q", "choice": [], "answer": "a", "id": "1", "audio_path": "x"}, [{"tool": "asr", "parameters": {"audio_path": "x", "audio_begin": "00:00:00.0", "audio_end": "00:00:01.0"}}]]
    entries = [json.dumps(x) for x in (good, [good[0], [3]], [good[0], good[1] + [3, 4]], [good[0], []], 7, [good[0]])]
    anyhow = F.udf(lambda x: "[" + ",".join(random.SystemRandom().sample(entries, len(entries))) + "]").asNondeterministic()
    texts = spark.range(40).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("source"), anyhow("id").alias("value"))
    schema = schedules.schedule_registry(spark)
    got = schedules.validation_totals(schedules.entry_errors(schedules.entries(texts), schema)).collect()
    assert len(got) == 40 and {(r["entries"], r["bad_entries"], r["errors"]) for r in got} == {(6, 5, 6)}
    said = schedules.entry_messages(schedules.entries(texts), schema).groupBy("source").agg(F.sum(F.size("messages")).alias("n")).collect()
    assert len(said) == 40 and {r["n"] for r in said} == {6}


def test_values_in_columns_as_in_lambdas(spark):
    """Both forms of loose equality agree on all pairs of kinds of values."""
    values = [None, "null", "true", "false", "1", "0", "1.03", "1e300", "-0.5", '" 1 "', '"1"', '"NaN"', '"x"', '" X"', '"00:00:01.5"', '"00:00:02"', '"1:2"', '""', "[1]", "[1.0]", '{"a": 1}', "12345678901234567890"]
    one = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").withColumn("x", F.try_parse_json("v"))
    pairs = one.crossJoin(one.select(F.col("i").alias("j"), F.col("x").alias("y")))  # a fixture's own pairs
    got = scalar.with_values_close(pairs, F.col("x"), F.col("y"), "fast").select("i", "j", "fast", scalar.values_close(F.col("x"), F.col("y")).alias("slow")).collect()
    assert len(got) == len(values) ** 2 and [(r["i"], r["j"]) for r in got if r["fast"] is not r["slow"]] == []
    close = {(values[r["i"]], values[r["j"]]) for r in got if r["fast"]}
    assert {("true", "1"), ("1", "1.03"), ('"x"', '" X"'), ('"00:00:01.5"', '"00:00:02"'), ("[1]", "[1]")} <= close and not {("1", '"1"'), ('"NaN"', '"NaN"'), ("true", "1.03")} & close


def test_position_scores_by_hand(spark):
    """Missing and extra steps, a wrong tool, no parameters on either side, one side, and shared ones of which some agree."""
    calls = lambda rows: spark.createDataFrame(rows, "id int, pos int, tool string, p map<string,string>").select("id", "pos", "tool", F.map_from_entries(F.transform(F.map_entries("p"), lambda e: F.struct(e["key"], F.try_parse_json(e["value"])))).alias("params"))
    gt = calls([(1, 1, "a", {"x": "1", "y": '"s"'}), (1, 2, "b", {}), (2, 1, "a", {}), (2, 2, "c", {"x": "1"}), (3, 1, "a", {"x": "1"})])
    pred = calls([(1, 1, "a", {"x": "1.01", "y": '"t"', "z": "3"}), (1, 2, "b", {}), (2, 1, "b", {}), (3, 1, "a", {}), (3, 2, "d", {}), (4, 1, "a", {})])
    got = {r["id"]: r["score"] for r in chains.position_scores(gt, pred).collect()}
    assert got == pytest.approx({1: (0.3 + 0.7 / 3 + 1.0) / 2, 2: 0.0, 3: 0.3 / 2, 4: 0.0})


def test_parameters_of_other_tools_are_not_compared(spark):
    """A position where the tools differ, or one is missing, is one row, however many parameters the calls share."""
    params = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i.cast("variant")))
    calls = lambda tool: spark.range(20).select("id", F.lit(1).alias("pos"), F.lit(tool).alias("tool"), params.alias("params"))
    for other, score in (("b", 0.0), ("a", 1.0)):
        done = chains.position_scores(calls("a"), calls(other))
        plan = done._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"CASE WHEN .* THEN array_intersect", plan)
        assert [r["score"] for r in done.collect()] == [pytest.approx(score)] * 20


def test_rewards_by_name(spark):
    scored = spark.createDataFrame([(1, True, 0.5, 1.0), (2, False, 0.5, 1.0), (3, None, 0.5, 1.0), (4, True, None, 1.0)], "id int, formed boolean, sequence double, names double")
    got = [[r[n] for n in chains.REWARDS] for r in chains.rewards(scored, *chains.REWARDS).orderBy("id").collect()]
    for row, want in zip(got, [[1, 0.5, 1, 0.65], [0] * 4, [0] * 4, [1, 0, 1, 0.3]], strict=True):
        assert row == pytest.approx(want)
    with pytest.raises(ValueError, match="odd"):
        chains.rewards(scored, "tool_use", "odd")


def test_sampled_folder(spark, tmp_path):
    for place in ("a", "b"):
        (tmp_path / place).mkdir()
        for i in range(20):
            (tmp_path / place / f"{i}.json").write_text(json.dumps({"id": str(i), "question": "q"}))
    first, second = (records.sampled_arrays(spark, str(tmp_path / place), 5, 3, "id string, question string").collect() for place in ("a", "b"))
    assert len(first) == 5 and sorted(r["id"] for r in first) == sorted(r["id"] for r in second) and all(r["_json_path"].endswith(f"/{r['id']}.json") for r in first)
    assert records.sampled_arrays(spark, str(tmp_path / "a"), 99, 3).count() == 20
    with pytest.raises(FileNotFoundError):
        records.sampled_arrays(spark, str(tmp_path / "a"), 5, 3, pattern="*.nothing")


def test_distribution_and_order(spark):
    samples = spark.createDataFrame([(1, "click"), (1, "(B) it"), (1, "none"), (1, None), (2, None)], "id int, text string")
    got = {r["id"]: r for r in uncertainty.answer_distribution(samples, F.array(F.lit("click"), F.lit("view"))).collect()}
    assert got[1]["distribution"] == {"click": 1, "view": 1, "unresolved": 1} and got[1]["entropy"] == pytest.approx(1.0986123) and got[2]["distribution"] == {} and got[2]["entropy"] is None
    ids = [r["id"] for r in sampling.shuffled(spark.range(200), "id", 4).collect()]
    assert sorted(ids) == list(range(200)) != ids and ids == [r["id"] for r in sampling.shuffled(spark.range(200).repartition(9), "id", 4).collect()]
