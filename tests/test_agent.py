"""The running agent with a scripted model: all stop reasons, ids, resumption."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.json_parse import told_turn
from plumbline.operators import agent as A
from plumbline.plans import agent_queries as Q

from .oracle import check

CALL = '{"tool_name": "%s", "parameters": %s}'
GOOD = CALL % ("clipping", '{"n": 1}')


def samples(spark, budgets):
    audios = [("audio_0", "/a"), ("audio_1", "/b")]
    return spark.createDataFrame([(s, [("user", f"do {s}")], audios, b) for s, b in budgets.items()], f"sample string, messages {A.MESSAGES}, audios array<struct<id: string, path: string>>, budget int")


def scripted(script, asked=None):
    """The model says script[sample][turn - 1]; asked gets (sample, messages)."""

    def generate(requests):
        if asked is not None:
            asked.extend((r["sample"], [m["content"] for m in r["messages"]], list(r["audios"])) for r in requests.collect())
        turn = F.floor((F.size("messages") + 1) / 2).cast("int")
        said = F.create_map(*[x for s, texts in script.items() for x in (F.lit(s), F.array(*map(F.lit, texts)))])
        return requests.select("sample", F.get(said[F.col("sample")], turn - 1).alias("text"))

    return generate


def execute(calls):
    out = F.concat_ws(":", "audio", "tool", F.col("step").cast("string"))
    none = F.lit(None).cast("string")
    is_ = lambda t: F.col("tool") == t
    rows = calls.where(~is_("lost"))
    return rows.select(
        "sample", F.when(is_("bad"), "failure").otherwise("success").alias("status"), F.when(is_("clipping"), out).alias("output_path"), none.alias("clip_path"),
        F.when(is_("split"), F.create_map(F.lit("target"), out, F.lit("residual"), F.concat(out, F.lit("!")))).alias("separated_files"), none.alias("transcript"), F.when(is_("bad"), "no good").alias("message"), F.col("parameters").alias("result"),
    )


TOOLS = ["clipping", "bad", "lost", "split", "say"]


def test_stop_reasons(spark, tmp_path):
    script = {
        "done": [GOOD, '{"done": true}'], "garbage": ["what?"], "list": ["[1]"], "nameless": ['{"parameters": {}}'], "forbidden": [CALL % ("rm", "{}")], "again": [GOOD, CALL % ("clipping", '{"n":   1}')],
        "unknown": [CALL % ("clipping", '{"audio_id": "audio_9"}')], "bad": [CALL % ("bad", "{}")], "lost": [CALL % ("lost", "{}")], "long": [GOOD, CALL % ("clipping", '{"n": 2}'), "x"], "silent": [None], "falsy": ['{"done": 0, "tool_name": "say", "parameters": [1]}', '{"done": "yes"}'],
    }
    begun = samples(spark, {**dict.fromkeys(script, 4), "long": 2, "none": 0})
    done = A.run(begun, scripted(script), execute, TOOLS, str(tmp_path))
    got = {r["sample"]: (r["stop_reason"], r["n_turns"], r["attempted"], r["successful"], r["final_audio"]) for r in A.outcomes(spark.read.parquet(f"{tmp_path}/start"), done).collect()}
    c = "clipping"
    assert got == {
        "done": ("model_signaled_done", 2, [c], [c], "/b:clipping:1"), "garbage": ("unparseable_output", 1, [], [], "/b"), "list": ("unparseable_output", 1, [], [], "/b"), "nameless": ("unparseable_output", 1, [], [], "/b"),
        "forbidden": ("disallowed_tool", 1, [], [], "/b"), "again": ("repeated_call", 2, [c], [c], "/b:clipping:1"), "unknown": ("unknown_audio_id", 1, [], [], "/b"), "bad": ("tool_execution_failed", 1, ["bad"], [], "/b"),
        "lost": ("tool_execution_failed", 1, ["lost"], [], "/b"), "long": ("max_steps_reached", 2, [c, c], [c, c], "/b:clipping:1:clipping:2"), "silent": ("unparseable_output", 1, [], [], "/b"),
        "falsy": ("model_signaled_done", 2, ["say"], ["say"], "/b"), "none": ("max_steps_reached", 0, [], [], "/b"),
    }
    errors = {r["sample"]: r["error"] for r in done.where("error is not null").collect()}
    assert errors["bad"] == "no good" and errors["lost"] == "no result" and errors["again"] == "repeated_call" and "done" not in errors


def test_ids_and_what_the_model_sees(spark, tmp_path):
    script = {"s": [CALL % ("split", '{"audio_id": "audio_0", "x": 1}'), '{"tool_name": "clipping", "parameters": {"audio_id": "audio_2_residual", "output_path": "/etc"}, "output_audio_id": "mine"}', CALL % ("say", '{"audio_path": "/q", "y": 2}'), GOOD, '{"done": true}']}
    asked = []
    done = A.run(samples(spark, {"s": 8}), scripted(script, asked), execute, TOOLS, str(tmp_path))
    rows = done.orderBy("round").collect()
    assert [r["produced"] for r in rows] == [["audio_2", "audio_2_residual"], ["mine"], [], ["audio_4"], []]  # a text takes a number too
    assert [r["input_id"] for r in rows] == ["audio_0", "audio_2_residual", "mine", "mine", None]
    token = Q.AUDIO_TOKEN
    told = [f"Output of step 1: <audio_2>{token} <audio_2_residual>{token}", f"Output of step 2: <mine>{token}", 'Output of step 3 (say): {"y": 2}', f"Output of step 4: <audio_4>{token}", None]
    assert [r["told"] for r in rows] == told
    assert rows[3]["ids"] == {"audio_0": "/a", "audio_1": "/b", "audio_2": "/a:split:1", "audio_2_residual": "/a:split:1!", "mine": "/a:split:1!:clipping:2", "audio_4": "/a:split:1!:clipping:2:clipping:4"}
    assert asked[-1] == ("s", ["do s", *[x for pair in zip(script["s"][:4], told[:4]) for x in pair]], ["/a", "/b", "/a:split:1", "/a:split:1!", "/a:split:1!:clipping:2", "/a:split:1!:clipping:2:clipping:4"])
    whole = A.transcripts(spark.read.parquet(f"{tmp_path}/start"), done).first()["messages"]
    assert [m["content"] for m in whole] == [*asked[-1][1], '{"done": true}'] and {m["role"] for m in whole} == {"user", "assistant", "tool"}


def test_a_run_that_is_cut_off_goes_on(spark, tmp_path):
    script = {"a": [CALL % ("clipping", f'{{"n": {i}}}') for i in range(4)], "b": [GOOD, '{"done": true}'], "c": ["?"]}
    budgets = {"a": 4, "b": 4, "c": 4}
    asked, failed = [], []

    def fails_once(calls):
        if not failed and calls.select("step").first()["step"] == 3:
            failed.append(1)
            raise RuntimeError("the cluster went away")
        return execute(calls)

    with pytest.raises(RuntimeError, match="went away"):
        A.run(samples(spark, budgets), scripted(script, asked), fails_once, TOOLS, f"{tmp_path}/x")
    half = len(asked)
    done = A.run(samples(spark, dict.fromkeys(budgets, 1)), scripted(script, asked), fails_once, TOOLS, f"{tmp_path}/x")  # what was begun stays
    whole = A.run(samples(spark, budgets), scripted(script), execute, TOOLS, f"{tmp_path}/y")
    key = lambda df: sorted((r["sample"], r["round"], r["text"], r["told"] or "", r["reason"] or "") for r in df.collect())
    assert key(done) == key(whole)
    # Six of eight answers were asked for before, the third round's among them; only live samples are asked.
    assert half == 6 and sorted(s for s, *_ in asked) == ["a"] * 4 + ["b"] * 2 + ["c"]
    assert A.run(samples(spark, budgets), None, None, TOOLS, f"{tmp_path}/x").count() == whole.count()  # all is there
    assert A.run(samples(spark, {}), scripted(script), execute, TOOLS, f"{tmp_path}/z").count() == 0


class Echo:
    def generate(self, prompts, audios):
        return [str(len(a)) + p.split("<|im_start|>")[-2].split("\n", 1)[1].removesuffix("<|im_end|>\n") for p, a in zip(prompts, audios)]


def test_a_model_speaks(spark):
    requests = spark.createDataFrame([("s", [("system", "be good"), ("user", "hi\nthere")], ["/a"])], f"sample string, messages {A.MESSAGES}, audios array<string>")
    assert A.with_model(Echo)(requests).collect() == [("s", "1hi\nthere")]


def test_turns_as_told():
    assert told_turn("```JSON\n{\"done\": false, \"tool_name\": \"a\", \"parameters\": {\"b\": 1, \"audio_id\": \"x\"}}\n```") == {"done": False, "tool": "a", "parameters": '{"audio_id": "x", "b": 1}', "given": '{"b": 1}', "audio_id": "x", "output_id": None}
    assert told_turn("{} x") is None and told_turn("{}")["tool"] is None and told_turn('{"tool_name": ["a"]}')["tool"] == '["a"]'


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, sf, name):
    check(spark, Q.QUERIES[name], Q.ORACLE[name], sf)
