"""The uncertainty protocol: fan-out, batches, failures, rounds of clustering against the fold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import protocol as P
from plumbline.plans import protocol_queries as Q

from .oracle import check

ITEMS = "id string, prompt string, audios array<string>, question string, choices array<string>, prediction string"


class Loud:
    """Answers with the prompt's length, its batch's size and the seed; can't stand the word bad."""

    def sample(self, prompts, audios, seeds, temperatures, limits):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no bad words")
        return [P.Answer(f"{len(p)}/{len(prompts)}/{s}/{t}/{n}/{len(a)}", [("x", -1.0)], [("True", -0.5)]) for p, a, s, t, n in zip(prompts, audios, seeds, temperatures, limits)]


def test_requests_and_batches(spark):
    items = spark.createDataFrame([("a", "p" * 10, ["/1"], "q", ["x"], "x"), ("b", "bad", None, "q", None, "y"), ("c", "p" * 5000, [], "q", ["x"], "x")], ITEMS)
    requests = P.sample_requests(items, 3, 7)
    assert requests.count() == 9 and requests.select("seed").distinct().count() == 9
    assert sorted(map(tuple, requests.select("id", "sample", "seed").collect())) == sorted(map(tuple, P.sample_requests(items, 3, 7).repartition(3).select("id", "sample", "seed").collect()))
    rows = P.complete(requests.unionByName(P.check_requests(items, F.lit("s"))), Loud, characters=10_000).collect()
    assert len(rows) == 12 and {(r["id"], r["status"]) for r in rows if r["sample"] >= 0} == {("a", "success"), ("b", "failure"), ("c", "success")}
    assert {r["message"] for r in rows if r["status"] == "failure"} == {"no bad words"}
    for r in rows:
        if r["status"] == "success":
            length, size, seed, temperature, limit, audios = r["text"].split("/")
            assert int(length) * int(size) <= 10_000 or int(size) == 1
            assert (temperature, limit) == (("0.0", "5") if r["sample"] == P.CHECK else ("1.0", "256")) and r["tokens"] == [("x", -1.0)] and int(audios) == (r["id"] == "a")


def test_measures(spark):
    """Samples without log probabilities, failures, items without any, and checks that say neither yes nor no."""
    token = lambda *ps: [("t", p) for p in ps]
    rows = [("a", 0, " x ", token(-1.0, -2.0), None), ("a", 1, "y", None, None), ("a", 2, None, token(-9.0), None), ("a", 3, "x", token(-1.0), []), ("a", -1, "True", [], [("True", math.log(0.6)), (" no.", math.log(0.2)), ("hm", 0.0)]), ("b", -1, "Hm", [], [("hm", 0.0)])]
    items = spark.createDataFrame([("a", ["x", "z"]), ("b", ["x"]), ("c", None)], "id string, choices array<string>")
    got = {r["id"]: r for r in P.measured(spark.createDataFrame(rows, f"id string, sample int, {P.ANSWER}"), items).collect()}
    a = got["a"]
    assert (a["num_samples"], a["sampled_predictions"], a["answer_distribution"], a["p_true_raw_response"]) == (3, ["x", "y", "x"], {"x": 2, "unresolved": 1}, "True")
    assert (round(a["predictive_entropy"], 9), round(a["length_normalized_entropy"], 9), round(a["p_true"], 9)) == (2.0, round(4 / 3, 9), 0.75)
    assert abs(a["discrete_semantic_entropy"] - (math.log(3) - 2 / 3 * math.log(2))) < 1e-9
    assert got["b"]["p_true"] is None and got["b"]["num_samples"] == 0 and got["b"]["discrete_semantic_entropy"] is None and got["c"]["predictive_entropy"] is None


class Close:
    """Texts are numbers; one entails another that is at most 10 larger."""

    def entails(self, premises, hypotheses):
        number = lambda x: int(x.split()[0])
        return [number(h) - number(p) <= 10 for p, h in zip(premises, hypotheses)]


def folded(texts):
    clusters = []
    for t in texts:
        hit = next((c for c in clusters if abs(int(c[0]) - int(t)) <= 10), None)
        clusters.append([t]) if hit is None else hit.append(t)
    return clusters


def test_rounds_equal_the_fold(spark, tmp_path):
    rng = random.Random(2)
    groups = {i: [str(rng.randrange(80)) for _ in range(rng.randrange(1, 9))] for i in range(40)}
    rows = [(i, k, t, "why" if i % 2 else None) for i, ts in groups.items() for k, t in enumerate(ts)]
    calls, score = [], P.with_scorer(Close, batch=7)

    def counted(pairs):
        calls.append(pairs.count())
        return score(pairs)

    done = P.clustered(spark.createDataFrame(rows, "id int, pos int, text string, question string"), counted, str(tmp_path / "x"))
    want = {i: folded(ts) for i, ts in groups.items()}
    got = {r["id"]: r["semantic_clusters"] for r in P.semantic(done).collect()}
    assert got == want
    largest = max(map(len, want.values()))
    assert len(calls) == 2 * largest  # two calls a round, whatever the number of items
    assert sum(calls[::2]) == sum(sum(len(t) for t in c[k:]) - 1 for c in want.values() for k in range(len(c)))  # each undecided text once a round
    assert P.clustered(spark.createDataFrame([], "id int, pos int, text string, question string"), score, str(tmp_path / "y")).count() == 0


def test_items_fan_out_over_many_tasks_and_stay_one_row_a_round(spark, tmp_path):
    items = spark.range(60).selectExpr("id", "concat('p', id) AS prompt", "array() AS audios", "'' AS question", "array('1') AS choices", "'1' AS prediction").coalesce(1)
    tasks = []

    def generate(requests):
        tasks.append(requests.rdd.getNumPartitions())
        text = ((F.col("id") * 7 + F.col("sample") * 25) % 60).cast("string")
        return requests.select("id", "sample", text.alias("text"), F.array().cast(P.TOKENS).alias("tokens"), F.array().cast(P.TOKENS).alias("first"))

    out = P.assess(items, generate, 5, 1, F.lit("s"), P.with_scorer(Close), check=False, folder=str(tmp_path / "x"))
    got = {r["id"]: r["semantic_clusters"] for r in out.select("id", "semantic_clusters").collect()}
    assert got == {i: folded([str((i * 7 + k * 25) % 60) for k in range(5)]) for i in range(60)}
    assert tasks == [P.TASKS_A_CORE * spark.sparkContext.defaultParallelism]
    assert spark.read.parquet(str(tmp_path / "x/clusters/decided/round=0")).count() == 60


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, sf, name):
    check(spark, Q.QUERIES[name], Q.ORACLE[name], sf)
