"""The uncertainty protocol with a model in it: K sampled answers and one self-check an item, and all that follows from them.

Items fan out into one request a sample, with a seed of its own, so samples of one item may run on different machines and a repeated
task draws the same. Answers carry the log probabilities of their tokens as structs. Everything about an item is then computed from its
one group of K answers, after one exchange. Meanings are compared by a model that gets batches of pairs across items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import count_substring, let, match_choice, normal_token, strip
from ..sources.records import scratch_folder
from .prompts import verification_prompt
from .uncertainty import FALSE_TOKENS, TRUE_TOKENS, entropy_of_counts

TOKENS = "array<struct<token: string, logprob: double>>"
#: An answer: its text, the log probability of each of its tokens, and the likeliest tokens at its first place.
ANSWER = f"text string, tokens {TOKENS}, first {TOKENS}"
#: The sample number of an item's self-check.
CHECK = -1
#: How samples and checks are drawn.
SAMPLE_TEMPERATURE, SAMPLE_TOKENS, CHECK_TOKENS = 1.0, 256, 5
AUDIO_MARK = "<|AUDIO|>"
#: Characters of prompts, each as long as the longest, of one batch.
BATCH_CHARACTERS = 200_000
#: Over how many tasks items are dealt before they fan out.
TASKS_A_CORE = 3


class Answer(NamedTuple):
    text: str
    tokens: list[tuple[str, float]]
    first: list[tuple[str, float]]


class Sampler(Protocol):
    """sample(prompts, audio paths of each, seeds, temperatures, most tokens of each) -> one answer each."""

    def sample(self, prompts: list[str], audios: list[list[str]], seeds: list[int], temperatures: list[float], limits: list[int]) -> list[Answer]: ...


def seed_of(seed: int, *keys: Column) -> Column:
    """A number under 2^31 that follows from seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def sample_requests(items: DataFrame, k: int, seed: int) -> DataFrame:
    """k requests for each of items (id, prompt, audios): (id, sample, prompt, audios, seed, temperature, tokens)."""
    drawn = items.select("id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample"), "prompt", "audios") if k > 0 else items.select("id", F.lit(0).alias("sample"), "prompt", "audios").where("false")
    return drawn.withColumns({"seed": seed_of(seed, F.col("id"), F.col("sample")), "temperature": F.lit(SAMPLE_TEMPERATURE), "limit": F.lit(SAMPLE_TOKENS)})


def check_requests(items: DataFrame, system: Column) -> DataFrame:
    """One request for each of items (id, prompt, audios, question, choices, prediction): is the prediction right?"""
    asked = verification_prompt(F.col("question"), F.col("choices"), system, F.col("prediction"), count_substring(F.col("prompt"), AUDIO_MARK).cast("int"))
    return items.select("id", F.lit(CHECK).alias("sample"), asked.alias("prompt"), "audios", F.lit(0).cast("long").alias("seed"), F.lit(0.0).alias("temperature"), F.lit(CHECK_TOKENS).alias("limit"))


def complete(requests: DataFrame, load: Callable[[], Sampler], characters: int = BATCH_CHARACTERS) -> DataFrame:
    """(id, sample, ANSWER, status, message) of requests. Each task loads the model once and takes its requests by length, so a
    batch pads little; a batch holds as many prompts as fit. A batch that fails is tried request by request; one that fails alone is a row."""

    def batches_of(frames: Iterator[pd.DataFrame]) -> Iterator[list]:
        batch, longest = [], 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                longest = max(longest, len(row.prompt))
                if batch and longest * (len(batch) + 1) > characters:
                    yield batch
                    batch, longest = [], len(row.prompt)
                batch.append(row)
        if batch:
            yield batch

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None

        def ask(rows: list) -> list[Answer]:
            got = model.sample([r.prompt for r in rows], [list(r.audios) for r in rows], [r.seed for r in rows], [r.temperature for r in rows], [r.limit for r in rows])
            if len(got) != len(rows):
                raise ValueError(f"{len(got)} answers to {len(rows)} requests")
            return got

        def attempt(rows: list) -> list[tuple[Answer | None, str | None]]:
            try:
                return [(a, None) for a in ask(rows)]
            except Exception as error:  # the model's own failure, whatever it is
                return [(None, str(error))] if len(rows) == 1 else [x for r in rows for x in attempt([r])]

        pairs = lambda tokens: [{"token": t, "logprob": p} for t, p in tokens]
        for batch in batches_of(frames):
            model = model or load()
            found = attempt(batch)
            yield pd.DataFrame({
                "id": [r.id for r in batch], "sample": [r.sample for r in batch], "text": [a and a.text for a, _ in found], "tokens": [a and pairs(a.tokens) for a, _ in found],
                "first": [a and pairs(a.first) for a, _ in found], "status": ["success" if a else "failure" for a, _ in found], "message": [m for _, m in found],
            })

    rows = requests.select("id", "sample", F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("audios", F.array().cast("array<string>")).alias("audios"), "seed", "temperature", "limit")
    dealt = rows.repartition(F.xxhash64("id", "sample")).sortWithinPartitions(F.length("prompt"), "id", "sample")
    return dealt.mapInPandas(run, f"id {dict(requests.dtypes)['id']}, sample int, {ANSWER}, status string, message string")


def with_sampler(load: Callable[[], Sampler], characters: int = BATCH_CHARACTERS) -> Callable[[DataFrame], DataFrame]:
    """A sampler as the protocol's generate."""
    return lambda requests: complete(requests, load, characters)


def mass_of_true(tokens: Column) -> Column:
    """The share of the first token's mass on words that mean yes, of that on yes and no; null where there is neither."""
    mass = lambda words: F.aggregate(F.filter(tokens, lambda t: normal_token(t["token"]).isin(*words)), F.lit(0.0), lambda a, t: a + F.exp(t["logprob"]))
    return let(F.struct(mass(TRUE_TOKENS).alias("t"), mass(FALSE_TOKENS).alias("f")), lambda m: F.when(m["t"] + m["f"] > 0, m["t"] / (m["t"] + m["f"])))


def distribution(answers: Column) -> Column:
    """How often each answer occurs, as a map in order of first occurrence."""
    return F.map_from_entries(F.transform(F.array_distinct(answers), lambda a: F.struct(a, F.size(F.filter(answers, lambda x: x == a)))))


def measured(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(id, num_samples, sampled_predictions, predictive_entropy, length_normalized_entropy, discrete_semantic_entropy, answer_distribution, p_true,
    p_true_raw_response) of items (id, choices) from answers (id, sample, text, tokens, first), self-checks among them.

    Texts are stripped. An answer without tokens has no log probability and counts for neither of the first two entropies; one without a
    text (a failure) is no sample. Items without samples or without a check have nulls there.
    """
    kept = answers.where("text is not null").select("id", "sample", strip(F.col("text")).alias("text"), F.when(F.size("tokens") > 0, -F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["logprob"])).alias("cost"), F.greatest(F.size("tokens"), F.lit(1)).alias("length"), "first")
    drawn = F.col("sample") != CHECK
    grouped = kept.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(drawn, F.struct("sample", "text")))).alias("drawn"), F.avg(F.when(drawn, F.col("cost"))).alias("predictive_entropy"),
        (F.sum(F.when(drawn, F.col("cost"))) / F.sum(F.when(drawn & F.col("cost").isNotNull(), F.col("length")))).alias("length_normalized_entropy"), F.max(F.when(~drawn, F.struct("text", "first"))).alias("check"),
    )
    both = items.select("id", "choices").join(grouped, "id", "left").withColumn("texts", F.coalesce(F.col("drawn")["text"], F.array().cast("array<string>")))
    named = both.withColumn("named", F.transform("texts", lambda t: F.coalesce(F.get(F.col("choices"), match_choice(t, F.col("choices"))), F.lit("unresolved"))))
    counted = named.withColumn("answer_distribution", distribution(F.col("named")))
    n = F.size("texts")
    return counted.select(
        "id", n.alias("num_samples"), F.col("texts").alias("sampled_predictions"), "predictive_entropy", "length_normalized_entropy",
        F.when(n > 0, entropy_of_counts(F.map_values("answer_distribution"), n)).alias("discrete_semantic_entropy"), "answer_distribution", mass_of_true(F.col("check.first")).alias("p_true"), F.col("check.text").alias("p_true_raw_response"),
    )


def _said(x: Column) -> Column:
    return F.concat_ws(" ", x["text"], F.nullif(x["question"], F.lit("")))


def clusters_by_rounds(groups: DataFrame, entails: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(id, cluster, members array<struct<pos, text>>) of groups (id, todo array<struct<pos, text, question>>): one row an id, its texts in
    order; each text joins the first cluster whose first member it and that entail each other, else it opens one, as in a fold.

    A round asks about all undecided texts of all ids against their id's first undecided one, which opens the round's cluster: what
    it doesn't take meets the next. So there are as many rounds as the largest number of clusters of an id. entails gets (id,
    pos, premise, hypothesis) and returns (id, pos, entails); it is called twice a round, the second time only with pairs whose first
    direction held. An id's undecided texts stay in one row, so pairs are made where the row is, and a round exchanges a row an id,
    once for both uses, and the pairs that held. Rounds are appended to `folder`.
    """
    spark, number = groups.sparkSession, 0
    groups.select("id", "todo").write.mode("overwrite").parquet(f"{folder}/left")
    left = spark.read.parquet(f"{folder}/left").where(F.size("todo") > 0)
    while not left.isEmpty():
        opener = _said(F.col("todo")[0])
        asked = left.select("id", opener.alias("premise"), F.explode(F.slice("todo", 2, F.size("todo"))).alias("x"))
        asked = asked.select("id", "x.pos", "premise", _said(F.col("x")).alias("hypothesis"))
        entails(asked).where("entails").select("id", "pos").write.mode("overwrite").parquet(f"{folder}/there/round={number}")
        held = spark.read.parquet(f"{folder}/there/round={number}").groupBy("id").agg(F.collect_list("pos").alias("held"))
        back = left.join(held, "id").select("id", F.explode(F.filter("todo", lambda x, i: (i > 0) & F.array_contains("held", x["pos"]))).alias("x"), opener.alias("hypothesis"))
        joins = entails(back.select("id", "x.pos", _said(F.col("x")).alias("premise"), "hypothesis")).where("entails").groupBy("id").agg(F.collect_list("pos").alias("joins"))
        joined = lambda x, i: (i == 0) | F.coalesce(F.array_contains("joins", x["pos"]), F.lit(False))
        members = F.transform(F.filter("todo", joined), lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text")))
        marked = left.join(joins, "id", "left").select("id", F.lit(number).alias("cluster"), members.alias("members"), F.filter("todo", lambda x, i: ~joined(x, i)).alias("todo"))
        marked.write.mode("overwrite").parquet(f"{folder}/decided/round={number}")
        left = spark.read.parquet(f"{folder}/decided/round={number}").where(F.size("todo") > 0).select("id", "todo")
        number += 1
    paths = [f"{folder}/decided/round={n}" for n in range(number)]
    pos = groups.schema["todo"].dataType.elementType["pos"].dataType.simpleString()
    empty = f"id {dict(groups.dtypes)['id']}, cluster int, members array<struct<pos: {pos}, text: string>>"
    return spark.read.parquet(*paths).select("id", "cluster", "members") if paths else spark.createDataFrame([], empty)


def clustered(texts: DataFrame, entails: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(id, pos, text, cluster) of texts (id, pos, text, question), as clusters_by_rounds() finds them. (id, pos) are distinct."""
    found = clusters_by_rounds(texts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "question"))).alias("todo")), entails, folder)
    return found.select("id", F.explode("members").alias("x"), "cluster").select("id", "x.pos", "x.text", "cluster")


def semantic(clusters: DataFrame) -> DataFrame:
    """(id, semantic_entropy, semantic_clusters array<array<string>>) of clustered texts."""
    return meanings(clusters.groupBy("id", "cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("members")))


def meanings(clusters: DataFrame) -> DataFrame:
    """The same of whole clusters (id, cluster, members array<struct<pos, text>>)."""
    each = clusters.select("id", "cluster", F.size("members").alias("c"), F.col("members")["text"].alias("texts"))
    grouped = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("cluster", "c", "texts"))).alias("x"), F.sum("c").alias("n"))
    return grouped.select("id", entropy_of_counts(F.col("x")["c"], F.col("n")).alias("semantic_entropy"), F.col("x")["texts"].alias("semantic_clusters"))


class PairScorer(Protocol):
    """entails(premises, hypotheses) -> one truth value each."""

    def entails(self, premises: list[str], hypotheses: list[str]) -> list[bool]: ...


def with_scorer(load: Callable[[], PairScorer], batch: int = 256) -> Callable[[DataFrame], DataFrame]:
    """A model of pairs as clustered's entails; each task loads it once and gives it batches across items."""

    def entails(pairs: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    model = model or load()
                    yield pd.DataFrame({"id": part["id"], "pos": part["pos"], "entails": model.entails(part["premise"].tolist(), part["hypothesis"].tolist())})

        kinds = dict(pairs.dtypes)
        return pairs.select("id", "pos", "premise", "hypothesis").mapInPandas(run, f"id {kinds['id']}, pos {kinds['pos']}, entails boolean")

    return entails


def assess(items: DataFrame, generate: Callable[[DataFrame], DataFrame], k: int, seed: int, system: Column, entails: Callable[[DataFrame], DataFrame] | None = None, check: bool = True, folder: str | None = None) -> DataFrame:
    """The whole protocol for items (id, prompt, audios, question, choices, prediction) with distinct ids: what `measured` gives, and with entails
    the semantic entropy and clusters. generate gets sample and check requests and returns (id, sample, ANSWER); its answers are
    written before they are used, so each request is answered once."""
    folder = folder or scratch_folder(items.sparkSession, "protocol")
    dealt = items.repartition(TASKS_A_CORE * items.sparkSession.sparkContext.defaultParallelism, "id")  # few bytes, much work: not as they were read
    requests = sample_requests(dealt, k, seed)
    requests = requests.unionByName(check_requests(dealt, system)) if check else requests
    generate(requests).select("id", "sample", "text", "tokens", "first").write.mode("overwrite").parquet(f"{folder}/answers")
    answers = items.sparkSession.read.parquet(f"{folder}/answers")
    out = measured(answers, items)
    if entails is None:
        return out
    drawn = answers.where((F.col("sample") != CHECK) & F.col("text").isNotNull()).select("id", F.col("sample").alias("pos"), strip(F.col("text")).alias("text"))
    texts = drawn.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("texts")).join(items.select("id", "question"), "id")
    groups = texts.select("id", F.transform("texts", lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), F.col("question").alias("question"))).alias("todo"))
    return out.join(meanings(clusters_by_rounds(groups, entails, f"{folder}/clusters")), "id", "left")
