"""Uncertainty of sampled answers: entropies, P(True), greedy clustering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import let, match_choice, normal_token

TRUE_TOKENS = ("yes", "true", "correct")
FALSE_TOKENS = ("no", "false", "incorrect")


def entropy_of_counts(counts: Column, total: Column) -> Column:
    """-sum p ln p over an array of counts."""
    return F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / total * F.ln(c / total)).otherwise(0.0))


def predictive_entropy(samples: DataFrame) -> DataFrame:
    """(id, predictive_entropy): the mean of -logprob over samples that have one; null if none has."""
    return samples.groupBy("id").agg(F.avg(-F.col("logprob")).alias("predictive_entropy"))


def length_normalised_entropy(samples: DataFrame) -> DataFrame:
    """(id, length_normalised_entropy): summed -logprob over summed lengths (each 1 at least), of samples with a logprob."""
    good = F.col("logprob").isNotNull()
    lengths = F.sum(F.when(good, F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(1))))
    return samples.groupBy("id").agg((F.sum(-F.col("logprob")) / lengths).alias("length_normalised_entropy"))


def discrete_entropy(samples: DataFrame, choices: Column) -> DataFrame:
    """(id, entropy, n, n_answers): of the distribution over choice texts (equal texts are one) and "unresolved"."""
    answer = F.coalesce(F.get(choices, match_choice(F.col("text"), choices)), F.lit("unresolved"))
    counts = samples.groupBy("id", answer.alias("answer")).agg(F.count("*").alias("c"))
    grouped = counts.groupBy("id").agg(F.sort_array(F.collect_list("c")).alias("cs"), F.sum("c").alias("n"))
    return grouped.select("id", entropy_of_counts(F.col("cs"), F.col("n")).alias("entropy"), "n", F.size("cs").cast("long").alias("n_answers"))


def answer_distribution(samples: DataFrame, choices: Column) -> DataFrame:
    """(id, entropy, distribution map<string,bigint>) of the samples' answers as for discrete_entropy(), with how often each was given. An id whose samples are all without
    a text (null) has a null entropy and an empty map."""
    answer = F.when(F.col("text").isNotNull(), F.coalesce(F.get(choices, match_choice(F.col("text"), choices)), F.lit("unresolved")))
    counts = samples.groupBy("id", answer.alias("answer")).agg(F.count("*").alias("c"))
    found = F.sort_array(F.collect_list(F.when(F.col("answer").isNotNull(), F.struct("answer", "c"))))
    grouped = counts.groupBy("id").agg(found.alias("found"), F.sum(F.when(F.col("answer").isNotNull(), F.col("c"))).alias("n"))
    return grouped.select("id", F.when(F.col("n") > 0, entropy_of_counts(F.col("found")["c"], F.col("n"))).alias("entropy"), F.map_from_entries("found").alias("distribution"))


def p_true(tokens: DataFrame) -> DataFrame:
    """(id, p_true): the mass of tokens that mean yes over that of yes and no; null where there is neither."""
    word = normal_token(F.col("token"))
    mass = lambda words: F.sum(F.when(word.isin(*words), F.exp("logprob")).otherwise(0.0))
    sums = tokens.groupBy("id").agg(mass(TRUE_TOKENS).alias("t"), mass(FALSE_TOKENS).alias("f"))
    return sums.select("id", (F.col("t") / F.nullif(F.col("t") + F.col("f"), F.lit(0.0))).alias("p_true"))


def greedy_clusters(texts: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Clusters (arrays of texts) of an ordered array: each text joins the first cluster whose first member it matches both
    ways, else it opens one. K samples of one answer, so a fold over one row."""

    def step(found: Column, text: Column) -> Column:
        hits = F.filter(F.transform(found, lambda c, i: F.struct((same(c[0], text) & same(text, c[0])).alias("hit"), i.alias("i"))), lambda x: x["hit"])
        at = F.get(hits, F.lit(0))["i"]
        grown = F.transform(found, lambda c, i: F.when(i == at, F.concat(c, F.array(text))).otherwise(c))
        return F.when(at.isNull(), F.concat(found, F.array(F.array(text)))).otherwise(grown)

    return F.aggregate(texts, F.array().cast("array<array<string>>"), step)


def cluster_sizes(texts: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The sizes of greedy_clusters(): only each cluster's first member and its count are carried along."""
    kind = "array<struct<first: string, n: bigint>>"

    def step(found: Column, text: Column) -> Column:
        hit = F.array_position(F.transform(found, lambda c: F.coalesce(same(c["first"], text) & same(text, c["first"]), F.lit(False))), F.lit(True))

        def grown(at: Column) -> Column:
            more = F.transform(found, lambda c, i: F.struct(c["first"].alias("first"), (c["n"] + (i + 1 == at).cast("long")).alias("n")))
            return F.when(at > 0, more).otherwise(F.concat(found, F.array(F.struct(text.alias("first"), F.lit(1).cast("long").alias("n")))))

        return let(hit, grown)

    return F.transform(F.aggregate(texts, F.array().cast(kind), step), lambda c: c["n"])


def semantic_entropy(samples: DataFrame, same: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, n_clusters, semantic_entropy) of each id's texts in order of pos."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    clustered = samples.groupBy("id").agg(ordered.alias("texts")).select("id", F.size("texts").alias("n"), cluster_sizes(F.col("texts"), same).alias("sizes"))
    return clustered.select("id", F.size("sizes").cast("long").alias("n_clusters"), entropy_of_counts(F.col("sizes"), F.col("n")).alias("semantic_entropy"))
