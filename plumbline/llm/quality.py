"""Host-level quality rules, with DataFrame functions only.

Each document is measured and judged by base rules. Failures are then aggregated by host; a host's failure rate is shrunk
towards the corpus with a beta prior fitted to all hosts by beta-binomial moments, that is, without the variance that small hosts' rates have by
chance alone. Hosts whose shrunk rate lies more than DEVIATIONS standard deviations of that prior above its mean are rejected as a
whole: what is too much follows from the corpus. Where hosts differ by no more than chance, none is rejected.
Verdicts are joined back to the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, WHITESPACE_RUN, joined_by_size, materialise

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk failure rate is over the prior's mean by so many of its standard deviations.
DEVIATIONS = 2.0
#: Rejected hosts of one broadcast (tens of megabytes).
HOSTS = 1_000_000


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs at least twice in the array."""

    def positions(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        flagged = let(by_hash, lambda s: F.filter(s, lambda x, i: F.coalesce((i > 0) & (F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        return F.sort_array(F.transform(flagged, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = let(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(positions(h), covered)))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' other columns with the base measures in place of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    no_space = F.translate(text, WHITESPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITESPACE, "")) > 0)
    words = F.array_remove(F.split(text, WHITESPACE_RUN), "")
    kept = [c for c in docs.columns if c != text_col]
    per_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    per_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.select(
        *kept,
        per_words.alias("__words"),
        F.length(no_space).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        per_lines.alias("n_dup_lines"),
    )
    return out.select(*kept, F.col("__words.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("__words.n_repeat_words").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, host_col: str, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_ok) for every non-null host; judged has base_failed.

    The prior is a beta distribution around the hosts' mean rate m. The variance v of k hosts' rates is m(1-m) (u + c (1 - u)) if u is
    the mean of 1/n over hosts and c the correlation of two failures at one host; solved for c, the prior has a strength of 1/c - 1
    pseudo-documents, at least 1. Without excess variance c is 0 and all rates shrink to m. The prior is one row, the only thing that
    the driver gets.
    """
    hosts = judged.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    k, m, v, u = hosts.agg(F.count("*"), F.avg(rate), F.var_samp(rate), F.avg(1 / F.col("n_docs"))).first()
    chance = (m or 0.0) * (1 - (m or 0.0))
    excess = (v - chance * u) / (chance * (1 - u)) if k > 1 and chance > 0 and u < 1 else 0.0
    if excess <= 0:
        return hosts.withColumn("shrunk_rate", F.lit(m).cast("double")).withColumn("host_ok", F.lit(True))
    strength = max(1.0, 1 / excess - 1)
    shrunk = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    limit = m + deviations * math.sqrt(chance / (strength + 1))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_ok", F.col("shrunk_rate") <= limit)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", deviations: float = DEVIATIONS) -> DataFrame:
    """One row per document: id_col, the measures, base_failed, host_rate, kept.

    Null text has no words and so fails. A document without a host is judged by the base rules alone. Repeated rows are
    judged each; empty input gives no rows; columns other than these three are not read.
    """
    measured = measures(docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.col(text_col).alias("__text")), "__text")
    judged = materialise(measured.withColumn("base_failed", base_failed()), "measures")
    verdicts = host_verdicts(judged, "__host", deviations).select(F.col("host").alias("__host"), F.col("shrunk_rate").alias("host_rate"), "host_ok", "n_docs")
    nowhere = judged.where("__host is null").withColumns({"host_rate": F.lit(None).cast("double"), "host_ok": F.lit(True)})
    out = joined_by_size(judged, materialise(verdicts, "hosts"), "__host", "n_docs", judged.count()).unionByName(nowhere)
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"), "host_rate")


def accepted(docs: DataFrame, text_col: str = "text", host_col: str = "source", deviations: float = DEVIATIONS) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns and nothing else."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    text, host = (names[docs.columns.index(c)] for c in (text_col, host_col))
    judged = materialise(measures(held.withColumn("__text", F.col(text)), "__text").withColumn("base_failed", base_failed()), "judged")
    bad = host_verdicts(judged.select(F.col(host).alias("__host"), "base_failed"), "__host", deviations).where("not host_ok").select(F.col("host").alias("__bad"))
    bad = materialise(bad, "rejected-hosts")
    # Texts aren't shuffled: the rejected hosts come to them, in broadcasts of bounded size.
    kept, broadcasts = judged.where("not base_failed"), -(-bad.count() // HOSTS)
    for part in range(broadcasts):
        kept = kept.join(F.broadcast(bad.where(F.pmod(F.xxhash64("__bad"), F.lit(broadcasts)) == part)), F.col(host) == F.col("__bad"), "left_anti")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its measures and verdicts."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host_rate")


#: The verdicts of documents as a CTE chain that ends in `judged`.
MEASURES_CTE = r"""
words AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM words, unnest(range(1, len(w) - 1)) AS u(i)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, w.source, len(w.w)::BIGINT AS n_words,
         length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         list_transform([list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))], lambda l: len(l) - len(list_distinct(l)))[1]::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN covered c USING (doc_id)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM based WHERE source IS NOT NULL GROUP BY source
), prior AS (
  SELECT count(*) AS c, coalesce(avg(f / n), 0) AS m, var_samp(f / n) AS v, avg(1 / n) AS u FROM hosts
), prior2 AS (
  SELECT m, CASE WHEN c > 1 AND m * (1 - m) > 0 AND u < 1 THEN (v - m * (1 - m) * u) / (m * (1 - m) * (1 - u)) ELSE 0 END AS e FROM prior
), prior3 AS (
  SELECT m, e, CASE WHEN e > 0 THEN greatest(1.0, 1 / e - 1) END AS k FROM prior2
), judged AS (
  SELECT b.*, NOT base_failed AND (e <= 0 OR coalesce((f + m * k) / (n + k) <= m + 2 * sqrt(m * (1 - m) / (k + 1)), TRUE)) AS kept
  FROM based b LEFT JOIN hosts USING (source) CROSS JOIN prior3
)"""

ORACLE = f"WITH {MEASURES_CTE} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
