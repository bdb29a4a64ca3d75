"""Queries on predictions and uncertainty, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import predictions as P
from ..operators import uncertainty as U
from . import views as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return add


def merged(spark, d):
    return P.merge(V.predictions_a(spark, d), V.predictions_b(spark, d))


_CELLS = """count(*) AS n, count(*) FILTER (common) AS n_common, count(*) FILTER (common AND coalesce(correct1, FALSE) AND coalesce(correct2, FALSE)) AS both_right,
  count(*) FILTER (common AND coalesce(correct1, FALSE) AND NOT coalesce(correct2, FALSE)) AS only_first, count(*) FILTER (common AND NOT coalesce(correct1, FALSE) AND coalesce(correct2, FALSE)) AS only_second,
  count(*) FILTER (common AND NOT coalesce(correct1, FALSE) AND NOT coalesce(correct2, FALSE)) AS both_wrong, count(*) FILTER (kept_from = 'file2') AS from_second, round(avg(correct::INT), 6) AS accuracy"""


@query(f"""WITH {V.PREDICTIONS_SQL}, named AS (SELECT k.*, coalesce(nullif(category, ''), '(none)') AS category FROM kept k LEFT JOIN categories USING (id)),
t AS (SELECT 'Overall' AS category, {_CELLS} FROM named UNION ALL SELECT category, {_CELLS} FROM named GROUP BY category)
SELECT *, round(both_right / nullif(n_common, 0), 6) AS both_right_share, round(only_first / nullif(n_common, 0), 6) AS only_first_share,
       round(only_second / nullif(n_common, 0), 6) AS only_second_share, round(both_wrong / nullif(n_common, 0), 6) AS both_wrong_share FROM t""")
def flagship_confusion(spark, d):
    """Merge two runs by confidence; confusion and accuracy overall and by category. Covers null confidences, one-sided ids, empty categories."""
    return P.confusion(P.with_category(merged(spark, d), V.categories(spark, d)))


@query(f"WITH {V.PREDICTIONS_SQL} SELECT id, kept_from, reason, correct, idx, row_number() OVER (ORDER BY idx, id) AS place FROM kept")
def merge_decisions(spark, d):
    """Every id's decision, with its place in the merged order (index, missing as 0; ties by id)."""
    from ..functions.ranks import global_rank

    rows = merged(spark, d).select("id", "kept_from", "reason", "correct", "idx")
    return global_rank(rows, ["idx", "id"], "place")


@query(f"WITH {V.PREDICTIONS_SQL} SELECT 'first' AS run, round(avg(coalesce(correct, FALSE)::INT), 6) AS accuracy, count(*) AS n FROM a UNION ALL SELECT 'second', round(avg(coalesce(correct, FALSE)::INT), 6), count(*) FROM b UNION ALL SELECT 'merged', round(avg(correct::INT), 6), count(*) FROM kept")
def run_accuracy(spark, d):
    parts = {"first": V.predictions_a(spark, d), "second": V.predictions_b(spark, d), "merged": merged(spark, d)}
    outs = [df.agg(F.lit(n).alias("run"), F.round(P.accuracy(F.col("correct")), 6).alias("accuracy"), F.count("*").alias("n")) for n, df in parts.items()]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@query(f"WITH {V.PREDICTIONS_SQL} SELECT a.id, a.correct = b.correct AS agree FROM a JOIN b USING (id)")
def common_predictions(spark, d):
    a, b = V.predictions_a(spark, d), V.predictions_b(spark, d)
    return a.join(b.select("id", F.col("correct").alias("other")), "id").select("id", (F.col("correct") == F.col("other")).alias("agree"))


@query(f"WITH {V.PREDICTIONS_SQL} SELECT 'common' AS part, id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'only first', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'only second', id FROM (SELECT id FROM b EXCEPT SELECT id FROM a)")
def id_overlap(spark, d):
    a, b = V.predictions_a(spark, d).select("id"), V.predictions_b(spark, d).select("id")
    name = lambda df, n: df.select(F.lit(n).alias("part"), "id")
    return name(a.intersect(b), "common").unionByName(name(a.exceptAll(b), "only first")).unionByName(name(b.exceptAll(a), "only second"))


@query(f"WITH {V.PREDICTIONS_SQL} SELECT kept_from, count(*) FILTER (correct) AS \"right\", count(*) FILTER (NOT correct) AS wrong FROM kept GROUP BY kept_from")
def selection_breakdown(spark, d):
    return P.selection_breakdown(merged(spark, d))


@query(f"WITH {V.PREDICTIONS_SQL} SELECT a.id, idx FROM a WHERE id NOT IN (SELECT id FROM b)")
def resume_pending(spark, d):
    """Items of the first run without a result in the second."""
    return P.pending(V.predictions_a(spark, d).select("id", "idx"), V.predictions_b(spark, d))


@query("SELECT conv_id, turn, role, length(text)::BIGINT AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_wins(spark, d):
    """Duplicate ids: the later row replaces the earlier ones."""
    return P.last_by(V.table(spark, d, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


_LETTERS = """pairs AS (
  SELECT nullif(regexp_extract(upper(chr(65 + (n_chars % 5)::INT) || '. x'), '^\\s*([A-Da-d])[.\\s]', 1), '') AS truth,
         nullif(upper(regexp_extract(CASE WHEN n_chars % 3 = 0 THEN ' ' ELSE '' END || chr(97 + (doc_id % 5)::INT) || ' ' || source, '^\\s*([A-Da-d])[.\\s]', 1)), '') AS pred
  FROM documents
)"""


def _letter_pairs(spark, d):
    docs = V.table(spark, d, "documents")
    truth = scalar.option_letter(F.concat(F.char(65 + F.col("n_chars") % 5), F.lit(". x")))
    said = F.concat(F.when(F.col("n_chars") % 3 == 0, " ").otherwise(""), F.char(97 + F.col("doc_id") % 5), F.lit(" "), F.col("source"))
    return docs.select(truth.alias("truth"), scalar.option_letter(said).alias("pred"))


@query(f"WITH {_LETTERS}, labels_ AS (SELECT truth AS label FROM pairs WHERE truth IS NOT NULL UNION SELECT pred FROM pairs WHERE pred IS NOT NULL) SELECT x.label AS truth, y.label AS pred, (SELECT count(*) FROM pairs p WHERE p.truth = x.label AND p.pred = y.label) AS n FROM labels_ x CROSS JOIN labels_ y")
def label_confusion(spark, d):
    """The dense grid of option letters; answers without a letter count for nothing."""
    return P.label_confusion(_letter_pairs(spark, d))


@query(f"WITH {_LETTERS} SELECT count(*) AS n, round(avg((truth = pred)::INT), 6) AS agreement FROM pairs WHERE truth IS NOT NULL AND pred IS NOT NULL")
def label_agreement(spark, d):
    return P.label_agreement(_letter_pairs(spark, d))


@query(r"""WITH t AS (SELECT doc_id AS id, text AS prediction, CASE WHEN doc_id % 11 = 0 THEN 'N/A' WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN NULL ELSE chr(9) || ' ' || substr(text, 1 + doc_id % 7, 3) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN chr(160) ELSE '' END END AS answer FROM documents)
SELECT id, coalesce(answer <> 'N/A' AND contains(prediction, regexp_replace(answer, '^[\s\v\x{a0}]+|[\s\v\x{a0}]+$', '', 'g')), FALSE) AS correct FROM t""")
def answer_correctness(spark, d):
    """Substring correctness over whole texts; covers the missing, the empty and the null answer, and white space of many kinds."""
    i = F.col("doc_id")
    answer = F.when(i % 11 == 0, "N/A").when(i % 13 == 0, "").when(i % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("\t "), F.substr("text", (1 + i % 7).cast("int"), F.lit(3)), F.lit("\n"), F.when(i % 3 == 0, "\u00a0").otherwise("")))
    return V.table(spark, d, "documents").select(i.alias("id"), scalar.is_correct(answer, F.col("text")).alias("correct"))


CHOICES = ["click", "Purchase", "view", "view"]
_MATCH = r"""matched AS (
  SELECT *, nullif(regexp_extract(trim(text), '^\s*\(?([A-Za-z])\)?\s*[\.\):,-]', 1), '') AS letter, ['click', 'Purchase', 'view', 'view'] AS choices FROM {src}
), resolved AS (
  SELECT *, CASE WHEN letter IS NOT NULL AND ascii(upper(letter)) - 65 < 4 THEN ascii(upper(letter)) - 65
    ELSE (SELECT i - 1 FROM (SELECT unnest([1, 2, 3, 4]) AS i) WHERE instr(lower(text), lower(choices[i])) > 0 ORDER BY instr(lower(text), lower(choices[i])), i LIMIT 1) END AS choice FROM matched
)"""


def _answers(spark, d):
    s = V.samples(spark, d)
    text = F.when(F.col("tokens") % 4 == 0, F.concat(F.lit("("), F.char(65 + F.col("tokens") % 7), F.lit(") "), "text")).otherwise(F.concat(F.lit("I say "), F.upper("text"), F.lit(" then click")))
    return s.withColumn("text", text)


_ANSWERS = V.SAMPLES_SQL + ", answers AS (SELECT id, pos, CASE WHEN tokens % 4 = 0 THEN '(' || chr(65 + tokens % 7) || ') ' || text ELSE 'I say ' || upper(text) || ' then click' END AS text FROM samples)"


@query(f"WITH {_ANSWERS}, {_MATCH.format(src='answers')} SELECT pos, choice::INT AS choice FROM resolved")
def choice_match(spark, d):
    """Free answers to choice indexes: letters in and out of range, earliest substring, ties to the lower index."""
    return _answers(spark, d).select("pos", scalar.match_choice(F.col("text"), F.array(*map(F.lit, CHOICES))).cast("int").alias("choice"))


@query(f"""WITH {_ANSWERS}, {_MATCH.format(src='answers')}, counts AS (SELECT id, coalesce(choices[choice + 1], 'unresolved') AS answer, count(*) AS c FROM resolved GROUP BY 1, 2), totals AS (SELECT *, sum(c) OVER (PARTITION BY id) AS n FROM counts)
SELECT id, round(-sum(c / n * ln(c / n)), 6) + 0.0 AS entropy, max(n)::BIGINT AS n, count(*) AS n_answers FROM totals GROUP BY id""")
def discrete_entropy(spark, d):
    """Equal choice texts are one answer; what matches none is "unresolved"."""
    return U.discrete_entropy(_answers(spark, d), F.array(*map(F.lit, CHOICES))).withColumn("entropy", F.round("entropy", 6) + 0.0)


@query(f"""WITH {_ANSWERS}, {_MATCH.format(src='answers')}, counts AS (SELECT id, coalesce(choices[choice + 1], 'unresolved') AS answer, count(*) AS c FROM resolved GROUP BY 1, 2)
SELECT id, round(-sum(c / n * ln(c / n)), 6) + 0.0 AS entropy, string_agg(answer || '=' || c, ',' ORDER BY answer) AS distribution FROM (SELECT *, sum(c) OVER (PARTITION BY id) AS n FROM counts) GROUP BY id""")
def answer_distribution(spark, d):
    """The entropy of answers beside how often each was given."""
    told = F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return U.answer_distribution(_answers(spark, d), F.array(*map(F.lit, CHOICES))).select("id", (F.round("entropy", 6) + 0.0).alias("entropy"), told.alias("distribution"))


@query(f"WITH {V.SAMPLES_SQL} SELECT id, round(avg(-logprob), 6) AS predictive_entropy FROM samples GROUP BY id")
def predictive_entropy(spark, d):
    return U.predictive_entropy(V.samples(spark, d)).withColumn("predictive_entropy", F.round("predictive_entropy", 6))


@query(f"WITH {V.SAMPLES_SQL} SELECT id, round(sum(-logprob) / sum(greatest(tokens, 1)), 6) AS length_normalised_entropy FROM samples GROUP BY id")
def length_normalised_entropy(spark, d):
    return U.length_normalised_entropy(V.samples(spark, d)).withColumn("length_normalised_entropy", F.round("length_normalised_entropy", 6))


_TOKENS = "tokens_ AS (SELECT id, logprob, CASE text WHEN 'click' THEN ' Yes.' WHEN 'view' THEN '\"no\"' WHEN 'purchase' THEN 'TRUE!' ELSE text END AS token FROM samples)"


@query(f"""WITH {V.SAMPLES_SQL}, {_TOKENS}, w AS (SELECT id, exp(logprob) AS p, trim(lower(trim(token)), '.!"') AS word FROM tokens_), s AS (SELECT id, sum(CASE WHEN word IN ('yes', 'true', 'correct') THEN p ELSE 0 END) AS t, sum(CASE WHEN word IN ('no', 'false', 'incorrect') THEN p ELSE 0 END) AS f FROM w GROUP BY id)
SELECT id, round(t / nullif(t + f, 0), 6) AS p_true FROM s""")
def p_true(spark, d):
    """Tokens with case and punctuation; null where none means yes or no."""
    t = F.col("text")
    token = F.when(t == "click", " Yes.").when(t == "view", '"no"').when(t == "purchase", "TRUE!").otherwise(t)
    return U.p_true(V.samples(spark, d).withColumn("token", token)).withColumn("p_true", F.round("p_true", 6))


@query(f"""WITH RECURSIVE {V.SAMPLES_SQL}, o AS (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM samples),
fold AS (SELECT DISTINCT id, 0::BIGINT AS i, []::VARCHAR[] AS firsts, []::BIGINT[] AS ns FROM samples UNION ALL
  SELECT id, i, CASE WHEN hit > 0 THEN firsts ELSE list_append(firsts, text) END, CASE WHEN hit > 0 THEN list_transform(ns, lambda n, k: n + (k = hit)::BIGINT) ELSE list_append(ns, 1) END
  FROM (SELECT f.id, o.i, f.firsts, f.ns, o.text, coalesce(list_position(list_transform(f.firsts, lambda x: abs(length(x) - length(o.text)) <= 1), TRUE), 0) AS hit FROM fold f JOIN o ON o.id = f.id AND o.i = f.i + 1)),
done AS (SELECT id, ns, list_sum(ns) AS n FROM fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1)
SELECT id, len(ns)::BIGINT AS n_clusters, round(-list_sum(list_transform(ns, lambda c: c / n * ln(c / n))), 6) + 0.0 AS semantic_entropy FROM done""")
def semantic_entropy(spark, d):
    """Greedy clustering, with a stand-in for the entailment model under which texts of nearly one length agree: not transitive, so
    the order decides."""
    same = lambda a, b: F.abs(F.length(a) - F.length(b)) <= 1
    return U.semantic_entropy(V.samples(spark, d), same).withColumn("semantic_entropy", F.round("semantic_entropy", 6) + 0.0)


@query(f"WITH {V.PREDICTIONS_SQL}, {V.SAMPLES_SQL}, e AS (SELECT id, round(avg(-logprob), 6) AS entropy FROM samples GROUP BY id) SELECT a.id, p_true, entropy FROM a LEFT JOIN e USING (id)")
def uncertainty_join(spark, d):
    """A prediction beside its uncertainty; the struct loses the metric that isn't asked for."""
    e = U.predictive_entropy(V.samples(spark, d)).select("id", F.round("predictive_entropy", 6).alias("entropy"))
    joined = V.predictions_a(spark, d).join(e, "id", "left").select("id", F.struct("p_true", "entropy", F.lit(0).alias("num_samples")).alias("u"))
    return joined.select("id", F.col("u").dropFields("num_samples").alias("u")).select("id", "u.*")
