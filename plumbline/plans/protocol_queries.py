"""The uncertainty protocol over the parts, with a sampler and an entailment model that follow from hashes so that SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import protocol as P
from . import views as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


CHOICES = ["red", "green", "blue", "grey"]
K, SEED = 6, 3


def items(spark, d):
    """Every part is an item; its brand is its question."""
    p = V.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("Which colour has "), "p_name", F.lit("? <|AUDIO|>")).alias("prompt"), F.array(F.concat(F.lit("/a/"), "p_partkey")).alias("audios"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_brand")).alias("question"), F.array(*map(F.lit, CHOICES)).alias("choices"), F.col("p_type").alias("prediction"),
    )


def sampler(requests):
    """A stand-in: what is said follows from seed and prompt; a check's answer from the prompt's end."""
    h = F.md5(F.concat_ws(":", "seed", "prompt"))
    digit = lambda i: F.conv(F.substring(h, i, 1), 16, 10).cast("int")
    said = F.get(F.array(*[F.lit(x) for x in ("red", " green ", "B. no idea", "it is blue", "who knows", "grey or red", "Green", "9")]), digit(1) % 8)
    n = digit(2) % 4
    tokens = F.transform(F.slice(F.array(*[F.lit(i) for i in range(3)]), F.lit(1), n), lambda i: F.struct(i.cast("string").alias("token"), (-(digit(3) + i) / 10.0).alias("logprob")))
    mark = F.md5(F.regexp_extract("prompt", r"Proposed answer: (.*)\nConsidering", 1))
    weight = lambda i: -(F.conv(F.substring(mark, i, 1), 16, 10).cast("double") + 1) / 4
    first = F.array(*[F.struct(F.lit(t).alias("token"), weight(i).alias("logprob")) for i, t in enumerate((" True", "False.", "maybe", "yes"), 1)])
    check = F.col("sample") == P.CHECK
    none = F.array().cast(P.TOKENS)
    first = F.when(F.substring(mark, 5, 1) == "0", none).otherwise(first)
    return requests.select("id", "sample", F.when(check, F.lit(" True\n")).otherwise(said).alias("text"), F.when(check, none).otherwise(tokens).alias("tokens"), F.when(check, first).otherwise(none).alias("first"))


def entails(pairs):
    """A stand-in that is neither symmetric nor transitive: a text entails those whose first letter comes before the one after its own."""
    letter = lambda c: F.ascii(F.lower(F.col(c)))
    return pairs.select("id", "pos", (letter("hypothesis") <= letter("premise") + 6).alias("entails"))


_X = "(strpos('0123456789abcdef', substr({}, {}, 1)) - 1)"
_SAID = f"""items AS (
  SELECT p_partkey AS id, 'Which colour has ' || p_name || '? <|AUDIO|>' AS prompt, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS question, md5(p_type) AS mark FROM part
), asked AS (
  SELECT id, k, question, md5((('0x' || substr(md5('{SEED}:' || id || ':' || k), 1, 8))::BIGINT & 2147483647) || ':' || prompt) AS h FROM items, range({K}) r(k)
), said AS (
  SELECT id, k, question, trim(['red', ' green ', 'B. no idea', 'it is blue', 'who knows', 'grey or red', 'Green', '9'][{_X.format("h", 1)} % 8 + 1]) AS text,
         ['red', 'green', 'green', 'blue', 'unresolved', 'grey', 'green', 'unresolved'][{_X.format("h", 1)} % 8 + 1] AS answer, least({_X.format("h", 2)} % 4, 3) AS n, {_X.format("h", 3)} AS w FROM asked
), costs AS (
  SELECT id, avg(cost) FILTER (n > 0) AS pe, sum(cost) FILTER (n > 0) / sum(n) FILTER (n > 0) AS lne, list(text ORDER BY k) AS texts FROM (SELECT *, list_sum(list_transform(range(n), lambda i: (w + i) / 10.0)) AS cost FROM said) GROUP BY id
), shares AS (
  SELECT id, -sum(c / {K} * ln(c / {K})) AS dse, string_agg(answer || '=' || c, ',' ORDER BY answer) AS dist FROM (SELECT id, answer, count(*) AS c FROM said GROUP BY ALL) GROUP BY id
), mass AS (
  SELECT id, CASE WHEN substr(mark, 5, 1) <> '0' THEN (exp(-({_X.format("mark", 1)} + 1) / 4) + exp(-({_X.format("mark", 4)} + 1) / 4)) / (exp(-({_X.format("mark", 1)} + 1) / 4) + exp(-({_X.format("mark", 4)} + 1) / 4) + exp(-({_X.format("mark", 2)} + 1) / 4)) END AS p FROM items
)"""


@query(f"""WITH {_SAID} SELECT id, {K}::BIGINT AS num_samples, array_to_string(texts, '|') AS texts, round(pe, 6) AS predictive_entropy, round(lne, 6) AS length_normalized_entropy, round(dse, 6) + 0.0 AS discrete_semantic_entropy, dist, round(p, 6) AS p_true, 'True' AS raw
FROM costs JOIN shares USING (id) JOIN mass USING (id)""")
def sampled_uncertainty(spark, d):
    """From items to all uncertainties of one model: K seeded samples and a self-check each."""
    out = P.assess(items(spark, d), sampler, K, SEED, F.lit("be brief"))
    spread = F.array_join(F.transform(F.array_sort(F.map_entries("answer_distribution")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    digits = {c: F.round(c, 6) + 0.0 for c in ("predictive_entropy", "length_normalized_entropy", "discrete_semantic_entropy", "p_true")}
    return out.withColumns(digits).select("id", F.col("num_samples").cast("long").alias("num_samples"), F.array_join("sampled_predictions", "|").alias("texts"), *digits, spread.alias("dist"), F.col("p_true_raw_response").alias("raw"))


_ENTAIL = "ascii(lower({h})) <= ascii(lower({p})) + 6"


@query(f"""WITH RECURSIVE {_SAID}, fold AS (
  SELECT id, 0::BIGINT AS k, []::VARCHAR[] AS firsts, []::VARCHAR[] AS members FROM items
  UNION ALL
  SELECT id, k + 1, CASE WHEN hit > 0 THEN firsts ELSE list_append(firsts, text) END, CASE WHEN hit > 0 THEN list_transform(members, lambda m, i: CASE WHEN i = hit THEN m || '|' || text ELSE m END) ELSE list_append(members, text) END
  FROM (SELECT f.*, s.text, coalesce(list_position(list_transform(f.firsts, lambda x: {_ENTAIL.format(p="x", h="s.text")} AND {_ENTAIL.format(p="s.text", h="x")}), TRUE), 0) AS hit FROM fold f JOIN said s ON s.id = f.id AND s.k = f.k)
), done AS (SELECT id, members, list_transform(members, lambda m: len(string_split(m, '|'))) AS ns FROM fold WHERE k = {K})
SELECT id, array_to_string(members, ' / ') AS clusters, round(-list_sum(list_transform(ns, lambda c: c / {K} * ln(c / {K}))), 6) + 0.0 AS semantic_entropy FROM done""")
def sampled_meanings(spark, d):
    """The same samples clustered by a model of pairs, in rounds over all items; the order of texts decides."""
    out = P.assess(items(spark, d), sampler, K, SEED, F.lit("be brief"), entails, check=False)
    return out.select("id", F.array_join(F.transform("semantic_clusters", lambda c: F.array_join(c, "|")), " / ").alias("clusters"), (F.round("semantic_entropy", 6) + 0.0).alias("semantic_entropy"))
