"""The driver's tables seen as evaluation data, each view with the SQL that defines the same for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, idx, correct, p_true): one prediction a document; unlabelled ones are wrong and have no p_true."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("n_chars").alias("idx"), (F.col("quality") == 1).alias("correct"),
        F.when(F.col("quality").isNotNull(), (F.col("n_chars") % 1000) / 1000).alias("p_true"),
    )


def predictions_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a second run: over the labelled documents and, with ids of their own, the pages."""
    labels, pages = table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages")
    first = labels.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") * 7).alias("idx"), (F.col("toxic") == 0).alias("correct"),
        F.when(F.col("doc_id") % 7 > 0, (F.col("doc_id") * 37 % 1000) / 1000).alias("p_true"),
    )
    second = pages.select((-1 - F.col("page_id")).alias("id"), F.lit(None).cast("long").alias("idx"), (F.length("url") % 2 == 0).alias("correct"), F.lit(None).cast("double").alias("p_true"))
    return first.unionByName(second)


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category): a document's language, where Spanish is written as the empty string."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "es", F.lit("")).otherwise(F.col("lang")).alias("category"))


PREDICTIONS_SQL = """
a AS (
  SELECT d.doc_id AS id, n_chars AS idx, quality = 1 AS correct, CASE WHEN quality IS NOT NULL THEN (n_chars % 1000) / 1000 END AS p_true
  FROM documents d LEFT JOIN labels l USING (doc_id)
), b AS (
  SELECT doc_id AS id, doc_id * 7 AS idx, toxic = 0 AS correct, CASE WHEN doc_id % 7 > 0 THEN (doc_id * 37 % 1000) / 1000 END AS p_true FROM labels
  UNION ALL SELECT -1 - page_id, NULL, length(url) % 2 = 0, NULL FROM pages
), categories AS (
  SELECT doc_id AS id, CASE WHEN lang = 'es' THEN '' ELSE lang END AS category FROM documents
), merged AS (
  SELECT coalesce(a.id, b.id) AS id,
         CASE WHEN a.id IS NULL THEN 'file2' WHEN b.id IS NULL THEN 'file1' WHEN a.p_true IS NULL AND b.p_true IS NOT NULL THEN 'file2'
              WHEN b.p_true > a.p_true + 0.1 THEN 'file2' ELSE 'file1' END AS kept_from,
         CASE WHEN b.id IS NULL THEN 'only in file1' WHEN a.id IS NULL THEN 'only in file2' ELSE 'cmp decision' END AS reason,
         a.correct AS correct1, b.correct AS correct2, a.id IS NOT NULL AND b.id IS NOT NULL AS common, a.idx AS idx1, b.idx AS idx2
  FROM a FULL JOIN b ON a.id = b.id
), kept AS (
  SELECT *, coalesce(CASE WHEN kept_from = 'file1' THEN correct1 ELSE correct2 END, FALSE) AS correct,
         coalesce(CASE WHEN kept_from = 'file1' THEN idx1 ELSE idx2 END, 0) AS idx FROM merged
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, text, logprob, tokens): sampled answers, one an event of a user, in time order."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"), (-F.col("value") / 10).alias("logprob"), F.get_json_object("props", "$.k").cast("int").alias("tokens"))


SAMPLES_SQL = "samples AS (SELECT user_id AS id, event_id AS pos, event_type AS text, -value / 10 AS logprob, CAST(json_extract_string(props, '$.k') AS INTEGER) AS tokens FROM events)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, step, tool, params, status): an agent's log, one step an event of a user in time order; an error ends a run as failed, a
    purchase as done."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    status = F.when(F.col("event_type") == "error", "tool_execution_failed").when(F.col("event_type") == "purchase", "done").otherwise("ok")
    return events.select(F.col("user_id").alias("sample"), F.row_number().over(order).alias("step"), F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").alias("params"), status.alias("status"))


STEPS_SQL = """
steps AS (
  SELECT user_id AS sample, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS tool, json_extract_string(props, '$.k') AS params,
         CASE WHEN event_type = 'error' THEN 'tool_execution_failed' WHEN event_type = 'purchase' THEN 'done' ELSE 'ok' END AS status
  FROM events
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, gt, pred, ok, params_gt, params_pred): chains of an order's lines. The prediction has the line status in place of the flag on open lines,
    lacks a chain's lines with tax 0, and its parameters stray with the discount."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.select(
        F.col("l_orderkey").alias("id"), F.row_number().over(order).alias("pos"), F.col("l_returnflag").alias("gt"),
        F.when(F.col("l_tax") == 0, F.lit(None)).when(F.col("l_linestatus") == "O", F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("pred"),
        (F.col("l_discount") < 0.09).alias("ok"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
    )


CALLS_SQL = """
calls AS (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_returnflag AS gt,
         CASE WHEN l_tax = 0 THEN NULL WHEN l_linestatus = 'O' THEN l_linestatus ELSE l_returnflag END AS pred, l_discount < 0.09 AS ok,
         l_quantity AS quantity, l_discount AS discount
  FROM lineitem
)"""
