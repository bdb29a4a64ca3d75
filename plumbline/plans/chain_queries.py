"""Queries on step logs and tool-call chains, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains as C
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


def _round(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


_ENDED = "ended AS (SELECT *, coalesce(max((status <> 'ok')::INT) OVER (PARTITION BY sample ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM steps)"


@query(f"WITH {V.STEPS_SQL}, {_ENDED} SELECT sample, step, tool, status FROM ended WHERE over_ = 0")
def step_replay(spark, d):
    """Runs cut at their first terminal step, which stays."""
    return C.replay(V.steps(spark, d), F.col("status") != "ok").select("sample", "step", "tool", "status")


_REASONS = f"""{V.STEPS_SQL}, marked AS (
  SELECT *, CASE WHEN status = 'done' THEN 'done' WHEN tool NOT IN ('click', 'view', 'purchase', 'error') THEN 'disallowed_tool'
    WHEN row_number() OVER (PARTITION BY sample, tool, params ORDER BY step) > 1 THEN 'repeated_call' WHEN status = 'tool_execution_failed' THEN 'tool_execution_failed' WHEN step >= 8 THEN 'max_steps' END AS reason
  FROM steps
), cut AS (
  SELECT * FROM (SELECT *, coalesce(max((reason IS NOT NULL)::INT) OVER (PARTITION BY sample ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM marked) WHERE over_ = 0
), runs AS (SELECT sample, coalesce(max(reason), 'max_steps') AS stop_reason, count(*) AS n_steps FROM cut GROUP BY sample)"""


@query(f"WITH {_REASONS} SELECT * FROM runs")
def stop_reasons(spark, d):
    """Why each run stopped: done, disallowed tool, repeated call, failure, or the budget."""
    return C.stop_reasons(V.steps(spark, d), ["click", "view", "purchase", "error"])


@query(f"WITH {_REASONS} SELECT stop_reason, count(*) AS n FROM runs GROUP BY stop_reason")
def stop_reason_counts(spark, d):
    return stop_reasons(spark, d).groupBy("stop_reason").agg(F.count("*").alias("n"))


@query(f"WITH {V.STEPS_SQL} SELECT sample, step, row_number() OVER (PARTITION BY sample, tool, params ORDER BY step) > 1 AS repeated FROM steps")
def repeated_calls(spark, d):
    s = V.steps(spark, d)
    return s.select("sample", "step", C.repeated(s).alias("repeated"))


@query(f"WITH {V.CALLS_SQL} SELECT id, least(count(*) + 2, 8)::BIGINT AS budget FROM calls GROUP BY id")
def step_budget(spark, d):
    return V.calls(spark, d).groupBy("id").agg(C.step_budget(F.count("*")).alias("budget"))


@query(f"WITH {V.CALLS_SQL} SELECT id, pos, CASE pos WHEN 1 THEN 'audio_0' ELSE 'audio_' || pos END AS input_id, 'audio_' || (pos + 1) AS output_id FROM calls")
def chain_ids(spark, d):
    return C.assign_ids(V.calls(spark, d).select("id", "pos")).select("id", "pos", "input_id", "output_id")


@query(f"WITH {V.STEPS_SQL} SELECT sample, step, coalesce(last_value(CASE WHEN status = 'ok' THEN 'out_' || step END IGNORE NULLS) OVER (PARTITION BY sample ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'audio_0') AS input FROM steps")
def last_produced_input(spark, d):
    """Steps read the latest output before them; failed steps produce none."""
    s = V.steps(spark, d)
    made = F.when(F.col("status") == "ok", F.concat(F.lit("out_"), "step"))
    return s.select("sample", "step", C.last_produced(s, made, "audio_0").alias("input"))


@query(f"WITH {V.CALLS_SQL} SELECT id, string_agg(gt, '>' ORDER BY pos DESC) AS recovery FROM calls GROUP BY id")
def recovery_order(spark, d):
    """A recovery undoes the last disturbance first."""
    return C.sequences(V.calls(spark, d)).select("id", F.array_join(F.reverse("gt"), ">").alias("recovery"))


@query(f"WITH {V.CALLS_SQL}, chains AS (SELECT id, count(*) AS length, bool_or(NOT ok) AS failed FROM calls GROUP BY id), turns AS (SELECT unnest(range(1, (SELECT max(length) FROM chains) + 1)) AS turn) SELECT turn, count(id) FILTER (length >= turn AND NOT failed) AS live FROM turns LEFT JOIN chains ON TRUE GROUP BY turn")
def turn_frontier(spark, d):
    """How many chains have work at each turn, failed ones out."""
    chains = V.calls(spark, d).groupBy("id").agg(F.count("*").alias("length"), F.max((~F.col("ok")).cast("int")).alias("f")).withColumn("failed", F.col("f") == 1)
    at = chains.select("length", "failed", F.explode(F.sequence(F.lit(1).cast("long"), "length")).alias("turn"))
    return at.groupBy("turn").agg(F.count_if(C.frontier(at, F.col("turn"))).alias("live"))


_SEQ = f"""{V.CALLS_SQL}, seqs AS (
  SELECT id, list(gt ORDER BY pos) AS gt, coalesce(list(pred ORDER BY pos) FILTER (pred IS NOT NULL), []) AS pred, coalesce(list(pred ORDER BY pos) FILTER (pred IS NOT NULL AND ok), []) AS done FROM calls GROUP BY id
), both_ AS (
  SELECT id, sum(least(g, p))::BIGINT AS n FROM (SELECT id, t, count(*) FILTER (side = 1) AS g, count(*) FILTER (side = 2) AS p FROM (SELECT id, unnest(gt) AS t, 1 AS side FROM seqs UNION ALL SELECT id, unnest(done), 2 FROM seqs) GROUP BY id, t) GROUP BY id
), pr AS (
  SELECT s.*, len(gt) AS n_gt, len(done) AS n_done, coalesce(n / nullif(len(done), 0), 0) AS precision, coalesce(n / nullif(len(gt), 0), 0) AS recall FROM seqs s JOIN both_ USING (id)
)"""


@query(f"""WITH {_SEQ} SELECT id, gt = done AS exact, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1,
  round(len(list_intersect(list_distinct(gt), list_distinct(done))) / len(list_distinct(gt)), 6) AS coverage, list_sort(list_intersect(list_distinct(gt), list_distinct(done))) AS used,
  list_sort(list_filter(list_distinct(gt), lambda x: NOT list_contains(done, x))) AS missed, len(list_intersect(list_distinct(gt), list_distinct(done))) > 0 AS any_used, len(list_intersect(list_distinct(gt), list_distinct(done))) = len(list_distinct(gt)) AS all_used, n_gt::BIGINT AS n_gt, n_done::BIGINT AS n_done FROM pr""")
def sequence_metrics(spark, d):
    """Exact match, multiset F1 and coverage of successful calls; covers chains without any."""
    return _round(C.sequence_metrics(C.sequences(V.calls(spark, d))), "precision", "recall", "f1", "coverage")


@query(f"""WITH {_SEQ}, o AS (SELECT id, sum(least(g, p))::BIGINT AS n FROM (SELECT id, t, count(*) FILTER (side = 1) AS g, count(*) FILTER (side = 2) AS p FROM (SELECT id, unnest(gt) AS t, 1 AS side FROM seqs UNION ALL SELECT id, unnest(pred), 2 FROM seqs) GROUP BY id, t) GROUP BY id)
SELECT id, round(CASE WHEN len(pred) = 0 THEN 0 ELSE 2.0 * n / (len(pred) + len(gt)) END, 6) AS name_f1 FROM seqs JOIN o USING (id)""")
def name_f1_reward(spark, d):
    return C.sequences(V.calls(spark, d)).select("id", F.round(C.name_f1(F.col("gt"), F.col("pred")), 6).alias("name_f1"))


_POSITION = """scored AS (
  SELECT id, sum(CASE WHEN gt = pred THEN 0.3 + 0.7 * ((1 + (abs(quantity * (1 + discount) - quantity) <= greatest(0.02, 0.05 * quantity))::INT) / 3) ELSE 0 END) / count(*) AS score FROM calls GROUP BY id
)"""


def _chains(spark, d):
    c = V.calls(spark, d)
    v = lambda x: x.cast("variant")
    gt = c.select("id", "pos", F.col("gt").alias("tool"), F.create_map(F.lit("q"), v(F.col("quantity")), F.lit("mode"), v(F.col("gt"))).alias("params"))
    pred = c.where("pred is not null").select("id", "pos", F.col("pred").alias("tool"), F.create_map(F.lit("q"), v(F.col("quantity") * (1 + F.col("discount"))), F.lit("mode"), v(F.concat(F.lit(" "), F.lower("gt"))), F.lit("extra"), v(F.lit(True))).alias("params"))
    return gt, pred


@query(f"WITH {V.CALLS_SQL}, {_POSITION} SELECT id, round(score, 6) AS score FROM scored")
def position_score(spark, d):
    """Calls in place: names, and parameters of mixed types with tolerance; an extra parameter costs."""
    return _round(C.position_scores(*_chains(spark, d)), "score")


@query(f"""WITH {_SEQ}, {_POSITION}, o AS (SELECT id, sum(least(g, p))::BIGINT AS n FROM (SELECT id, t, count(*) FILTER (side = 1) AS g, count(*) FILTER (side = 2) AS p FROM (SELECT id, unnest(gt) AS t, 1 AS side FROM seqs UNION ALL SELECT id, unnest(pred), 2 FROM seqs) GROUP BY id, t) GROUP BY id)
SELECT id, round(0.7 * score + 0.3 * CASE WHEN len(pred) = 0 THEN 0 ELSE 2.0 * n / (len(pred) + len(gt)) END, 6) AS reward, round(0.2 * (len(pred) > 0)::INT + 0.8 * score, 6) AS weighted FROM seqs JOIN o USING (id) JOIN scored USING (id)""")
def composite_reward(spark, d):
    seqs = C.sequences(V.calls(spark, d)).select("id", C.name_f1(F.col("gt"), F.col("pred")).alias("names"), (F.size("pred") > 0).cast("int").alias("formed"))
    both = seqs.join(C.position_scores(*_chains(spark, d)), "id")
    return both.select("id", F.round(C.chain_reward(F.col("score"), F.col("names")), 6).alias("reward"), F.round(C.weighted_reward(F.col("formed"), F.col("score")), 6).alias("weighted"))


@query(f"""WITH {_SEQ}, {_POSITION}, o AS (SELECT id, sum(least(g, p))::BIGINT AS n FROM (SELECT id, t, count(*) FILTER (side = 1) AS g, count(*) FILTER (side = 2) AS p FROM (SELECT id, unnest(gt) AS t, 1 AS side FROM seqs UNION ALL SELECT id, unnest(pred), 2 FROM seqs) GROUP BY id, t) GROUP BY id),
r AS (SELECT id, id % 5 > 0 AS formed, score, CASE WHEN len(pred) = 0 THEN 0 ELSE 2.0 * n / (len(pred) + len(gt)) END AS names FROM seqs JOIN o USING (id) JOIN scored USING (id))
SELECT id, formed::INT::DOUBLE AS tool_format, round(formed::INT * score, 6) AS tool_accuracy, round(formed::INT * names::DOUBLE, 6) AS tool_name_f1, round(formed::INT * (0.7 * score + 0.3 * names)::DOUBLE, 6) AS tool_use FROM r""")
def named_rewards(spark, d):
    """All rewards by name; a fifth of the completions couldn't be read."""
    seqs = C.sequences(V.calls(spark, d)).select("id", (F.col("id") % 5 > 0).alias("formed"), C.name_f1(F.col("gt"), F.col("pred")).alias("names"))
    scored = seqs.join(C.position_scores(*_chains(spark, d)).withColumnRenamed("score", "sequence"), "id")
    return _round(C.rewards(scored, *C.REWARDS).select("id", *C.REWARDS), *C.REWARDS)


_RESULTS = _SEQ + """, results AS (
  SELECT id, len(pred) AS n_pred, n_done AS n_ok, n_gt, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1,
         CASE WHEN id % 5 = 0 THEN 'nan'::DOUBLE WHEN id % 7 = 0 THEN NULL ELSE (id % 100) / 100 END AS closeness, (id % 90) / 100 AS baseline FROM pr
)"""


def _results(spark, d):
    s = C.sequences(V.calls(spark, d))
    m = C.sequence_metrics(s).select("id", "f1", "n_gt", F.col("n_done").alias("n_ok")).join(s.select("id", F.size("pred").cast("long").alias("n_pred")), "id")
    close = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 100 / 100)
    return m.withColumns({"closeness": close, "baseline": F.col("id") % 90 / 100})


@query(f"WITH {_RESULTS} SELECT count(*) AS n, round(sum(n_ok) / sum(n_pred), 6) AS success_rate, round(avg(f1), 6) AS mean_f1, round(avg(closeness) FILTER (NOT isnan(closeness)), 6) AS mean_closeness, round(avg(closeness - baseline) FILTER (NOT isnan(closeness)), 6) AS mean_gain FROM results")
def evaluation_summary(spark, d):
    """Micro success rate and means without nulls and NaNs."""
    return _round(C.summary(_results(spark, d)), "success_rate", "mean_f1", "mean_closeness", "mean_gain")


@query(f"WITH {_RESULTS} SELECT n_gt, count(*) AS n, round(avg(f1), 6) AS mean_f1, CASE WHEN bool_or(isnan(closeness)) THEN 'nan'::DOUBLE ELSE round(avg(closeness), 6) END AS mean_closeness FROM results GROUP BY n_gt")
def breakdown_by_length(spark, d):
    """By truth length; a NaN makes its length's mean NaN."""
    return _round(C.breakdown(_results(spark, d), "n_gt"), "mean_f1", "mean_closeness")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS k FROM conversations)
SELECT conv_id, md5(string_agg(role || ':' || text || CASE WHEN role = 'assistant' AND i < n THEN '|tool:Output of step ' || k || ': <audio>' ELSE '' END, '|' ORDER BY i)) AS digest, count(*) FILTER (role = 'assistant' AND i < n) AS n_outputs FROM t GROUP BY conv_id""")
def training_messages(spark, d):
    """Multi-turn rows: each step's output message stands after its call."""
    folded = C.fold_messages(V.table(spark, d, "conversations"))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return folded.select("conv_id", F.md5(flat).alias("digest"), "n_outputs")
