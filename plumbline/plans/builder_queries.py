"""Queries on built samples and saved results, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from ..operators import builders as B
from ..operators import datasets as T
from ..operators import prompts as P
from ..sources import records as R
from ..sources import results as S
from . import views as V
from .data_queries import _POOL, _U

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


def _sql(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _run(calls):
    """A stand-in for tools."""
    out = F.md5(F.concat_ws(":", "tool", "audio"))
    parameters = F.create_map(F.lit("audio_path"), "audio", F.lit("step"), F.col("step").cast("string"))
    return calls.select("key", out.alias("output"), parameters.alias("parameters"), F.when(out.startswith("f"), "failure").otherwise("success").alias("status"))


def _attempt_sql(attempt: int, seed: int) -> str:
    """All tasks' outputs at one attempt; a call fails where its output begins with f."""
    key = f"task || '/{attempt}'"
    step = lambda k, before: f"CASE WHEN k >= {k} THEN md5(chain[{k}] || ':' || {before}) END"
    return f"""t{attempt} AS (SELECT task, floor({_U.format(text=f"'{seed}:' || {key} || ':source'")} * m)::BIGINT AS place FROM t, (SELECT count(*) AS m FROM s)), a{attempt} AS (SELECT task, source, k, o1, o2, {step(3, "o2")} AS o3, chain FROM (SELECT *, {step(2, "o1")} AS o2 FROM (SELECT *, {step(1, "source")} AS o1 FROM (
  SELECT t.task, 'part_' || s.p_partkey AS source, floor({_U.format(text=f"'{seed}:' || {key} || ':length'")} * 3 + 1)::INT AS k, list_sort([md5('{seed}:' || {key} || ':' || x) || x for x in {_POOL}]).list_transform(lambda y: substr(y, 33)) AS chain
  FROM t{attempt} AS t JOIN s USING (place)))))"""


def _built_sql(table: str, sources: str, seed: int) -> str:
    """As many samples as table has rows, from sources (p_partkey, place)."""
    return f"""WITH n AS (SELECT count(*) AS n FROM {table}), s AS ({sources}), t AS (SELECT unnest(range(4 * n)) AS task FROM n), {_attempt_sql(0, seed)}, {_attempt_sql(1, seed)},
tried AS (SELECT *, 0 AS attempt FROM a0 UNION ALL SELECT *, 1 FROM a1), good AS (SELECT * FROM tried WHERE NOT (starts_with(o1, 'f') OR coalesce(starts_with(o2, 'f'), false) OR coalesce(starts_with(o3, 'f'), false))),
best AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY task ORDER BY attempt) = 1), kept AS (SELECT * FROM best QUALIFY row_number() OVER (ORDER BY task) <= (SELECT n FROM n))
SELECT task, 'sample_' || substr(md5('{seed}:' || task), 1, 12) AS id, source AS source_audio, coalesce(o3, o2, o1) AS target_audio, k AS num_steps,
  CASE k WHEN 1 THEN 'audio_0>audio_2' WHEN 2 THEN 'audio_0>audio_2,audio_2>audio_3' ELSE 'audio_0>audio_2,audio_2>audio_3,audio_3>audio_4' END AS ids, array_to_string(chain[1:k], ',') AS tools,
  'audio_0=' || source || ',audio_1=' || coalesce(o3, o2, o1) || ',audio_2=' || o1 || CASE WHEN k > 1 THEN ',audio_3=' || o2 ELSE '' END || CASE WHEN k > 2 THEN ',audio_4=' || o3 ELSE '' END AS audios FROM kept"""


_ALL_PARTS = "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part"
_LAST_PARTS = "SELECT p_partkey, r - 1 - floor(m * (1 - 0.2)) AS place FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r, count(*) OVER () AS m FROM part) WHERE r > floor(m * (1 - 0.2))"


def _built(spark, d):
    parts = global_rank(V.table(spark, d, "part").select("p_partkey"), ["p_partkey"], "place")
    sources = parts.select((F.col("place") - 1).alias("place"), F.concat(F.lit("part_"), "p_partkey").alias("audio"))
    return B.build(V.table(spark, d, "customer").count(), sources, _POOL, 1, 3, 5, 2, _run, R.scratch_folder(spark, "samples"))


def _told(built):
    ids = F.transform("tool_calls", lambda c: F.concat_ws(">", c["parameters"]["audio_id"], c["output_audio_id"]))
    audios = F.transform(F.map_entries("audio_id_map"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return built.select("task", "id", "source_audio", "target_audio", "num_steps", F.array_join(ids, ",").alias("ids"), F.array_join(F.col("tool_calls")["tool_name"], ",").alias("tools"), F.array_join(audios, ",").alias("audios"))


@query(_built_sql("customer", _ALL_PARTS, 5))
def built_samples(spark, d):
    """One sample a customer, from chains of tools of which some fail: retried once, then replaced by further tasks."""
    return _told(_built(spark, d))


@query(_built_sql("supplier", _LAST_PARTS, 1234))
def benchmark_samples(spark, d):
    """One sample a supplier, from audios that no training sample was built from: the last fifth of them in order (a feature)."""
    pool = V.table(spark, d, "part").select("p_partkey", F.concat(F.lit("part_"), "p_partkey").alias("audio"))
    return _told(B.benchmark(V.table(spark, d, "supplier").count(), pool, "p_partkey", 0.2, _POOL, 1, 3, 1234, 2, _run, R.scratch_folder(spark, "benchmark")))


_STEP_MESSAGES = """list_transform(range(1, num_steps + 1), lambda k: 'assistant:{"tool_name": "' || string_split(tools, ',')[k] || '", "parameters": {"step": "' || k || '", "audio_id": "' || CASE k WHEN 1 THEN 'audio_0' ELSE 'audio_' || k END || '"}, "output_audio_id": "audio_' || (k + 1) || '"}|tool:Output of step ' || k || ': <audio_' || (k + 1) || '><audio>')"""


@query(f"""WITH b AS ({_built_sql("customer", _ALL_PARTS, 5)}) SELECT id, (3 + 2 * num_steps)::BIGINT AS n_messages, md5('system:Be brief.' || chr(10) || chr(10) || {_sql(P.TOOLS_BEGIN)} || 'the tools|user:From <audio_0><audio> to <audio_1><audio>, not from ' || source_audio || '|' || array_to_string({_STEP_MESSAGES}, '|') || '|assistant:{{"done": true}}') AS digest,
  array_to_string(list_transform(string_split(audios, ','), lambda a: string_split(a, '=')[2]), ',') AS audios FROM b""")
def training_samples(spark, d):
    """Built samples as conversations: tagged question, a turn for each call and its result, and the end."""
    asked = F.concat(F.lit("From "), "source_audio", F.lit(" to "), "target_audio", F.lit(", not from "), "source_audio")
    rows = T.multi_turn_rows(_built(spark, d).withColumn("question", asked), P.composed_system(F.lit("the tools"), F.lit("Be brief.")))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return rows.select("id", F.size("messages").cast("long").alias("n_messages"), F.md5(flat).alias("digest"), F.array_join("audios", ",").alias("audios"))


_WEIGHTS = {"clipping": 1.0, "denoise": 2.5, "trim_silence": 0.5, "asr": 0.0}


@query(f"""WITH i AS (SELECT p_partkey AS id, 'part_' || p_partkey AS o0, floor({_U.format(text="'6:' || p_partkey || ':length'")} * 4)::INT AS k FROM part), w(tool, w) AS (VALUES ('clipping', 1.0), ('denoise', 2.5), ('trim_silence', 0.5)),
c AS (SELECT id, o0, k, list(tool ORDER BY -ln({_U.format(text="'6:' || id || ':' || tool")}) / w) AS chain FROM i, w GROUP BY ALL),
a AS (SELECT *, CASE WHEN k >= 3 AND NOT starts_with(o1, 'f') AND NOT starts_with(o2, 'f') THEN md5(chain[3] || ':' || o2) END AS o3 FROM (SELECT *, CASE WHEN k >= 2 AND NOT starts_with(o1, 'f') THEN md5(chain[2] || ':' || o1) END AS o2 FROM (SELECT *, CASE WHEN k >= 1 THEN md5(chain[1] || ':' || o0) END AS o1 FROM c))),
g AS (SELECT *, nullif(regexp_replace(o1, '^f.*', ''), '') AS g1, nullif(regexp_replace(o2, '^f.*', ''), '') AS g2, nullif(regexp_replace(o3, '^f.*', ''), '') AS g3 FROM a)
SELECT id, o0 AS original_audio, array_to_string(chain[1:(g1 IS NOT NULL)::INT + (g2 IS NOT NULL)::INT + (g3 IS NOT NULL)::INT], ',') AS tools, concat_ws(',', g1, g2, g3) AS outputs, coalesce(g3, g2, g1, o0) AS tool_applied_audio, coalesce(starts_with(coalesce(o3, o2, o1), 'f'), false) AS failed FROM g""")
def applied_pairs(spark, d):
    """Every part's audio beside the same with up to three tools applied, drawn by weight, until one fails."""
    items = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("part_"), "p_partkey").alias("audio"))
    pairs = B.applied_pairs(items, _WEIGHTS, 0, 3, 6, _run, R.scratch_folder(spark, "pairs"))
    return pairs.select("id", "original_audio", F.array_join(F.col("tool_chain")["tool"], ",").alias("tools"), F.array_join(F.col("tool_chain")["output_path"], ",").alias("outputs"), "tool_applied_audio", "failed")


@query("""WITH e AS (SELECT event_id AS id, event_type AS tool, event_id % 6 AS k, '{"n": ' || event_id || '}' AS record, 'tool_result_' || event_type AS base FROM events)
SELECT id, base || '.txt' AS name, NULL AS source, 'said ' || id AS content FROM e WHERE k = 0 UNION ALL SELECT id, base || '.wav', '/a/' || id || '.wav', NULL FROM e WHERE k = 1 OR (k = 2 AND id % 4 = 0)
UNION ALL SELECT id, base || '_' || stem || '.flac', '/s.1/' || stem || '.flac', NULL FROM e, (VALUES ('voice'), ('rest')) v(stem) WHERE k = 3
UNION ALL SELECT id, base || '.json', NULL, CASE k WHEN 4 THEN '{"_problem": null}' ELSE substr(record, 1, length(record) - 1) || ', "_problem": {"id": ' || id || '}}' END FROM e WHERE k IN (3, 4, 5) OR (k = 2 AND id % 4 <> 0)""")
def saved_results(spark, d):
    """The files of every kind of result."""
    e, none = V.table(spark, d, "events"), F.lit(None).cast("string")
    k, wav = F.col("event_id") % 6, F.concat(F.lit("/a/"), "event_id", F.lit(".wav"))
    results = e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("tool"), F.when(k == 0, F.concat(F.lit("said "), "event_id")).alias("transcript"), F.when(k <= 1, wav).alias("clip_path"), F.when(k <= 2, wav).when(k == 5, "/a/1.txt").alias("output_path"),
        F.when(k == 3, F.create_map(F.lit("voice"), F.lit("/s.1/voice.flac"), F.lit("rest"), F.lit("/s.1/rest.flac"))).alias("separated_files"),
        F.when(k == 4, "{ }").otherwise(F.concat(F.lit('{"n": '), "event_id", F.lit("}"))).alias("record"), F.when(k != 4, F.concat(F.lit('{"id": '), "event_id", F.lit("}"))).otherwise(none).alias("problem"),
    )
    existing = e.where(F.col("event_id") % 4 == 0).select(wav.alias("path"))
    return S.result_files(results, existing)
