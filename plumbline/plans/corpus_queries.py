"""Queries on prompts, messages, tool catalogues, corpus building and validation, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import json_parse as J
from ..operators import batch_run as BR
from ..operators import corpus as K
from ..operators import events as EV
from ..operators import prompts as P
from ..operators import schedules as H
from ..sources import records as R
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


def _sql(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# Prompts ------------------------------------------------------------------------------------------------------------------

_TOKEN = _sql(P.AUDIO_TOKEN)
_OPTIONS = "role || chr(10) || 'none of them'"


@query(f"""SELECT conv_id, turn,
  md5('<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Focus on the audio clip and answer the question.' || {_TOKEN} || chr(10) || 'Question: ' || text || chr(10) || 'Choose from the following options:' || chr(10) || {_OPTIONS} || chr(10) || 'Please answer with the best choice letter and the full choice text.' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS standard,
  md5('<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || repeat({_TOKEN}, greatest(turn % 3, 1)) || chr(10) || 'Question: ' || text || chr(10) || 'Choices:' || chr(10) || {_OPTIONS} || chr(10) || 'Proposed answer: ' || role || chr(10) || 'Considering the audio, is the proposed answer correct? Respond with exactly one word: True or False.' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS verification,
  md5('<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || replace(replace(replace(replace({_sql(P.USER_TURN)}, '{{options}}', {_OPTIONS}), '{{audio}}', {_TOKEN}), '{{tool_results}}', CASE WHEN turn % 2 = 0 THEN 'No tools have been invoked yet.' ELSE 'result ' || turn END), '{{question}}', text) || 'Please answer with the best choice letter and the full choice text.' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS tool_chain FROM conversations""")
def chat_prompts(spark, d):
    """Evaluation prompts: plain, for checking an answer (with as many audios as it has, one at least), and after tools."""
    t, system = F.col("turn"), F.lit("Be brief.")
    choices = F.array(F.col("role"), F.lit("none of them"))
    results = F.when(t % 2 > 0, F.concat(F.lit("result "), t))
    prompts = {"standard": P.standard_prompt(F.col("text"), choices, system), "verification": P.verification_prompt(F.col("text"), choices, system, F.col("role"), (t % 3).cast("int")), "tool_chain": P.tool_chain_prompt(F.col("text"), choices, system, results)}
    return V.table(spark, d, "conversations").select("conv_id", "turn", *[F.md5(p).alias(n) for n, p in prompts.items()])


@query(f"""WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS tools, CASE WHEN o_orderkey % 5 = 0 THEN 'own' END AS own, o_custkey % 2 = 0 AS tuned FROM orders),
b AS (SELECT *, coalesce(own, CASE WHEN tuned THEN 'official' ELSE {_sql(P.PROTOCOL)} END) AS base FROM t)
SELECT id, md5(CASE WHEN tools <> '' THEN base || chr(10) || chr(10) || 'Available tools:' || chr(10) || tools WHEN own IS NOT NULL THEN own WHEN tuned THEN NULL ELSE {_sql(P.PROTOCOL)} END) AS system FROM b""")
def system_prompts(spark, d):
    """The system prompt of an entry: override, official or protocol, with its tools if it has any."""
    i = F.col("o_orderkey")
    tools = F.when(i % 2 == 0, "").when(i % 3 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    system = P.resolved_system(tools, F.when(i % 5 == 0, "own"), F.lit("official"), F.col("o_custkey") % 2 == 0)
    return V.table(spark, d, "orders").select(i.alias("id"), F.md5(system).alias("system"))


@query(f"""SELECT conv_id, turn, md5('{{"tool_name": ' || to_json(role) || ', "parameters": {{"n": ' || turn || '}}, "output_audio_id": "audio_' || turn || '"}}') AS call,
  md5('Output of step ' || turn || CASE WHEN turn % 2 = 0 THEN ': <audio_1>' || {_TOKEN} || ' <audio_2>' || {_TOKEN} ELSE ' (' || role || '): ' || text END) AS result,
  md5(text || chr(10) || chr(10) || 'Input audio:' || chr(10) || 'audio_0: <audio_0>' || {_TOKEN}) AS asked, md5(chr(10) || 'audio id: ' || role || chr(10) || 'audio: ' || {_TOKEN} || chr(10)) AS element FROM conversations""")
def turn_messages(spark, d):
    """A call, its result with audios or text, the user's message with its audios, and an audio's element."""
    n = F.col("turn").cast("string")
    call = P.call_message(F.col("role"), F.concat(F.lit('{"n": '), n, F.lit("}")), F.concat(F.lit("audio_"), n))
    tags = F.when(F.col("turn") % 2 == 0, F.array(P.audio_tag(F.lit("audio_1")), P.audio_tag(F.lit("audio_2")))).otherwise(F.array().cast("array<string>"))
    asked = P.user_message(F.col("text"), F.array(F.lit("audio_0")))
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.md5(call).alias("call"), F.md5(P.result_message(F.col("turn"), F.col("role"), tags, F.col("text"))).alias("result"), F.md5(asked).alias("asked"), F.md5(P.audio_element(F.col("role"))).alias("element"))


_REGISTRY = [(t, *p) for t in H.SEGMENT_TOOLS for p in (H.AUDIO, *H.SEGMENT)] + [(t, *H.AUDIO) for t in H.WHOLE_TOOLS] + H.SEGMENT_PARAMETERS + H.WHOLE_PARAMETERS
_ROWS = ", ".join(f"({_sql(t)}, {_sql(p)}, {_sql(k)}, {'NULL' if a is None else _sql(str(a))}, {r}, {_sql(P.PARAMETER_NOTES[t, p]) if (t, p) in P.PARAMETER_NOTES else 'NULL'})" for t, p, k, a, r in _REGISTRY)
_ABOUT = ", ".join(f"({_sql(t)}, {_sql(x)})" for t, x in P.DESCRIPTIONS.items())


def _configured(spark, d):
    """Every supplier's configuration as JSON text, read again, and the environments of the nations with an even number."""
    key = F.col("s_suppkey")
    flag = lambda c: F.when(c, "true").otherwise("false")
    text = F.format_string(
        '{"max_tools": 3, "tools": {"denoise": {"enabled": %s, "weight": %s, "params": {}}, "clipping": {"enabled": true}, "asr": {"enabled": %s}, "super_resolution": {"enabled": true, "env": "/envs/%s"}, "unheard_of": {"enabled": true}, "pitch_shift": {}}}',
        flag(key % 2 == 0), (key % 5).cast("string"), flag(key % 3 == 0), F.col("s_nationkey").cast("string"),
    )
    tools = K.config_tools(spark, V.table(spark, d, "supplier").select(key.alias("supplier"), text.alias("value")))
    there = V.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("/envs/"), "n_nationkey").alias("path"))
    return tools, K.available(tools, H.registry(spark), there)


_CONFIGURED = """configured AS (
  SELECT s_suppkey AS supplier, tool, weight FROM supplier, (VALUES ('denoise'), ('clipping'), ('asr'), ('super_resolution')) AS t(tool), LATERAL (SELECT CASE tool WHEN 'denoise' THEN (s_suppkey % 5)::DOUBLE ELSE 1.0 END AS weight)
  WHERE CASE tool WHEN 'denoise' THEN s_suppkey % 2 = 0 WHEN 'asr' THEN s_suppkey % 3 = 0 WHEN 'super_resolution' THEN s_nationkey % 2 = 0 AND s_nationkey IN (SELECT n_nationkey FROM nation) ELSE TRUE END
)"""


@query(f"""WITH {_CONFIGURED}, r(tool, param, kind, allowed, required, note) AS (VALUES {_ROWS}), about(tool, x) AS (VALUES {_ABOUT}),
l AS (SELECT tool, string_agg('- ' || param || ' (' || CASE kind WHEN 'timestamp' THEN 'string' ELSE kind END || '), ' || CASE WHEN required THEN 'required' ELSE 'optional' END || CASE kind WHEN 'timestamp' THEN ', format=HH:MM:SS.mmm' ELSE '' END || coalesce(', allowed=' || allowed, '') || coalesce(', ' || note, ''), chr(10) ORDER BY param) AS params FROM r GROUP BY tool), c AS (SELECT tool, tool || ': ' || x || chr(10) || 'Parameters:' || chr(10) || params AS text FROM l JOIN about USING (tool))
SELECT supplier, string_agg(text, chr(10) || chr(10) ORDER BY tool) AS tools_block, count(*) FILTER (tool <> 'asr') AS n_audio FROM configured JOIN c USING (tool) GROUP BY supplier""")
def tool_catalogue(spark, d):
    """The block of tools of each supplier's configuration, with their parameters in order, and how many of them make audio."""
    schema = H.registry(spark)
    audio = H.audio_tools(schema).withColumn("makes_audio", F.lit(1))
    known = P.catalogue(schema).join(audio, "tool", "left")
    mine = _configured(spark, d)[1].join(F.broadcast(known), "tool").groupBy("supplier")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("tool", "text"))), lambda x: x["text"])
    return mine.agg(F.array_join(texts, "\n\n").alias("tools_block"), F.count("makes_audio").alias("n_audio"))


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'residual=r.wav,target=t.wav' WHEN 1 THEN '=o.wav' WHEN 2 THEN '=c.wav' WHEN 3 THEN '=o.wav' WHEN 4 THEN '=c.wav' ELSE '' END AS outputs FROM events""")
def audio_outputs(spark, d):
    """New audios of results: separated files, else the output, else the clip; a transcript has none."""
    i = F.col("event_id") % 6
    separated = F.when(i == 0, F.create_map(F.lit("target"), F.lit("t.wav"), F.lit("residual"), F.lit("r.wav"))).when(i == 1, F.create_map().cast("map<string,string>"))
    got = P.audio_outputs(separated, F.when(i.isin(0, 1, 3), "o.wav").when(i == 2, ""), F.when(i.isin(2, 3, 4), "c.wav"))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries(got)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), flat.alias("outputs"))


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN event_type || '-isolated auxiliary audio: <a>' WHEN 1 THEN 'auxiliary audio with ' || event_type || ' removed: <a>' WHEN 2 THEN 'transcription of the audio: ' || props WHEN 3 THEN 'human voice enhanced audio: <a>' WHEN 4 THEN 'pitch-shifted audio: <a>' ELSE 'time-stretched audio: <a>' END AS said FROM events""")
def result_phrases(spark, d):
    """What is said of each tool's result."""
    tool = F.get(F.array(*map(F.lit, R.RESULT_PHRASES)), F.array_position(F.lit([0, 1, 2, 3, 4, 5]), (F.col("event_id") % 6).cast("int")).cast("int") - 1)
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), R.result_phrase(tool, F.col("event_type"), F.col("props"), "<a>").alias("said"))


@query(r"""WITH e AS (SELECT p_partkey AS event, [p_name, p_brand || ' (size ' || p_size || ')', 'manufacturer#' || p_size % 7 || '/x&y'] AS labels FROM part), l AS (SELECT event, unnest(labels) AS label FROM e),
q AS (SELECT DISTINCT 'SIZE ' || p_size AS asked FROM part UNION SELECT DISTINCT substr(p_brand, 6) FROM part UNION SELECT DISTINCT upper(p_name) FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT unnest(['#', '&', '(', '/x', 'x&y', '&y', 'manufacturer', 'facturer', '5)', '\E', 'Ü'])),
d AS (SELECT DISTINCT label FROM l), x AS (SELECT asked, label FROM q JOIN d ON lower(asked) = lower(label)),
w AS (SELECT asked, label FROM (SELECT asked FROM q WHERE asked NOT IN (SELECT asked FROM x)) JOIN d ON regexp_matches(label, '(?i)\b' || regexp_escape(asked) || '\b'))
SELECT asked, count(DISTINCT event) AS n, min(event) AS first FROM (SELECT * FROM x UNION ALL SELECT * FROM w) JOIN l USING (label) GROUP BY asked""")
def event_lookup(spark, d):
    """Labels asked for, among them parts of words and signs, and the events that have them."""
    p = V.table(spark, d, "part")
    events = p.select(F.col("p_partkey").alias("event"), F.array("p_name", F.concat("p_brand", F.lit(" (size "), "p_size", F.lit(")")), F.concat(F.lit("manufacturer#"), F.col("p_size") % 7, F.lit("/x&y"))).alias("label"))
    signs = spark.createDataFrame([(x,) for x in ("#", "&", "(", "/x", "x&y", "&y", "manufacturer", "facturer", "5)", "\\E", "Ü")], "label string")
    asked = p.select(F.explode(F.array(F.concat(F.lit("SIZE "), "p_size"), F.substring("p_brand", 6, 9), F.upper("p_name"), F.get(F.split("p_name", " "), F.lit(1)))).alias("label")).union(signs)
    return EV.lookup(asked, events).groupBy("asked").agg(F.count("*").alias("n"), F.min("event").alias("first"))


# Parsing and validation ---------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS k, '{"q": ' || to_json(text) || '}' AS p FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0 END::BIGINT AS n_calls, CASE WHEN k < 4 THEN CASE k WHEN 1 THEN '{}' ELSE md5(p) END END AS first, k IN (0, 4, 5, 6) AS turn_parses, (k < 5)::INT AS well_formed FROM t""")
def parsed_calls(spark, d):
    """Calls in model output: plain, fenced, as a list, amid prose; empty; with one bad call; another object; cut off."""
    k, text = (F.col("conv_id") + F.col("turn")) % 8, F.col("text")
    p = F.concat(F.lit('{"q": '), P.quoted(text), F.lit("}"))
    call = F.concat(F.lit('{"tool_name": "a", "parameters": '), p, F.lit("}"))
    plain = F.concat(F.lit('{"tool_calls": ['), call, F.lit(', {"tool_name": "b"}]}'))
    said = (
        F.when(k == 0, plain).when(k == 1, 'so ```json\n{"tool_calls": [{"tool_name": "b"}]}\n``` it is').when(k == 2, F.concat(F.lit("["), call, F.lit("]")))
        .when(k == 3, F.concat(F.lit('I say {"tool_calls": ['), call, F.lit(']} and "}" more'))).when(k == 4, '{"tool_calls": []}').when(k == 5, F.concat(F.lit('{"tool_calls": ['), call, F.lit(', {"name": 1}]}')))
        .when(k == 6, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).otherwise(F.substring(plain, F.lit(1), F.length(plain) - 1))
    )
    read = V.table(spark, d, "conversations").select("conv_id", "turn", J.extract_calls(said).alias("calls"), J.parse_turn(said).alias("parsed"))
    first = F.get("calls", F.lit(0))["parameters"]
    return read.select("conv_id", "turn", F.when(F.col("calls").isNotNull(), F.size("calls")).cast("long").alias("n_calls"), F.when(first == "{}", first).otherwise(F.md5(first)).alias("first"), F.col("parsed").isNotNull().alias("turn_parses"), F.col("calls").isNotNull().cast("int").alias("well_formed"))


_ENTRIES = [
    '[{"question": "q", "choice": ["a"], "answer": "a", "id": "1", "audio_path": "x.wav"}, [{"tool": "denoise", "parameters": {"audio_path": "x.wav", "audio_begin": "00:00:00.000", "audio_end": "00:00:05.500", "algorithm": "wiener"}}]]',
    '[{"question": "q", "choice": "a", "answer": "a", "id": "1"}, []]',
    '[{"question": "q", "choice": ["a"], "answer": "a", "id": "1", "audio_path": "x.wav"}]',
    '"no entry"',
    '[7, {"tool": "asr"}]',
    '[{"question": "q", "choice": [], "answer": "a", "id": "1", "audio_path": "x.wav"}, [3, {"parameters": {}}, {"tool": 5}, {"tool": "pitch_shift", "parameters": {}}, {"tool": "asr", "parameters": [1]}]]',
    '[{"question": "q", "choice": ["a"], "answer": "a", "id": "1", "audio_path": "x.wav"}, [{"tool": "asr", "parameters": {"audio_path": 1, "audio_begin": "00:00:00", "volume": 3}}, {"tool": "denoise", "parameters": {"audio_path": "x.wav", "audio_begin": "00:00:00.0", "audio_end": "00:00:01.0", "algorithm": null}}]]',
]
#: What the seven entries have wrong, counted by hand: none; a key missing, a choice that is no list, no calls; one element; no list;
#: metadata and calls of the wrong kind; a call that is none, a tool missing, a tool of the wrong kind with parameters missing, an unknown tool,
#: parameters of the wrong kind; audio_end missing, an audio_path that is no text, a time without fraction, volume, and an algorithm that is null.
_WRONG = [0, 3, 1, 1, 2, 6, 5]


@query(f"""WITH e AS (SELECT user_id, {_WRONG}[event_id % 7 + 1] AS wrong FROM events) SELECT user_id::VARCHAR AS source, count(*) AS entries, count(*) FILTER (wrong > 0) AS bad_entries, sum(wrong)::BIGINT AS errors FROM e GROUP BY 1""")
def schedule_validation(spark, d):
    """Whole schedules: entries, bad entries and errors of each, over all kinds of faults."""
    entry = F.get(F.array(*map(F.lit, _ENTRIES)), (F.col("event_id") % 7).cast("int"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("event_id", entry.alias("text")))), lambda x: x["text"])
    texts = V.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("source")).agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("value"))
    return H.validation_totals(H.entry_errors(H.entries(texts), H.schedule_registry(spark)))


#: What is said of the seven entries, written by hand.
_SAID = [
    "",
    "entry[0].metadata: metadata missing required keys: ['audio_path'];entry[0].metadata: metadata 'choice' must be a list;entry[0].tool_calls: list is empty",
    "entry[0]: must have exactly 2 elements, got 1",
    "entry[0]: must be a 2-element list, got text",
    "entry[0].metadata: metadata must be a dict, got number;entry[0].tool_calls: must be a list, got object",
    "entry[0]: tool_call[0]: must be a dict, got number;entry[0]: tool_call[1]: missing 'tool' key;entry[0]: tool_call[2]: 'tool' must be a string, got number;entry[0]: tool_call[2]: missing 'parameters' key;"
    "entry[0]: tool_call[3]: unknown tool 'pitch_shift';entry[0]: tool_call[4](tool=asr): 'parameters' must be a dict, got list",
    "entry[0]: tool_call[0](tool=asr): Missing required parameters: ['audio_end'];entry[0]: tool_call[0](tool=asr): 'audio_begin' timestamp format error: 00:00:00;entry[0]: tool_call[0](tool=asr): Parameter 'audio_path' must be a string;"
    "entry[0]: tool_call[0](tool=asr): Unexpected parameter: 'volume';entry[0]: tool_call[1](tool=denoise): Parameter 'algorithm' must be a string",
]


@query(f"SELECT event_id::VARCHAR AS source, 0::BIGINT AS entry, [{', '.join(_sql(x) for x in _SAID)}][event_id % 7 + 1] AS messages FROM events")
def schedule_messages(spark, d):
    """What is wrong with each entry, in words: a schedule of one entry for each event."""
    entry = F.get(F.array(*map(F.lit, _ENTRIES)), (F.col("event_id") % 7).cast("int"))
    texts = V.table(spark, d, "events").select(F.col("event_id").cast("string").alias("source"), F.concat(F.lit("["), entry, F.lit("]")).alias("value"))
    return H.entry_messages(H.entries(texts), H.schedule_registry(spark)).select("source", F.col("entry").cast("long").alias("entry"), F.array_join("messages", ";").alias("messages"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, CASE WHEN event_type <> 'error' THEN event_type || '_' || event_id || '.wav' END AS output, CASE WHEN event_type = 'error' THEN 'no such tool: error' END AS message FROM events")
def tool_batch_run(spark, d):
    """Calls run in batches of one tool; a tool that raises fails its batch and no other."""

    def run(calls: list[dict]) -> list[dict]:
        if calls[0]["tool"] == "error":
            raise ValueError("no such tool: error")
        return [{"output": f"{c['tool']}_{c['id']}.wav"} for c in calls]

    calls = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), F.floor(F.col("event_id") / 500).alias("batch"))
    return H.run_batches(calls, run, "id long, tool string, batch long, status string, output string, message string").select("id", "status", "output", "message")


_ORDERED = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""WITH s AS (SELECT user_id::VARCHAR AS id, {_ORDERED} AS step, event_type AS tool, event_id % 13 = 0 AS bad, event_id FROM events),
r AS (SELECT *, CASE WHEN bad THEN 'error' WHEN tool = 'error' THEN 'failure' ELSE 'success' END AS status, CASE WHEN bad OR tool = 'view' THEN 1 ELSE 2 END AS attempt FROM s)
SELECT id, string_agg(tool, ',' ORDER BY step) AS tool_chain, string_agg(status, ',' ORDER BY step) AS statuses, string_agg(attempt::VARCHAR, ',' ORDER BY step) AS attempts, coalesce(string_agg(tool || ' ' || step, ',' ORDER BY step) FILTER (status = 'success'), '') AS texts FROM r GROUP BY id""")
def batch_transaction(spark, d):
    """A schedule run in two attempts, the first for one tool alone, and the summary of what both did."""
    e = V.table(spark, d, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = e.select(F.col("user_id").cast("string").alias("id"), order.alias("step"), F.col("event_type").alias("tool"), F.lit("{}").alias("parameters"), (F.col("event_id") % 13 != 0).alias("well_formed"))

    def run(calls: list[dict]) -> list[dict]:
        if calls[0]["tool"] == "error":
            raise ValueError("no such tool: error")
        return [{"text": f"{c['tool']} {c['step']}", "files": []} for c in calls]

    folder = R.scratch_folder(spark, "batch")
    BR.run(steps, run, folder, only_tool="view")
    BR.run(steps, run, folder)
    joined = lambda part: F.array_join(F.transform("results", part), ",")
    texts = F.array_join(F.array_compact(F.transform("results", lambda r: r["text"])), ",")
    return BR.summary(steps, BR.manifest(spark, folder)).select("id", F.array_join("tool_chain", ",").alias("tool_chain"), joined(lambda r: r["status"]).alias("statuses"), joined(lambda r: r["attempt"].cast("string")).alias("attempts"), texts.alias("texts"))


# Corpora ------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_type AS category, p_size::BIGINT AS seconds FROM part WHERE p_size <= 30 AND p_partkey % 3 = 1 AND p_brand = 'Brand#13'")
def admitted_items(spark, d):
    """One audio, at most thirty seconds, one corpus; columns renamed."""
    audios = F.array_repeat(F.lit("a.wav"), (F.col("p_partkey") % 3).cast("int"))
    parts = K.admitted(V.table(spark, d, "part"), audios, F.col("p_size"), p_brand="Brand#13").select("p_partkey", "p_type", F.col("p_size").cast("long").alias("p_size"))
    return K.renamed(parts, {"p_partkey": "id", "p_type": "category", "p_size": "seconds", "absent": "x"})


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")
def first_items(spark, d):
    """A look at the first seven (a feature)."""
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (-F.col("s_acctbal")).alias("__order"))
    return K.first_items(s, 7, "__order", "id").drop("__order")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN '/in/' || s_nationkey ELSE '/root' END || '/' || s_suppkey || '.wav' AS path, CASE WHEN s_suppkey % 3 = 0 THEN '/b/Y' || s_suppkey WHEN s_suppkey % 3 = 1 THEN '/a/' || s_suppkey END AS first FROM supplier")
def located_files(spark, d):
    """An item's file beside it or under the root; a corpus's file by id, with or without the letter before it, the first of several."""
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.col("s_suppkey"), F.lit(".wav")).alias("name"), F.concat(F.lit("/in/"), "s_nationkey").alias("folder"))
    i = F.col("id")
    files = s.select(F.when(i % 2 == 0, F.concat("folder", F.lit("/"), "name")).otherwise(F.concat(F.lit("/root/"), "name")).alias("path"))
    listed = s.where(i % 3 == 0).select(F.concat(F.lit("Y"), i).alias("stem"), F.concat(F.lit("/b/Y"), i).alias("path"))
    listed = listed.unionByName(s.where(i % 3 == 1).select(i.cast("string").alias("stem"), F.explode(F.array(F.concat(F.lit("/c/"), i), F.concat(F.lit("/a/"), i))).alias("path")))
    found = K.first_match(s.select(i.cast("string").alias("id")), listed).select(i.cast("long").alias("id"), F.col("path").alias("first"))
    return K.located(s, files, F.col("folder"), "/root").select("id", "path").join(found, "id", "left")


@query("SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def manifest_join(spark, d):
    """Items with what a manifest says of them; one that isn't in it would be an error."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    m = V.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return K.with_manifest(o, m, "key").select("id", "name")


@query(f"WITH {_CONFIGURED} SELECT * FROM configured")
def configured_tools(spark, d):
    """The tools of each supplier's configuration that are enabled, known, and whose environment is there."""
    tools, there = _configured(spark, d)
    return there.join(tools, ["supplier", "tool"]).select("supplier", "tool", "weight")


@query("SELECT DISTINCT unnest(string_split(p_type, ' ')) AS label FROM part")
def label_list(spark, d):
    return K.label_list(V.table(spark, d, "part").select(F.split("p_type", " ").alias("labels")), "labels")


@query("SELECT count(*) AS items, max(n)::INT AS longest, count(*) FILTER (failed) AS failed FROM (SELECT user_id, count(*) AS n, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1)")
def chain_totals(spark, d):
    """Items, the longest chain, and how many failed."""
    runs = V.table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("calls"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    return K.chain_totals(runs, "calls", "failed")


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def all_items(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return K.all_items(c, V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


# Sources and sinks --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderstatus AS tool, o_totalprice AS price, 'é' || o_orderpriority AS note, 2 AS files FROM orders")
def json_round_trip(spark, d):
    """Rows written as JSON lines, one folder for each tool, then more of them appended, and all read back as they were."""
    folder = R.scratch_folder(spark, "round-trip")
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("tool"), F.col("o_totalprice").alias("price"), F.concat(F.lit("é"), "o_orderpriority").alias("note"))
    R.write_by(o.where("id % 2 = 0"), f"{folder}/by", "tool")
    R.append_results(o.where("id % 4 = 1"), f"{folder}/done")
    R.append_results(o.where("id % 4 = 3"), f"{folder}/done")
    schema = "id long, tool string, price double, note string"
    by = R.json_lines(spark, f"{folder}/by", schema)
    return by.unionByName(R.json_lines(spark, f"{folder}/done", schema)).withColumn("files", F.lit(2))


@query("SELECT n_nationkey AS id, 'n' || n_name AS question, [n_name, 'other'] AS choice, 'entries' AS kind FROM nation UNION ALL SELECT n_nationkey, 'n' || n_name, [n_name, 'other'], 'items' FROM nation")
def json_array_files(spark, d):
    """Files of one JSON array each, written a region at a time, read as items, and again by the reader that insists on a list."""
    folder = R.scratch_folder(spark, "arrays")
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("n"), "n_name").alias("question"), F.array("n_name", F.lit("other")).alias("choice"), F.col("n_regionkey").alias("region"))
    R.write_arrays(n, folder, "region", "id")
    schema = "id int, question string, choice array<string>"
    items = R.json_arrays(spark, f"{folder}/*", schema).select("id", "question", "choice", F.lit("items").alias("kind"))
    return items.unionByName(R.checked_arrays(spark, f"{folder}/*", schema).withColumn("kind", F.lit("entries")))
