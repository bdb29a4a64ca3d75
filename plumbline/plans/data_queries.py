"""Queries on scalar functions, sampling, schedules, logs and vectors, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vectors as X
from ..operators import disturb as D
from ..operators import sampling as M
from ..operators import schedules as H
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


def _r(x, digits: int = 6):
    return F.round(x, digits)


# Timestamps and loose equality ------------------------------------------------------------------------------------------

_STAMP = "event_id, CASE event_id % 6 WHEN 0 THEN '00:' || (event_id % 90) || ':07.5' WHEN 1 THEN '25:61:00.123456' WHEN 2 THEN '00:00:10' WHEN 3 THEN '1:02:03.' || (event_id % 1000) WHEN 4 THEN '12:34:59.0' ELSE 'x' || event_id END AS s"


def _stamps(spark, d):
    i = F.col("event_id")
    text = (
        F.when(i % 6 == 0, F.concat(F.lit("00:"), i % 90, F.lit(":07.5"))).when(i % 6 == 1, "25:61:00.123456").when(i % 6 == 2, "00:00:10")
        .when(i % 6 == 3, F.concat(F.lit("1:02:03."), i % 1000)).when(i % 6 == 4, "12:34:59.0").otherwise(F.concat(F.lit("x"), i))
    )
    return V.table(spark, d, "events").select("event_id", text.alias("s"))


@query(rf"""WITH t AS (SELECT {_STAMP} FROM events), p AS (SELECT *, string_split(s, '.') AS h, string_split(string_split(s, '.')[1], ':') AS c FROM t)
SELECT event_id, CASE WHEN len(h) = 2 AND len(c) = 3 THEN round(TRY_CAST(c[1] AS INT) * 3600 + TRY_CAST(c[2] AS INT) * 60 + TRY_CAST(c[3] AS INT) + TRY_CAST(substr(rpad(h[2], 3, '0'), 1, 3) AS INT) / 1000, 6) END AS parsed,
  regexp_full_match(s, '(2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d\.\d{{1,6}}') AS valid,
  CASE WHEN regexp_full_match(s, '\d{{1,2}}:\d{{2}}:\d{{2}}(\.\d{{1,3}})?') THEN round(TRY_CAST(c[1] AS INT) * 3600 + TRY_CAST(c[2] AS INT) * 60 + TRY_CAST(c[3] AS INT) + coalesce(TRY_CAST(rpad(h[2], 3, '0') AS INT) / 1000, 0), 6) END AS reward FROM p""")
def timestamp_dialects(spark, d):
    """The three readings of a timestamp, which differ on hours over 23, missing fractions and digits."""
    t = _stamps(spark, d)
    return t.select("event_id", _r(S.parse_timestamp(F.col("s"))).alias("parsed"), S.valid_timestamp(F.col("s")).alias("valid"), _r(S.reward_seconds(F.col("s"))).alias("reward"))


@query("""WITH t AS (SELECT event_id, value * 100 - 50 AS x FROM events UNION ALL SELECT -1, 10.0), m AS (SELECT *, greatest(0, floor((greatest(0.0, x) - 1e-6) * 1000))::BIGINT AS ms FROM t)
SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM m""")
def timestamp_format(spark, d):
    """Written a millionth early: 10 s is 00:00:09.999; negatives are 0."""
    x = V.table(spark, d, "events").select("event_id", (F.col("value") * 100 - 50).alias("x")).unionByName(spark.sql("SELECT -1L AS event_id, 10.0D AS x"))
    return x.select("event_id", S.format_timestamp(F.col("x")).alias("stamp"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price, CASE l_linenumber % 4
  WHEN 0 THEN abs(l_quantity * (1 + l_discount) - l_quantity) <= greatest(0.02, 0.05 * l_quantity)
  WHEN 1 THEN lower(trim(' ' || l_returnflag || ' ')) = lower(l_linestatus)
  WHEN 2 THEN abs(l_linenumber - (l_linenumber + 1) * l_discount) <= 0.75
  ELSE l_returnflag = 'N' END AS close FROM lineitem""")
def loose_equality(spark, d):
    """Variant values: numbers, strings, timestamps, booleans."""
    t, n, q = V.table(spark, d, "lineitem"), F.col("l_linenumber"), F.col("l_quantity")
    v = lambda x: x.cast("variant")
    stamp = lambda x: F.concat(F.lit("00:00:"), F.lpad(F.floor(x).cast("string"), 2, "0"), F.lit("."), F.lpad(_r(x % 1 * 1000, 0).cast("int").cast("string"), 3, "0"))
    pred = F.when(n % 4 == 0, v(q * (1 + F.col("l_discount")))).when(n % 4 == 1, v(F.concat(F.lit(" "), "l_returnflag", F.lit(" ")))).when(n % 4 == 2, v(stamp(n.cast("double")))).otherwise(v(F.col("l_returnflag") == "N"))
    truth = F.when(n % 4 == 0, v(q)).when(n % 4 == 1, v(F.col("l_linestatus"))).when(n % 4 == 2, v(stamp((n + 1) * F.col("l_discount")))).otherwise(v(F.lit(True)))
    return S.with_values_close(t, pred, truth, "close").select(F.col("l_orderkey").alias("id"), n.alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"), "close")


# Texts ------------------------------------------------------------------------------------------------------------------


@query(r"""SELECT conv_id, turn, md5(coalesce(nullif(regexp_extract('said ```json' || chr(10) || text || chr(10) || '``` and ```x```', '(?s)```(?:json)?\s*(.*?)\s*```', 1), ''), text)) AS body, ((length(text) - length(replace(text, 'en', ''))) / 2)::BIGINT AS n_en,
  CASE WHEN instr(text, 'e') > 0 THEN md5(substr(text, 1, instr(text, 'e') - 1) || '<audio>' || substr(text, instr(text, 'e') + 1)) ELSE md5(text) END AS tagged,
  regexp_replace(role || '_' || turn || '_' || text, '[^\p{L}\p{N}_\-]', '_', 'g') AS suffix FROM conversations""")
def text_functions(spark, d):
    """Fences, counts, first-only replacement, file-safe suffixes."""
    t = F.col("text")
    fenced = F.concat(F.lit("said ```json\n"), t, F.lit("\n``` and ```x```"))
    suffix = S.file_suffix(F.array("role", F.col("turn").cast("string"), "text"))
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.md5(S.strip_fence(fenced)).alias("body"), S.count_substring(t, "en").alias("n_en"), F.md5(S.replace_first(t, F.lit("e"), F.lit("<audio>"))).alias("tagged"), suffix.alias("suffix"))


@query("SELECT p_partkey AS id, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), nullif(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END, ''), 'none') AS path, printf('item_%03d', p_partkey::BIGINT) AS name, coalesce(p_size, 0) AS idx FROM part")
def qa_projection(spark, d):
    """First filled path, default ids, defaults for what is missing."""
    size = F.col("p_size")
    path = S.first_filled(F.when(size % 2 == 0, "").otherwise(F.col("p_brand")), F.when(size % 3 == 0, F.lit(None)).otherwise(F.col("p_type")), F.lit("none"))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"), F.format_string("item_%03d", "p_partkey").alias("name"), F.coalesce(size, F.lit(0)).alias("idx"))


@query("SELECT o_orderkey AS id, 'a=' || o_orderstatus || ',audio_path=/in/' || o_custkey AS params FROM orders")
def parameter_override(spark, d):
    """The audio path of a call is forced, its output path and audio id are dropped."""
    given = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("audio_path"), F.lit("/old"), F.lit("output_path"), F.lit("/x"), F.lit("audio_id"), F.lit("audio_3"))
    kept = F.map_filter(given, lambda k, v: ~k.isin("audio_path", "output_path", "audio_id"))
    forced = F.map_concat(kept, F.create_map(F.lit("audio_path"), F.concat(F.lit("/in/"), "o_custkey")))
    flat = F.array_join(F.transform(F.array_sort(F.map_keys(forced)), lambda k: F.concat(k, F.lit("="), F.element_at(forced, k))), ",")
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), flat.alias("params"))


@query("""WITH e AS (SELECT DISTINCT p_type AS label FROM part), q AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS label FROM part UNION SELECT lower(p_type) FROM part UNION SELECT 'nothing such'),
x AS (SELECT q.label, e.label AS hit FROM q JOIN e ON lower(q.label) = lower(e.label)), w AS (SELECT q.label, e.label AS hit FROM q JOIN e ON regexp_matches(e.label, '(?i)\\b' || regexp_escape(q.label) || '\\b'))
SELECT label, hit FROM x UNION ALL SELECT label, hit FROM w WHERE label NOT IN (SELECT label FROM x)""")
def label_lookup(spark, d):
    """Exact labels in any case; whole-word matches only for a label without an exact one. Whole words are found by joining on
    a label's first word, never by comparing all pairs."""
    types = V.table(spark, d, "part").select(F.col("p_type").alias("label")).distinct()
    asked = types.select(F.split("label", " ")[0].alias("label")).union(types.select(F.lower("label"))).union(spark.sql("SELECT 'nothing such'")).distinct()
    entries = types.select(F.col("label").alias("hit"))
    exact = asked.join(entries, F.lower("label") == F.lower("hit"))
    words = lambda c: F.filter(F.split(F.lower(c), r"\W+"), lambda x: x != "")
    by_word = entries.select("hit", F.explode(F.array_distinct(words("hit"))).alias("w"))
    rest = asked.join(exact.select("label").distinct(), "label", "left_anti").withColumn("w", F.get(words("label"), F.lit(0)))
    whole = rest.join(by_word, "w").where(F.expr(r"regexp_like(hit, concat('(?i)\\b\\Q', label, '\\E\\b'))")).select("label", "hit")
    return exact.unionByName(whole)


# Sampling -----------------------------------------------------------------------------------------------------------------

_U = "((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


@query("SELECT p_partkey AS id FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 100")
def seeded_sample(spark, d):
    """A sampling operator: 100 parts."""
    return M.sample(V.table(spark, d, "part").select(F.col("p_partkey").alias("id")), "id", 100, 7)


@query(f"SELECT p_partkey AS id FROM part WHERE p_size - 1 > 0 ORDER BY -ln({_U.format(text="'3:' || p_partkey")}) / (p_size - 1), p_partkey LIMIT 100")
def weighted_sample(spark, d):
    """A sampling operator: 100 parts by size; weight 0 is never drawn."""
    parts = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size"))
    return M.weighted_sample(parts, "id", (F.col("p_size") - 1).cast("double"), 100, 3).select("id")


@query("SELECT c_mktsegment AS segment, c_custkey AS id FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) = 1")
def first_by_segment(spark, d):
    return M.first_of_each(V.table(spark, d, "customer"), "c_mktsegment", ["c_custkey"]).select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))


@query("SELECT s_suppkey AS id, repetition::INT AS repetition FROM supplier, range(3) AS r(repetition)")
def repeated_items(spark, d):
    return M.repeat(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), 3)


_POOL = ["clipping", "denoise", "pitch_shift", "time_stretch", "trim_silence"]


@query(f"""WITH k AS (SELECT p_partkey AS id, floor({_U.format(text="'5:' || p_partkey || ':length'")} * 3 + 1)::INT AS n FROM part), t AS (SELECT id, n, unnest({_POOL}) AS tool FROM k), r AS (SELECT id, n, tool, row_number() OVER (PARTITION BY id ORDER BY md5('5:' || id || ':' || tool)) AS pos FROM t)
SELECT id, pos::INT AS pos, tool FROM r WHERE pos <= n""")
def drawn_chains(spark, d):
    """Chains of one to three distinct tools for each item."""
    return M.chains(V.table(spark, d, "part").select(F.col("p_partkey").alias("id")), "id", _POOL, 1, 3, 5)


#: Parameters of the denoise and clipping tools in a tool configuration.
TOOL_PARAMETERS = {
    "algorithm": {"kind": "choice", "values": ["spectral_subtraction", "wiener", "adaptive"]},
    "noise_factor": {"kind": "uniform", "min": 1.5, "max": 2.5, "round": 2, "only_if": {"param": "algorithm", "values": ["spectral_subtraction"]}},
    "sensitivity": {"kind": "uniform", "min": 0.3, "max": 0.7, "round": 2, "only_if": {"param": "algorithm", "values": ["adaptive"]}},
    "n_steps": {"kind": "randint", "min": -4, "max": 4},
    "mode": {"kind": "fixed", "value": "full"},
}


@query(f"""WITH u AS (SELECT p_partkey AS id, ['spectral_subtraction', 'wiener', 'adaptive'][floor({_U.format(text="'9:' || p_partkey || ':algorithm'")} * 3)::INT + 1] AS algorithm, {_U.format(text="'9:' || p_partkey || ':noise_factor'")} AS a, {_U.format(text="'9:' || p_partkey || ':sensitivity'")} AS b, {_U.format(text="'9:' || p_partkey || ':n_steps'")} AS c FROM part)
SELECT id, algorithm, CASE WHEN algorithm = 'spectral_subtraction' THEN round(1.5 + a, 2) END AS noise_factor, CASE WHEN algorithm = 'adaptive' THEN round(0.3 + (0.7 - 0.3) * b, 2) END AS sensitivity, (floor(c * 9) - 4)::INT AS n_steps, 'full' AS mode FROM u""")
def drawn_parameters(spark, d):
    """A tool's parameters by their specification, with those that depend on others."""
    drawn = M.draw_params(TOOL_PARAMETERS, 9, "id")
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id")).select("id", *[c.alias(n) for n, c in drawn.items()])


@query("SELECT o_orderkey AS id FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) > floor((SELECT count(*) FROM orders) * 0.9)")
def held_out_tail(spark, d):
    """The last tenth of the items in order (a feature: benchmarks are built from it)."""
    return M.held_out_tail(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 0.1)


@query(f"SELECT s_suppkey AS id, (floor({_U.format(text="'1:' || s_suppkey || ':template'")} * 3))::INT AS template, md5('4:' || s_suppkey) AS shuffle_key FROM supplier")
def template_choice(spark, d):
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.select("id", M.choice(1, [0, 1, 2], "id", F.lit("template")).alias("template"), M.shuffle_key(4, F.col("id")).alias("shuffle_key"))


_OPS = ["add_noise", "pad_noise", "insert_background_event", "change_speed", "change_pitch"]


def _recovered(spark, d):
    items = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(F.array(*map(F.lit, _OPS)), (F.col("p_partkey") % 5).cast("int")).alias("op"), (F.col("p_size") + 1.0).alias("duration"))
    done = D.disturb(items, 11).withColumns({"input_duration": F.col("duration"), "output_duration": F.col("duration") + F.coalesce(F.col("params.duration_sec"), F.lit(0.0)), "offset": F.least(F.col("duration"), F.col("params.onset") + 1.5)})
    return D.recover(done, 11)


@query(f"""WITH i AS (SELECT p_partkey AS id, {_OPS}[p_partkey % 5 + 1] AS op, p_size + 1.0 AS duration FROM part),
u AS (SELECT *, {_U.format(text="'11:' || id || ':strategy'")} AS s, round(greatest(0.0, duration - 0.2) * {_U.format(text="'11:' || id || ':timestamp'")}, 2) AS onset, [0.8, 0.9, 1.1, 1.25][floor({_U.format(text="'11:' || id || ':rate'")} * 4)::INT + 1] AS rate, [-5, -3, 3, 5][floor({_U.format(text="'11:' || id || ':n_steps'")} * 4)::INT + 1] AS steps,
  ['background sound', 'background sound', 'noise', 'noise', 'background sound', 'noise', 'background sound', 'background sound'][floor({_U.format(text="'11:' || id || ':label'")} * 8)::INT + 1] AS target FROM i),
w AS (SELECT *, CASE op WHEN 'add_noise' THEN ['denoise_spectral_subtraction', 'denoise_wiener', 'denoise_adaptive'] WHEN 'pad_noise' THEN ['clip_off_padding', 'trim_silence_heuristic'] WHEN 'change_speed' THEN ['inverse_time_stretch'] WHEN 'change_pitch' THEN ['inverse_pitch_shift']
  ELSE CASE WHEN greatest(onset, duration - least(duration, onset + 1.5)) >= 0.6 * duration THEN ['remove_target_by_label', 'edge_clip'] ELSE ['remove_target_by_label'] END END AS options FROM u),
p AS (SELECT *, options[floor(s * len(options))::INT + 1] AS strategy FROM w)
SELECT id, op, strategy, CASE WHEN strategy = 'inverse_time_stretch' THEN round(1.0 / rate, 6) END AS rate, CASE WHEN strategy = 'inverse_pitch_shift' THEN (-steps)::INT END AS n_steps, CASE WHEN strategy = 'remove_target_by_label' THEN target END AS target FROM p""")
def disturb_recover(spark, d):
    """Disturbances and the calls that undo them; an edge clip is only drawn where it keeps enough."""
    return _recovered(spark, d).select("id", "op", "strategy", F.col("call.rate").cast("double").alias("rate"), F.col("call.n_steps").alias("n_steps"), F.col("call.target_description").alias("target"))


@query("WITH p AS (SELECT p_partkey AS id, p_size + 1.0 AS duration, round(0.4 + 0.5 * " + _U.format(text="'2:' || p_partkey || ':clip'") + ", 3) AS f FROM part) SELECT id, round(greatest(least(duration, 0.5), duration * f), 6) AS \"end\" FROM p")
def clip_parameters(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1.0).alias("duration"))
    f = M.uniform(2, 0.4, 0.9, "id", F.lit("clip"), digits=3)
    return p.select("id", _r(F.greatest(F.least("duration", F.lit(0.5)), F.col("duration") * f)).alias("end"))


# Schedules ----------------------------------------------------------------------------------------------------------------

_TOOLS = ["denoise", "trim_silence", "clipping", "no_such_tool"]


def _schedule_calls(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    v = lambda x: F.lit(x).cast("variant") if not hasattr(x, "cast") else x.cast("variant")
    k = F.col("k")
    base = F.create_map(F.lit("audio_path"), v("a.wav"), F.lit("audio_begin"), v("00:00:00.000"))
    end = F.when(k % 5 > 0, F.create_map(F.lit("audio_end"), F.when(k % 7 == 0, v(12)).when(k % 3 == 0, v("00:00:99.0")).otherwise(v("00:00:05.500"))))
    algorithm = F.when(k % 2 == 0, F.create_map(F.lit("algorithm"), F.when(k % 4 == 0, v("wiener")).otherwise(v("magic"))))
    empty = F.create_map().cast("map<string,variant>")
    params = F.map_concat(base, F.coalesce(end, empty), F.coalesce(algorithm, empty))
    return e.select(F.col("event_id").alias("call_id"), F.get(F.array(*map(F.lit, _TOOLS)), k % 4).alias("tool"), params.alias("params"), "k")


@query("""WITH e AS (SELECT event_id AS call_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), t AS (SELECT *, ['denoise', 'trim_silence', 'clipping', 'no_such_tool'][k % 4 + 1] AS tool FROM e)
SELECT call_id, CASE WHEN tool = 'no_such_tool' THEN 1 ELSE (k % 5 = 0 OR (tool = 'denoise' AND k % 2 > 0))::INT
  + CASE WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 THEN 2 WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 2 > 0 THEN 0 WHEN tool <> 'denoise' THEN 1 WHEN k % 4 > 0 THEN 1 ELSE 0 END END::BIGINT AS errors FROM t""")
def schedule_errors(spark, d):
    """Errors of each call against its tool's schema: missing, unexpected, mistyped, bad timestamps and values."""
    return H.parameter_errors(_schedule_calls(spark, d).select("call_id", "tool", "params"), H.schedule_registry(spark))


@query("WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT coalesce(CASE WHEN k % 9 > 0 THEN ['denoise', 'trim_silence', 'clipping', 'no_such_tool'][k % 4 + 1] END, 'UnknownTool') AS tool, count(*) AS n FROM e GROUP BY 1")
def tool_usage(spark, d):
    named = F.when(F.col("k") % 9 > 0, F.col("tool"))
    return _schedule_calls(spark, d).groupBy(F.coalesce(named, F.lit("UnknownTool")).alias("tool")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS tool, (event_id // 1000)::BIGINT AS batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1, 2")
def tool_batches(spark, d):
    """Calls of a tool in order, in batches of bounded ranges."""
    e = V.table(spark, d, "events").select(F.col("event_type").alias("tool"), F.col("event_id").alias("ord"), F.col("event_id").alias("id"))
    b = H.batches(e, 1000)
    return b.select("tool", "batch", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first"), F.element_at("ids", -1).alias("last"))


@query("WITH t AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_type <> 'click' THEN 'skipped' ELSE 'ready' END AS status FROM events) SELECT status, count(*) AS n FROM t GROUP BY status")
def step_statuses(spark, d):
    """A schedule restricted to one tool keeps the others' rows as skipped, malformed ones as errors."""
    e = V.table(spark, d, "events").select(F.col("event_type").alias("tool"), (F.col("event_id") % 10 > 0).alias("well_formed"))
    return H.statuses(e, "click").groupBy("status").agg(F.count("*").alias("n"))


# Logs and vectors -----------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderpriority AS run, o_orderkey AS step, round(avg(o_totalprice) OVER w, 4) AS smooth, round(ln(avg(o_totalprice) OVER w), 6) AS log_smooth, round(ln(o_totalprice), 6) AS log_raw FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS 9 PRECEDING)""")
def training_curves(spark, d):
    """A rolling mean of ten, and logarithms of it and of the raw loss."""
    w = Window.partitionBy("run").orderBy("step").rowsBetween(-9, 0)
    o = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"))
    return o.select("run", "step", _r(F.avg("loss").over(w), 4).alias("smooth"), _r(F.ln(F.avg("loss").over(w))).alias("log_smooth"), _r(F.ln("loss")).alias("log_raw"))


@query("SELECT o_orderpriority AS run, max(o_orderkey) AS last_step, max_by(o_totalprice, o_orderkey) AS last_loss, count(*) AS n FROM orders GROUP BY 1")
def final_losses(spark, d):
    o = V.table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("run")).agg(F.max("o_orderkey").alias("last_step"), F.max_by("o_totalprice", "o_orderkey").alias("last_loss"), F.count("*").alias("n"))


_PAIRS = "pairs AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _vector_pairs(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"""WITH {_PAIRS}, c AS (SELECT *, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-8) AS cos FROM pairs)
SELECT vec_id, round(cos, 6) AS cosine, round(greatest(0, least(1, 0.5 * (cos + 1))), 6) AS closeness, round(list_aggregate(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2])), 'avg'), 6) AS l1, round(20 * log10(sqrt(list_dot_product(x, x) / len(x)) + 1e-8) - 20 * log10(sqrt(list_dot_product(y, y) / len(y)) + 1e-8), 4) AS level FROM c""")
def vector_closeness(spark, d):
    x, y = F.col("x"), F.col("y")
    c = X.cosine(x, y)
    return _vector_pairs(spark, d).select("vec_id", _r(c).alias("cosine"), _r(X.closeness(c, c)).alias("closeness"), _r(X.mean_difference(x, y)).alias("l1"), _r(X.level_db(x) - X.level_db(y), 4).alias("level"))


@query(f"""WITH {_PAIRS}, s AS (SELECT *, list_dot_product(x, y) / (list_dot_product(y, y) + 1e-8) AS k FROM pairs), n AS (SELECT *, list_transform(list_zip(x, y), lambda p: p[1] - k * p[2]) AS e FROM s)
SELECT vec_id, round(10 * log10((k * k * list_dot_product(y, y) + 1e-8) / (list_dot_product(e, e) + 1e-8)), 4) + 0.0 AS si_sdr, round(x[2] - 0.97 * x[1], 6) AS emphasised, round(x[3] - list_avg(x), 6) AS centred, round(x[1] / list_max(list_transform(x, lambda v: abs(v))) * 0.9, 6) AS peak, round(x[1] / sqrt(list_dot_product(x, x) / 64) * 0.9 / sqrt(2), 6) AS rms FROM n""")
def signal_functions(spark, d):
    """Distortion ratio, pre-emphasis, offset removal, and both normalisations."""
    x, y = F.col("x"), F.col("y")
    return _vector_pairs(spark, d).select(
        "vec_id", (_r(X.si_sdr(x, y), 4) + 0.0).alias("si_sdr"), _r(X.pre_emphasis(x, 0.97)[1]).alias("emphasised"), _r(X.remove_offset(x)[2]).alias("centred"),
        _r(X.normalise_peak(x, 0.9)[0]).alias("peak"), _r(X.normalise_rms(x, 0.9)[0]).alias("rms"),
    )


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, round(x[37], 6) AS tiled_101, round(list_sum(x[1:5]), 6) AS cut_sum, 0.0 AS padded_last, round(x[1] * 0.0, 6) + 0.0 AS faded_first, round(x[2] * 0.5 * (1 - cos(pi() / 7)), 6) AS faded_second FROM v""")
def length_functions(spark, d):
    """Tiling, cutting, padding and fading."""
    x = F.col("x")
    faded = X.fade(x, F.lit(8))
    v = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return v.select("vec_id", _r(X.fit_length(x, F.lit(150))[100]).alias("tiled_101"), _r(X.total(X.match_length(x, F.lit(5)))).alias("cut_sum"), X.match_length(x, F.lit(70))[69].alias("padded_last"), (_r(faded[0]) + 0.0).alias("faded_first"), _r(faded[1]).alias("faded_second"))
