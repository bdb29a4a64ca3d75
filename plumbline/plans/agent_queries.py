"""Running agents, with a model and tools that follow from hashes so that SQL can say what they did."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agent as A
from ..operators.prompts import AUDIO_TOKEN, user_message
from ..sources import records as R
from . import views as V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


TOOLS = ["asr", "source_separation", "denoise", "clipping"]


def model(requests):
    """A stand-in for a model: what it says depends on the last message, by hash."""
    h = F.md5(F.concat_ws(":", "sample", F.element_at("messages", -1)["content"]))
    kind, p = F.substring(h, 1, 1), F.substring(h, 2, 1)
    call = lambda tool, params: F.concat(F.lit(f'{{"tool_name": "{tool}", "parameters": {{'), params, F.lit("}}"))
    pair = lambda key, value: F.concat(F.lit(f'"{key}": "'), value, F.lit('"'))
    clip = call("clipping", pair("n", F.when(p < "8", "1").otherwise("2")))
    text = (
        F.when(kind == "0", '{"done": true}').when(kind == "1", "no call here").when(kind == "2", '{"tool_name": "forbidden", "parameters": {}}').when(kind == "3", call("asr", pair("language", p)))
        .when(kind == "4", F.concat(F.lit('{"tool_name": "source_separation", "output_audio_id": "part_'), p, F.lit('", "parameters": {"target": "'), p, F.lit('"}}')))
        .when(kind == "5", call("denoise", F.concat(pair("audio_id", F.lit("audio_0")), F.lit(", "), pair("n", p)))).when(kind == "6", call("denoise", pair("audio_id", F.lit("audio_77"))))
        .when(kind == "7", F.concat(F.lit("```json\n"), clip, F.lit("\n```"))).when(kind == "8", '{"parameters": {}}').otherwise(clip)
    )
    return requests.select("sample", text.alias("text"))


def tools(calls):
    """A stand-in for tools: an output is a hash of the call; one that begins with f is a failure."""
    out = F.md5(F.concat_ws(":", "tool", "parameters", "audio"))
    is_ = lambda name: F.col("tool") == name
    none = F.lit(None).cast("string")
    return calls.select(
        "sample", F.when(out.startswith("f"), "failure").otherwise("success").alias("status"), F.when(is_("denoise"), out).alias("output_path"), F.when(is_("clipping"), out).alias("clip_path"),
        F.when(is_("source_separation"), F.create_map(F.lit("target"), F.concat(out, F.lit("t")), F.lit("residual"), F.concat(out, F.lit("r")))).alias("separated_files"),
        F.when(is_("asr"), F.concat(F.lit("heard "), F.substring(out, 1, 4))).alias("transcript"), none.alias("message"), none.alias("result"),
    )


def samples(spark, d):
    """Every customer asks for something to be done with two audios, in 0 to 8 steps."""
    c, key = V.table(spark, d, "customer"), F.col("c_custkey")
    audio = lambda i, name: F.struct(F.lit(f"audio_{i}").alias("id"), F.concat(F.lit(f"{name}_"), key).alias("path"))
    asked = user_message(F.concat(F.lit("Restore "), "c_name"), F.array(F.lit("audio_0"), F.lit("audio_1")))
    return c.select(key.alias("sample"), F.array(F.struct(F.lit("user").alias("role"), asked.alias("content"))).alias("messages"), F.array(audio(0, "source"), audio(1, "target")).alias("audios"), (key % 9).alias("budget"))


_T = AUDIO_TOKEN
_LOOP = f"""WITH RECURSIVE run AS (
  SELECT *, [last_msg] AS said FROM (
    SELECT c_custkey AS sample, 0 AS n, c_custkey % 9 AS budget, MAP {{'audio_0': 'source_' || c_custkey, 'audio_1': 'target_' || c_custkey}} AS ids, 'audio_1' AS last_id, 2 AS fresh, []::VARCHAR[] AS sigs, []::VARCHAR[] AS tried, []::VARCHAR[] AS good,
      'Restore ' || c_name || chr(10) || chr(10) || 'Input audio:' || chr(10) || 'audio_0: <audio_0>{_T}' || chr(10) || 'audio_1: <audio_1>{_T}' AS last_msg, NULL::VARCHAR AS reason FROM customer)
  UNION ALL
  SELECT sample, n + 1, budget, CASE WHEN made = 0 THEN ids WHEN made = 1 THEN map_concat(ids, MAP {{own: out}}) ELSE map_concat(ids, MAP {{own: out || 't', own || '_residual': out || 'r'}}) END,
    CASE WHEN made > 0 THEN own ELSE last_id END, CASE WHEN ok AND tool <> 'source_separation' THEN fresh + 1 ELSE fresh END, CASE WHEN early IS NULL THEN list_append(sigs, sig) ELSE sigs END,
    CASE WHEN early IS NULL THEN list_append(tried, tool) ELSE tried END, CASE WHEN ok THEN list_append(good, tool) ELSE good END, CASE WHEN ok THEN told ELSE text END,
    coalesce(early, CASE WHEN NOT ok THEN 'tool_execution_failed' WHEN n + 1 >= budget THEN 'max_steps_reached' END), CASE WHEN ok THEN list_concat(said, [text, told]) ELSE list_append(said, text) END
  FROM (SELECT *, CASE WHEN NOT ok OR tool = 'asr' THEN 0 WHEN tool = 'source_separation' THEN 2 ELSE 1 END AS made,
      'Output of step ' || (n + 1) || CASE tool WHEN 'asr' THEN ' (asr): heard ' || substr(out, 1, 4) WHEN 'source_separation' THEN ': <' || own || '>{_T} <' || own || '_residual>{_T}' ELSE ': <' || own || '>{_T}' END AS told
    FROM (SELECT *, early IS NULL AND NOT starts_with(out, 'f') AS ok, CASE WHEN tool = 'source_separation' THEN 'part_' || p ELSE 'audio_' || fresh END AS own
      FROM (SELECT *, md5(tool || ':' || given || ':' || ids[wanted]) AS out, CASE WHEN k = '0' THEN 'model_signaled_done' WHEN k IN ('1', '8') THEN 'unparseable_output' WHEN k = '2' THEN 'disallowed_tool'
              WHEN list_contains(sigs, sig) THEN 'repeated_call' WHEN ids[wanted] IS NULL THEN 'unknown_audio_id' END AS early
        FROM (SELECT *, tool || params AS sig, CASE k WHEN '5' THEN 'audio_0' WHEN '6' THEN 'audio_77' ELSE last_id END AS wanted,
            CASE k WHEN '0' THEN '{{"done": true}}' WHEN '1' THEN 'no call here' WHEN '8' THEN '{{"parameters": {{}}}}' WHEN '4' THEN '{{"tool_name": "source_separation", "output_audio_id": "part_' || p || '", "parameters": ' || params || '}}'
              WHEN '7' THEN '```json' || chr(10) || '{{"tool_name": "clipping", "parameters": ' || params || '}}' || chr(10) || '```' ELSE '{{"tool_name": "' || tool || '", "parameters": ' || params || '}}' END AS text
          FROM (SELECT *, CASE WHEN k = '2' THEN 'forbidden' WHEN k = '3' THEN 'asr' WHEN k = '4' THEN 'source_separation' WHEN k IN ('5', '6') THEN 'denoise' ELSE 'clipping' END AS tool,
              CASE k WHEN '2' THEN '{{}}' WHEN '3' THEN '{{"language": "' || p || '"}}' WHEN '4' THEN '{{"target": "' || p || '"}}' WHEN '5' THEN '{{"audio_id": "audio_0", "n": "' || p || '"}}' WHEN '6' THEN '{{"audio_id": "audio_77"}}' ELSE '{{"n": "' || CASE WHEN p < '8' THEN 1 ELSE 2 END || '"}}' END AS params,
              CASE k WHEN '3' THEN '{{"language": "' || p || '"}}' WHEN '4' THEN '{{"target": "' || p || '"}}' WHEN '5' THEN '{{"n": "' || p || '"}}' WHEN '6' THEN '{{}}' ELSE '{{"n": "' || CASE WHEN p < '8' THEN 1 ELSE 2 END || '"}}' END AS given
            FROM (SELECT *, substr(h, 1, 1) AS k, substr(h, 2, 1) AS p FROM (SELECT *, md5(sample || ':' || last_msg) AS h FROM run WHERE reason IS NULL AND n < budget)))))))
), ended AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY sample ORDER BY n DESC) = 1)"""


def _done(spark, d):
    folder = R.scratch_folder(spark, "agents")
    done = A.run(samples(spark, d), model, tools, TOOLS, folder)
    return spark.read.parquet(f"{folder}/start"), done


@query(f"""{_LOOP} SELECT sample, coalesce(reason, 'max_steps_reached') AS stop_reason, n::BIGINT AS n_turns, array_to_string(tried, ',') AS attempted, array_to_string(good, ',') AS successful, ids[last_id] AS final_audio FROM ended""")
def agent_outcomes(spark, d):
    """Every customer's run: why it stopped, what it called, and the audio that it left."""
    out = A.outcomes(*_done(spark, d))
    return out.withColumns({"attempted": F.array_join("attempted", ","), "successful": F.array_join("successful", ","), "n_turns": F.col("n_turns").cast("long")})


@query(f"""{_LOOP} SELECT sample, len(said)::BIGINT AS n_messages, md5(array_to_string(said, chr(10))) AS messages_md5 FROM ended""")
def agent_transcripts(spark, d):
    """Every customer's dialogue, whole."""
    told = A.transcripts(*_done(spark, d))
    return told.select("sample", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(F.col("messages")["content"], "\n")).alias("messages_md5"))


@query(f"""{_LOOP} SELECT coalesce(reason, 'max_steps_reached') AS stop_reason, count(*) AS n, round(avg(n), 6) AS mean_turns FROM ended GROUP BY 1""")
def agent_stop_reasons(spark, d):
    """How runs stopped, and after how many turns on average."""
    out = A.outcomes(*_done(spark, d))
    return out.groupBy("stop_reason").agg(F.count("*").alias("n"), F.round(F.avg("n_turns"), 6).alias("mean_turns"))
