"""Tool schedules: parse, validate against parameter schemas held as rows, batch by tool."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalar import valid_timestamp

#: Keys that an entry's metadata must have.
METADATA_KEYS = ["question", "choice", "answer", "id", "audio_path"]
#: The parameters of the tools that work on a segment of an audio, besides AUDIO and SEGMENT:
#: (tool, parameter, type, allowed values, required).
SEGMENT_TOOLS = ["asr", "clipping", "amplitude_normalize", "loudness_normalize", "remove_dc_offset", "spectral_normalize", "trim_silence", "pre_emphasis", "source_separation"]
SEGMENT_PARAMETERS = [
    ("asr", "language", "string", None, False),
    ("amplitude_normalize", "target_level", "number", None, False),
    ("amplitude_normalize", "method", "string", ["peak", "rms"], False),
    ("loudness_normalize", "target_lufs", "number", None, False),
    ("spectral_normalize", "strength", "number", None, False),
    ("trim_silence", "threshold_db", "number", None, False),
    ("trim_silence", "frame_length", "integer", None, False),
    ("trim_silence", "hop_length", "integer", None, False),
    ("pre_emphasis", "coef", "number", None, False),
    ("source_separation", "target_description", "string", None, False),
    ("source_separation", "save_residual", "boolean", None, False),
]
#: Those of the tools that work on a whole audio, besides AUDIO; schedules know three of them, with a segment.
WHOLE_TOOLS = ["denoise", "extract_target", "remove_target", "human_voice_enhance", "super_resolution", "pitch_shift", "time_stretch"]
SCHEDULED_WHOLE_TOOLS = ["denoise", "extract_target", "remove_target"]
SEPARATION_LABELS = ["vocals", "background sound", "background music", "noise"]
WHOLE_PARAMETERS = [
    ("denoise", "algorithm", "string", ["spectral_subtraction", "wiener", "echo_cancellation", "adaptive"], True),
    ("denoise", "noise_factor", "number", None, False),
    ("denoise", "sensitivity", "number", None, False),
    ("extract_target", "target_description", "string", SEPARATION_LABELS, True),
    ("remove_target", "target_description", "string", SEPARATION_LABELS, True),
    ("super_resolution", "model_name", "string", ["basic", "speech"], False),
    ("super_resolution", "ddim_steps", "number", None, False),
    ("super_resolution", "guidance_scale", "number", None, False),
    ("pitch_shift", "n_steps", "number", None, True),
    ("pitch_shift", "bins_per_octave", "integer", None, False),
    ("time_stretch", "rate", "number", None, True),
]
AUDIO = ("audio_path", "string", None, True)
SEGMENT = [("audio_begin", "timestamp", None, True), ("audio_end", "timestamp", None, True)]
#: Fixed value: the tools whose result is text.
TEXT_TOOLS = ["asr"]
SCHEMA = "tool string, param string, type string, allowed array<string>, required boolean"


def registry(spark: SparkSession) -> DataFrame:
    """SCHEMA rows of all sixteen tools' parameters."""
    rows = [(t, *p) for t in SEGMENT_TOOLS for p in (AUDIO, *SEGMENT)] + [(t, *AUDIO) for t in WHOLE_TOOLS]
    return spark.createDataFrame(rows + SEGMENT_PARAMETERS + WHOLE_PARAMETERS, SCHEMA)


def schedule_registry(spark: SparkSession) -> DataFrame:
    """SCHEMA rows of the twelve tools that schedules may name: all have a segment, and targets are free text."""
    tools = SEGMENT_TOOLS + SCHEDULED_WHOLE_TOOLS
    own = [(t, p, kind, None if p == "target_description" else allowed, required) for t, p, kind, allowed, required in SEGMENT_PARAMETERS + WHOLE_PARAMETERS if t in tools]
    return spark.createDataFrame([(t, *p) for t in tools for p in (AUDIO, *SEGMENT)] + own, SCHEMA)


def audio_tools(schema: DataFrame) -> DataFrame:
    """(tool) of those whose result is a new audio."""
    return schema.select("tool").distinct().where(~F.col("tool").isin(TEXT_TOOLS))


def entries(schedules: DataFrame, text_col: str = "value") -> DataFrame:
    """(source, entry, meta, calls): the entries of whole-text JSON schedules, as variants; what isn't JSON has one null entry."""
    parsed = schedules.select(F.col("source"), F.try_parse_json(text_col).alias("v"))
    query = "SELECT source, e.pos AS entry, try_variant_get(e.value, '$[0]', 'variant') AS meta, try_variant_get(e.value, '$[1]', 'variant') AS calls, e.value AS raw FROM {parsed}, LATERAL variant_explode_outer(v) AS e"
    return schedules.sparkSession.sql(query, parsed=parsed)


def _kind(v: Column) -> Column:
    """"ARRAY", "OBJECT", "STRING", "VOID" and so on; null for what isn't there."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def entry_errors(found: DataFrame, schema: DataFrame) -> DataFrame:
    """(source, entry, errors) of entries(): errors of an entry's shape, of its metadata and of all its calls.

    An entry that is no list of two is one error. Metadata that is no object is one, a missing key (METADATA_KEYS) one in all, a
    choice that is no list one. Calls that are no list, or an empty one, are one; a call is judged by its shape, its tool and its
    parameters (parameter_errors). Entries are read once and never joined with themselves, as their order may differ when texts are made again.
    """
    parts = F.try_variant_get("raw", "$", "array<variant>")
    pair = (_kind(F.col("raw")) == "ARRAY") & (F.size(parts) == 2)
    meta = F.try_variant_get("meta", "$", "map<string,variant>")
    has = lambda key: F.map_contains_key(meta, key)
    lacking = ~F.forall(F.array(*map(F.lit, METADATA_KEYS)), has)
    choice = F.coalesce(has("choice") & (_kind(F.element_at(meta, "choice")) != "ARRAY"), F.lit(False))
    of_meta = F.when(F.coalesce(_kind(F.col("meta")) == "OBJECT", F.lit(False)), lacking.cast("int") + choice.cast("int")).otherwise(1)
    calls = F.when(F.coalesce(_kind(F.col("calls")) == "ARRAY", F.lit(False)), F.try_variant_get("calls", "$", "array<variant>"))
    of_calls = F.when(calls.isNull() | (F.size(calls) == 0), 1).otherwise(0)
    numbered = found.withColumn("row", F.monotonically_increasing_id())
    one = numbered.select("row", "source", "entry", F.coalesce(pair, F.lit(False)).alias("pair"), (of_meta + of_calls).alias("own"), F.posexplode_outer(F.when(pair, calls)).alias("pos", "call"))
    call = F.try_variant_get("call", "$", "map<string,variant>")
    tool, params = F.try_element_at(call, F.lit("tool")), F.try_element_at(call, F.lit("parameters"))
    read = one.select(
        "row", "source", "entry", "pair", "own", "pos", (_kind(F.col("call")) == "OBJECT").alias("object"), F.when(_kind(tool) == "STRING", F.try_variant_get(tool, "$", "string")).alias("tool"), F.map_contains_key(call, "parameters").alias("given"),
        _kind(params).alias("kind"), F.try_variant_get(params, "$", "map<string,variant>").alias("params"),
    )
    judged = read.join(_specs(schema), "tool", "left")
    is_known = F.col("spec").isNotNull()
    inside = F.when(F.col("kind") == "OBJECT", _errors_inside(F.col("spec"), F.col("params"))).otherwise(1)
    errors = F.when(~F.col("object"), 1).otherwise((~is_known).cast("int") + (~F.col("given")).cast("int") + F.when(is_known & F.col("given"), inside).otherwise(0))
    by_entry = judged.groupBy("row", "source", "entry").agg(F.first("pair").alias("pair"), F.first("own").alias("own"), F.sum(F.when(F.col("pos").isNotNull(), errors)).alias("of_calls"))
    total = F.when(F.col("pair"), F.col("own") + F.coalesce("of_calls", F.lit(0))).otherwise(1)
    return by_entry.select("source", "entry", total.cast("long").alias("errors"))


def validation_totals(judged: DataFrame) -> DataFrame:
    """(source, entries, bad_entries, errors) of entry_errors()."""
    return judged.groupBy("source").agg(F.count("*").alias("entries"), F.count_if(F.col("errors") > 0).alias("bad_entries"), F.sum("errors").alias("errors"))


def _specs(schema: DataFrame) -> DataFrame:
    """(tool, spec): a map from each parameter, by name, to what the schema says of it."""
    told = F.sort_array(F.collect_list(F.struct("param", F.struct("type", "allowed", "required"))))
    return F.broadcast(schema.groupBy("tool").agg(F.map_from_entries(told).alias("spec")))


def _given_or_none(params: Column) -> Column:
    return F.coalesce(params, F.create_map().cast("map<string,variant>"))


def _errors_inside(spec: Column, given: Column) -> Column:
    """The errors of a known tool's parameters."""
    params = _given_or_none(given)
    missing = F.exists(F.map_keys(spec), lambda p: spec[p]["required"] & ~F.map_contains_key(params, p))

    def errors_of(p: Column) -> Column:
        s, value = spec[p], params[p]
        kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
        is_string = F.coalesce(kind == "STRING", F.lit(False))
        wrong_type = s["type"].isin("string", "timestamp") & ~is_string
        wrong_time = (s["type"] == "timestamp") & ~(is_string & F.coalesce(valid_timestamp(text), F.lit(False)))
        wrong_value = s["allowed"].isNotNull() & F.coalesce(kind != "VOID", F.lit(False)) & ~F.coalesce(is_string & F.array_contains(s["allowed"], text), F.lit(False))
        return F.when(s.isNull(), 1).otherwise(wrong_type.cast("int") + wrong_time.cast("int") + wrong_value.cast("int"))

    return F.aggregate(F.transform(F.map_keys(params), errors_of), missing.cast("int"), lambda a, n: a + n)


def parameter_errors(calls: DataFrame, schema: DataFrame) -> DataFrame:
    """(call_id, errors): of calls (call_id, tool, params map<string, variant>). An unknown tool is one error; else one for
    missing parameters, one for each unexpected one, and one for each wrong string type, timestamp or value. Numbers,
    integers and booleans aren't type-checked."""
    spec = F.col("spec")
    errors = F.when(spec.isNull(), 1).otherwise(_errors_inside(spec, F.col("params")))
    return calls.join(_specs(schema), "tool", "left").select("call_id", errors.cast("long").alias("errors"))


def _listed(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))


def _shown(value: Column) -> Column:
    """A variant in a message: a text as it is, else its JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value), F.lit("null"))


def _named(value: Column) -> Column:
    """What kind of value a variant is, in a message."""
    kind = F.coalesce(_kind(value), F.lit("VOID"))
    names = {"ARRAY": "list", "OBJECT": "object", "STRING": "text", "BOOLEAN": "boolean", "VOID": "null"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[kind], F.lit("number"))


def _faults(*found: tuple[Column, Column]) -> Column:
    """The messages of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), message) for holds, message in found]))


def _messages_inside(spec: Column, given: Column) -> Column:
    """What _errors_inside() counts, in words: missing parameters first, in the schema's order by name, then what is wrong with each given
    one, by name."""
    params = _given_or_none(given)
    missing = F.filter(F.map_keys(spec), lambda p: spec[p]["required"] & ~F.map_contains_key(params, p))

    def messages_of(p: Column) -> Column:
        s, value = spec[p], params[p]
        text, quoted = F.try_variant_get(value, "$", "string"), F.concat(F.lit("'"), p, F.lit("'"))
        is_text, given = F.coalesce(_kind(value) == "STRING", F.lit(False)), F.coalesce(F.schema_of_variant(value) != "VOID", F.lit(False))
        bad_time = F.when(is_text, F.concat(F.lit(" timestamp format error: "), text)).otherwise(F.concat(F.lit(" must be a string in HH:MM:SS.mmm format, got "), _named(value)))
        return _faults(
            (s.isNull(), F.concat(F.lit("Unexpected parameter: "), quoted)),
            (s["type"].isin("string", "timestamp") & ~is_text, F.concat(F.lit("Parameter "), quoted, F.lit(" must be a string"))),
            ((s["type"] == "timestamp") & ~(is_text & F.coalesce(valid_timestamp(text), F.lit(False))), F.concat(quoted, bad_time)),
            (s["allowed"].isNotNull() & given & ~F.coalesce(is_text & F.array_contains(s["allowed"], text), F.lit(False)), F.concat(F.lit("Parameter "), quoted, F.lit(" has invalid value '"), _shown(value), F.lit("'. Allowed: "), _listed(s["allowed"]))),
        )

    of_missing = _faults((F.size(missing) > 0, F.concat(F.lit("Missing required parameters: "), _listed(missing))))
    return F.concat(of_missing, F.flatten(F.transform(F.array_sort(F.map_keys(params)), messages_of)))


def entry_messages(found: DataFrame, schema: DataFrame) -> DataFrame:
    """(source, entry, messages array<string>) of entries(): what entry_errors() counts, in words; each says where it is. A text without entries
    has one message."""
    parts = F.try_variant_get("raw", "$", "array<variant>")
    is_list = F.coalesce(_kind(F.col("raw")) == "ARRAY", F.lit(False))
    pair = is_list & (F.size(parts) == 2)
    meta = F.try_variant_get("meta", "$", "map<string,variant>")
    is_object = F.coalesce(_kind(F.col("meta")) == "OBJECT", F.lit(False))
    lacking = F.filter(F.array(*map(F.lit, METADATA_KEYS)), lambda key: ~F.map_contains_key(meta, key))
    choice = F.map_contains_key(meta, "choice") & (_kind(F.element_at(meta, "choice")) != "ARRAY")
    calls_listed = F.coalesce(_kind(F.col("calls")) == "ARRAY", F.lit(False))
    calls = F.when(calls_listed, F.try_variant_get("calls", "$", "array<variant>"))
    at = F.concat(F.lit("entry["), F.col("entry").cast("string"), F.lit("]"))
    shape = _faults(
        (F.col("entry").isNull(), F.lit("schedule: no list of entries")),
        (~is_list & F.col("entry").isNotNull(), F.concat(at, F.lit(": must be a 2-element list, got "), _named(F.col("raw")))),
        (is_list & ~pair, F.concat(at, F.lit(": must have exactly 2 elements, got "), F.size(parts).cast("string"))),
    )
    about = _faults(
        (pair & ~is_object, F.concat(at, F.lit(".metadata: metadata must be a dict, got "), _named(F.col("meta")))),
        (pair & is_object & (F.size(lacking) > 0), F.concat(at, F.lit(".metadata: metadata missing required keys: "), _listed(lacking))),
        (pair & is_object & choice, F.concat(at, F.lit(".metadata: metadata 'choice' must be a list"))),
        (pair & ~calls_listed, F.concat(at, F.lit(".tool_calls: must be a list, got "), _named(F.col("calls")))),
        (pair & calls_listed & (F.size(calls) == 0), F.concat(at, F.lit(".tool_calls: list is empty"))),
    )
    numbered = found.withColumn("row", F.monotonically_increasing_id())
    one = numbered.select("row", "source", "entry", F.concat(shape, about).alias("own"), F.posexplode_outer(F.when(pair, calls)).alias("pos", "call"))
    call = F.try_variant_get("call", "$", "map<string,variant>")
    tool, params = F.try_element_at(call, F.lit("tool")), F.try_element_at(call, F.lit("parameters"))
    read = one.select(
        "row", "source", "entry", "own", "pos", _named(F.col("call")).alias("call_kind"), tool.isNull().alias("no_tool"), _named(tool).alias("tool_kind"), F.try_variant_get(tool, "$", "string").alias("tool"),
        F.map_contains_key(call, "parameters").alias("given"), _named(params).alias("kind"), F.try_variant_get(params, "$", "map<string,variant>").alias("params"),
    )
    judged = read.join(_specs(schema), "tool", "left")
    is_call, is_text = F.col("call_kind") == "object", F.col("tool_kind") == "text"
    is_known = is_text & F.col("spec").isNotNull()
    nothing = F.col("no_tool") | (F.col("tool_kind") == "null")
    prefix = F.concat(F.lit("tool_call["), F.col("pos").cast("string"), F.lit("]"))
    of_tool = F.concat(prefix, F.lit("(tool="), F.col("tool"), F.lit("): "))
    wrong = _faults(
        (~is_call, F.concat(prefix, F.lit(": must be a dict, got "), F.col("call_kind"))),
        (is_call & nothing, F.concat(prefix, F.lit(": missing 'tool' key"))),
        (is_call & ~nothing & ~is_text, F.concat(prefix, F.lit(": 'tool' must be a string, got "), F.col("tool_kind"))),
        (is_call & is_text & ~is_known, F.concat(prefix, F.lit(": unknown tool '"), F.col("tool"), F.lit("'"))),
        (is_call & ~F.col("given"), F.concat(prefix, F.lit(": missing 'parameters' key"))),
        (is_call & is_text & is_known & F.col("given") & (F.col("kind") != "object"), F.concat(of_tool, F.lit("'parameters' must be a dict, got "), F.col("kind"))),
    )
    inside = F.when(is_known & F.col("given") & (F.col("kind") == "object"), _messages_inside(F.col("spec"), F.col("params")))
    told = F.concat(wrong, F.transform(F.coalesce(inside, F.array().cast("array<string>")), lambda m: F.concat(of_tool, m)))
    of_call = F.when(F.col("pos").isNotNull(), F.struct("pos", told.alias("m")))
    by_entry = judged.groupBy("row", "source", "entry").agg(F.first("own").alias("own"), F.flatten(F.transform(F.sort_array(F.collect_list(of_call)), lambda x: x["m"])).alias("of_calls"))
    of_calls = F.transform("of_calls", lambda m: F.concat(at, F.lit(": "), m))
    return by_entry.select("source", "entry", F.concat("own", of_calls).alias("messages"))


def statuses(steps: DataFrame, only_tool: str | None) -> DataFrame:
    """Steps (tool, path, well_formed) with a status: error for a malformed one, skipped for another tool than the one asked for
    (rows stay), else ready."""
    other = F.lit(only_tool).isNotNull() & (F.col("tool") != F.lit(only_tool))
    return steps.withColumn("status", F.when(~F.col("well_formed") | F.col("tool").isNull(), "error").when(F.coalesce(other, F.lit(False)), "skipped").otherwise("ready"))


def batches(steps: DataFrame, size: int) -> DataFrame:
    """(tool, batch, ids): calls of one tool in order, `size` at a time. Batches are formed from ranges of `ord`, so no task
    gets all of a tool's calls."""
    cut = F.floor(F.col("ord") / size)
    return steps.groupBy("tool", cut.alias("batch")).agg(F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("x")).select("tool", "batch", F.transform("x", lambda s: s["id"]).alias("ids"))


def run_batches(calls: DataFrame, run, schema: str) -> DataFrame:
    """Run each tool's calls with `run(list of parameter dicts) -> list of result dicts`, once for a task's rows of one tool. A
    batch that raises fails as one; a missing or extra result is an error of its rows, never a shift of others' results."""
    columns = to_arrow_schema(StructType.fromDDL(schema))
    known = lambda v: None if isinstance(v, float) and v != v else v

    def one(table: pa.Table) -> pa.Table:
        given = table.to_pylist()
        try:
            results = run([dict(c) for c in given])
            if len(results) != len(given):
                raise ValueError(f"{len(results)} results for {len(given)} calls")
            out = [{"status": "success", **r} for r in results]
        except Exception as error:  # the tool's own failure, whatever it is, becomes rows
            out = [{"status": "failure", "message": str(error)}] * len(given)
        rows = [{k: known(v) for k, v in {**a, **b}.items()} for a, b in zip(given, out)]
        return pa.Table.from_pylist(rows, schema=columns)

    return calls.groupBy("tool", "batch").applyInArrow(one, schema)
