"""Tool calls in free-form model output, by Python's strict JSON rules (which Spark's readers are laxer than)."""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a code fence anywhere.
FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL)
#: What decides where an object ends: whole strings, and braces outside of them. A string that never ends hides the rest.
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', re.DOTALL)
CALLS = T.ArrayType(T.StructType([T.StructField("tool_name", T.StringType()), T.StructField("parameters", T.StringType())]))


def first_object(text: str) -> str | None:
    """The text from its first brace to the one that balances it; None without such."""
    start = text.find("{")
    braces = [m for m in _TOKENS.finditer(text, max(start, 0)) if m[0] in "{}"] if start >= 0 else []
    depths = accumulate(1 if m[0] == "{" else -1 for m in braces)
    return next((text[start : m.end()] for m, depth in zip(braces, depths) if depth == 0), None)


def read_json(text: str | None):
    """(whether it is JSON, the value)."""
    try:
        return text is not None, json.loads(text) if text is not None else None
    except json.JSONDecodeError:
        return False, None


def payload(text: str | None) -> dict | None:
    """The object that a text is or holds, in a fence or amid prose. A list at the top is one of calls; any other JSON is nothing."""
    if text is None:
        return None
    inner = FENCE.search(text.strip())
    body = inner[1] if inner else text.strip()
    whole, value = read_json(body)
    if not whole:
        value = read_json(first_object(body))[1]
    by_kind = {dict: lambda: value, list: lambda: {"tool_calls": value}}
    return by_kind.get(type(value), lambda: None)()


def is_call(x) -> bool:
    """A call is an object with a name; its parameters, if there are any, are an object."""
    return isinstance(x, dict) and isinstance(x.get("tool_name"), str) and isinstance(x.get("parameters", {}), dict)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def calls_of(text: str | None) -> list[tuple[str, str]] | None:
    """(name, parameters as canonical JSON) of all calls; one malformed call spoils the lot."""
    calls = (payload(text) or {}).get("tool_calls")
    good = isinstance(calls, list) and all(map(is_call, calls))
    return [(x["tool_name"], canonical(x.get("parameters", {}))) for x in calls] if good else None


def turn_of(text: str) -> dict | None:
    """One turn's object: a fence only at the very start is taken off, and nothing may follow the object."""
    text = text.strip()
    if text.startswith("```"):
        text = re.sub(r"^json\s*", "", text.strip("`").strip(), flags=re.IGNORECASE)
    value = read_json(text)[1]
    return value if isinstance(value, dict) else None


@F.pandas_udf(CALLS)
def extract_calls(text: pd.Series) -> pd.Series:
    return pd.Series([None if (found := calls_of(t)) is None else [{"tool_name": n, "parameters": p} for n, p in found] for t in text])


@F.pandas_udf(T.StringType())
def parse_turn(text: pd.Series) -> pd.Series:
    """The turn's object as canonical JSON, or null."""
    return pd.Series([None if t is None or (found := turn_of(t)) is None else canonical(found) for t in text])


#: What says where a call's audio lies; the caller decides that, not the model.
PLACES = ("audio_id", "audio_path", "output_path")
TURN = T.StructType([T.StructField("done", T.BooleanType()), *(T.StructField(f, T.StringType()) for f in ("tool", "parameters", "given", "audio_id", "output_id"))])


def told_turn(text: str) -> dict | None:
    """What a turn says: whether it is done, the tool's name (None without), its parameters and those without places as canonical
    JSON, and the ids of its input and output audio where it names them. What Python holds for false counts as not said."""
    found = turn_of(text)
    if found is None:
        return None
    name, given = found.get("tool_name"), found.get("parameters")
    given = given if isinstance(given, dict) else {}
    as_text = lambda x: None if not x else x if isinstance(x, str) else canonical(x)
    return {
        "done": bool(found.get("done")), "tool": as_text(name), "parameters": canonical(given), "given": canonical({k: v for k, v in given.items() if k not in PLACES}),
        "audio_id": as_text(given.get("audio_id")), "output_id": as_text(found.get("output_audio_id")),
    }


@F.pandas_udf(TURN)
def read_turn(text: pd.Series) -> pd.DataFrame:
    """told_turn of each text; null where the text is no turn."""
    rows = [told_turn(t) or {} for t in text]
    return pd.DataFrame({f: pd.Series([r.get(f) for r in rows], dtype=object) for f in TURN.fieldNames()})
