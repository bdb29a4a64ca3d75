"""Scalar functions on Spark columns: labels, choices, timestamps, loose equality. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of free-form answers, timestamps and code fences, and what a file name's part may hold.
OPTION_LETTER = r"^\s*([A-Da-d])[.\s]"
CHOICE_LETTER = r"^\s*\(?([A-Za-z])\)?\s*[\.\):,-]"
TIMESTAMP = r"^(2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d\.\d{1,6}$"
REWARD_TIMESTAMP = r"^\d{1,2}:\d{2}:\d{2}(?:\.\d{1,3})?$"
FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"
NOT_IN_NAMES = r"[^\p{L}\p{N}_\-]"
PUNCTUATION = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_correct(answer: Column, prediction: Column) -> Column:
    """The stripped answer occurs in the prediction, by case; a missing answer ("N/A") and nulls are wrong, an empty one right."""
    missing = F.coalesce(answer, F.lit("")) == "N/A"
    return F.coalesce(~missing & F.contains(prediction, strip(answer)), F.lit(False))


def option_letter(text: Column) -> Column:
    """A-D (any case) at the start, followed by a dot or white space; else null."""
    return F.nullif(F.upper(F.regexp_extract(text, OPTION_LETTER, 1)), F.lit(""))


def match_choice(text: Column, choices: Column) -> Column:
    """The index of the choice that a free answer names: by a leading letter with punctuation if it is in range, else the
    choice whose text occurs first (of equals the lower index); null if none does."""
    letter = F.upper(F.regexp_extract(strip(text), CHOICE_LETTER, 1))
    by_letter = F.ascii(letter) - 65
    found = F.transform(choices, lambda c, i: F.struct(F.when(strip(c) != "", F.nullif(F.instr(F.lower(text), F.lower(strip(c))), F.lit(0))).alias("at"), i.alias("i")))
    first = F.array_min(F.filter(found, lambda x: x["at"].isNotNull()))["i"]
    return F.when((letter != "") & (by_letter < F.size(choices)), by_letter).otherwise(first)


def normal_token(token: Column) -> Column:
    """Stripped, lower case, without punctuation at the ends."""
    return F.regexp_replace(F.lower(strip(token)), f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")


def parse_timestamp(text: Column) -> Column:
    """Seconds of H:M:S.fff with exactly one dot and three integer parts; the fraction is cut or padded to three digits. Hours
    and minutes have no upper limit. Anything else is null."""
    halves = F.split(text, r"\.")
    parts = F.split(F.get(halves, F.lit(0)), ":")
    h, m, s = (F.get(parts, F.lit(i)).try_cast("int") for i in range(3))
    millis = F.substring(F.rpad(F.get(halves, F.lit(1)), 3, "0"), 1, 3).try_cast("int")
    return F.when((F.size(halves) == 2) & (F.size(parts) == 3), h * 3600 + m * 60 + s + millis / 1000.0)


def format_timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm, a millionth early and floored, so that parsing it never overshoots; negative counts as 0."""
    ms = F.greatest(F.lit(0), F.floor((F.greatest(F.lit(0.0), seconds) - 1e-6) * 1000)).cast("long")
    whole = F.floor(ms / 1000)
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, ms % 1000))


def valid_timestamp(text: Column) -> Column:
    """Hours 0-23, minutes and seconds 0-59, one or two digits each, and a fraction of one to six digits."""
    return text.rlike(TIMESTAMP)


def _seconds(stripped: Column) -> Column:
    h, m, s = (F.get(F.split(stripped, ":"), F.lit(i)).try_cast("double") for i in range(3))
    return F.when(stripped.rlike(REWARD_TIMESTAMP), h * 3600 + m * 60 + s)


def reward_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS with an optional fraction of up to three digits, two-digit minutes and seconds; else null."""
    return let(strip(text), _seconds)


def numbers_close(pred: Column, truth: Column) -> Column:
    return F.abs(pred - truth) <= F.greatest(F.lit(0.02), 0.05 * F.abs(truth))


def _same_text(p, t) -> Column:
    """p, t: raw, stripped text and seconds, by name."""
    numbers = lambda x, y: F.when(F.isnan(x) | F.isnan(y), F.lit(False)).otherwise(numbers_close(x, y))
    # Only texts that end like numbers are read as such.
    numeric = p["text"].rlike("[0-9.a-zA-Z]$") & p["text"].rlike("^[-+0-9.iInN]") & t["text"].rlike("^[-+0-9.iInN]")
    x, y = p["raw"].try_cast("double"), t["raw"].try_cast("double")
    return (
        F.when(p["seconds"].isNotNull() & t["seconds"].isNotNull(), F.abs(p["seconds"] - t["seconds"]) <= 0.75)
        .when(F.coalesce(numeric & x.isNotNull() & y.isNotNull(), F.lit(False)), numbers(x, y))
        .otherwise(F.lower(p["text"]) == F.lower(t["text"]))
    )


def strings_close(pred: Column, truth: Column) -> Column:
    """Loose equality of two strings: timestamps within 0.75 s, numbers within tolerance, else equal when stripped, in any case."""
    read = lambda text: F.struct(text.alias("raw"), strip(text).alias("text"), F.when(F.contains(text, F.lit(":")), reward_seconds(text)).alias("seconds"))
    return let(F.struct(read(pred).alias("p"), read(truth).alias("t")), lambda both: _same_text(both["p"], both["t"]))


def _parts(v: Column, kind: Column) -> dict[str, Column]:
    """What a variant of a kind is compared by."""
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    value = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(number, F.try_variant_get(v, "$", "double"))
    return {"boolean": kind == "BOOLEAN", "number": value, "text": F.when(kind == "STRING", F.try_variant_get(v, "$", "string")), "json": F.when(value.isNull() & (kind != "STRING"), F.to_json(v))}


def _same_value(p, t, texts: Column) -> Column:
    """p, t: _parts by name. texts: whether they are the same if both are texts."""
    return (
        F.when(p["boolean"] | t["boolean"], p["number"] == t["number"])
        .when(p["number"].isNotNull() & t["number"].isNotNull(), numbers_close(p["number"], t["number"]))
        .when(p["text"].isNotNull() & t["text"].isNotNull(), texts)
        .otherwise(p["json"] == t["json"])
    )


def values_close(pred: Column, truth: Column) -> Column:
    """Loose equality of two VARIANT values: booleans only equal themselves (and 1 or 0), numbers have a tolerance, strings
    compare loosely, all else must be equal as JSON. Kind, number and text of either side are read once. For values inside arrays
    and maps; those of two columns are compared faster by with_values_close()."""
    read = lambda v: let(v, lambda x: let(F.schema_of_variant(x), lambda kind: F.struct(*[c.alias(n) for n, c in _parts(x, kind).items()])))
    same = lambda both: _same_value(both["p"], both["t"], strings_close(both["p"]["text"], both["t"]["text"]))
    return F.coalesce(let(F.struct(read(pred).alias("p"), read(truth).alias("t")), same), F.lit(False))


def with_values_close(df: DataFrame, pred: Column, truth: Column, name: str) -> DataFrame:
    """df with values_close(pred, truth) as a column, read step by step in plain columns, for which Spark generates code."""
    sides = ("__p", "__t")
    out = df.withColumns({"__p": pred, "__t": truth}).withColumns({f"{s}_kind": F.schema_of_variant(s) for s in sides})
    out = out.withColumns({f"{s}_{n}": c for s in sides for n, c in _parts(F.col(s), F.col(f"{s}_kind")).items()})
    out = out.withColumns({f"{s}_stripped": strip(F.col(f"{s}_text")) for s in sides})
    out = out.withColumns({f"{s}_seconds": F.when(F.contains(f"{s}_text", F.lit(":")), _seconds(F.col(f"{s}_stripped"))) for s in sides})
    p, t = ({n: F.col(f"{s}_{n}") for n in ("boolean", "number", "text", "json")} for s in sides)
    x, y = ({"raw": F.col(f"{s}_text"), "text": F.col(f"{s}_stripped"), "seconds": F.col(f"{s}_seconds")} for s in sides)
    return out.withColumn(name, F.coalesce(_same_value(p, t, _same_text(x, y)), F.lit(False))).select(*df.columns, name)


def strip_fence(text: Column) -> Column:
    """The content of the first code fence anywhere, or the text."""
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def count_substring(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def replace_first(text: Column, part: Column, by: Column) -> Column:
    at = F.instr(text, part)
    return F.when(at > 0, F.overlay(text, by, at, F.length(part))).otherwise(text)


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def file_suffix(values: Column) -> Column:
    """The values joined by underscores, with anything but letters and digits of any script, underscores and hyphens made an underscore."""
    return F.regexp_replace(F.array_join(values, "_"), NOT_IN_NAMES, "_")
