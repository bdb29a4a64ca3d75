"""Reproducible sampling: every draw is a hash of a seed and the row's key, so it is the same on any cluster.

The draws have the distributions of seeded random generators, not their sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(seed: int, *keys: Column | str) -> Column:
    """A uniform number in (0, 1) for the keys: 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def shuffle_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df in a drawn order: sorted over all tasks by a hash of seed and key, so a key's place doesn't depend on how df lay."""
    return df.orderBy(shuffle_key(seed, F.col(key)), key)


def sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows (or all) without replacement. A top-k: each task keeps k rows at most."""
    return df.orderBy(shuffle_key(seed, F.col(key)), key).limit(k)


def weighted_sample(df: DataFrame, key: str, weight: Column, k: int, seed: int) -> DataFrame:
    """k rows without replacement, by weight (null counts as 1; 0 never): the k least of -ln(u) / weight."""
    w = F.coalesce(weight, F.lit(1.0))
    return df.where(w > 0).orderBy(-F.ln(draw(seed, key)) / w, key).limit(k)


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key, the first in order; rows without a key are one key. Added up before the exchange, so no task sorts a key's rows."""
    return df.groupBy(key).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("__row")).select("__row.*")


def repeat(df: DataFrame, times: int) -> DataFrame:
    """Every row `times` times, with its repetition."""
    return df.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def choice(seed: int, values: list, *keys: Column | str) -> Column:
    """One of the values."""
    at = F.floor(draw(seed, *keys) * len(values)).cast("int")
    return F.get(F.array(*map(F.lit, values)), at)


def uniform(seed: int, low: Column | float, high: Column | float, *keys: Column | str, digits: int | None = None) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    value = low + (high - low) * draw(seed, *keys)
    return value if digits is None else F.round(value, digits)


def integer(seed: int, low: int, high: int, *keys: Column | str) -> Column:
    """A whole number from low to high, both included."""
    return (F.floor(draw(seed, *keys) * (high - low + 1)) + low).cast("int")


def draw_params(spec: dict[str, dict], seed: int, key: str) -> dict[str, Column]:
    """Columns for a tool's parameters by their specification: kinds choice, uniform (with round), randint and fixed. One with
    only_if is null unless the parameter that it names, drawn before it, has one of the values."""
    out: dict[str, Column] = {}
    for name, s in spec.items():
        salt = F.lit(name)
        match s["kind"]:
            case "choice":
                value = choice(seed, s["values"], key, salt)
            case "uniform":
                value = uniform(seed, float(s["min"]), float(s["max"]), key, salt, digits=s.get("round"))
            case "randint":
                value = integer(seed, s["min"], s["max"], key, salt)
            case "fixed":
                value = F.lit(s["value"])
            case other:
                raise ValueError(f"unknown kind of parameter: {other!r}")
        if rule := s.get("only_if"):
            before = out.get(rule["param"])
            value = F.when(before.isin(rule["values"]), value) if before is not None else F.lit(None)
        out[name] = value
    return out


def chain(key: str, tools: list[str] | dict[str, float], least: int, most: int, seed: int) -> Column:
    """An array of distinct tools, of a drawn length between least and most (clamped to the pool), in a drawn order; with
    weights, heavier tools come earlier and more often, and tools of weight 0 never."""
    weights = {t: w for t, w in tools.items() if w > 0} if isinstance(tools, dict) else dict.fromkeys(tools)
    k = F.least(F.lit(len(weights)), integer(seed, least, most, key, F.lit("length")))
    by = lambda t, w: draw(seed, key, F.lit(t)) if w is None else -F.ln(draw(seed, key, F.lit(t))) / w
    pool = F.sort_array(F.array(*[F.struct(by(t, w).alias("u"), F.lit(t).alias("tool")) for t, w in weights.items()]))
    return F.slice(pool, F.lit(1), k)["tool"]


def chains(items: DataFrame, key: str, tools: list[str], least: int, most: int, seed: int) -> DataFrame:
    """(key, pos, tool): a drawn chain of each item."""
    return items.select(key, F.posexplode(chain(key, tools, least, most, seed)).alias("pos", "tool")).withColumn("pos", F.col("pos") + 1)


def held_out_tail(df: DataFrame, order: str, share: float) -> DataFrame:
    """The rows of the last `share` in a total order: all from number floor(n * (1 - share)) on."""
    from ..functions.ranks import global_rank

    n = df.count()
    return global_rank(df, [order], "__rank").where(F.col("__rank") > int(n * (1 - share))).drop("__rank")
