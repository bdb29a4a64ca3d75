"""Building evaluation corpora: which items enter, where their audio is, and which tools there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SECONDS = 30.0


def renamed(items: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by their new names; names that items doesn't have are passed over."""
    return items.withColumnsRenamed(names)


def admitted(items: DataFrame, audios: Column, seconds: Column, **equal) -> DataFrame:
    """Items with exactly one audio of at most MAX_SECONDS whose columns have the given values. What isn't known doesn't enter."""
    rule = (F.size(audios) == 1) & (seconds <= MAX_SECONDS)
    for name, value in equal.items():
        rule &= F.col(name) == F.lit(value)
    return items.where(rule)


def first_items(items: DataFrame, n: int, *order: str) -> DataFrame:
    """A look at the first n items in order."""
    return items.orderBy(*order).limit(n)


def located(items: DataFrame, files: DataFrame, folder: Column, root: str) -> DataFrame:
    """items (id, name) with the path of their file: under their own folder if it is there, else under the root. files: (path). A
    name found in neither is an error."""
    here, there = F.concat(folder, F.lit("/"), "name"), F.concat(F.lit(root + "/"), "name")
    asked = items.select("*", F.explode(F.array(F.struct(F.lit(0).alias("rank"), here.alias("path")), F.struct(F.lit(1).alias("rank"), there.alias("path")))).alias("__try"))
    known = asked.join(files.select(F.col("path").alias("__path")).distinct(), F.col("__try.path") == F.col("__path"), "left")
    best = known.groupBy(*items.columns).agg(F.min(F.when(F.col("__path").isNotNull(), F.col("__try"))).alias("__best"))
    return best.select(*items.columns, F.coalesce("__best.path", F.raise_error(F.concat(F.lit("no file for "), "name"))).alias("path"))


def first_match(ids: DataFrame, files: DataFrame) -> DataFrame:
    """ids (id) with the first file, by path, whose stem is the id or the id after a Y; ids without one are left out. files: (stem, path)."""
    stems = ids.select("id", F.explode(F.array(F.col("id"), F.concat(F.lit("Y"), "id"))).alias("stem"))
    return stems.join(files, "stem").groupBy("id").agg(F.min("path").alias("path"))


def with_manifest(items: DataFrame, manifest: DataFrame, *keys: str) -> DataFrame:
    """items joined with the manifest on the keys; an item that isn't in it is an error."""
    known = manifest.withColumn("__known", F.lit(True))
    both = items.join(known, list(keys), "left")
    checked = F.coalesce("__known", F.raise_error(F.concat(F.lit("not in the manifest: "), F.to_json(F.struct(*keys)))))
    return both.withColumn("__known", checked).where("__known").drop("__known")


def config_tools(spark: SparkSession, config: DataFrame) -> DataFrame:
    """(tool, enabled, weight, env) from configs (value: the whole JSON text), beside their other columns. A tool is off unless it says otherwise."""
    names = "".join(f"`{c}`, " for c in config.columns if c != "value")
    query = f"""SELECT {names}t.key AS tool, coalesce(try_variant_get(t.value, '$.enabled', 'boolean'), false) AS enabled, coalesce(try_variant_get(t.value, '$.weight', 'double'), 1.0D) AS weight,
      try_variant_get(t.value, '$.env', 'string') AS env FROM {{config}}, LATERAL variant_explode(try_variant_get(try_parse_json(value), '$.tools', 'variant')) AS t"""
    return spark.sql(query, config=config)


def available(tools: DataFrame, known: DataFrame, environments: DataFrame) -> DataFrame:
    """(tool) in order, beside the configurations' other columns: enabled, known, and with no environment or one that exists. environments: (path)."""
    others = [c for c in tools.columns if c not in ("tool", "enabled", "weight", "env")]
    there = environments.select(F.col("path").alias("env")).distinct().withColumn("__there", F.lit(True))
    present = tools.join(F.broadcast(known.select("tool").distinct()), "tool", "left_semi").join(there, "env", "left")
    return present.where(F.col("enabled") & (F.coalesce(F.col("env"), F.lit("")).eqNullSafe("") | F.col("__there"))).select(*others, "tool").orderBy(*others, "tool")


def label_list(entries: DataFrame, labels: str) -> DataFrame:
    """(label): all labels of an array column, once each, in order."""
    return entries.select(F.explode(labels).alias("label")).distinct().orderBy("label")


def chain_totals(items: DataFrame, calls: str, failed: str) -> DataFrame:
    """One row: items, the longest chain (0 without any), and how many failed."""
    return items.agg(F.count("*").alias("items"), F.coalesce(F.max(F.size(calls)), F.lit(0)).alias("longest"), F.count_if(F.coalesce(F.col(failed), F.lit(False))).alias("failed"))


def all_items(*lists: DataFrame) -> DataFrame:
    """Item lists below one another; a column that a list doesn't have is null."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
