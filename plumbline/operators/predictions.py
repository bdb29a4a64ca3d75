"""Prediction sets: merge by confidence, compare, and break down. Duplicate ids are the caller's to resolve (last_by)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much more confident the second prediction must be to win.
MARGIN = 0.1


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order: a later prediction of an id replaces an earlier one."""
    return df.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("__row")).select("__row.*")


def prefers_second(p1: Column, p2: Column) -> Column:
    """The second wins if only it has a confidence, or if it leads by more than MARGIN."""
    return F.coalesce((p1.isNull() & p2.isNotNull()) | (p2 > p1 + MARGIN), F.lit(False))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, kept_from, reason, correct, idx, correct1, correct2, common) of the full outer join of two prediction sets
    (id, idx, correct, p_true)."""
    one, two = (d.select("id", *[F.col(c).alias(f"{c}{k}") for c in ("idx", "correct", "p_true")], F.lit(True).alias(f"in{k}")) for k, d in ((1, first), (2, second)))
    both = one.join(two, "id", "full")
    in1, in2 = F.col("in1").isNotNull(), F.col("in2").isNotNull()
    from2 = ~in1 | (in1 & in2 & prefers_second(F.col("p_true1"), F.col("p_true2")))
    pick = lambda c: F.when(from2, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
    return both.select(
        "id", F.when(from2, "file2").otherwise("file1").alias("kept_from"), F.when(~in2, "only in file1").when(~in1, "only in file2").otherwise("cmp decision").alias("reason"),
        F.coalesce(pick("correct"), F.lit(False)).alias("correct"), F.coalesce(pick("idx"), F.lit(0)).alias("idx"), "correct1", "correct2", (in1 & in2).alias("common"),
    )


def accuracy(correct: Column) -> Column:
    """The share of true values; null counts as wrong, no rows as 0."""
    return F.coalesce(F.avg(F.coalesce(correct, F.lit(False)).cast("double")), F.lit(0.0))


def with_category(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """df with the category of its id; an unknown id or an empty category is "(none)"."""
    return df.join(lookup, "id", "left").withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("(none)")))


def confusion(merged: DataFrame) -> DataFrame:
    """Both-right, only-first, only-second and both-wrong counts and shares over common ids, the merged accuracy, and how many
    rows came from the second set: overall and by category, in one scan."""
    c1, c2 = (F.coalesce(F.col(c), F.lit(False)) for c in ("correct1", "correct2"))
    cell = lambda x, y: F.count_if(F.col("common") & (c1 == x) & (c2 == y))
    out = merged.rollup("category").agg(
        F.grouping("category").alias("g"), F.count("*").alias("n"), F.count_if("common").alias("n_common"), cell(True, True).alias("both_right"), cell(True, False).alias("only_first"),
        cell(False, True).alias("only_second"), cell(False, False).alias("both_wrong"), F.count_if(F.col("kept_from") == "file2").alias("from_second"), accuracy(F.col("correct")).alias("accuracy"),
    )
    share = lambda c: F.round(F.try_divide(F.col(c), F.col("n_common")), 6).alias(f"{c}_share")
    return out.select(
        F.when(F.col("g") == 1, "Overall").otherwise(F.col("category")).alias("category"), "n", "n_common", "both_right", "only_first", "only_second", "both_wrong",
        share("both_right"), share("only_first"), share("only_second"), share("both_wrong"), "from_second", F.round("accuracy", 6).alias("accuracy"),
    )


def label_confusion(pairs: DataFrame) -> DataFrame:
    """(truth, pred, n) over all labels that occur on either side, zeros included. The labels are a closed answer set, so the
    grid is small."""
    labels = pairs.select(F.col("truth").alias("label")).union(pairs.select("pred")).where("label is not null").distinct()
    counts = pairs.where("truth is not null and pred is not null").groupBy("truth", "pred").agg(F.count("*").alias("n"))
    found = labels.agg(F.sort_array(F.collect_set("label")).alias("all")).select(F.explode("all").alias("truth"), "all").select("truth", F.explode("all").alias("pred"))
    return found.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def label_agreement(pairs: DataFrame) -> DataFrame:
    """(n, agreement): the diagonal's share; null on no rows."""
    good = pairs.where("truth is not null and pred is not null")
    return good.agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("double")), 6).alias("agreement"))


def selection_breakdown(merged: DataFrame) -> DataFrame:
    return merged.groupBy("kept_from").agg(F.count_if("correct").alias("right"), F.count_if(~F.col("correct")).alias("wrong"))


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """The items whose id has no result yet."""
    return items.join(done.select("id"), "id", "left_anti")
