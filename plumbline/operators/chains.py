"""Tool-call chains: replay of step logs, sequence and multiset scores, rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import with_values_close

NAME_WEIGHT, PARAM_WEIGHT = 0.3, 0.7
SEQUENCE_SHARE, NAME_SHARE = 0.7, 0.3
FORMAT_WEIGHT, ACCURACY_WEIGHT = 0.2, 0.8
EXTRA_STEPS, MOST_STEPS = 2, 8


def replay(steps: DataFrame, terminal: Column) -> DataFrame:
    """The steps (sample, step, ...) of each run up to and including its first terminal one."""
    before = Window.partitionBy("sample").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("__ended", F.max(terminal.cast("int")).over(before)).where("coalesce(__ended, 0) = 0").drop("__ended")


def repeated(steps: DataFrame) -> Column:
    """Whether a step's tool and parameters (as canonical JSON) were called before in its run."""
    return F.row_number().over(Window.partitionBy("sample", "tool", "params").orderBy("step")) > 1


def step_budget(truth_length: Column, cap: int = MOST_STEPS) -> Column:
    return F.least(truth_length + EXTRA_STEPS, F.lit(cap))


def stop_reasons(steps: DataFrame, allowed: list[str], cap: int = MOST_STEPS) -> DataFrame:
    """(sample, stop_reason, n_steps) by the first of: done, disallowed tool, repeated call, failed execution, budget spent."""
    reason = (
        F.when(F.col("status") == "done", "done")
        .when(~F.col("tool").isin(*allowed), "disallowed_tool")
        .when(F.col("__repeat"), "repeated_call")
        .when(F.col("status") == "tool_execution_failed", "tool_execution_failed")
        .when(F.col("step") >= cap, "max_steps")
    )
    marked = steps.withColumn("__repeat", repeated(steps)).withColumn("reason", reason)
    kept = replay(marked, F.col("reason").isNotNull())
    return kept.groupBy("sample").agg(F.coalesce(F.max("reason"), F.lit("max_steps")).alias("stop_reason"), F.count("*").alias("n_steps"))


def assign_ids(chain: DataFrame) -> DataFrame:
    """Each step of a chain (id, pos from 1) reads what the one before wrote: audio_0, the source, first; audio_1 is the target,
    so step 1 writes audio_2, step 2 audio_3, ..."""
    pos = F.col("pos")
    return chain.withColumns({"input_id": F.when(pos == 1, "audio_0").otherwise(F.concat(F.lit("audio_"), pos)), "output_id": F.concat(F.lit("audio_"), pos + 1)})


def last_produced(steps: DataFrame, produced: Column, first: str) -> Column:
    """What the latest earlier step of the run produced, or `first`."""
    before = Window.partitionBy("sample").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(produced, ignorenulls=True).over(before), F.lit(first))


def frontier(chains: DataFrame, turn: Column) -> Column:
    """Whether a chain (length, failed) still has work at a turn."""
    return (F.col("length") >= turn) & ~F.col("failed")


def sequences(calls: DataFrame) -> DataFrame:
    """One row a chain of (id, pos, gt, pred, ok): ordered names of the truth, of all predicted and of the successful calls."""
    ordered = lambda value, keep: F.transform(F.filter(F.sort_array(F.collect_list(F.struct("pos", value.alias("v"), keep.alias("k")))), lambda x: x["k"]), lambda x: x["v"])
    predicted = F.col("pred").isNotNull()
    return calls.groupBy("id").agg(ordered(F.col("gt"), F.col("gt").isNotNull()).alias("gt"), ordered(F.col("pred"), predicted).alias("pred"), ordered(F.col("pred"), predicted & F.col("ok")).alias("done"))


def overlap(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two arrays."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def ratio(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def sequence_metrics(seqs: DataFrame) -> DataFrame:
    """Exact match, multiset precision, recall and F1 of the successful calls (0 where undefined), coverage of distinct tools
    (1 for an empty truth), tools used and missed, and whether any or all were used (null for an empty truth)."""
    gt, done = F.col("gt"), F.col("done")
    tools, used = F.array_distinct(gt), F.array_sort(F.array_intersect(gt, done))
    n = F.size(tools)
    out = seqs.withColumns({"n_gt": F.size(gt).cast("long"), "n_done": F.size(done).cast("long"), "__both": overlap(gt, done)})
    out = out.withColumns({"precision": ratio(F.col("__both"), F.col("n_done")), "recall": ratio(F.col("__both"), F.col("n_gt"))})
    return out.select(
        "id", (gt == done).alias("exact"), "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"), F.when(n == 0, 1.0).otherwise(F.size(used) / n).alias("coverage"),
        used.alias("used"), F.array_sort(F.array_except(gt, done)).alias("missed"), F.when(n > 0, F.size(used) > 0).alias("any_used"), F.when(n > 0, F.size(used) == n).alias("all_used"), "n_gt", "n_done",
    )


def name_f1(gt: Column, pred: Column) -> Column:
    """Bag-of-names F1 for rewards: both empty 1, one empty 0."""
    both, n, m = overlap(gt, pred), F.size(pred), F.size(gt)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(f1(both / n, both / m))


def position_scores(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, score) of chains of calls (id, pos, tool, params map<string, variant>), compared by position; a missing or extra step
    scores 0, a call of the right tool a share for its name and one for its parameters. Chains empty on both sides have no rows here; their score is 1 by definition (see chain_reward)."""
    g = gt.select("id", "pos", F.col("tool").alias("gt"), F.col("params").alias("gp"))
    p = pred.select("id", "pos", F.col("tool").alias("pt"), F.col("params").alias("pp"))
    both = g.join(p, ["id", "pos"], "full").withColumn("n", F.greatest(F.size("gp"), F.size("pp")))
    # A row for each parameter that both calls of the same tool have, and one for any other call; a call counts on its first row.
    same = F.col("gt") == F.col("pt")
    each = both.select("id", "gt", "pt", "gp", "pp", "n", F.posexplode_outer(F.when(same, F.array_intersect(F.map_keys("gp"), F.map_keys("pp")))).alias("at", "name"))
    each = with_values_close(each, F.try_element_at("pp", F.col("name")), F.try_element_at("gp", F.col("name")), "close")
    first = F.coalesce("at", F.lit(0)) == 0
    named = F.when(F.col("n") == 0, NAME_WEIGHT + PARAM_WEIGHT).when(F.col("gp").isNotNull(), NAME_WEIGHT)
    points = F.sum(F.when(same & first, named)), F.sum(F.when(same & F.col("close"), PARAM_WEIGHT / F.col("n")))
    counted = lambda side: F.count(F.when(first, F.col(side)))
    return each.groupBy("id").agg(((F.coalesce(points[0], F.lit(0.0)) + F.coalesce(points[1], F.lit(0.0))) / F.greatest(counted("gt"), counted("pt"))).alias("score"))


def chain_reward(sequence: Column, names: Column) -> Column:
    return SEQUENCE_SHARE * sequence + NAME_SHARE * names


def weighted_reward(well_formed: Column, accuracy: Column) -> Column:
    return FORMAT_WEIGHT * well_formed + ACCURACY_WEIGHT * accuracy


#: Rewards by name, over formed (whether a completion could be read), sequence and names (scores in [0, 1]).
REWARDS = {
    "tool_format": lambda formed, sequence, names: F.lit(1.0),
    "tool_accuracy": lambda formed, sequence, names: sequence,
    "tool_name_f1": lambda formed, sequence, names: names,
    "tool_use": lambda formed, sequence, names: chain_reward(sequence, names),
}


def rewards(scored: DataFrame, *asked: str) -> DataFrame:
    """scored (formed, sequence, names and more) with a column for each reward asked for by name (see REWARDS); a completion that couldn't be read
    has 0 in all, a score that is missing counts as 0. An unknown name is an error."""
    if unknown := sorted(set(asked) - set(REWARDS)):
        raise ValueError(f"unknown rewards: {unknown}; known: {sorted(REWARDS)}")
    formed, sequence, names = F.coalesce("formed", F.lit(False)), F.coalesce("sequence", F.lit(0.0)), F.coalesce("names", F.lit(0.0))
    return scored.withColumns({name: F.when(formed, REWARDS[name](formed, sequence, names)).otherwise(0.0) for name in asked})


def mean_of_numbers(x: Column) -> Column:
    """The mean without nulls and NaNs; null if nothing is left."""
    return F.avg(F.nanvl(x, F.lit(None)))


def summary(results: DataFrame) -> DataFrame:
    """One row over all samples (n_pred, n_ok, f1, closeness, baseline): the micro success rate and means."""
    return results.agg(
        F.count("*").alias("n"), ratio(F.sum("n_ok").cast("double"), F.sum("n_pred")).alias("success_rate"), mean_of_numbers(F.col("f1")).alias("mean_f1"),
        mean_of_numbers(F.col("closeness")).alias("mean_closeness"), mean_of_numbers(F.col("closeness") - F.col("baseline")).alias("mean_gain"),
    )


def breakdown(results: DataFrame, by: str) -> DataFrame:
    """By chain length: n and means; here a NaN is not skipped."""
    return results.groupBy(by).agg(F.count("*").alias("n"), F.avg("f1").alias("mean_f1"), F.avg("closeness").alias("mean_closeness"))


def fold_messages(turns: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<role, content>>, n_outputs): turns in order; after each assistant turn but a last one comes
    the tool's message with the step's number."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    chats = turns.groupBy("conv_id").agg(ordered.alias("t"))

    # A step's number is its place in the list of assistant turns; both lists are put together by position.
    message = lambda at, after, role, content: F.struct(at.alias("at"), F.lit(after).alias("after"), role.alias("role"), content.alias("content"))
    said = chats.select("conv_id", F.transform("t", lambda x, i: message(i, 0, x["role"], x["content"])).alias("said"))
    steps = F.filter("said", lambda x: (x["role"] == "assistant") & (x["at"] < F.size("said") - 1))
    outputs = F.transform(steps, lambda x, k: message(x["at"], 1, F.lit("tool"), F.concat(F.lit("Output of step "), k + 1, F.lit(": <audio>"))))
    both = said.select("conv_id", "said", outputs.alias("outputs"))
    told = F.transform(F.array_sort(F.concat("said", "outputs")), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return both.select("conv_id", told.alias("messages"), F.size("outputs").cast("long").alias("n_outputs"))
