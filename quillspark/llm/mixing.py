"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key scaled by its quality weight (Efraimidis and Spirakis); in the order of these keys
within its source the sizes are prefix-summed to the source's token budget. Complete epochs come first, then the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packing import byte_tokens

#: Documents that one sorting task holds; a larger source is cut into so many ranges of its keys.
ROWS_PER_RANGE = 100_000


def quality_weight(text: Column) -> Column:
    """A weight in (0, 1]: the share of letters among the characters that are not white space, at least 0.05."""
    solid = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    return F.greatest(F.lit(0.05), F.coalesce(letters / F.nullif(solid, F.lit(0)), F.lit(0.05)))


def _sized(docs: DataFrame, targets: DataFrame, size: Column, weight: Column) -> tuple[DataFrame, DataFrame]:
    """Documents of the listed sources with size and weight, an id once; and the plan: one row for each listed source.

    The plan's budgets are a water level over the caps (max_repeats times a source's size): a source gets its target share
    times the level, or its cap if that is less, and the level is such that all budgets together are the size of all listed
    documents (times the sum of the target shares, if that is not 1), or every source is at its cap.
    """
    listed = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sized = docs.select("doc_id", "source", size.alias("tokens"), weight.cast("double").alias("weight")).where((F.col("tokens") > 0) & F.col("doc_id").isNotNull())
    sized = sized.join(listed.select("source"), "source", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("source", "tokens", "weight"), F.struct("source", "tokens")).alias("d")).select("doc_id", "d.*")
    # Weights in classes an eighth of a doubling wide, a few hundred at most, tell how the keys of a source are spread.
    classes = sized.groupBy("source", F.round(F.log2("weight") * 8).cast("int").alias("c")).agg(F.sum("tokens").alias("size"), F.count("*").alias("docs"))
    totals = classes.groupBy("source").agg(F.sum("size").alias("size"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("c") / 8.0).alias("weight"), "docs"))).alias("weights"))
    plan = listed.join(totals, "source", "left").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("docs", F.lit(0)).alias("docs"), "weights")
    plan = plan.withColumn("cap", F.col("max_repeats") * F.col("size")).withColumn("_ratio", F.col("cap") / F.nullif(F.col("target_share"), F.lit(0.0)))
    # Sources in the order in which a rising level reaches their caps: one row a source, in one task.
    rising = Window.orderBy(F.col("_ratio").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    reached = plan.withColumn("total", F.sum("size").over(every)).withColumn("_goal", F.col("total") * F.sum("target_share").over(every))
    left = F.col("_goal") - F.coalesce(F.sum("cap").over(rising), F.lit(0))
    shares = F.sum("target_share").over(every) - F.coalesce(F.sum("target_share").over(rising), F.lit(0.0))
    reached = reached.withColumn("_level", F.when(shares > 1e-12, left / shares)).withColumn("_level", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
    plan = reached.withColumn("_level", F.max("_level").over(every)).withColumn("budget", F.coalesce(F.least(F.col("target_share") * F.col("_level"), F.col("cap")), F.col("cap")).cast("double"))
    plan = plan.withColumn("budget", F.when(F.col("target_share") > 0, F.col("budget")).otherwise(F.lit(0.0)))
    epochs = F.when(F.col("size") > 0, F.least(F.floor(F.col("budget") / F.col("size")), F.col("max_repeats").cast("long"))).otherwise(F.lit(0))
    plan = plan.withColumn("epochs", F.greatest(epochs, F.lit(0)).cast("int"))
    rest = F.when((F.col("epochs") >= F.col("max_repeats")) | (F.col("size") == 0), F.lit(0.0)).otherwise(F.col("budget") - F.col("epochs") * F.col("size"))
    return sized, plan.withColumn("rest", rest).withColumn("ranges", F.ceil(F.greatest(F.col("docs"), F.lit(1)) / ROWS_PER_RANGE).cast("int")).drop("_ratio", "_goal", "_level", "cap")


def mix_sources(docs: DataFrame, targets: DataFrame, size: Column | None = None, weight: Column | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, repeats): how often each document enters the mix; documents with no repeat are left out.

    A source enters in complete epochs, floor(budget / size), then with the documents that come first by key until the rest
    of the budget is reached (the document at the edge enters if more than half of it fits). Documents without a size, an id
    or a listed source are in no mix; a repeated id counts once. Ties of keys go by document id. The sum over a source runs
    in ranges of keys, sized by the source and the spread of its weights, so a source that holds a third of all rows is
    sorted in many tasks.
    """
    size = byte_tokens(F.col("text")) if size is None else size
    weight = quality_weight(F.col("text")) if weight is None else weight
    sized, plan = _sized(docs, targets, size, weight)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    keyed = sized.join(F.broadcast(plan.select("source", "epochs", "rest", "ranges", "docs", "weights")), "source")  # as many rows as target shares
    keyed = keyed.withColumn("key", -F.log(uniform) / F.col("weight"))
    # The share of the source's documents whose keys are expected below this one.
    below = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w["docs"] * (1 - F.exp(-F.col("key") * w["weight"]))) / F.col("docs")
    keyed = keyed.withColumn("range", F.when(F.col("ranges") == 1, 0).otherwise(F.least(F.col("ranges") - 1, F.floor(below * F.col("ranges")))).cast("int")).drop("weights", "docs")
    before = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    before = before.select("source", "range", (F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")).alias("before"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = keyed.join(before, ["source", "range"]).withColumn("upto", F.col("before") + F.sum("tokens").over(within))
    partly = (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    return summed.withColumn("repeats", F.col("epochs") + partly.cast("int")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def mix_report(docs: DataFrame, targets: DataFrame, size: Column | None = None, weight: Column | None = None, seed: int = 42) -> DataFrame:
    """(source, target_share, max_repeats, size, budget, epochs, mixed_tokens, actual_share, short): a row for each listed source.

    `actual_share` is that of the tokens that the mix took. A source is short if what the mix took of it is below its target
    share of all listed tokens though all its repeats are used up; the others then share what it leaves.
    """
    size = byte_tokens(F.col("text")) if size is None else size
    weight = quality_weight(F.col("text")) if weight is None else weight
    _, plan = _sized(docs, targets, size, weight)
    mixed = mix_sources(docs, targets, size, weight, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"))
    out = plan.join(mixed, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    short = (F.col("mixed_tokens") >= F.col("max_repeats") * F.col("size")) & (F.col("mixed_tokens") < F.col("target_share") * F.col("total"))
    total = out.agg(F.sum("mixed_tokens").alias("all_mixed"))
    return out.join(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "size", "budget", "epochs", "mixed_tokens", (F.col("mixed_tokens") / F.nullif(F.col("all_mixed"), F.lit(0))).alias("actual_share"), short.alias("short")
    )


def found_short(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """p7_found: the listed sources that stay below their share even at max_repeats."""
    return mix_report(documents, targets).where("short").select("source").distinct()
