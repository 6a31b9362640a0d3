"""Mixing sources to target weights.

Tokens are summed per source; shares of the mix follow the sources' weights, no source above its limit of
repetition.  A source's repetition rate is its target over its size: every document is emitted
floor(rate) times, and once more if a number drawn from its seeded hash is below the fraction.

The shares are found by rounds over the written table of sources: each round adds up, with one aggregate, what
the sources at their limit take and the weights of the others, and so reshares the excess until no
source is above.  The order of the sources comes from a range sort with counted partitions, so no step gathers
all sources in one task.  A hot source needs no shuffle of its documents: they meet one row per source.

Defined results: a null text has size 0; null sources form one source, the last; a source without tokens has
target 0; rows that agree in id and text are drawn alike, and rows without an id by their text; an empty table
gives an empty result.  Further columns pass through ``mix`` and are not read by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rttscope.session import materialise

WEIGHTS = (3, 1, 2)
#: Percent of all tokens that the mix holds; times that a source may be repeated.
PERCENT = 150
LIMIT = 2
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def chance(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 48 bits of a seeded MD5 of id and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def ranked(sources: DataFrame, column: str) -> DataFrame:
    """Adds ``rank`` from 0 by code point, null last: ranks inside range partitions plus what stands before them."""
    key = (F.col(column).isNull(), F.col(column))
    dealt = materialise(sources.repartitionByRange(*key).withColumn("at", F.spark_partition_id()), "mix-sources")
    before = F.coalesce(F.sum("n").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per range partition
    starts = dealt.groupBy("at").agg(F.count("*").alias("n")).select("at", before.alias("start"))
    inside = F.row_number().over(W.partitionBy("at").orderBy(*key)) - 1
    return dealt.withColumn("inside", inside).join(starts, "at").withColumn("rank", F.col("start") + F.col("inside")).drop("at", "inside", "start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target): ``percent`` of all tokens shared by weight, nothing above ``limit`` times a source's size.

    ``sizes`` has the columns source and source_size; the weights repeat along the sources' order.
    """
    if percent > 100 * limit:
        raise ValueError("no mix of this size keeps the limit")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialise(ranked(sizes, "source").select("source", "source_size", weight.cast("long").alias("weight")), "mix-weights")
    cap = limit * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    exact = lambda x: x.cast("decimal(19,0)")
    # share per weight unit as the fraction over / units, in whole numbers of 1/100 token
    over, units = percent * total, table.agg(F.sum("weight")).first()[0] or 1
    while True:
        full = exact(cap) * exact(F.lit(100 * units)) <= exact(F.col("weight")) * exact(F.lit(over))
        at_limit, rest = table.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        now = (percent * total - 100 * at_limit, rest)
        if not rest or now == (over, units):
            break
        over, units = now
    share = F.col("weight") * F.lit(over) / (F.lit(100.0) * F.lit(units))
    return table.select("source", "source_size", F.when(full, cap.cast("double")).otherwise(share).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies): one row per document."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    slim = materialise(docs.select("doc_id", "source", size.alias("size"), chance(F.col("doc_id"), F.col("text"), seed).alias("chance")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialise(targets(sizes, weights, percent, limit), "mix-targets").withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(F.col("chance") < rate - F.floor(rate), 1).otherwise(0)
    return slim.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: every row of ``docs`` as often as planned, columns unchanged.

    The draw is a function of the row and of its source's rate, so the rows meet their sources' rates and texts are
    not shuffled where that table is small enough for the planner to broadcast.
    """
    weights, percent, limit, seed = (options.get(k, d) for k, d in (("weights", WEIGHTS), ("percent", PERCENT), ("limit", LIMIT), ("seed", SEED)))
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = materialise(targets(sizes, weights, percent, limit).select(F.struct(F.col("source"), rate.alias("rate")).alias("goal")), "mix-targets")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(goal, F.col("row.source").eqNullSafe(F.col("goal.source")))
    copies = F.floor("goal.rate") + F.when(chance(F.col("row.doc_id"), F.col("row.text"), seed) < F.col("goal.rate") - F.floor("goal.rate"), 1).otherwise(0)
    return whole.select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("again")).select("row.*")
