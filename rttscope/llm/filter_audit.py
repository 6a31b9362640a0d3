"""Interaction audit of document filters: what every order of the filters removes, and who gets the credit.

A document's filters that fail form a five-bit mask.  Whatever the order, a document's way through it
depends on its mask alone, so documents are first counted per part and mask (32 cells a part at most).
Every cell then folds, with SQL's higher-order functions, across an array that holds all 120 orders: for
each order ``aggregate`` carries whether the document is still there and ``transform`` weighs each step with
the cell's counts, which gives 600 structs a cell; the cells of a part are merged by elementwise sums.

Copies are found on slim rows: texts leave the scan as SHA-256 digests, equal rows are counted before
they are shuffled, and equal digests of one part meet as a few counted rows.

Defined results: a null text counts as empty and equals other empty ones; a null lang belongs to the part
``''``; a document without an id is no copy and makes none, and has no labels; rows that repeat an id and a
text count each, and none is a copy of the other; several label rows of one id count as one with the
largest values; null labels count as 0; an empty table gives an empty result.  Only ``doc_id``, ``text``
and ``lang`` are read, so further columns do not clash.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACE = r"[\x20\x09-\x0D]+"
#: The summed fields of a step.
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the filters A to D that the text fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (n < 200, 100 * distinct < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, good ones and toxic ones per part and set of failed filters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_mask(F.col("text")).alias("own"))
    counted = slim.groupBy("id", "part", "digest", "own").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # rows without an id have no labels: a second key deals them out instead of hashing null to one task
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    rows = counted.withColumn("spread", spread).join(known.withColumn("label_spread", F.lit(0).cast("long")), (F.col("id") == F.col("label_id")) & (F.col("spread") == F.col("label_spread")), "left")
    rows = rows.select("id", "part", "digest", "own", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # equal texts have equal masks, so a digest has a few rows only: one per part and labels
    texts = rows.groupBy("digest", "own", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(W.partitionBy("digest"))
    original = F.col("no_id") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("own").alias("mask"), original.alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - original).alias("n")))
    split = texts.select("part", "good", "toxic", both.alias("both")).select("part", "good", "toxic", F.inline("both")).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def fold(orders: Column) -> Column:
    """A cell's 600 structs: for each order and step its filter and the cell's counts, weighted 0 or 1."""
    zero = F.lit(0).cast("long")

    def steps(order: Column) -> Column:
        def step(state, k):
            letter = F.substring(order, k, F.lit(1))
            bit = F.element_at(F.create_map(*(x for i, f in enumerate(FILTERS) for x in (F.lit(f), F.lit(1 << i)))), letter)
            fails = F.col("mask").bitwiseAND(bit) != 0
            when = lambda what, count: F.when(what, F.col(count)).otherwise(zero)
            row = F.struct(
                order.alias("filter_order"), k.alias("step"), letter.alias("letter"), when(state["there"] & ~fails, "n").alias("kept"), when(state["there"] & fails, "n").alias("removed"),
                when(~state["there"] & fails, "n").alias("redundant"), when(F.col("mask") == bit, "n").alias("unique_fails"),
                when(state["there"] & fails, "good").alias("good_lost"), when(state["there"] & fails, "toxic").alias("toxic_lost"))
            return F.struct((state["there"] & ~fails).alias("there"), F.concat(state["rows"], F.array(row)).alias("rows"))

        kind = "array<struct<filter_order:string,step:int,letter:string," + ",".join(f"{f}:bigint" for f in FIELDS) + ">>"
        start = F.struct(F.lit(True).alias("there"), F.array().cast(kind).alias("rows"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), start, step, lambda state: state["rows"])

    return F.flatten(F.transform(orders, steps))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, zeros included: part, filter_order, step, the counts of ``FIELDS`` and shapley."""
    orders = F.array(*(F.lit(o) for o in ORDERS))
    folded = cells(docs, labels).select("part", fold(orders).alias("steps"))

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(x["filter_order"].alias("filter_order"), x["step"].alias("step"), x["letter"].alias("letter"), *((x[f] + y[f]).alias(f) for f in FIELDS)))

    # at most 32 arrays of 600 structs a part
    lists = folded.groupBy("part").agg(F.collect_list("steps").alias("lists"))
    merged = lists.select("part", F.aggregate(F.slice("lists", 2, 32), F.col("lists")[0], add).alias("steps"))
    removed = lambda f: F.aggregate("steps", F.lit(0).cast("long"), lambda s, x: s + F.when(x["letter"] == f, x["removed"]).otherwise(0))
    credit = F.create_map(*(x for f in FILTERS for x in (F.lit(f), removed(f))))
    rows = merged.select("part", credit.alias("credit"), F.explode("steps").alias("s"))
    return rows.select("part", "s.filter_order", "s.step", *(f"s.{f}" for f in FIELDS), F.element_at("credit", F.col("s.letter")).alias("shapley"))
