"""Exact quantiles and exact KS gaps over huge groups, by levels of histograms.

``percentile`` keeps one value map per group in a single task, which a hot key would overflow, and a
plain sort shuffles every value.  Here each level counts rows per bucket with map-side partial counts, so
a bucket is one row whatever it holds.  Only buckets that hold a wanted rank are looked into: one with few
rows is put in order, one with a single value needs no look at all, and any other is cut
into ``WIDTH`` buckets between its least and largest value for the next level, whose rows are written and
narrower each time.  Values are shuffled only from buckets of at most ``FEW`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rttscope.session import materialise

#: Buckets of the first level per e-fold of the value, and buckets that a later level cuts one into.
STEPS, WIDTH = 64, 4096
#: Rows of a bucket that are put in order.
FEW = 20_000


def bucket_of(value: Column) -> Column:
    """A monotone bucket number; at most some ten thousand distinct ones exist."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * STEPS).cast("long")


def _finite(df: DataFrame, keys: list[str], value: str, *more: str) -> DataFrame:
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"), *more)
    return rows.withColumn("_b", F.array(bucket_of(F.col("_v"))))


def _inside(rows: DataFrame, open_: DataFrame, on: list[str], *more: str) -> DataFrame:
    """The rows of the open buckets with the number of the next level's bucket, written."""
    low, high = F.col("_lo"), F.col("_hi")
    part = F.least(F.floor((F.col("_v") - low) / (high - low) * WIDTH).cast("long"), F.lit(WIDTH - 1).cast("long"))
    held = rows.join(open_.select(*on, "_lo", "_hi"), on)
    return materialise(held.select(*[c for c in on if c != "_b"], "_v", *more, F.concat("_b", F.array(part)).alias("_b")), "quantile-rows")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], few: int = FEW) -> DataFrame:
    """One row per key with ``n`` and one column per entry of ``probs``: linear between the ranks around (n - 1) p."""
    if not keys:
        one = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, few)
        return one.drop("_all")
    on = [*keys, "_b"]

    def rank(p: float, step: int) -> Column:
        low = F.floor((F.col("n") - 1) * F.lit(float(p))).cast("long")
        return F.least(low + step, F.col("n") - 1)

    wanted = F.array_distinct(F.array(*[rank(p, s) for p in probs.values() for s in (0, 1)]))
    rows = _finite(df, keys, value)
    parents, hits = None, []
    while True:
        hist = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        if parents is None:
            up_to = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
            hist = hist.withColumns({"n": F.sum("_c").over(Window.partitionBy(*keys)), "_below": F.coalesce(F.sum("_c").over(up_to), F.lit(0))})
            hist = hist.withColumn("_ranks", wanted)
        else:
            up_to = Window.partitionBy(*keys, "_up").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
            hist = hist.withColumn("_up", F.slice("_b", F.lit(1), F.size("_b") - 1))
            hist = hist.join(parents.select(*keys, F.col("_b").alias("_up"), "n", F.col("_below").alias("_start"), "_ranks"), [*keys, "_up"])
            hist = hist.withColumn("_below", F.col("_start") + F.coalesce(F.sum("_c").over(up_to), F.lit(0))).drop("_up", "_start")
        inside = F.filter("_ranks", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c")))
        targets = materialise(hist.withColumn("_ranks", inside).where(F.size("_ranks") > 0), "quantile-buckets")
        one_value = targets.where("_lo = _hi")
        hits.append(one_value.select(*keys, "n", F.col("_lo").alias("_v"), F.explode("_ranks").alias("_r")))
        short = targets.where((F.col("_lo") < F.col("_hi")) & (F.col("_c") <= few))
        place = F.row_number().over(Window.partitionBy(*on).orderBy("_v")).cast("long") - 1 + F.col("_below")
        near = rows.join(short.select(*on, "n", "_below", "_ranks"), on).withColumn("_r", place)
        hits.append(near.where(F.array_contains("_ranks", F.col("_r"))).select(*keys, "n", "_v", "_r"))
        parents = targets.where((F.col("_lo") < F.col("_hi")) & (F.col("_c") > few))
        if parents.isEmpty():
            break
        rows = _inside(rows, parents, on)
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    # at most two entries per probability and key
    picked = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))

    def interpolated(p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col("_at")[rank(p, 0)], F.col("_at")[rank(p, 1)]
        return low + (high - low) * (place - F.floor(place))

    return picked.select(*keys, "n", *[interpolated(p).alias(name) for name, p in probs.items()])


def largest_gap(left: DataFrame, right: DataFrame, keys: list[str], value: str, few: int = FEW) -> DataFrame:
    """(keys, na, nb, gap): the largest distance of two samples' distribution functions per key.

    A bucket's end shows a gap, and the counts before and behind it bound every gap inside; only buckets that
    could hold a larger one than the ends seen so far are looked into.
    """
    on = [*keys, "_b"]
    marked = left.select(*keys, value, F.lit(1).alias("_a"), F.lit(0).alias("_c")).unionByName(right.select(*keys, value, F.lit(0).alias("_a"), F.lit(1).alias("_c")))
    rows = _finite(marked, keys, value, "_a", "_c")
    share_a, share_b = F.try_divide("_a1", "na"), F.try_divide("_b1", "nb")
    parents, seen = None, []
    while True:
        hist = rows.groupBy(*on).agg(F.sum("_a").alias("_na"), F.sum("_c").alias("_nb"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        if parents is None:
            whole, up_to = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
            hist = hist.withColumns({"na": F.sum("_na").over(whole), "nb": F.sum("_nb").over(whole), "_a1": F.sum("_na").over(up_to), "_b1": F.sum("_nb").over(up_to)})
        else:
            hist = hist.withColumn("_up", F.slice("_b", F.lit(1), F.size("_b") - 1))
            up_to = Window.partitionBy(*keys, "_up").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
            before = parents.select(*keys, F.col("_b").alias("_up"), "na", "nb", F.col("_a0").alias("_sa"), F.col("_b0").alias("_sb"))
            hist = hist.join(before, [*keys, "_up"]).withColumns({"_a1": F.col("_sa") + F.sum("_na").over(up_to), "_b1": F.col("_sb") + F.sum("_nb").over(up_to)}).drop("_up", "_sa", "_sb")
        hist = hist.withColumns({"_a0": F.col("_a1") - F.col("_na"), "_b0": F.col("_b1") - F.col("_nb"), "gap": F.abs(share_a - share_b)})
        most = F.greatest(F.abs(share_a - F.try_divide("_b0", "nb")), F.abs(share_b - F.try_divide("_a0", "na")))
        hist = materialise(hist.withColumn("_most", most), "gap-buckets")
        ends = hist.groupBy(*keys, "na", "nb").agg(F.max("gap").alias("gap"))
        seen.append(ends)
        best = ends.select(*keys, F.col("gap").alias("_best"))
        open_ = materialise(hist.where("_lo < _hi").join(best, keys).where("_most > _best"), "gap-open")
        size = F.col("_na") + F.col("_nb")
        short = open_.where(size <= few).select(*on, "na", "nb", "_a0", "_b0")
        equal = Window.partitionBy(*on).orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
        near = rows.join(short, on).withColumns({"_a1": F.col("_a0") + F.sum("_a").over(equal), "_b1": F.col("_b0") + F.sum("_c").over(equal)})
        seen.append(near.groupBy(*keys, "na", "nb").agg(F.max(F.abs(share_a - share_b)).alias("gap")))
        parents = open_.where(size > few)
        if parents.isEmpty():
            break
        rows = _inside(rows, parents, on, "_a", "_c")
    found = seen[0]
    for more in seen[1:]:
        found = found.unionByName(more)
    return found.groupBy(*keys, "na", "nb").agg(F.max("gap").alias("gap"))
