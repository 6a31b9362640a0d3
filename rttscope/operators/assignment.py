"""A largest assignment of owners to slots, found in rounds of joins over written tables.

Owners (countries) may each hold one slot; a place (a network) has a fixed number of slots.  First
owners propose for free slots by preference and slots accept one each.  Owners that are left
then search together for an exchange: a breadth-first forest grows from all of them, level by level,
in which every slot and every owner is reached once, so the paths that end in free slots do not
touch and all of them are carried out at once.  When no path is left the assignment is largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rttscope.session import materialise

HELD = "owner string, place long, slot int, item long"
#: Offers up to which all tables are kept in one partition, so that rounds need no exchange.
SMALL = 100_000


def _first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def assign(options: DataFrame, slots: int, fixed: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """(owner, place, slot, item) for as many owners as can be served.

    ``options`` has owner, place, item and pref (smaller is liked more), one row per owner and place;
    ``fixed`` are assignments that stay, ``start`` those to begin with.  Earlier slots are preferred to later
    ones, so a place is shared only where no free one is left.
    """
    spark = options.sparkSession
    columns = ["owner", "place", "slot", "item"]
    each = F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot")
    fixed = fixed if fixed is not None else spark.createDataFrame([], HELD)
    offers = options.select("owner", "place", "item", "pref", each).join(fixed.select("place", "slot"), ["place", "slot"], "left_anti")
    offers = materialise(offers, "assign-offers")
    small = offers.count() <= SMALL

    def kept(df: DataFrame, name: str) -> DataFrame:
        return materialise(df.coalesce(1), name).coalesce(1) if small else materialise(df, name)

    offers = offers.coalesce(1) if small else offers
    held = fixed.select(*columns)
    if start is not None:
        held = held.unionByName(start.join(offers, columns, "left_semi").select(*columns))
    held = kept(held, "assign-held")

    def free(df):
        return df.join(held.select("place", "slot"), ["place", "slot"], "left_anti")

    def waiting(df):
        return df.join(held.select("owner"), "owner", "left_anti")

    while True:
        asked = _first(free(waiting(offers)), ["owner"], "slot", "pref", "place")
        given = kept(_first(asked, ["place", "slot"], "pref", "owner").select("owner", "place", "slot", "item"), "assign-given")
        if given.isEmpty():
            break
        held = kept(held.unionByName(given), "assign-held")
    while True:
        paths = _exchanges(offers, held, kept)
        if paths is None:
            return held
        moved = paths.select(F.explode("path").alias("m")).select("m.*")
        held = kept(held.join(moved.select("owner"), "owner", "left_anti").unionByName(moved.select("owner", "place", "slot", "item")), "assign-held")


def _exchanges(offers: DataFrame, held: DataFrame, kept) -> DataFrame | None:
    """Paths of moves, one per owner that gets served; None if nobody can be."""
    front = offers.join(held.select("owner"), "owner", "left_anti").select("owner").distinct()
    front = kept(front.select(F.col("owner").alias("root"), "owner", F.lit(None).cast("array<struct<owner:string,place:long,slot:int,item:long>>").alias("path")), "assign-front")
    seen = offers.sparkSession.createDataFrame([], "place long, slot int")
    while not front.isEmpty():
        steps = front.join(offers, "owner").join(seen, ["place", "slot"], "left_anti")
        reached = _first(steps, ["place", "slot"], "pref", "root", "owner")
        move = F.array(F.struct("owner", "place", "slot", "item"))
        reached = kept(reached.select("root", "place", "slot", "pref", F.concat(F.coalesce("path", F.array().cast("array<struct<owner:string,place:long,slot:int,item:long>>")), move).alias("path")), "assign-reached")
        ends = reached.join(held.select("place", "slot"), ["place", "slot"], "left_anti")
        ends = kept(_first(ends, ["root"], "slot", "pref", "place"), "assign-ends")
        if not ends.isEmpty():
            return ends
        seen = seen.unionByName(reached.select("place", "slot"))
        front = kept(reached.join(held.select("owner", "place", "slot"), ["place", "slot"]).select("root", "owner", "path"), "assign-front")
    return None
