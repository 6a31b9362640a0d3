"""Row windows over flow series without putting a whole flow in one task.

A flow may hold a large part of all rows, so ``partitionBy(flow)`` alone would send it
to a single task.  Here a series is cut into time chunks.  After deduplication a flow has
at most a few rows per second, so a chunk is bounded by its length in seconds whatever
the data volume.  Rolling frames, ``lead`` and running counters are then put together
from three pieces that share one shuffle on (flow, chunk):

* inside a chunk the plain window result is already right, except near its borders;
* rows near a border are computed again from a border table holding the few first and
  last rows of every chunk, windowed by flow (its size is a fixed number per chunk);
* running counters add what the earlier chunks contributed, from one summary per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rttscope.session import materialise

CHUNK_S = 86_400
_CHUNK, _RN, _N, _LAST_RESET = "_chunk", "_rn", "_n", "_last_reset"


def series_windows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    exprs: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    after: int,
    reset: Column | None = None,
    chunk_s: int = CHUNK_S,
) -> DataFrame:
    """Add ``exprs(window)`` to every row, as if windowed by ``keys`` ordered by ``order``.

    ``exprs`` may look back at most ``before`` rows and ahead at most ``after`` rows.
    ``order[0]`` is the time in whole seconds.  Also adds ``pos`` (1-based row number in the
    series) and, when ``reset`` is given, ``since_reset``: rows since the last reset row,
    which is the length of the current run of rows where ``reset`` is false.
    """
    part = [*keys, _CHUNK]
    w = Window.partitionBy(*part).orderBy(*order)
    whole = Window.partitionBy(*part)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_reset = F.lit(False) if reset is None else F.coalesce(reset, F.lit(True))
    names = list(exprs(w))

    base = df.withColumn(_CHUNK, F.floor(F.col(order[0]) / F.lit(chunk_s)).cast("long"))
    base = base.withColumn("_is_reset", is_reset)
    base = base.withColumns({_RN: F.row_number().over(w), _N: F.count(F.lit(1)).over(whole)})
    base = base.withColumns({
        _LAST_RESET: F.max(F.when(F.col("_is_reset"), F.col(_RN))).over(running),
        **exprs(w),
    })
    # summary, body and border read this table; unwritten, each would shuffle and window the series again
    base = materialise(base, "series-chunks")

    placed = base.join(_carried(base, keys, part), part, "left")
    placed = placed.withColumns({
        "pos": F.col("_rows_before") + F.col(_RN),
        "since_reset": F.col("_rows_before") + F.col(_RN) - F.coalesce(
            F.col("_rows_before") + F.col(_LAST_RESET), F.col("_reset_before"), F.lit(0)
        ),
    })

    from_end = F.col(_N) - F.col(_RN) + 1
    inner = (F.col(_RN) > before) & (from_end > after)
    pad = before + after
    body = placed.where(inner)
    border = placed.where((F.col(_RN) <= pad) | (from_end <= pad))
    by_flow = Window.partitionBy(*keys).orderBy(*order)
    border = border.withColumns(exprs(by_flow)).where(~inner)
    out = [*df.columns, *[n for n in names if n not in df.columns], "pos", "since_reset"]
    return body.select(*out).unionByName(border.select(*out))


def _carried(base: DataFrame, keys: list[str], part: list[str]) -> DataFrame:
    """Per chunk: rows before it and position of the last reset before it (one row a chunk)."""
    summary = base.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(_LAST_RESET).alias("_reset_in")
    )
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    rows_before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    placed = summary.withColumns({
        "_rows_before": rows_before,
        "_reset_pos": F.sum("_rows").over(to_here) - F.col("_rows") + F.col("_reset_in"),
    })
    return placed.select(*part, "_rows_before", F.max("_reset_pos").over(earlier).alias("_reset_before"))


def lookback(df: DataFrame, keys: list[str], order: list[str], rows: int, exprs) -> DataFrame:
    """Frames over the ``rows`` latest rows including the current one."""
    return series_windows(df, keys, order, exprs, before=rows - 1, after=0)
