"""The 21 features of one flow series, and its target columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators.series import series_windows

FLOW = ["anchor_id", "probe_id"]


def instant_features(df: DataFrame) -> DataFrame:
    """Row-level features; a ratio with a zero or missing denominator is missing."""
    delta = F.col("delta_ttl")
    # least/greatest skip NULL, so a missing delta is guarded explicitly
    clipped = F.when(
        delta.isNotNull(), F.greatest(F.lit(-float(K.TTL_CLIP)), F.least(F.lit(float(K.TTL_CLIP)), delta))
    )
    return df.withColumns({
        "rtt_ausente": F.col("rtt_avg").isNull().cast("int"),
        "razao_rtt_p95": F.try_divide("rtt_avg", "p95_rtt_A"),
        "razao_rtt_p99": F.try_divide("rtt_avg", "p99_rtt_A"),
        "razao_jitter_p95": F.try_divide("jitter_ms", "p95_jitter_A"),
        "amplitude_rtt_rel": F.try_divide(F.col("rtt_max") - F.col("rtt_min"), F.col("rtt_avg")),
        "delta_ttl_clip": clipped,
        "ttl_reset": F.coalesce(F.abs(delta) >= K.TTL_RESET, F.lit(False)).cast("int"),
    })


def rolling(w: WindowSpec) -> dict[str, Column]:
    """Window features over the current and the n-1 previous rows."""
    out = {}
    ratio = F.col("razao_rtt_p95")
    for n in K.WINDOWS:
        frame = w.rowsBetween(-(n - 1), 0)
        out[f"perda_media_w{n}"] = F.avg("perda_pct").over(frame)
        out[f"rtt_p95_max_w{n}"] = F.max(ratio).over(frame)
        out[f"jitter_p95_max_w{n}"] = F.max("razao_jitter_p95").over(frame)
        out[f"n_rtt_acima_p95_w{n}"] = F.sum((ratio > 1).cast("double")).over(frame)
    return out


def upcoming(w: WindowSpec, horizon: int = K.HORIZON) -> dict[str, Column]:
    """The next measurement's class and the distance to it."""
    return {
        "alvo": F.lead("classe", horizon).over(w),
        "gap_s": F.lead("timestamp", horizon).over(w) - F.col("timestamp"),
    }


def series_features(series: DataFrame) -> DataFrame:
    """All features plus target columns, one shuffle by (flow, time chunk)."""
    rows = instant_features(series)
    out = series_windows(
        rows, FLOW, ["timestamp", "msm_id"], lambda w: {**rolling(w), **upcoming(w)},
        before=max(K.WINDOWS) - 1, after=K.HORIZON, reset=~(F.col("perda_pct") > 0),
    )
    return out.withColumnRenamed("since_reset", K.STREAK_FEATURE)


def fill_sentinel(df: DataFrame) -> DataFrame:
    """Missing becomes -1 in every feature but the four that are never missing."""
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(K.SENTINEL)) for c in K.FEATURES if c not in K.NO_SENTINEL
    })
