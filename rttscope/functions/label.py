"""Row rules: the ordered label, the split tag and small banding functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rttscope import contract as K


def _sure(condition: Column) -> Column:
    """Missing operands never satisfy a comparison."""
    return F.coalesce(condition, F.lit(False))


def first_match(rules, otherwise=None) -> Column:
    """An ordered (condition, value) list as one ``when`` chain."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, F.lit(value) if not isinstance(value, Column) else value)
    return chain.otherwise(otherwise)


def label_reason(loss="perda_pct", latency="latencia_ms", jitter="jitter_ms") -> Column:
    """First reason that holds, severity order; see :func:`label_class` for its class."""
    loss, latency, jitter = F.col(loss), F.col(latency), F.col(jitter)
    return first_match(
        [
            (F.col("status_baseline").isNull(), K.REASON_NO_BASELINE),
            (F.col("status_baseline") != K.STATUS_VALID, K.REASON_SHORT_BASELINE),
            (loss.isNull(), K.REASON_NO_LOSS),
            (loss >= K.LOSS_FAIL - K.LOSS_EPS, K.REASON_SEVERE_LOSS),
            (_sure(latency > F.col("p99_rtt_A")), K.REASON_P99),
            (loss >= K.LOSS_RISK - K.LOSS_EPS, K.REASON_PARTIAL_LOSS),
            (_sure(latency > F.col("p95_rtt_A")), K.REASON_P95),
            (_sure(jitter > F.col("p95_jitter_A")), K.REASON_JITTER),
        ],
        K.REASON_NONE,
    )


def label_class(reason="motivo_rotulagem") -> Column:
    r = F.col(reason)
    return (
        F.when(r.isin(K.REASON_SEVERE_LOSS, K.REASON_P99), "FALHA")
        .when(r.isin(K.REASON_PARTIAL_LOSS, K.REASON_P95, K.REASON_JITTER), "RISCO")
        .when(r == K.REASON_NONE, "OK")
    )


def split_tag(ts: Column, t0: Column, train_days: float, valid_days: float, embargo_min: float) -> Column:
    """Chronological split; the embargo after each cut belongs to no split."""
    cut1, cut2 = t0 + int(train_days * 86400), t0 + int(valid_days * 86400)
    hold = int(embargo_min * 60)
    return (
        F.when(ts < cut1, "treino")
        .when(ts < cut1 + hold, K.REASON_EMBARGO)
        .when(ts < cut2, "validacao")
        .when(ts < cut2 + hold, K.REASON_EMBARGO)
        .otherwise("teste")
    )


def rtt_band(col: str) -> Column:
    v = F.col(col)
    return (
        F.when(v.isNull() | F.isnan(v) | (v == K.SENTINEL), "sem_rtt")
        .when(v < 0.8, "abaixo").when(v <= 1.2, "tipica").otherwise("alta")
    )


def psi_status(value: Column) -> Column:
    return (
        F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), K.DRIFT_STATUS[0])
        .when(value < K.PSI_STABLE, K.DRIFT_STATUS[1])
        .when(value <= K.PSI_ALERT, K.DRIFT_STATUS[2])
        .otherwise(K.DRIFT_STATUS[3])
    )


def status_rank(col: Column) -> Column:
    """Ordinal of a drift status; unknown text counts as the lowest."""
    return F.coalesce(
        F.array_position(F.array(*[F.lit(s) for s in K.DRIFT_STATUS]), col) - 1, F.lit(0)
    ).cast("int")


def worst_status(col: Column) -> Column:
    """Aggregate: the most severe status of a group."""
    return F.element_at(
        F.array(*[F.lit(s) for s in K.DRIFT_STATUS]), F.coalesce(F.max(status_rank(col)), F.lit(0)) + 1
    )


def near(a: Column, b: Column, eps: float = K.TOLERANCE) -> Column:
    """Equal within ``eps`` or in six significant digits; two missing values are equal."""
    same_text = F.format_string("%.5e", a) == F.format_string("%.5e", b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(
        (F.abs(a - b) <= eps) | same_text
    )
