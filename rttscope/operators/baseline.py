"""Reference values of each flow, from period A only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators.quantiles import exact_quantiles

PAIR = ["anchor_id", "probe_id"]


def ttl_stats(rows_a: DataFrame) -> DataFrame:
    """TTL median, count, range and distinct values per pair.

    TTLs are counted per value first; a pair has at most 256 values, so the exact median
    of the counts is small whatever the number of rows.
    """
    counts = rows_a.where("ttl is not null").groupBy(*PAIR, "ttl").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*PAIR).agg(
        F.expr("percentile(ttl, 0.5D, c)").alias("ttl_baseline"),
        F.sum("c").alias("n_ttl_A"),
        F.min("ttl").alias("ttl_min_A"), F.max("ttl").alias("ttl_max_A"),
        F.count(F.lit(1)).alias("n_ttl_distintos_A"),
    )


def ttl_baseline(rows_a: DataFrame, minimum: int = K.MIN_SAMPLES) -> DataFrame:
    """The step-5 table: only pairs with enough TTLs."""
    return (
        ttl_stats(rows_a).where(F.col("n_ttl_A") >= minimum)
        .withColumnRenamed("n_ttl_A", "n_amostras_A")
        .select(*PAIR, "ttl_baseline", "n_amostras_A", "ttl_min_A", "ttl_max_A", "n_ttl_distintos_A")
    )


_PROBS = {"mediana": 0.5, "p95": 0.95, "p99": 0.99}


def rtt_baseline(
    instants_a: DataFrame, universe: DataFrame | None = None, minimum: int = K.MIN_SAMPLES
) -> DataFrame:
    """The 16-column baseline per flow from period-A instant metrics.

    RTT and jitter quantiles of all flows come from one pass over long (flow, metric,
    value) rows.  ``universe`` adds flows that should be listed even without a row in A.
    """
    flow = [*PAIR, "id_fluxo"]
    counts = instants_a.groupBy(*flow).agg(
        F.count(F.lit(1)).alias("n_amostras_A"),
        F.count("rtt_avg").alias("n_rtt_validos_A"),
    )
    if universe is not None:
        counts = universe.select(*flow).join(counts, flow, "left").na.fill(
            0, ["n_amostras_A", "n_rtt_validos_A"]
        )
    long = instants_a.select(*PAIR, F.inline(F.array(
        F.struct(F.lit("rtt").alias("metric"), F.col("rtt_avg").alias("value")),
        F.struct(F.lit("jitter").alias("metric"), F.col("jitter_ms").alias("value")),
    )))
    quantiles = exact_quantiles(long, [*PAIR, "metric"], "value", _PROBS)
    wide = quantiles.groupBy(*PAIR).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{p}_{m}_A")
        for m in ("rtt", "jitter") for p in _PROBS
    ])
    enough = F.col("n_rtt_validos_A") >= minimum
    joined = counts.join(wide, PAIR, "left").join(ttl_stats(instants_a), PAIR, "left")
    blanked = {
        f"{p}_{m}_A": F.when(enough, F.col(f"{p}_{m}_A")) for m in ("rtt", "jitter") for p in _PROBS
    }
    return joined.withColumns({
        **blanked,
        "ttl_baseline": F.when(F.col("n_ttl_A") >= minimum, F.col("ttl_baseline")),
        "status_baseline": F.when(enough, K.STATUS_VALID).otherwise(K.STATUS_SHORT),
    }).select(*K.BASELINE_COLUMNS)


def loss_share(rows_a: DataFrame) -> DataFrame:
    """Percent of executions with any loss, and number of measurements seen, per flow."""
    lossy = F.coalesce(F.col("rcvd") < F.col("sent"), F.lit(False))
    by_msm = rows_a.groupBy("id_fluxo", "msm_id").agg(
        F.count_if(lossy).alias("l"), F.count(F.lit(1)).alias("c")
    )
    return by_msm.groupBy("id_fluxo").agg(
        F.round(F.lit(100.0) * F.sum("l") / F.sum("c"), 6).alias("pct_execucoes_com_perda"),
        F.count("msm_id").alias("n_msm"), F.sum("c").alias("n_execucoes"),
    )


def universe(classes: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Flows that get a baseline: used in A and on no exclusion list."""
    kept = classes.where(F.col("classe_fluxo").isin("A+B", "A"))
    return kept if excluded is None else kept.join(excluded, ["id_fluxo"], "left_anti")


def compare_ttl(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Per flow the TTL fields that differ between two baselines, or that one is absent."""
    fields = ["ttl_baseline", "ttl_min_A", "ttl_max_A", "n_ttl_distintos_A"]
    right = other.select(*PAIR, *[F.col(f).alias(f"_o_{f}") for f in fields], F.lit(True).alias("_seen"))
    joined = mine.join(right, PAIR, "left")
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f).eqNullSafe(F.col(f"_o_{f}")), F.lit(f)) for f in fields
    ]))
    return joined.select(
        *PAIR, "id_fluxo",
        F.when(F.col("_seen").isNull(), F.lit("ausente")).otherwise(F.array_join(differing, ",")).alias("diferenca"),
    ).where("diferenca <> ''")
