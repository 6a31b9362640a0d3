"""Data-quality jobs: invariants as violation counts, differential and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions.label import near
from rttscope.operators.features import series_features


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, all counted in one pass, as (regra, n)."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("regra"), F.col(n).alias("n")) for n in rules
    ])))


def dataset_invariants(processed: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Alias equality, period, delta and change recomputation, total loss without RTT."""
    delta = F.col("ttl") - F.col("ttl_baseline")
    return violations(processed, {
        "latencia_igual_rtt_avg": ~F.col("latencia_ms").eqNullSafe(F.col("rtt_avg")),
        "fora_da_janela": ~((F.col("timestamp") >= window[0]) & (F.col("timestamp") < window[1])),
        "delta_ttl": ~F.col("delta_ttl").eqNullSafe(delta),
        "ttl_changed": ~F.col("ttl_changed").eqNullSafe((delta != 0).cast("int")),
        "rtt_com_perda_total": (F.col("perda_pct") == 100) & F.col("rtt_avg").isNotNull(),
        "ordem_min_max": F.col("rtt_min") > F.col("rtt_max") + K.DIVERGENCE_MS,
    })


def one_ttl_baseline(processed: DataFrame) -> DataFrame:
    """Pairs showing more than one TTL baseline."""
    return processed.groupBy("anchor_id", "probe_id").agg(
        F.count_distinct("ttl_baseline").alias("n")
    ).where("n > 1")


def recorded_divergences(parsed: DataFrame, eps: float = K.DIVERGENCE_MS) -> DataFrame:
    """Recorded min/max/avg that differ from the packets' own values."""
    rows = parsed.where((F.col("rcvd") != 0) & (F.size("_rtts") > 0))
    long = rows.select("event_id", "id_fluxo", "timestamp", F.inline(F.array(
        F.struct(F.lit("min").alias("campo"), F.col("min").alias("original"), F.array_min("_rtts").alias("recalculado")),
        F.struct(F.lit("max").alias("campo"), F.col("max").alias("original"), F.array_max("_rtts").alias("recalculado")),
        F.struct(F.lit("avg").alias("campo"), F.col("avg").alias("original"), F.col("_rtt_mean").alias("recalculado")),
    )))
    return long.where(F.abs(F.col("original") - F.col("recalculado")) > eps)


def label_invariants(labelled: DataFrame) -> DataFrame:
    """What the rule promises, checked on its output."""
    loss, lat, cls = F.col("perda_pct"), F.col("latencia_ms"), F.col("classe")
    valid = F.col("status_baseline").eqNullSafe(K.STATUS_VALID)
    return violations(labelled, {
        "perda_severa_sem_falha": valid & (loss >= K.LOSS_FAIL - K.LOSS_EPS) & ~cls.eqNullSafe("FALHA"),
        "acima_p99_sem_falha": valid & loss.isNotNull() & (lat > F.col("p99_rtt_A")) & ~cls.eqNullSafe("FALHA"),
        "acima_p95_ok": valid & (lat > F.col("p95_rtt_A")) & (cls == "OK"),
        "sem_baseline_com_classe": ~valid & cls.isNotNull(),
        "perda_vazia_com_classe": loss.isNull() & cls.isNotNull(),
    })


def split_order(final: DataFrame, embargo_s: int) -> DataFrame:
    """Boundaries of the splits in time order, with the pause each one keeps to the one before."""
    per = final.groupBy("split").agg(F.min("timestamp").alias("inicio"), F.max("timestamp").alias("fim"))
    # three rows
    row = per.groupBy().pivot("split", list(K.SPLITS)).agg(F.min("inicio").alias("i"), F.max("fim").alias("f"))
    c = F.col
    return row.select(
        ((c("validacao_i") - c("treino_f")) >= embargo_s).alias("treino_antes_validacao"),
        ((c("teste_i") - c("validacao_f")) >= embargo_s).alias("validacao_antes_teste"),
    )


def duplicated_keys(final: DataFrame, keys=("id_fluxo", "timestamp")) -> DataFrame:
    return final.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def feature_differences(left: DataFrame, right: DataFrame, keys: list[str], names=K.FEATURES) -> DataFrame:
    """Full equi join of two feature tables by key; one row per (key, feature) that differs."""
    def side(df, name):
        return df.select(*keys, F.struct(*[F.col(n).cast("double").alias(n) for n in names]).alias(name))

    both = side(left, "l").join(side(right, "r"), keys, "full_outer")
    differing = F.array_compact(F.array(*[
        F.when(~near(F.col(f"l.{n}"), F.col(f"r.{n}")), F.struct(F.lit(n).alias("feature"), F.col(f"l.{n}").alias("a"), F.col(f"r.{n}").alias("b")))
        for n in names
    ]))
    return both.select(*keys, F.inline(differing))


def mutated_future(series: DataFrame, cut: int) -> DataFrame:
    """The series with every measurement after ``cut`` replaced."""
    later = F.col("timestamp") > cut

    def shifted(c):
        return F.when(later, F.coalesce(F.col(c), F.lit(0.0)) * 3 + 1).otherwise(F.col(c))

    return series.withColumns({
        "perda_pct": F.when(later, 100 - F.col("perda_pct")).otherwise(F.col("perda_pct")),
        **{c: shifted(c) for c in ("rtt_avg", "rtt_min", "rtt_max", "jitter_ms")},
        "delta_ttl": F.when(later, F.coalesce("delta_ttl", F.lit(0)) + 2 * K.TTL_RESET).otherwise(F.col("delta_ttl")),
        "classe": F.when(later, F.when(F.col("classe").eqNullSafe("OK"), "FALHA").otherwise("OK")).otherwise(F.col("classe")),
    })


def leakage_differences(series: DataFrame, features: DataFrame, cut: int) -> DataFrame:
    """Features up to ``cut`` that move when all later measurements change, or vanish.

    Two recomputations are compared with the stored features: on the prefix alone, and on
    the series with a mutated future.  Both must give no row.
    """
    keys = ["id_fluxo", "timestamp", "msm_id"]
    before = features.where(F.col("timestamp") <= cut).select(*keys, *K.FEATURES)
    prefix = series_features(series.where(F.col("timestamp") <= cut))
    mutated = series_features(mutated_future(series, cut)).where(F.col("timestamp") <= cut)
    a = feature_differences(before, prefix.select(*keys, *K.FEATURES), keys).withColumn("prova", F.lit("prefixo"))
    b = feature_differences(before, mutated.select(*keys, *K.FEATURES), keys).withColumn("prova", F.lit("futuro"))
    return a.unionByName(b)


def matrix_support(scores: DataFrame) -> DataFrame:
    """Metric rows whose matrix row sums do not equal the class supports."""
    from rttscope.operators.metrics import cell

    bad = F.lit(False)
    for c in K.CLASSES:
        total = sum((F.col(cell(c, p)) for p in K.CLASSES), F.lit(0))
        bad = bad | (total != F.col(f"suporte_{c}"))
    return scores.where(bad)


def same_value(computed: DataFrame, recorded: DataFrame, keys: list[str], col: str, eps: float = K.TOLERANCE) -> DataFrame:
    """Computed against recorded metric within a tolerance."""
    right = recorded.select(*keys, F.col(col).alias("_r"))
    return computed.join(right, keys, "full_outer").select(
        *keys, F.coalesce(F.abs(F.col(col) - F.col("_r")) <= eps, F.lit(False)).alias("confere")
    )
