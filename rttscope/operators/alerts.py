"""Alert rules over drift and performance tables, cooldown and the append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions.privacy import alert_id

# fixed values: rule -> (severity, action)
RULES = {
    "psi_feature_importante": ("media", "investigar a fatia afetada (rota, API, sazonalidade)"),
    "proporcao_classes": ("media", "verificar evento real contra artefato"),
    "contrato_ou_coleta": ("alta", "pausar as previsoes da execucao e investigar a coleta"),
    "macro_f1": ("alta", "abrir processo de retreino"),
}


def _alert(df: DataFrame, rule: str, key: Column, evidence: Column, now: str) -> DataFrame:
    severity, action = RULES[rule]
    return df.select(
        alert_id(F.lit(rule), key).alias("id"), F.lit(now).alias("ts"), F.lit(rule).alias("regra"),
        key.alias("chave"), F.lit(severity).alias("gravidade"), evidence.cast("double").alias("evidencia"),
        F.lit(action).alias("acao"), F.lit("aberto").alias("status"),
    )


def important(importance: DataFrame) -> DataFrame:
    """Features at or above the upper-middle importance and above zero.

    The table has one row per feature.
    """
    w = Window.orderBy("importancia")
    ranked = importance.withColumns({
        "_r": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy()),
    })
    middle = ranked.where(F.col("_r") == F.floor(F.col("_n") / 2)).select("importancia").scalar()
    return importance.where((F.col("importancia") >= middle) & (F.col("importancia") > 0))


def psi_alerts(features: DataFrame, importance: DataFrame, now: str) -> DataFrame:
    """Important features whose PSI status stands at alert and whose PSI is over the limit."""
    rows = features.where((F.col("status_final") == "alerta") & (F.col("psi") > K.PSI_ALERT)).join(
        important(importance).select("feature"), "feature", "left_semi"
    )
    return _alert(rows, "psi_feature_importante", F.concat_ws(":", "janela", "feature"), F.col("psi"), now)


def mix_alerts(mix: DataFrame, now: str) -> DataFrame:
    rows = mix.where(F.col("status") == "alerta")
    return _alert(rows, "proporcao_classes", F.concat(F.col("janela"), F.lit(":proporcao")), F.col("js"), now)


def collection_alerts(state: DataFrame, now: str) -> DataFrame:
    """``state``: rows with ``falha_coleta`` and ``contrato_invalido``; one alert if any holds."""
    row = state.agg(F.bool_or(F.col("falha_coleta") | F.col("contrato_invalido")).alias("ruim")).where("ruim")
    return _alert(row, "contrato_ou_coleta", F.lit("coleta"), F.lit(1.0), now)


def low_runs(history: DataFrame, order: str, floor: float = K.MACRO_F1_MIN, k: int = K.LOW_F1_WINDOWS) -> DataFrame:
    """Whether the last ``k`` evaluation windows were all conclusive and under the floor."""
    last = history.orderBy(F.desc(order)).limit(k)
    low = F.coalesce((F.col("status") != K.DRIFT_STATUS[0]) & (F.col("macro_f1") < floor), F.lit(False))
    return last.agg(((F.count(F.lit(1)) == k) & F.every(low)).alias("abaixo"), F.max("macro_f1").alias("macro_f1"))


def performance_alerts(history: DataFrame, order: str, now: str) -> DataFrame:
    row = low_runs(history, order).where("abaixo")
    return _alert(row, "macro_f1", F.lit("macro_f1"), F.col("macro_f1"), now)


def outside_cooldown(alerts: DataFrame, earlier: DataFrame, now: str, hours: int = K.COOLDOWN_H) -> DataFrame:
    """Drop alerts whose rule and key already stand unresolved within the cooldown."""
    limit = F.lit(now).cast("timestamp") - F.expr(f"interval {int(hours)} hours")
    open_ones = earlier.where(
        (F.col("status") != "resolvido") & (F.col("ts").cast("timestamp") >= limit)
    ).select("regra", "chave").distinct()
    return alerts.join(open_ones, ["regra", "chave"], "left_anti")
