"""Series bookkeeping shared by live scoring and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators.series import series_windows


def gap_and_warmup(df: DataFrame, keys=("id_fluxo",), gap_s: int = K.GAP_MAX_S, warmup: int = K.SCORE_WARMUP) -> DataFrame:
    """Flag rows after a gap and the first rows of each flow."""
    out = series_windows(
        df, list(keys), ["timestamp", "msm_id"],
        lambda w: {"_before": F.lag("timestamp").over(w)}, before=1, after=0,
    )
    return out.withColumns({
        "lacuna": F.coalesce(F.col("timestamp") - F.col("_before") > gap_s, F.lit(False)),
        "aquecimento": F.col("pos") <= warmup,
    }).drop("_before", "since_reset")


def newest_rows(df: DataFrame, n: int = K.HISTORY_CAP, keys=("id_fluxo",)) -> DataFrame:
    """The ``n`` latest rows of each flow; each task forwards at most ``n`` per flow."""
    w = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), F.desc("msm_id"))
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def close_forecasts(forecasts: DataFrame, keys=("id_fluxo",), gap_s: int = K.GAP_MAX_S) -> DataFrame:
    """Attach to each forecast at t the class seen at t+1, a hit flag and the gap flag."""
    out = series_windows(
        forecasts, list(keys), ["timestamp", "msm_id"],
        lambda w: {"real": F.lead("classe").over(w), "_next": F.lead("timestamp").over(w)},
        before=0, after=1,
    )
    return out.withColumns({
        "fechada": F.col("_next").isNotNull(),
        "acerto": F.when(F.col("real").isNotNull(), F.col("previsto") == F.col("real")),
        "lacuna": F.coalesce(F.col("_next") - F.col("timestamp") > gap_s, F.lit(False)),
    }).drop("_next", "since_reset")


def counted_rows(forecasts: DataFrame, warmup: int = K.SCORE_WARMUP) -> DataFrame:
    """Rows that count in session metrics: past the warm-up and not across a gap."""
    return forecasts.where((F.col("pos") > warmup) & ~F.col("lacuna"))


def session_metrics(forecasts: DataFrame, keys: list[str], warmup: int = K.SCORE_WARMUP) -> DataFrame:
    """Per session: rows, warm-up flag, closed forecasts, transitions, and the scores of forecast and persistence.

    Only closed rows past the warm-up and not across a gap count in the scores.  The gain is left out where
    persistence scores 0, the recall of FALHA where none happened.
    """
    from rttscope.operators import metrics

    rows = counted_rows(forecasts, warmup).where("real is not null")
    mine = metrics.scores(metrics.confusion(rows, keys, "real", "previsto"), "zero")
    base = metrics.scores(metrics.confusion(rows, keys, "real", "classe"), "zero").select(
        *keys, F.col("acuracia").alias("acuracia_persistencia"), F.col("macro_f1").alias("macro_f1_persistencia"))
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fechadas"), F.count_if(F.col("real") != F.col("classe")).alias("transicoes"), F.count_if(F.col("real") == "FALHA").alias("_falhas"))
    whole = forecasts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("abaixo_do_aquecimento", F.col("n") <= warmup)
    out = whole.join(counts, keys).join(mine.select(*keys, "acuracia", "macro_f1", F.col("recall_FALHA").alias("recall_falha")), keys).join(base, keys)
    return out.withColumns({
        "recall_falha": F.when(F.col("_falhas") > 0, F.col("recall_falha")),
        "ganho_macro_f1": F.when(F.col("macro_f1_persistencia") != 0, F.col("macro_f1") - F.col("macro_f1_persistencia")),
    }).drop("_falhas")


def stored_forecasts(forecasts: DataFrame, since: int, limit: int, closed_only: bool = False) -> DataFrame:
    """Newest stored forecasts since an instant."""
    rows = forecasts.where(F.col("timestamp") >= since)
    if closed_only:
        rows = rows.where("real is not null")
    return rows.orderBy(F.desc("timestamp"), "id_fluxo", "msm_id").limit(limit)


def health(measurements: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """One row: newest measurement and its lag, collection cycles by outcome, and warnings of the last day in the event log."""
    newest = measurements.agg(F.max("timestamp")).scalar()
    recent = (F.col("ts") >= now - 86400) & F.col("nivel").isin("AVISO", "ERRO")
    return events.agg(
        F.count_if(F.col("tipo") == "coleta_ok").alias("ciclos_ok"), F.count_if(F.col("tipo").isin("erro_rede", "http_429")).alias("ciclos_falha"),
        F.count_if(recent).alias("avisos_24h"),
    ).select(newest.alias("ultimo"), (F.lit(now) - newest).alias("atraso_s"), "ciclos_ok", "ciclos_falha", "avisos_24h")


def accepted_marks(marks: DataFrame, session: DataFrame) -> DataFrame:
    """Human marks, accepted only if that exact row exists in the session."""
    keys = ["id_fluxo", "timestamp", "status", "motivo"]
    known = session.select(*keys).distinct().withColumn("_known", F.lit(True))
    return marks.join(known, keys, "left").withColumn(
        "situacao", F.when(F.col("_known"), "aceita").otherwise("rejeitada")
    ).drop("_known")
