"""Scored rows: log layout, contract check, audit, late labels, verdict and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions.label import first_match
from rttscope.functions.parse import iso_from_unix
from rttscope.operators import metrics

KEY = ["run_id", "fluxo_id", "ts_previsao"]


def feature_map(names=K.FEATURES) -> Column:
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])


def class_map(probabilities: list[Column]) -> Column:
    return F.create_map(*[x for c, p in zip(K.CLASSES, probabilities) for x in (F.lit(c), p)])


def log_rows(scored: DataFrame, window_s: int, version: str | Column, digest: str | Column) -> DataFrame:
    """The 13 contract fields of each scored row; the run id names its execution window."""
    run = F.floor(F.col("timestamp") / window_s) * window_s
    cols = {
        "run_id": F.concat(F.lit("run-"), run.cast("string")),
        "ts_previsao": iso_from_unix("timestamp"),
        "fluxo_id": F.col("id_fluxo"), "modelo_versao": F.lit(version), "modelo_hash": F.lit(digest),
        "features": feature_map(), "latencia_inferencia_ms": F.lit(0).cast("long"),
        "rotulo_real": F.lit(None).cast("string"), "ts_rotulo": F.lit(None).cast("string"),
    }
    return scored.withColumns(cols).select(*K.LOG_FIELDS)


def contract_violations(names=K.FEATURES) -> Column:
    """Names of the contract rules a log row breaks; empty array for a sound row."""
    classes = F.array(*[F.lit(c) for c in K.CLASSES])
    keys = F.coalesce(F.map_keys("proba"), F.array().cast("array<string>"))
    total = F.aggregate(F.map_values("proba"), F.lit(0.0), lambda a, x: a + x)
    wrong_keys = (F.size(F.array_except(keys, classes)) > 0) | (F.size(F.array_except(classes, keys)) > 0)
    off = F.coalesce(F.abs(total - 1) > K.PROBA_TOLERANCE, F.lit(True))
    missing = F.exists(
        F.array(*[F.lit(n) for n in names]), lambda n: F.try_element_at("features", n).isNull()
    )
    return F.array_compact(F.array(
        F.when(F.col("run_id").isNull() | F.col("fluxo_id").isNull() | F.col("ts_previsao").isNull(), "chave ausente"),
        F.when(~F.coalesce(F.col("classe_prevista").isin(*K.CLASSES), F.lit(False))
               | ~F.coalesce(F.col("classe_atual").isin(*K.CLASSES), F.lit(False)), "classe invalida"),
        F.when(wrong_keys | off, "proba nao soma 1"),
        F.when(F.col("rotulo_real").isNotNull() & ~F.col("rotulo_real").isin(*K.CLASSES), "rotulo_real invalido"),
        F.when(F.coalesce(missing, F.lit(True)), "feature ausente"),
        F.when(F.coalesce(F.col("modelo_versao"), F.lit("")).eqNullSafe("") | ~F.coalesce(F.col("modelo_hash").startswith("sha256:"), F.lit(False)),
               "modelo_versao ou modelo_hash fora do manifesto"),
        F.when(F.col("latencia_inferencia_ms") < 0, "latencia negativa"),
    ))


def accept(rows: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split scored rows into new sound ones and quarantined ones with their reasons."""
    checked = rows.withColumn("motivos", contract_violations())
    bad = checked.where(F.size("motivos") > 0).withColumn("motivos", F.array_join("motivos", "; "))
    w = Window.partitionBy(*KEY).orderBy("classe_prevista")
    good = checked.where(F.size("motivos") == 0).drop("motivos")
    good = good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if stored is not None:
        good = good.join(stored.select(*KEY), KEY, "left_anti")
    return good, bad


def attach_labels(log: DataFrame, labels: DataFrame) -> DataFrame:
    """Fill a late label once: only where none is set, and only the first row of a key.

    Labels outside the class domain are ignored; of several labels for a key the earliest
    wins.
    """
    valid = labels.where(F.col("rotulo").isin(*K.CLASSES))
    first = valid.groupBy(*KEY).agg(F.min(F.struct("ts", "rotulo")).alias("_l"))
    w = Window.partitionBy(*KEY).orderBy(F.col("rotulo_real").isNotNull(), "classe_prevista")
    ranked = log.withColumn("_n", F.row_number().over(w)).join(first, KEY, "left")
    fill = F.col("rotulo_real").isNull() & (F.col("_n") == 1) & F.col("_l").isNotNull()
    return ranked.withColumns({
        "rotulo_real": F.when(fill, F.col("_l.rotulo")).otherwise(F.col("rotulo_real")),
        "ts_rotulo": F.when(fill, F.col("_l.ts")).otherwise(F.col("ts_rotulo")),
    }).drop("_n", "_l")


def audit(rows: DataFrame, label_share: float = K.LABEL_SHARE_MIN, names=K.FEATURES) -> DataFrame:
    """One verdict row over a period of the log, from counts of each kind of problem."""
    checked = rows.withColumn("_m", contract_violations())
    repeated = rows.groupBy(*KEY).agg((F.count(F.lit(1)) - 1).alias("r")).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r"))

    def broken(name):
        return F.count_if(F.array_contains("_m", name))

    row = checked.agg(
        F.count(F.lit(1)).alias("n"), broken("classe invalida").alias("classe_invalida"),
        broken("proba nao soma 1").alias("proba_invalida"), broken("rotulo_real invalido").alias("rotulo_invalido"),
        broken("feature ausente").alias("com_nulos"), F.count("rotulo_real").alias("com_rotulo"),
    ).withColumn("duplicatas", repeated.scalar())
    share = F.try_divide("com_rotulo", "n")
    failed = (F.col("classe_invalida") + F.col("proba_invalida") + F.col("rotulo_invalido") + F.col("duplicatas")) > 0
    return row.withColumn("fracao_rotulada", share).withColumn("veredito", first_match([
        (F.col("n") == 0, "ATENCAO"), (failed, "FALHOU"),
        ((F.col("fracao_rotulada") < label_share) | (F.col("com_nulos") > 0), "ATENCAO"),
    ], "PASSOU"))


def field_slices(log: DataFrame, minimum: int) -> DataFrame:
    """General and transition metrics of labelled predictions; small slices are inconclusive."""
    rows = log.where(F.col("rotulo_real").isin(*K.CLASSES) & F.col("classe_atual").isin(*K.CLASSES))
    member = F.array_compact(F.array(F.lit("geral"), F.when(F.col("rotulo_real") != F.col("classe_atual"), "transicoes")))
    rows = rows.withColumn("fatia", F.explode(member))
    model = metrics.scores(metrics.confusion(rows, ["fatia"], "rotulo_real", "classe_prevista"), "zero")
    base = metrics.scores(metrics.confusion(rows, ["fatia"], "rotulo_real", "classe_atual"), "zero")
    out = metrics.gain(model, base, ["fatia"])
    shown = F.col("n") >= minimum
    return out.select(
        "fatia", "n", F.when(shown, "calculado").otherwise("INCONCLUSIVO").alias("status"),
        *[F.when(shown, F.col(c)).alias(c) for c in ("macro_f1", "recall_falha", "ganho")],
    )


def verdict(slices: DataFrame, floors: dict[str, float | None], lead_time: float | None = None,
            other_slices_ok: bool = False) -> DataFrame:
    """Field verdict from the slice metrics and the three agreed floors."""
    def metric(name, which):
        return F.max(F.when((F.col("fatia") == which) & (F.col("status") == "calculado"), F.col(name)))

    pairs = {
        "macro_f1_transicoes": ("macro_f1", "transicoes"), "recall_falha": ("recall_falha", "geral"),
        "ganho_sobre_persistencia": ("ganho", "geral"),
    }
    row = slices.agg(*[metric(*v).alias(k) for k, v in pairs.items()])
    agreed = all(floors.get(k) is not None for k in pairs)
    limits = {k: F.lit(floors.get(k)).cast("double") for k in pairs}
    present = sum((F.col(k).isNotNull().cast("int") for k in pairs), F.lit(0))
    below = F.lit(False)
    for k in pairs:
        below = below | F.coalesce(F.col(k) < limits[k], F.lit(False))
    no_lead = floors.get("antecedencia_media_minutos") is not None and lead_time is None
    return row.withColumn("veredito", first_match([
        (F.lit(not agreed) | (present == 0), "INCONCLUSIVO"), (below, "FALHOU"),
        ((present < len(pairs)) | F.lit(not other_slices_ok or no_lead), "ATENCAO"),
    ], "PASSOU"))


def gate(challenger: DataFrame, floors: DataFrame, new_test_set: bool = True) -> DataFrame:
    """Promotion gate: every floor met by the challenger on a new test set."""
    rows = floors.join(challenger, "metrica", "left")
    met = F.coalesce(F.col("valor") >= F.col("piso"), F.lit(False))
    return rows.agg(
        (F.every(met) & F.lit(new_test_set)).alias("promove"),
        F.array_join(F.sort_array(F.collect_list(F.when(~met, F.col("metrica")))), ",").alias("faltas"),
    )


def operation_counters(log: DataFrame, file_col: str = "arquivo") -> DataFrame:
    """Collection totals, one entry per (file, flow)."""
    once = log.dropDuplicates([file_col, "fluxo_id"])
    return once.agg(
        F.sum(F.coalesce("ok", F.lit(0)) + F.coalesce("timeout", F.lit(0))).alias("coletadas"),
        F.sum(F.coalesce("invalida", F.lit(0))).alias("descartadas"),
        F.sum(F.coalesce("timeout", F.lit(0))).alias("timeouts"),
        F.sum(F.coalesce("sem_resultado", F.lit(0))).alias("sem_resultado"),
        F.count_distinct(file_col).alias("n_execucoes"),
    )


def period(log: DataFrame) -> DataFrame:
    return log.agg(
        F.min("ts_previsao").alias("inicio"), F.max("ts_previsao").alias("fim"), F.count("ts_previsao").alias("n")
    )


def compare_scores(recorded: DataFrame, rescored: DataFrame, keys=("id_fluxo", "timestamp")) -> DataFrame:
    """Stored against recomputed predictions of the same rows."""
    right = rescored.select(*keys, F.col("classe_prevista").alias("recalculada"))
    return recorded.join(right, list(keys), "full_outer").withColumn(
        "igual", F.col("classe_prevista").eqNullSafe(F.col("recalculada"))
    )


def classify_item(df: DataFrame, probe: Column, timeout_is_loss: bool = True) -> DataFrame:
    """Contract classifier of one collected item: situation and reason, first match.

    An offline item has its own situation and no reason.  With ``timeout_is_loss`` any timeout mark
    takes RTT, latency and jitter away, also from a partly answered ping.
    """
    offline = F.coalesce("offline", F.lit(False))
    lost = F.coalesce(F.col("rcvd") == 0, F.lit(False))
    avg = F.col("avg")
    timeout = F.coalesce(F.col("tem_timeout"), F.lit(False)) | F.coalesce(avg == -1, F.lit(False))
    reason = first_match([
        (offline, F.lit(None).cast("string")),
        (~F.coalesce(F.col("probe_id") == probe, F.lit(False)), K.ITEM_OTHER_PROBE),
        (F.col("timestamp").isNull(), K.ITEM_BAD_TIME),
        (~F.coalesce(F.col("perda_pct").between(0, 100), F.lit(False)), K.ITEM_BAD_LOSS),
        (F.coalesce(avg < 0, F.lit(False)) & ~timeout & ~lost, K.ITEM_NEGATIVE),
        (F.col("rtt_avg").isNull() & ~timeout & ~lost, K.ITEM_NO_LATENCY),
    ])
    rows = df.withColumn("motivo", reason)
    situation = first_match([
        (offline, K.ITEM_OFFLINE), (F.col("motivo").isNotNull(), "invalida"), (timeout, "timeout"),
    ], "ok")
    rows = rows.withColumn("situacao", situation)
    if timeout_is_loss:
        gone = ("rtt_min", "rtt_max", "rtt_avg", "latencia_ms", "jitter_ms")
        rows = rows.withColumns({c: F.when(~timeout, F.col(c)) for c in gone})
    return rows


def in_batch(start: int, end: int) -> Column:
    """Window test that lets items without a time through, so that they reach quarantine."""
    t = F.col("timestamp")
    return t.isNull() | F.coalesce("offline", F.lit(False)) | ((t >= start) & (t < end))


def new_rows(batch: DataFrame, known: DataFrame, keys=("id_fluxo", "timestamp"), order=("event_id",)):
    """New rows of a batch and, apart, rows repeating a time inside it.

    The second and later row of one time in the batch is a reject, also of a known time; the
    first is skipped silently where its time is known.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = batch.withColumn("_n", F.row_number().over(w))
    fresh = ranked.where("_n = 1").drop("_n").join(known.select(*keys).distinct(), list(keys), "left_anti")
    return fresh, ranked.where("_n > 1").drop("_n").withColumn("motivo", F.lit(K.ITEM_REPEATED))
