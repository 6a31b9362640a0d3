"""Queries of production: log contract, labels, audit, verdict, gate, alerts, stored forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions.privacy import alert_id, pseudonym, pseudonymise
from rttscope.operators import alerts, baseline, collection, drift, metrics, online, scoring
from rttscope.plans.bayes_sql import NB_IMPORTANCE
from rttscope.plans.catalog import register, rounded, stages
from rttscope.plans.queries_drift import DRIFT_CTES, FINAL_STATUS, Drift
from rttscope.session import materialise, work_path
from rttscope.sources import adapter, sinks

RUN = 3600
NOW = "2024-01-31T00:00:00Z"
ISO = "strftime(to_timestamp({}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"

PROD_CTES = {
    **DRIFT_CTES,
    "scored": """
  SELECT *, CASE WHEN timestamp % 89 = 0 THEN 'OUTRA' ELSE classe_prevista END AS prevista, CASE WHEN timestamp % 97 = 0 THEN 0.4 ELSE 0.1 END AS resto FROM preds""",
    "logrows": f"""
  SELECT 'run-' || (timestamp // {RUN} * {RUN})::VARCHAR AS run_id, {ISO.format('timestamp')} AS ts_previsao, fluxo_id, anchor_id, prevista AS classe_prevista,
    classe_atual, alvo, timestamp, prevista = 'OUTRA' AS m1, resto <> 0.1 AS m2, timestamp % 83 = 0 OR timestamp % 79 = 0 AS m3 FROM scored""",
    "good": """
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, fluxo_id, ts_previsao ORDER BY classe_prevista) AS n FROM logrows WHERE NOT m1 AND NOT m2 AND NOT m3) WHERE n = 1""",
    "late": """
  SELECT run_id, fluxo_id, ts_previsao, CASE WHEN timestamp % 10 = 3 THEN 'NADA' ELSE alvo END AS rotulo, timestamp AS ts FROM good WHERE timestamp % 10 < 7
  UNION ALL SELECT run_id, fluxo_id, ts_previsao, 'OK', timestamp + 60 FROM good WHERE timestamp % 10 < 2""",
    "labelled_log": """
  SELECT g.*, l.rotulo AS rotulo_real FROM good g LEFT JOIN (SELECT run_id, fluxo_id, ts_previsao, arg_min(rotulo, ts) AS rotulo FROM late
    WHERE rotulo IN ('OK', 'RISCO', 'FALHA') GROUP BY ALL) l USING (run_id, fluxo_id, ts_previsao)""",
}


_LOGS: dict = {}


def scored_rows(spark, sf):
    """Scored rows and their stored log, a few of them broken on purpose."""
    rows = Drift(spark, sf).preds
    rest = F.when(F.col("timestamp") % 97 == 0, 0.4).otherwise(0.1)
    rows = rows.withColumn("classe_prevista", F.when(F.col("timestamp") % 89 == 0, "OUTRA").otherwise(F.col("classe_prevista")))
    share = [F.when(F.col("classe_prevista") == c, 0.8).otherwise(rest) for c in K.CLASSES]
    # a row of an unknown class still gets a probability map over the three classes
    share[0] = F.when(F.col("classe_prevista") == "OUTRA", 0.8).otherwise(share[0])
    rows = rows.withColumn("proba", scoring.class_map(share))
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LOGS:
        digest = F.when(F.col("timestamp") % 83 == 0, "0" * 64).otherwise("sha256:" + "0" * 64)
        version = F.when(F.col("timestamp") % 79 != 0, "rf_v1.0.0")
        _LOGS[key] = materialise(scoring.log_rows(rows, RUN, version, digest), "log")
    return rows, _LOGS[key]


def late_labels(good):
    t = F.unix_seconds(F.to_timestamp("ts_previsao"))
    now = F.col("_alvo")
    first = good.where(t % 10 < 7).select(*scoring.KEY, F.when(t % 10 == 3, "NADA").otherwise(now).alias("rotulo"), t.alias("_t"))
    again = good.where(t % 10 < 2).select(*scoring.KEY, F.lit("OK").alias("rotulo"), (t + 60).alias("_t"))
    return first.unionByName(again).select(*scoring.KEY, "rotulo", F.date_format(F.timestamp_seconds("_t"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))


def labelled_log(spark, sf):
    rows, log = scored_rows(spark, sf)
    good, _ = scoring.accept(log)
    truth = rows.select(F.col("id_fluxo").alias("fluxo_id"), F.date_format(
        F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_previsao"), F.col("alvo").alias("_alvo"))
    truth = truth.groupBy("fluxo_id", "ts_previsao").agg(F.min("_alvo").alias("_alvo"))
    labels = late_labels(good.join(truth, ["fluxo_id", "ts_previsao"]))
    return scoring.attach_labels(good, labels)


@register("m9_accepted", "SELECT run_id, fluxo_id, ts_previsao, anchor_id, classe_prevista, classe_atual FROM good", PROD_CTES)
def m9_accepted(spark, sf):
    good, _ = scoring.accept(scored_rows(spark, sf)[1])
    return good.select("run_id", "fluxo_id", "ts_previsao", "anchor_id", "classe_prevista", "classe_atual")


@register("s18_quarantine", """
SELECT run_id, fluxo_id, ts_previsao, concat_ws('; ', CASE WHEN m1 THEN 'classe invalida' END, CASE WHEN m2 THEN 'proba nao soma 1' END, CASE WHEN m3 THEN 'modelo_versao ou modelo_hash fora do manifesto' END) AS motivos
FROM logrows WHERE m1 OR m2 OR m3""", PROD_CTES)
def s18_quarantine(spark, sf):
    _, bad = scoring.accept(scored_rows(spark, sf)[1])
    return bad.select("run_id", "fluxo_id", "ts_previsao", "motivos")


@register("m9_idempotent", "SELECT run_id, fluxo_id, ts_previsao FROM good WHERE timestamp % 3 <> 0", PROD_CTES)
def m9_idempotent(spark, sf):
    _, log = scored_rows(spark, sf)
    stored = log.where(F.unix_seconds(F.to_timestamp("ts_previsao")) % 3 == 0)
    good, _ = scoring.accept(log, stored)
    return good.select(*scoring.KEY)


@register("j13_late_labels", "SELECT run_id, fluxo_id, ts_previsao, rotulo_real FROM labelled_log", PROD_CTES)
def j13_late_labels(spark, sf):
    return labelled_log(spark, sf).select("run_id", "fluxo_id", "ts_previsao", "rotulo_real")


@register("m10_log_audit", """
SELECT count(*) AS n, count(*) FILTER (m1) AS classe_invalida, count(*) FILTER (m2) AS proba_invalida, 0 AS rotulo_invalido, 0 AS com_nulos, 0 AS com_rotulo,
  0.0::DOUBLE AS fracao_rotulada, (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM logrows GROUP BY run_id, fluxo_id, ts_previsao))::BIGINT AS duplicatas,
  'FALHOU' AS veredito FROM logrows""", PROD_CTES)
def m10_log_audit(spark, sf):
    return scoring.audit(scored_rows(spark, sf)[1])


@register("m10_audit_clean", """
SELECT count(*) AS n, 0 AS classe_invalida, 0 AS proba_invalida, 0 AS rotulo_invalido, 0 AS com_nulos, count(rotulo_real) AS com_rotulo,
  round(count(rotulo_real)::DOUBLE / count(*), 6) AS fracao_rotulada, 0 AS duplicatas,
  CASE WHEN count(rotulo_real)::DOUBLE / count(*) < 0.5 THEN 'ATENCAO' ELSE 'PASSOU' END AS veredito FROM labelled_log""", PROD_CTES)
def m10_audit_clean(spark, sf):
    return rounded(scoring.audit(labelled_log(spark, sf)))


def _f1(c):
    return (f"coalesce(2.0 * count(*) FILTER (rotulo_real = '{c}' AND {{p}} = '{c}') / nullif(count(*) FILTER (rotulo_real = '{c}') + "
            f"count(*) FILTER ({{p}} = '{c}'), 0), 0.0)")


MACRO = "(" + " + ".join(_f1(c) for c in K.CLASSES) + ") / 3"
FIELD = f"""
  SELECT fatia, n, CASE WHEN n >= 30 THEN 'calculado' ELSE 'INCONCLUSIVO' END AS status, CASE WHEN n >= 30 THEN mf END AS macro_f1,
    CASE WHEN n >= 30 THEN rf END AS recall_falha, CASE WHEN n >= 30 AND fatia = 'geral' THEN mf - mp END AS ganho FROM (
    SELECT fatia, count(*) AS n, {MACRO.format(p='classe_prevista')} AS mf, {MACRO.format(p='classe_atual')} AS mp,
      coalesce(count(*) FILTER (rotulo_real = 'FALHA' AND classe_prevista = 'FALHA') / nullif(count(*) FILTER (rotulo_real = 'FALHA'), 0), 0.0) AS rf
    FROM (SELECT *, 'geral' AS fatia FROM labelled_log WHERE rotulo_real IS NOT NULL UNION ALL
      SELECT *, 'transicoes' FROM labelled_log WHERE rotulo_real IS NOT NULL AND rotulo_real <> classe_atual) GROUP BY fatia)"""
PROD_CTES["field"] = FIELD
FLOORS = {"macro_f1_transicoes": 0.05, "recall_falha": 0.1, "ganho_sobre_persistencia": -0.5}


@register("m11_field_slices", "SELECT fatia, n, status, round(macro_f1, 6) AS macro_f1, round(recall_falha, 6) AS recall_falha, round(ganho, 6) AS ganho FROM field", PROD_CTES)
def m11_field_slices(spark, sf):
    return rounded(scoring.field_slices(labelled_log(spark, sf), K.MIN_DRIFT_ROWS))


@register("m11_verdict", """
SELECT round(t, 6) AS macro_f1_transicoes, round(r, 6) AS recall_falha, round(g, 6) AS ganho_sobre_persistencia,
  CASE WHEN t IS NULL AND r IS NULL AND g IS NULL THEN 'INCONCLUSIVO' WHEN coalesce(t < 0.05, false) OR coalesce(r < 0.1, false) OR coalesce(g < -0.5, false) THEN 'FALHOU'
    ELSE 'ATENCAO' END AS veredito FROM (SELECT max(macro_f1) FILTER (fatia = 'transicoes') AS t, max(recall_falha) FILTER (fatia = 'geral') AS r, max(ganho) FILTER (fatia = 'geral') AS g FROM field)""", PROD_CTES)
def m11_verdict(spark, sf):
    slices = scoring.field_slices(labelled_log(spark, sf), K.MIN_DRIFT_ROWS)
    return rounded(scoring.verdict(slices, FLOORS))


@register("m12_gate", """
SELECT bool_and(coalesce(v >= p, false)) AS promove, coalesce(string_agg(CASE WHEN NOT coalesce(v >= p, false) THEN m END, ',' ORDER BY m), '') AS faltas FROM (
  SELECT 'antecedencia_media_minutos' AS m, 4.0 AS p, NULL::DOUBLE AS v UNION ALL SELECT 'macro_f1_transicoes', 0.05, max(macro_f1) FILTER (fatia = 'transicoes') FROM field
  UNION ALL SELECT 'recall_falha', 0.99, max(recall_falha) FILTER (fatia = 'geral') FROM field UNION ALL SELECT 'ganho_sobre_persistencia', -0.5, max(ganho) FILTER (fatia = 'geral') FROM field)""", PROD_CTES)
def m12_gate(spark, sf):
    slices = scoring.field_slices(labelled_log(spark, sf), K.MIN_DRIFT_ROWS)
    row = scoring.verdict(slices, FLOORS).drop("veredito")
    challenger = row.unpivot([], list(FLOORS), "metrica", "valor")
    floors = spark.createDataFrame(
        [("macro_f1_transicoes", 0.05), ("recall_falha", 0.99), ("ganho_sobre_persistencia", -0.5), ("antecedencia_media_minutos", 4.0)],
        "metrica string, piso double")
    return scoring.gate(challenger, floors)


@register("g28_log_period", "SELECT min(ts_previsao) AS inicio, max(ts_previsao) AS fim, count(*) AS n FROM logrows", PROD_CTES)
def g28_log_period(spark, sf):
    return scoring.period(scored_rows(spark, sf)[1])


# ---------------------------------------------------------------- collected items
ITEMS = f"""
  SELECT *, event_id % 83 = 0 AS offline, CASE WHEN event_id % 79 = 0 THEN NULL ELSE timestamp END AS t2,
    CASE WHEN event_id % 73 = 0 THEN -1 ELSE 3 END AS sent2, contains(result, '"x"') AS to_,
    CASE WHEN event_id % 71 = 0 THEN -5.0 ELSE avg END AS avg2 FROM pings"""
CLASSIFIED = """
  SELECT event_id, motivo, CASE WHEN offline THEN 'probe_offline' WHEN motivo IS NOT NULL THEN 'invalida'
    WHEN to_ OR avg2 = -1 THEN 'timeout' ELSE 'ok' END AS situacao, id_fluxo, timestamp, t2, probe_id = user_probe AS own_probe FROM (SELECT *, CASE WHEN offline THEN NULL
    WHEN probe_id <> user_probe THEN 'probe_diferente' WHEN t2 IS NULL THEN 'timestamp_invalido' WHEN sent2 <= 0 THEN 'perda_fora_de_0_a_100'
    WHEN avg2 < 0 AND NOT (to_ OR avg2 = -1) AND rcvd <> 0 THEN 'latencia_negativa' END AS motivo FROM (SELECT *, CASE WHEN event_id % 67 = 0 THEN 99 ELSE probe_id END AS user_probe FROM items))"""
ITEM_CTES = {"items": ITEMS, "classified_items": CLASSIFIED}


def items(spark, sf):
    from rttscope.functions.parse import has_timeout, instant_metrics
    rows = adapter.pings(spark, sf).withColumns({
        "offline": F.col("event_id") % 83 == 0,
        "timestamp": F.when(F.col("event_id") % 79 != 0, F.col("timestamp")),
        "sent": F.when(F.col("event_id") % 73 == 0, -1).otherwise(F.col("sent")),
        "avg": F.when(F.col("event_id") % 71 == 0, -5.0).otherwise(F.col("avg")),
        "tem_timeout": has_timeout("result"),
    })
    probe = F.when(F.col("event_id") % 67 == 0, 99).otherwise(F.col("probe_id"))
    return scoring.classify_item(instant_metrics(rows), probe).withColumn("do_probe", F.col("probe_id") == probe)


@register("p8_contract_items", "SELECT event_id, situacao, motivo FROM classified_items", ITEM_CTES)
def p8_contract_items(spark, sf):
    return items(spark, sf).select("event_id", "situacao", "motivo")


@register("p9_batch_window", f"""
SELECT event_id FROM items WHERE t2 IS NULL OR offline OR (t2 >= {adapter.B_START} AND t2 < {adapter.B_START + 86400})""", ITEM_CTES)
def p9_batch_window(spark, sf):
    return items(spark, sf).where(scoring.in_batch(adapter.B_START, adapter.B_START + 86400)).select("event_id")


@register("w8_new_rows", f"""
SELECT event_id, n > 1 AS rejeitada FROM (SELECT *, row_number() OVER (PARTITION BY id_fluxo, timestamp ORDER BY event_id) AS n FROM tagged WHERE periodo = 'B')
WHERE n > 1 OR (id_fluxo, timestamp) NOT IN (SELECT (id_fluxo, timestamp) FROM tagged WHERE periodo = 'B' AND event_id % 5 = 0)""")
def w8_new_rows(spark, sf):
    rows = collection.with_period(adapter.pings(spark, sf), adapter.PERIODS).where("periodo = 'B'")
    fresh, rejected = scoring.new_rows(rows, rows.where("event_id % 5 = 0"))
    return fresh.select("event_id", F.lit(False).alias("rejeitada")).unionByName(rejected.select("event_id", F.lit(True).alias("rejeitada")))


OPERATION = """SELECT sum(o + t)::BIGINT AS coletadas, sum(i)::BIGINT AS descartadas, sum(t)::BIGINT AS timeouts, sum(s)::BIGINT AS sem_resultado, count(DISTINCT arquivo) AS n_execucoes FROM (
  SELECT t2 // 86400 AS arquivo, id_fluxo, count(*) FILTER (situacao = 'ok') AS o, count(*) FILTER (situacao = 'timeout') AS t, count(*) FILTER (situacao = 'invalida') AS i,
    (count(*) FILTER (own_probe) = 0)::INTEGER AS s FROM classified_items WHERE t2 IS NOT NULL GROUP BY ALL)"""


def collection_log(spark, sf):
    """One entry per day and flow, each written twice as a retried run would."""
    day = F.floor(F.col("timestamp") / 86400).alias("arquivo")
    log = items(spark, sf).where("timestamp is not null").groupBy(day, F.col("id_fluxo").alias("fluxo_id")).agg(*[
        F.count_if(F.col("situacao") == s).alias(s) for s in ("ok", "timeout", "invalida", K.ITEM_OFFLINE)
    ], (F.count_if("do_probe") == 0).cast("long").alias("sem_resultado"))
    return log.unionByName(log)


@register("g26_operation_counters", OPERATION, ITEM_CTES)
def g26_operation_counters(spark, sf):
    return scoring.operation_counters(collection_log(spark, sf))


# ---------------------------------------------------------------- alerts
HISTORY = """
  SELECT timestamp // 86400 AS dia, count(*) AS n, CASE WHEN count(*) < 30 THEN 'amostra_insuficiente' ELSE 'calculado' END AS status, """ + MACRO.format(
    p="classe_prevista") + " AS macro_f1 FROM preds GROUP BY dia"
PROD_CTES["history"] = HISTORY


def performance_history(spark, sf):
    rows = Drift(spark, sf).preds.withColumn("dia", F.floor(F.col("timestamp") / 86400))
    out = metrics.scores(metrics.confusion(rows, ["dia"], "rotulo_real", "classe_prevista"), "zero")
    return out.select("dia", "n", "macro_f1", F.when(F.col("n") < K.MIN_DRIFT_ROWS, K.DRIFT_STATUS[0]).otherwise("calculado").alias("status"))


@register("w11_low_runs", """
SELECT count(*) = 3 AND bool_and(coalesce(status <> 'amostra_insuficiente' AND macro_f1 < 0.6, false)) AS abaixo, round(max(macro_f1), 6) AS macro_f1
FROM (SELECT * FROM history ORDER BY dia DESC LIMIT 3)""", PROD_CTES)
def w11_low_runs(spark, sf):
    return rounded(alerts.low_runs(performance_history(spark, sf), "dia"))


IMPORTANCE = {**NB_IMPORTANCE, "importance": "SELECT feature, importancia FROM nb_importance"}


@register("l1_important_features", """
SELECT feature, round(importancia::DOUBLE, 6) AS importancia FROM importance WHERE importancia > 0 AND importancia >= (
  SELECT importancia FROM (SELECT importancia, row_number() OVER (ORDER BY importancia) - 1 AS r, count(*) OVER () AS n FROM importance) WHERE r = n // 2)""", {**DRIFT_CTES, **IMPORTANCE})
def l1_important_features(spark, sf):
    return rounded(alerts.important(stages(spark, sf).importance))


def _alert_id(rule, key):
    return f"substr(sha256('{rule}:' || {key}), 1, 16)"


ALERTS = f"""
  SELECT {_alert_id('psi_feature_importante', "janela || ':' || feature")} AS id, 'psi_feature_importante' AS regra, janela || ':' || feature AS chave, 'media' AS gravidade
  FROM season WHERE {FINAL_STATUS} = 'alerta' AND psi > 0.25 AND feature IN (SELECT feature FROM importance WHERE importancia > 0 AND importancia >= (
    SELECT importancia FROM (SELECT importancia, row_number() OVER (ORDER BY importancia) - 1 AS r, count(*) OVER () AS n FROM importance) WHERE r = n // 2))
  UNION ALL SELECT {_alert_id('proporcao_classes', "janela || ':proporcao'")}, 'proporcao_classes', janela || ':proporcao', 'media' FROM mix WHERE status = 'alerta'
  UNION ALL SELECT {_alert_id('contrato_ou_coleta', "'coleta'")}, 'contrato_ou_coleta', 'coleta', 'alta' FROM (SELECT bool_or(motivo = 'timestamp_invalido') AS b FROM classified_items) WHERE b
  UNION ALL SELECT {_alert_id('macro_f1', "'macro_f1'")}, 'macro_f1', 'macro_f1', 'alta' FROM (SELECT count(*) = 3 AND bool_and(coalesce(status <> 'amostra_insuficiente' AND macro_f1 < 0.6, false)) AS b
    FROM (SELECT * FROM history ORDER BY dia DESC LIMIT 3)) WHERE b"""
ALL_CTES = {**PROD_CTES, **ITEM_CTES, **IMPORTANCE, "alert_rows": ALERTS}


def all_alerts(spark, sf):
    d = Drift(spark, sf)
    windows = d.windows
    features = d.features
    state = items(spark, sf).select(
        F.lit(False).alias("falha_coleta"), F.coalesce(F.col("motivo") == "timestamp_invalido", F.lit(False)).alias("contrato_invalido"))
    parts = [
        alerts.psi_alerts(features, stages(spark, sf).importance, NOW), alerts.mix_alerts(drift.prediction_block(windows, d.ref_props), NOW),
        alerts.collection_alerts(state, NOW), alerts.performance_alerts(performance_history(spark, sf), "dia", NOW),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("l3_alerts", "SELECT id, regra, chave, gravidade FROM alert_rows", ALL_CTES)
def l3_alerts(spark, sf):
    return all_alerts(spark, sf).select("id", "regra", "chave", "gravidade")


@register("l4_cooldown", """
SELECT regra, chave FROM (SELECT regra, fluxo AS chave FROM (SELECT 'r1' AS regra, id_fluxo AS fluxo FROM classes UNION ALL SELECT 'r2', id_fluxo FROM classes)) a
WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'r1' AS regra, id_fluxo AS chave, CASE WHEN probe_id < 3 THEN 10 ELSE 30 END AS idade, CASE WHEN anchor_id = 0 THEN 'aberto' ELSE 'resolvido' END AS status FROM classes) e
  WHERE e.regra = a.regra AND e.chave = a.chave AND e.status <> 'resolvido' AND e.idade <= 24)""")
def l4_cooldown(spark, sf):
    flows = stages(spark, sf).classes
    now = F.lit(NOW).cast("timestamp")
    new = flows.select(F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("regra"), F.col("id_fluxo").alias("chave"))
    earlier = flows.select(
        F.lit("r1").alias("regra"), F.col("id_fluxo").alias("chave"),
        F.when(F.col("probe_id") < 3, now - F.expr("interval 10 hours")).otherwise(now - F.expr("interval 30 hours")).alias("ts"),
        F.when(F.col("anchor_id") == 0, "aberto").otherwise("resolvido").alias("status"))
    return alerts.outside_cooldown(new, earlier, NOW).select("regra", "chave")


@register("g33_status_row", f"""
SELECT n_previsoes, inicio, fim, coletadas, descartadas, timeouts, veredito, alertas_abertos, pior_drift FROM
  (SELECT count(*) AS n_previsoes, min(ts_previsao) AS inicio, max(ts_previsao) AS fim FROM logrows), ({OPERATION}),
  (SELECT CASE WHEN t IS NULL AND r IS NULL AND g IS NULL THEN 'INCONCLUSIVO' WHEN coalesce(t < 0.05, false) OR coalesce(r < 0.1, false) OR coalesce(g < -0.5, false) THEN 'FALHOU' ELSE 'ATENCAO' END AS veredito
   FROM (SELECT max(macro_f1) FILTER (fatia = 'transicoes') AS t, max(recall_falha) FILTER (fatia = 'geral') AS r, max(ganho) FILTER (fatia = 'geral') AS g FROM field)),
  (SELECT count(*) AS alertas_abertos FROM alert_rows),
  (SELECT ['amostra_insuficiente', 'estavel', 'atencao', 'alerta'][max(CASE {FINAL_STATUS} WHEN 'estavel' THEN 1 WHEN 'atencao' THEN 2 WHEN 'alerta' THEN 3 ELSE 0 END) + 1] AS pior_drift FROM season WHERE janela = '24h')""", ALL_CTES)
def g33_status_row(spark, sf):
    from rttscope.functions.label import worst_status
    d = Drift(spark, sf)
    features = d.features.where("janela = '24h'")
    parts = [
        scoring.period(scored_rows(spark, sf)[1]).withColumnRenamed("n", "n_previsoes"),
        scoring.operation_counters(collection_log(spark, sf)).select("coletadas", "descartadas", "timeouts"),
        scoring.verdict(scoring.field_slices(labelled_log(spark, sf), K.MIN_DRIFT_ROWS), FLOORS).select("veredito"),
        all_alerts(spark, sf).agg(F.count(F.lit(1)).alias("alertas_abertos")),
        features.agg(worst_status(F.col("status_final")).alias("pior_drift")),
    ]
    # every part is one aggregate row; the constant key makes the join a plain equi join
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


# ---------------------------------------------------------------- stored forecasts, sessions
FORECASTS = {"forecasts": """
  SELECT *, lead(classe) OVER w AS real, coalesce(lead(timestamp) OVER w - timestamp > 600, false) AS lacuna, row_number() OVER w AS pos,
    lead(timestamp) OVER w IS NOT NULL AS fechada FROM labelled WINDOW w AS (PARTITION BY id_fluxo ORDER BY timestamp, msm_id)"""}


def forecasts(spark, sf):
    return online.close_forecasts(stages(spark, sf).labelled.withColumn("previsto", F.col("classe")))


@register("j12_closed_forecasts", "SELECT id_fluxo, timestamp, msm_id, classe AS previsto, real, classe = real AS acerto, lacuna, fechada FROM forecasts", FORECASTS)
def j12_closed_forecasts(spark, sf):
    return forecasts(spark, sf).select("id_fluxo", "timestamp", "msm_id", "previsto", "real", "acerto", "lacuna", "fechada")


def _macro(seen):
    return "(" + " + ".join(f"coalesce(2.0 * count(*) FILTER (real = '{c}' AND {seen} = '{c}') / nullif(count(*) FILTER (real = '{c}') + count(*) FILTER ({seen} = '{c}'), 0), 0.0)" for c in K.CLASSES) + ") / 3"


SESSION = f"""
SELECT id_fluxo, n, n <= 12 AS abaixo_do_aquecimento, fechadas, transicoes, round(acuracia, 6) AS acuracia, round(macro_f1, 6) AS macro_f1, round(recall_falha, 6) AS recall_falha,
  round(acuracia_persistencia, 6) AS acuracia_persistencia, round(macro_f1_persistencia, 6) AS macro_f1_persistencia,
  round(CASE WHEN macro_f1_persistencia <> 0 THEN macro_f1 - macro_f1_persistencia END, 6) AS ganho_macro_f1
FROM (SELECT id_fluxo, count(*) AS n FROM ruled GROUP BY id_fluxo) JOIN (
  SELECT id_fluxo, count(*) AS fechadas, count(*) FILTER (real <> classe) AS transicoes, avg((regra = real)::INTEGER) AS acuracia, {_macro('regra')} AS macro_f1,
    count(*) FILTER (real = 'FALHA' AND regra = 'FALHA')::DOUBLE / nullif(count(*) FILTER (real = 'FALHA'), 0) AS recall_falha,
    avg((classe = real)::INTEGER) AS acuracia_persistencia, {_macro('classe')} AS macro_f1_persistencia
  FROM ruled WHERE real IS NOT NULL AND pos > 12 AND NOT lacuna GROUP BY id_fluxo) USING (id_fluxo)"""


@register("g30_session_metrics", SESSION, {**FORECASTS, "ruled": "SELECT *, CASE WHEN perda_pct > 0 THEN 'FALHA' ELSE classe END AS regra FROM forecasts"})
def g30_session_metrics(spark, sf):
    """Each flow as a session; a rule that calls every loss a failure forecasts, so that it differs from persistence."""
    from rttscope.operators.online import session_metrics
    rule = F.when(F.col("perda_pct") > 0, "FALHA").otherwise(F.col("classe"))
    return rounded(session_metrics(forecasts(spark, sf).withColumn("previsto", rule), ["id_fluxo"]))


@register("t8_warm_rows", "SELECT id_fluxo, timestamp, msm_id FROM forecasts WHERE pos > 12 AND NOT lacuna", FORECASTS)
def t8_warm_rows(spark, sf):
    from rttscope.operators.online import counted_rows
    return counted_rows(forecasts(spark, sf)).select("id_fluxo", "timestamp", "msm_id")


@register("s21_stored_forecasts", f"""
SELECT id_fluxo, timestamp, real FROM forecasts WHERE timestamp >= {adapter.B_START + 5 * 86400} AND real IS NOT NULL ORDER BY timestamp DESC, id_fluxo, msm_id LIMIT 50""", FORECASTS)
def s21_stored_forecasts(spark, sf):
    return online.stored_forecasts(forecasts(spark, sf), adapter.B_START + 5 * 86400, 50, closed_only=True).select("id_fluxo", "timestamp", "real")


EVENTS = {"event_log": f"""
  SELECT timestamp AS ts, ['coleta_ok', 'coleta_ok', 'erro_rede', 'http_429', 'modelo'][event_id % 5 + 1] AS tipo,
    CASE WHEN event_id % 5 IN (2, 3) THEN 'ERRO' WHEN event_id % 7 = 0 THEN 'AVISO' ELSE 'INFO' END AS nivel FROM tagged WHERE periodo = 'B'"""}


@register("s22_health", f"""
SELECT (SELECT max(timestamp) FROM forecasts) AS ultimo, {adapter.B_END} - (SELECT max(timestamp) FROM forecasts) AS atraso_s,
  count(*) FILTER (tipo = 'coleta_ok') AS ciclos_ok, count(*) FILTER (tipo IN ('erro_rede', 'http_429')) AS ciclos_falha,
  count(*) FILTER (ts >= {adapter.B_END - 86400} AND nivel IN ('AVISO', 'ERRO')) AS avisos_24h FROM event_log""", {**FORECASTS, **EVENTS})
def s22_health(spark, sf):
    """Health from the stored measurements and the operational event log, which is written by day and read back."""
    b = stages(spark, sf).raw.where((F.col("timestamp") >= adapter.B_START) & (F.col("timestamp") < adapter.B_END))
    kinds = F.array(*[F.lit(x) for x in ("coleta_ok", "coleta_ok", "erro_rede", "http_429", "modelo")])
    k = F.col("event_id") % 5
    level = F.when(k.isin(2, 3), "ERRO").when(F.col("event_id") % 7 == 0, "AVISO").otherwise("INFO")
    log = b.select(F.col("timestamp").alias("ts"), F.get(kinds, k.cast("int")).alias("tipo"), level.alias("nivel"))
    path = work_path(spark, "event-log")
    sinks.append_events(log, path, F.to_date(F.timestamp_seconds("ts")))
    return online.health(forecasts(spark, sf), spark.read.parquet(path), adapter.B_END)


@register("j17_accepted_marks", """
SELECT event_id, situacao FROM (SELECT l.event_id, CASE WHEN l.event_id % 4 = 0 THEN 'rejeitada' ELSE 'aceita' END AS situacao FROM labelled l)""")
def j17_accepted_marks(spark, sf):
    rows = stages(spark, sf).labelled
    marks = rows.select("event_id", "id_fluxo", "timestamp", F.col("classe").alias("status"), F.when(
        F.col("event_id") % 4 == 0, "outro").otherwise(F.col("motivo_rotulagem")).alias("motivo"))
    session = rows.select("id_fluxo", "timestamp", F.col("classe").alias("status"), F.col("motivo_rotulagem").alias("motivo"))
    return online.accepted_marks(marks, session).select("event_id", "situacao")


# ---------------------------------------------------------------- pseudonyms
@register("f23_pseudonyms", "SELECT event_id, anchor_id, sha256('sal:' || probe_id::VARCHAR) AS probe_id_hash FROM pings")
def f23_pseudonyms(spark, sf):
    rows = adapter.pings(spark, sf).select("event_id", "anchor_id", "probe_id")
    return pseudonymise(rows, ["probe_id"], "sal")


@register("f24_alert_ids", "SELECT id_fluxo, substr(sha256('macro_f1:' || id_fluxo), 1, 16) AS id FROM (SELECT DISTINCT id_fluxo FROM pings)")
def f24_alert_ids(spark, sf):
    rows = adapter.pings(spark, sf).select("id_fluxo").distinct()
    return rows.select("id_fluxo", alert_id(F.lit("macro_f1"), F.col("id_fluxo")).alias("id"))
