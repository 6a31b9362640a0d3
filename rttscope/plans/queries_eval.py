"""Queries of evaluation: matrices, metric conventions, slices, gains, quality tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators import dataset, metrics, picks, quality
from rttscope.plans.catalog import register, rounded, stages
from rttscope.plans.oracle import usage_sql

CELLS = ", ".join(
    f"count(*) FILTER ({{r}} = '{r}' AND {{p}} = '{p}') AS {metrics.cell(r, p)}" for r, p in metrics.CELLS
)


def confusion_sql(rows: str, keys: list[str], real: str, pred: str) -> str:
    head = "".join(f"{k}, " for k in keys)
    tail = " GROUP BY ALL" if keys else ""
    return f"SELECT {head}{CELLS.format(r=real, p=pred)} FROM {rows}{tail}"


def scores_sql(conf: str, keys: list[str], absent: str, digits: int = 6) -> str:
    """Metric rows from a CTE of counters, written independently of the Spark expressions."""
    parts, n = [], " + ".join(metrics.cell(r, p) for r, p in metrics.CELLS)
    for c in K.CLASSES:
        sup = "(" + " + ".join(metrics.cell(c, p) for p in K.CLASSES) + ")"
        called = "(" + " + ".join(metrics.cell(r, c) for r in K.CLASSES) + ")"
        hit = metrics.cell(c, c)
        values = {
            "precisao": f"CASE WHEN {called} = 0 THEN 0.0 ELSE {hit} / {called} END",
            "recall": f"CASE WHEN {sup} = 0 THEN 0.0 ELSE {hit} / {sup} END",
            "f1": f"CASE WHEN {sup} + {called} = 0 THEN 0.0 ELSE 2.0 * {hit} / ({sup} + {called}) END",
        }
        for name, v in values.items():
            parts.append(f"CASE WHEN {sup} > 0 OR '{absent}' = 'zero' THEN {v} END AS {name}_{c}")
        parts.append(f"{sup} AS suporte_{c}")
    head = "".join(f"{k}, " for k in keys)
    f1 = [f"f1_{c}" for c in K.CLASSES]
    macro = f"({' + '.join(f'coalesce({x}, 0.0)' for x in f1)}) / " + (
        "3" if absent == "zero" else f"nullif({' + '.join(f'({x} IS NOT NULL)::INTEGER' for x in f1)}, 0)"
    )
    out = [f"round({x}_{c}, {digits}) AS {x}_{c}" for c in K.CLASSES for x in ("precisao", "recall", "f1")]
    out += [f"suporte_{c}" for c in K.CLASSES]
    weighted = " + ".join(f"coalesce(f1_{c}, 0.0) * suporte_{c}" for c in K.CLASSES)
    hits = " + ".join(metrics.cell(c, c) for c in K.CLASSES)
    return (
        f"SELECT {head}{', '.join(out)}, n, round(CASE WHEN n > 0 THEN {macro} END, {digits}) AS macro_f1, "
        f"round(({weighted}) / nullif(n, 0), {digits}) AS f1_ponderado, round(({hits}) / nullif(n, 0), {digits}) AS acuracia "
        f"FROM (SELECT *, {n} AS n, {', '.join(parts)} FROM {conf})"
    )


SCORE_COLS = [f"{x}_{c}" for c in K.CLASSES for x in ("precisao", "recall", "f1", "suporte")] + [
    "n", "macro_f1", "f1_ponderado", "acuracia"]

DOMINANT = """
  SELECT split, anchor_id::VARCHAR AS dominante, c::DOUBLE / sum(c) OVER (PARTITION BY split) AS fracao,
    row_number() OVER (PARTITION BY split ORDER BY c DESC, anchor_id::VARCHAR) AS r
  FROM (SELECT split, anchor_id, count(*) AS c FROM final WHERE alvo = 'FALHA' GROUP BY ALL)"""
SLICED = """
  SELECT *, 'geral' AS fatia FROM final UNION ALL SELECT *, 'transicoes' FROM final WHERE classe_atual <> alvo
  UNION ALL SELECT *, 'inicio_falha' FROM final WHERE classe_atual <> 'FALHA' AND alvo = 'FALHA'
  UNION ALL SELECT f.*, 'sem_anchor_dominante' FROM final f LEFT JOIN (SELECT * FROM dominant WHERE r = 1) d USING (split)
    WHERE d.dominante IS NULL OR f.anchor_id::VARCHAR <> d.dominante"""
SLICE_CTES = {
    "dominant": DOMINANT, "sliced": SLICED,
    "sliced_conf": f"""
  SELECT s.split, s.fatia, {', '.join(f'coalesce({metrics.cell(r, p)}, 0) AS {metrics.cell(r, p)}' for r, p in metrics.CELLS)}
  FROM (SELECT DISTINCT split, unnest(['geral', 'transicoes', 'inicio_falha', 'sem_anchor_dominante']) AS fatia FROM final) s
  LEFT JOIN ({confusion_sql('sliced', ['split', 'fatia'], 'alvo', 'classe_atual')}) c USING (split, fatia)""",
    "trend_conf": f"""
  SELECT s.split, s.fatia, {', '.join(f'coalesce({metrics.cell(r, p)}, 0) AS {metrics.cell(r, p)}' for r, p in metrics.CELLS)}
  FROM (SELECT DISTINCT split, unnest(['geral', 'transicoes', 'inicio_falha', 'sem_anchor_dominante']) AS fatia FROM final) s
  LEFT JOIN ({confusion_sql("(SELECT *, CASE WHEN perdas_consecutivas >= 2 THEN 'FALHA' WHEN perda_media_w3 > 0 THEN 'RISCO' ELSE 'OK' END AS regra FROM sliced)", ['split', 'fatia'], 'alvo', 'regra')}) c USING (split, fatia)""",
}


def persistence(spark, sf):
    """M1: the next class is forecast to be the current one."""
    return stages(spark, sf).final.withColumn("previsto", F.col("classe_atual"))


def rule_forecast(spark, sf):
    """A simple fixed challenger, so that gains over persistence are not all zero."""
    rule = (
        F.when(F.col("perdas_consecutivas") >= 2, "FALHA").when(F.col("perda_media_w3") > 0, "RISCO").otherwise("OK")
    )
    return dataset.published(stages(spark, sf).final.withColumn("previsto", rule))


@register("g13_transition_matrix", f"""
SELECT real, {', '.join(f"count(*) FILTER (classe_atual = '{c}') AS prev_{c}" for c in K.CLASSES)}, split
FROM (SELECT *, alvo AS real FROM final) GROUP BY split, real""")
def g13_transition_matrix(spark, sf):
    return metrics.long_matrix(metrics.confusion(persistence(spark, sf), ["split"]), ["split"])


@register("g14_macro_f1_zero", scores_sql("conf", ["split"], "zero"), {"conf": confusion_sql("final", ["split"], "alvo", "classe_atual")})
def g14_macro_f1_zero(spark, sf):
    wide = metrics.confusion(persistence(spark, sf), ["split"])
    return rounded(metrics.scores(wide, "zero").select("split", *SCORE_COLS))


@register("g15_slice_metrics", scores_sql("sliced_conf", ["split", "fatia"], "skip"), SLICE_CTES)
def g15_slice_metrics(spark, sf):
    return rounded(metrics.sliced_scores(persistence(spark, sf), ["split"]).select("split", "fatia", *SCORE_COLS))


@register("g16_metrics_by_flow", scores_sql("conf", ["id_fluxo"], "zero"), {"conf": confusion_sql("final", ["id_fluxo"], "alvo", "classe_atual")})
def g16_metrics_by_flow(spark, sf):
    wide = metrics.confusion(persistence(spark, sf), ["id_fluxo"])
    return rounded(metrics.scores(wide, "zero").select("id_fluxo", *SCORE_COLS))


@register("g18_dominant_anchor", "SELECT split, dominante AS anchor_dominante, round(fracao, 6) AS fracao_dominante FROM dominant WHERE r = 1", SLICE_CTES)
def g18_dominant_anchor(spark, sf):
    return rounded(metrics.dominant_anchor(stages(spark, sf).final, ["split"]))


@register("g19_gain", f"""
SELECT m.split, m.fatia, round(m.macro_f1, 6) AS macro_f1, round(p.macro_f1, 6) AS macro_f1_persistencia,
  CASE WHEN m.fatia <> 'transicoes' THEN round(m.macro_f1 - p.macro_f1, 4) END AS ganho
FROM ({scores_sql('trend_conf', ['split', 'fatia'], 'skip')}) m JOIN ({scores_sql('sliced_conf', ['split', 'fatia'], 'skip')}) p USING (split, fatia)""", SLICE_CTES)
def g19_gain(spark, sf):
    model = metrics.sliced_scores(rule_forecast(spark, sf), ["split"])
    base = metrics.sliced_scores(persistence(spark, sf), ["split"])
    keys = ["split", "fatia"]
    rows = metrics.gain(rounded(model.select(*keys, "macro_f1")), rounded(base.select(*keys, "macro_f1")), keys)
    return rows.withColumn("ganho", F.round("ganho", 4))


@register("g20_persistence_rates", """
SELECT split, round(avg((classe_atual = alvo)::INTEGER), 6) AS acerto_persistencia, round(avg((alvo = 'OK')::INTEGER), 6) AS sempre_ok
FROM final GROUP BY split""")
def g20_persistence_rates(spark, sf):
    return rounded(stages(spark, sf).final.groupBy("split").agg(
        F.avg((F.col("classe_atual") == F.col("alvo")).cast("double")).alias("acerto_persistencia"),
        F.avg((F.col("alvo") == "OK").cast("double")).alias("sempre_ok")))


@register("g21_class_proportions", "SELECT split, " + ", ".join(
    f"round(avg((alvo = '{c}')::INTEGER), 6) AS prop_{c}" for c in K.CLASSES) + " FROM final GROUP BY split")
def g21_class_proportions(spark, sf):
    return rounded(stages(spark, sf).final.groupBy("split").agg(*metrics.proportions("alvo")))


WHOLE_ROW = (*K.FINAL_META, K.TARGET, *K.FEATURES)


@register("g29_fingerprint", f"""
SELECT split, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', {', '.join(
    f"coalesce(CAST(round({c}::DOUBLE * 1000000) AS BIGINT)::VARCHAR, '∅')" if c in K.FEATURES else f"coalesce({c}::VARCHAR, '∅')" for c in WHOLE_ROW)})), 1, 8))::BIGINT)::BIGINT AS impressao
FROM final GROUP BY split""")
def g29_fingerprint(spark, sf):
    """Every column of the row counts; features enter in millionths, so summation order does not show."""
    rows = stages(spark, sf).final.withColumns({c: F.round(F.col(c).cast("double") * 1_000_000).cast("long") for c in K.FEATURES})
    out = quality.fingerprint(rows, ["split"], list(WHOLE_ROW))
    return out.withColumn("impressao", F.col("impressao").cast("long"))


@register("g11_nulls_per_column", " UNION ALL ".join(
    f"SELECT '{c}' AS coluna, count(*) FILTER ({c} IS NULL) AS n FROM processed" for c in K.DATASET_COLUMNS))
def g11_nulls_per_column(spark, sf):
    return quality.nulls_per_column(stages(spark, sf).processed, list(K.DATASET_COLUMNS))


REASONS = (K.REASON_SEVERE_LOSS, K.REASON_P99, K.REASON_PARTIAL_LOSS, K.REASON_P95, K.REASON_JITTER, K.REASON_NONE,
           K.REASON_NO_BASELINE, K.REASON_SHORT_BASELINE, K.REASON_NO_LOSS)


@register("g12_domain_counts", f"""
SELECT valor, count(motivo_rotulagem) AS n FROM (SELECT unnest([{', '.join(repr(r) for r in REASONS)}]) AS valor) d
LEFT JOIN labelled ON motivo_rotulagem = valor GROUP BY valor""")
def g12_domain_counts(spark, sf):
    return quality.domain_counts(stages(spark, sf).labelled, "motivo_rotulagem", REASONS)


@register("g31_quality_document", """
SELECT '5' AS stage, periodo AS key, 'linhas' AS metric, count(*)::DOUBLE AS value FROM used GROUP BY periodo
UNION ALL SELECT '5', CASE WHEN type <> 'ping' THEN 'type diferente de ping' ELSE 'ok' END, 'descartes', count(*) FROM used GROUP BY ALL
UNION ALL SELECT '5', '', 'anchors', count(DISTINCT anchor_id) FROM processed
UNION ALL SELECT '5', '', 'probes', count(DISTINCT probe_id) FROM processed
UNION ALL SELECT '6', status_baseline, 'fluxos', count(*) FROM baseline GROUP BY ALL
UNION ALL SELECT '7', classe, 'rotulos', count(*) FROM labelled GROUP BY ALL
UNION ALL SELECT '7', motivo_rotulagem, 'motivos', count(*) FROM labelled GROUP BY ALL
UNION ALL SELECT '7', split || '|' || alvo, 'alvos', count(*) FROM final GROUP BY ALL
UNION ALL SELECT '7', classe_atual || '|' || alvo, 'transicoes', count(*) FROM final GROUP BY ALL""")
def g31_quality_document(spark, sf):
    from rttscope.operators import collection
    from rttscope.sources import adapter
    s = stages(spark, sf)
    reason = F.coalesce(collection.discard_reason(adapter.PERIODS), F.lit("ok"))
    distinct = quality.long_metrics(s.processed, "5", {
        "anchors": F.count_distinct("anchor_id"), "probes": F.count_distinct("probe_id")})
    parts = [
        quality.grouped_counts(s.used, "5", "linhas", F.col("periodo")),
        quality.grouped_counts(s.used, "5", "descartes", reason),
        quality.grouped_counts(s.baseline, "6", "fluxos", F.col("status_baseline")),
        quality.grouped_counts(s.labelled, "7", "rotulos", F.col("classe")),
        quality.grouped_counts(s.labelled, "7", "motivos", F.col("motivo_rotulagem")),
        quality.grouped_counts(s.final, "7", "alvos", F.concat_ws("|", "split", "alvo")),
        quality.grouped_counts(s.final, "7", "transicoes", F.concat_ws("|", "classe_atual", "alvo")),
    ]
    out = distinct
    for p in parts:
        out = out.unionByName(p)
    return out


@register("g32_step_totals", """
SELECT '4' AS stage, '' AS key, unnest(['fluxos', 'linhas', 'rtts_validos', 'duplicadas', 'fora_da_janela']) AS metric, unnest([f, l, v, d, o])::DOUBLE AS value
FROM (SELECT count(DISTINCT id_fluxo) AS f, count(*) AS l, count(*) FILTER (avg >= 0) AS v,
  (SELECT count(*) FROM tagged WHERE periodo IS NOT NULL) - (SELECT count(*) FROM collected) AS d, count(*) FILTER (periodo IS NULL) AS o FROM tagged)""")
def g32_step_totals(spark, sf):
    from rttscope.operators import collection
    from rttscope.sources import adapter
    rows = collection.with_period(adapter.pings(spark, sf), adapter.PERIODS)
    main = quality.long_metrics(rows, "4", {
        "fluxos": F.count_distinct("id_fluxo"), "linhas": F.count(F.lit(1)),
        "rtts_validos": F.count_if(F.col("avg") >= 0), "fora_da_janela": F.count_if(F.col("periodo").isNull())})
    repeated = quality.long_metrics(collection.repeats(rows.where("periodo is not null")), "4", {
        "duplicadas": F.coalesce(F.sum("n_descartadas"), F.lit(0))})
    return main.unionByName(repeated)


@register("g32_period_totals", """
SELECT '5' AS stage, periodo AS key, unnest(['fluxos', 'fluxos_vazios', 'fluxos_usados', 'linhas']) AS metric, unnest([a, b, c, d])::DOUBLE AS value FROM (
  SELECT periodo, count(*) AS a, count(*) FILTER (linhas = 0) AS b, count(*) FILTER (usado) AS c, sum(linhas) AS d FROM usage_tight GROUP BY periodo)
UNION ALL SELECT '5', '', 'pares_com_perda_alta', count(*)::DOUBLE FROM (
  SELECT probe_id, anchor_id FROM pings GROUP BY ALL HAVING (sum(sent) - sum(rcvd)) / sum(sent) >= 0.1)""", {"usage_tight": usage_sql("collected", 2100.0)})
def g32_period_totals(spark, sf):
    """Totals of the collection step: flows, empty and used ones per period, and pairs with much loss."""
    from rttscope.operators import collection
    from rttscope.sources import adapter
    use = collection.usage(stages(spark, sf).collected, adapter.PERIODS, 2100.0)
    per = quality.long_metrics(use, "5", {
        "fluxos": F.count(F.lit(1)), "fluxos_vazios": F.count_if(F.col("linhas") == 0), "fluxos_usados": F.count_if("usado"), "linhas": F.sum("linhas")}, ["periodo"])
    loss = quality.long_metrics(collection.high_loss(adapter.pings(spark, sf), 0.1), "5", {"pares_com_perda_alta": F.count(F.lit(1))})
    return per.unionByName(loss)


# ---------------------------------------------------------------- orders, samples, picks
@register("k1_canonical_order", """
SELECT periodo, anchor_id, probe_id, timestamp, event_id FROM collected ORDER BY periodo, anchor_id, probe_id, timestamp""")
def k1_canonical_order(spark, sf):
    rows = stages(spark, sf).collected.select("periodo", "anchor_id", "probe_id", "timestamp", "event_id")
    return rows.orderBy("periodo", "anchor_id", "probe_id", "timestamp")


@register("k2_display_sample", "SELECT anchor_id, probe_id, timestamp, msm_id FROM processed ORDER BY anchor_id, probe_id, timestamp, msm_id LIMIT 10")
def k2_display_sample(spark, sf):
    rows = stages(spark, sf).processed.select("anchor_id", "probe_id", "timestamp", "msm_id")
    return picks.first_rows(rows, ["anchor_id", "probe_id", "timestamp", "msm_id"], 10)


@register("k3_covering_sample", """
SELECT id_fluxo, timestamp, msm_id, classe FROM (
  SELECT *, row_number() OVER (ORDER BY p, h, id_fluxo, timestamp, msm_id) AS n FROM (
    SELECT *, CASE WHEN rc = 1 OR (lost AND rl = 1) THEN 0 ELSE 1 END AS p FROM (
      SELECT *, row_number() OVER (PARTITION BY classe ORDER BY h, id_fluxo, timestamp, msm_id) AS rc,
        row_number() OVER (PARTITION BY lost ORDER BY h, id_fluxo, timestamp, msm_id) AS rl
      FROM (SELECT *, md5(concat_ws('|', '42', id_fluxo, timestamp::VARCHAR, msm_id::VARCHAR)) AS h,
        coalesce(perda_pct = 100 AND rtt_avg IS NULL AND classe = 'FALHA', false) AS lost FROM labelled WHERE classe IS NOT NULL))))
WHERE n <= 10""")
def k3_covering_sample(spark, sf):
    rows = stages(spark, sf).labelled.select("id_fluxo", "timestamp", "msm_id", "classe", "perda_pct", "rtt_avg")
    return picks.covering_sample(rows, 10, ["id_fluxo", "timestamp", "msm_id"]).select("id_fluxo", "timestamp", "msm_id", "classe")


@register("k9_farthest_contrast", """
SELECT id_fluxo, round(p95_rtt_A, 9) AS p95_rtt_A, round(abs(p95_rtt_A - (SELECT p95_rtt_A FROM baseline WHERE id_fluxo = '0_0')), 9) AS distancia
FROM baseline WHERE id_fluxo <> '0_0' AND p95_rtt_A IS NOT NULL ORDER BY distancia DESC, id_fluxo LIMIT 1""")
def k9_farthest_contrast(spark, sf):
    return rounded(picks.farthest_contrast(stages(spark, sf).baseline, "0_0"), 9)


@register("k10_exemplar", """
SELECT id_fluxo, timestamp, prioridade FROM (SELECT *, CASE WHEN latencia_ms > 100 AND latencia_ms < 160 THEN 0
  WHEN latencia_ms > 100 THEN 1 WHEN latencia_ms IS NOT NULL THEN 2 ELSE 3 END AS prioridade FROM labelled WHERE id_fluxo = '0_0')
ORDER BY prioridade, timestamp, msm_id LIMIT 1""")
def k10_exemplar(spark, sf):
    return picks.exemplar(stages(spark, sf).labelled, "0_0", 100.0, 160.0).select("id_fluxo", "timestamp", "prioridade")


@register("k12_hashed_sample", """
SELECT id_fluxo, timestamp, alvo FROM final ORDER BY md5(concat_ws('|', '42', id_fluxo, timestamp::VARCHAR)), id_fluxo, timestamp LIMIT 200""")
def k12_hashed_sample(spark, sf):
    rows = stages(spark, sf).final.select("id_fluxo", "timestamp", "alvo")
    return picks.hashed_sample(rows, K.LEAK_SAMPLE, ["id_fluxo", "timestamp"])


MEDIANS = {"meds": "SELECT id_fluxo, mediana_rtt_A AS m FROM baseline",
           "cuts": "SELECT quantile_cont(m, 1.0::DOUBLE / 3) AS q1, quantile_cont(m, 2.0::DOUBLE / 3) AS q2 FROM meds"}
MEDIANS["cuts"] = "SELECT quantile_cont(m, 0.3333333333333333) AS q1, quantile_cont(m, 0.6666666666666666) AS q2 FROM meds"
MEDIANS["banded"] = """SELECT meds.id_fluxo, m, CASE WHEN m <= q1 THEN 'curta' WHEN m <= q2 THEN 'media' ELSE 'longa' END AS faixa FROM meds, cuts"""


@register("w14_tertile_bands", "SELECT id_fluxo, round(m, 9) AS mediana_rtt_A, faixa FROM banded", MEDIANS)
def w14_tertile_bands(spark, sf):
    base = stages(spark, sf).baseline.select("id_fluxo", "mediana_rtt_A")
    return rounded(picks.with_band(base, "mediana_rtt_A"), 9)


@register("k8_shortlist", """
SELECT id_fluxo, faixa, ordem FROM (SELECT *, row_number() OVER (PARTITION BY faixa ORDER BY CASE WHEN id_fluxo LIKE '%_1' THEN 0 ELSE 1 END,
  CASE faixa WHEN 'curta' THEN m WHEN 'media' THEN abs(m - (SELECT quantile_cont(m, 0.5) FROM banded WHERE faixa = 'media')) ELSE -m END, id_fluxo) AS ordem FROM banded)
WHERE ordem <= CASE faixa WHEN 'longa' THEN 1 ELSE 2 END""", MEDIANS)
def k8_shortlist(spark, sf):
    base = picks.with_band(stages(spark, sf).baseline.select("id_fluxo", "mediana_rtt_A"), "mediana_rtt_A")
    return picks.shortlist(base, "mediana_rtt_A", F.col("id_fluxo").endswith("_1")).select("id_fluxo", "faixa", "ordem")


@register("k14_preferred_flow", """
SELECT id_fluxo, CASE WHEN anchor_id = 1 AND n_rtt_validos_A >= 470 THEN 0 WHEN n_rtt_validos_A >= 470 THEN 1 ELSE 2 END AS prioridade
FROM baseline ORDER BY prioridade, id_fluxo LIMIT 1""")
def k14_preferred_flow(spark, sf):
    base = stages(spark, sf).baseline
    return picks.preferred_first(base, F.col("anchor_id") == 1, F.col("n_rtt_validos_A") >= 470, ["id_fluxo"]).select("id_fluxo", "prioridade")


# ---------------------------------------------------------------- set operations
@register("u3_flow_sets", """
SELECT 'vistos_fora_do_universo' AS conjunto, count(*) AS n FROM (SELECT DISTINCT id_fluxo FROM collected WHERE periodo = 'A'
  EXCEPT SELECT id_fluxo FROM baseline WHERE n_rtt_validos_A >= 460)
UNION ALL SELECT 'bloqueados_no_final', count(*) FROM (SELECT id_fluxo FROM stale INTERSECT SELECT id_fluxo FROM final)""")
def u3_flow_sets(spark, sf):
    s = stages(spark, sf)
    seen = s.collected.where("periodo = 'A'").select("id_fluxo").distinct()
    outside = seen.subtract(s.baseline.where("n_rtt_validos_A >= 460").select("id_fluxo"))
    blocked = s.stale.select(F.concat_ws("_", "probe_id", "anchor_id").alias("id_fluxo")).intersect(s.final.select("id_fluxo"))
    count = F.count(F.lit(1)).alias("n")
    return outside.agg(count).select(F.lit("vistos_fora_do_universo").alias("conjunto"), "n").unionByName(
        blocked.agg(count).select(F.lit("bloqueados_no_final").alias("conjunto"), "n"))
