"""Queries of the verification jobs and of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions import label, parse
from rttscope.functions.parse import instant_metrics
from rttscope.operators import checks, metrics
from rttscope.operators.features import fill_sentinel
from rttscope.plans.catalog import register, rounded, stages
from rttscope.plans.queries_eval import SLICE_CTES, persistence, scores_sql
from rttscope.session import materialise
from rttscope.sources import adapter

CUT = adapter.B_START + 7 * 86400


def _zeros(names, extra=""):
    return f"SELECT unnest([{', '.join(repr(n) for n in names)}]) AS regra, 0 AS n {extra}"


@register("v1_dataset_invariants", f"""
SELECT 'latencia_igual_rtt_avg' AS regra, count(*) FILTER (latencia_ms IS DISTINCT FROM rtt_avg) AS n FROM processed
UNION ALL SELECT 'fora_da_janela', count(*) FILTER (timestamp < {adapter.B_START} OR timestamp >= {adapter.B_END}) FROM processed
UNION ALL SELECT 'delta_ttl', count(*) FILTER (delta_ttl IS DISTINCT FROM ttl - ttl_baseline) FROM processed
UNION ALL SELECT 'ttl_changed', count(*) FILTER (ttl_changed IS DISTINCT FROM (ttl <> ttl_baseline)::INTEGER) FROM processed
UNION ALL SELECT 'rtt_com_perda_total', count(*) FILTER (perda_pct = 100 AND rtt_avg IS NOT NULL) FROM processed
UNION ALL SELECT 'ordem_min_max', count(*) FILTER (rtt_min > rtt_max + 0.01) FROM processed""")
def v1_dataset_invariants(spark, sf):
    return checks.dataset_invariants(stages(spark, sf).processed, (adapter.B_START, adapter.B_END))


@register("v1_ttl_baseline_unique", "SELECT anchor_id, probe_id, count(DISTINCT ttl_baseline) AS n FROM processed GROUP BY ALL HAVING count(DISTINCT ttl_baseline) > 1")
def v1_ttl_baseline_unique(spark, sf):
    return checks.one_ttl_baseline(stages(spark, sf).processed)


@register("v2_recorded_divergences", """
SELECT event_id, campo, round(original, 6) AS original, round(recalculado, 6) AS recalculado FROM (
  SELECT event_id, unnest(['min', 'max', 'avg']) AS campo, unnest([min + CASE WHEN event_id % 61 = 0 THEN 1 ELSE 0 END, max, avg]) AS original,
    unnest([list_min(rtts), list_max(rtts), rtt_mean]) AS recalculado FROM instants WHERE rcvd <> 0 AND len(rtts) > 0)
WHERE abs(original - recalculado) > 0.01""")
def v2_recorded_divergences(spark, sf):
    # one recorded minimum in 61 is moved by a millisecond, so that the check has something to find
    rows = stages(spark, sf).used.where("type = 'ping'").withColumn(
        "min", F.col("min") + F.when(F.col("event_id") % 61 == 0, 1).otherwise(0))
    out = checks.recorded_divergences(instant_metrics(rows))
    return rounded(out.select("event_id", "campo", "original", "recalculado"))


@register("v3_label_invariants", """
SELECT 'perda_severa_sem_falha' AS regra, count(*) FILTER (status_baseline = 'VALIDO' AND perda_pct >= 66.65 AND classe IS DISTINCT FROM 'FALHA') AS n FROM labelled
UNION ALL SELECT 'acima_p99_sem_falha', count(*) FILTER (status_baseline = 'VALIDO' AND perda_pct IS NOT NULL AND latencia_ms > p99_rtt_A AND classe IS DISTINCT FROM 'FALHA') FROM labelled
UNION ALL SELECT 'acima_p95_ok', count(*) FILTER (latencia_ms > p95_rtt_A AND classe = 'OK') FROM labelled
UNION ALL SELECT 'sem_baseline_com_classe', count(*) FILTER (status_baseline IS DISTINCT FROM 'VALIDO' AND classe IS NOT NULL) FROM labelled
UNION ALL SELECT 'perda_vazia_com_classe', count(*) FILTER (perda_pct IS NULL AND classe IS NOT NULL) FROM labelled""")
def v3_label_invariants(spark, sf):
    return checks.label_invariants(stages(spark, sf).labelled)


@register("v4_future_leak", "SELECT id_fluxo, timestamp, '' AS feature, '' AS prova FROM final WHERE false")
def v4_future_leak(spark, sf):
    s = stages(spark, sf)
    out = checks.leakage_differences(s.series, s.candidates, CUT)
    return out.select("id_fluxo", "timestamp", "feature", "prova")


@register("v5_split_order", f"""
SELECT (SELECT min(timestamp) FROM final WHERE split = 'validacao') - (SELECT max(timestamp) FROM final WHERE split = 'treino') >= {K.EMBARGO_MIN * 60} AS treino_antes_validacao,
  (SELECT min(timestamp) FROM final WHERE split = 'teste') - (SELECT max(timestamp) FROM final WHERE split = 'validacao') >= {K.EMBARGO_MIN * 60} AS validacao_antes_teste""")
def v5_split_order(spark, sf):
    return checks.split_order(stages(spark, sf).final, K.EMBARGO_MIN * 60)


@register("v5_duplicated_keys", "SELECT id_fluxo, timestamp, count(*) AS n FROM final GROUP BY ALL HAVING count(*) > 1")
def v5_duplicated_keys(spark, sf):
    return checks.duplicated_keys(stages(spark, sf).final)


@register("v6_persistence_matches", """
SELECT split, round(avg((classe_atual = alvo)::INTEGER), 6) AS acuracia, true AS confere FROM final GROUP BY split""")
def v6_persistence_matches(spark, sf):
    """Accuracy from the matrix beside the one counted row by row."""
    rows = persistence(spark, sf)
    computed = metrics.scores(metrics.confusion(rows, ["split"]), "zero").select("split", "acuracia")
    recorded = rows.groupBy("split").agg(F.avg((F.col("classe_atual") == F.col("alvo")).cast("double")).alias("acuracia"))
    return rounded(checks.same_value(computed, recorded, ["split"], "acuracia").join(computed, "split").select("split", "acuracia", "confere"))


@register("v6_matrix_support", """
SELECT split, fatia, count(*) FILTER (alvo = 'OK') AS suporte_OK, count(*) FILTER (alvo = 'RISCO') AS suporte_RISCO, count(*) FILTER (alvo = 'FALHA') AS suporte_FALHA, true AS confere
FROM sliced GROUP BY split, fatia""", SLICE_CTES)
def v6_matrix_support(spark, sf):
    scored = materialise(metrics.sliced_scores(persistence(spark, sf), ["split"]), "slice-scores")
    wrong = checks.matrix_support(scored).select("split", "fatia", F.lit(False).alias("_wrong"))
    rows = scored.where("n > 0").join(wrong, ["split", "fatia"], "left")
    return rows.select("split", "fatia", *[f"suporte_{c}" for c in K.CLASSES], F.col("_wrong").isNull().alias("confere"))


@register("f1_numbers", """
SELECT event_id, TRY_CAST(v AS DOUBLE) AS numero, CASE WHEN regexp_full_match(trim(v), '-?[0-9]+') THEN TRY_CAST(trim(v) AS BIGINT) END AS inteiro FROM (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN event_id::VARCHAR || '.5' WHEN 3 THEN '-' || event_id::VARCHAR WHEN 4 THEN NULL ELSE event_id::VARCHAR END AS v FROM pings)""")
def f1_numbers(spark, sf):
    e = F.col("event_id")
    v = (F.when(e % 6 == 0, "").when(e % 6 == 1, "abc").when(e % 6 == 2, F.concat(e.cast("string"), F.lit(".5")))
         .when(e % 6 == 3, F.concat(F.lit("-"), e.cast("string"))).when(e % 6 == 5, e.cast("string")))
    rows = adapter.pings(spark, sf).select("event_id", v.alias("v"))
    return rows.select("event_id", parse.number("v").alias("numero"), parse.whole("v").alias("inteiro"))


@register("f14_sentinel", "SELECT " + ", ".join(
    f"count(*) FILTER (coalesce({c}, -1.0) = -1.0) AS {c}" for c in K.FEATURES if c not in K.NO_SENTINEL) + " FROM candidates")
def f14_sentinel(spark, sf):
    rows = fill_sentinel(stages(spark, sf).candidates)
    return rows.agg(*[F.count_if(F.col(c) == K.SENTINEL).alias(c) for c in K.FEATURES if c not in K.NO_SENTINEL])


@register("f19_rtt_bands", """
SELECT CASE WHEN razao_rtt_p95 = -1 THEN 'sem_rtt' WHEN razao_rtt_p95 < 0.8 THEN 'abaixo' WHEN razao_rtt_p95 <= 1.2 THEN 'tipica' ELSE 'alta' END AS faixa, count(*) AS n FROM final GROUP BY ALL""")
def f19_rtt_bands(spark, sf):
    return stages(spark, sf).final.groupBy(label.rtt_band("razao_rtt_p95").alias("faixa")).agg(F.count(F.lit(1)).alias("n"))


@register("f22_iso_times", "SELECT event_id, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso, timestamp AS volta FROM pings")
def f22_iso_times(spark, sf):
    rows = adapter.pings(spark, sf).select("event_id", parse.iso_from_unix("timestamp").alias("iso"))
    return rows.withColumn("volta", parse.unix_from_iso("iso"))


@register("f29_near", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false ELSE min IS NULL END AS iguais FROM pings""")
def f29_near(spark, sf):
    e = F.col("event_id")
    a = F.coalesce(F.col("min"), F.lit(7.0))
    left = F.when(e % 3 == 2, F.col("min")).otherwise(a)
    right = F.when(e % 3 == 0, a + 1e-8).when(e % 3 == 1, a + 0.01)
    return adapter.pings(spark, sf).select("event_id", label.near(left, right).alias("iguais"))


@register("p25_collection_window", f"""
SELECT count(*) AS n, min(timestamp) AS inicio, max(timestamp) AS fim FROM pings WHERE timestamp >= {adapter.B_END - 86400} // 3600 * 3600 AND timestamp < {adapter.B_END} // 3600 * 3600""")
def p25_collection_window(spark, sf):
    from rttscope.sources.readers import collection_window
    start, end = collection_window(now="2024-01-31T00:00:00+00:00")
    rows = adapter.pings(spark, sf).where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("inicio"), F.max("timestamp").alias("fim"))


@register("p16_projection", "SELECT " + ", ".join(
    f"count(*) FILTER ({c} IS NULL) AS {c}" for c in K.FEATURES) + " FROM final")
def p16_projection(spark, sf):
    from rttscope.sources.readers import model_input
    return model_input(stages(spark, sf).final).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in K.FEATURES])
