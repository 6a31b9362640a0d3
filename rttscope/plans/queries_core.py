"""Queries of the dataset build: collection, baselines, labels, features, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators import baseline, collection, dataset
from rttscope.plans.catalog import register, rounded, stages
from rttscope.plans.oracle import usage_sql
from rttscope.sources import adapter

A, B = "periodo = 'A'", "periodo = 'B'"


def _round_list(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


_FLOATS = ("razao_rtt_p95", "razao_rtt_p99", "razao_jitter_p95", "amplitude_rtt_rel", "perda_pct")


@register("label_counts", "SELECT classe, motivo_rotulagem, count(*) AS n FROM labelled GROUP BY ALL")
def label_counts(spark, sf):
    return stages(spark, sf).labelled.groupBy("classe", "motivo_rotulagem").agg(F.count(F.lit(1)).alias("n"))


@register("final_dataset", f"""
SELECT id_fluxo, anchor_id, probe_id, timestamp, split, classe_atual, alvo, {", ".join(
    f"CAST({c} AS BIGINT) AS {c}" if c in ('rtt_ausente', 'ttl_reset', 'perdas_consecutivas')
    else f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in K.FEATURES)} FROM final""")
def final_dataset(spark, sf):
    ints = ("rtt_ausente", "ttl_reset", "perdas_consecutivas")
    return rounded(stages(spark, sf).final).withColumns({c: F.col(c).cast("long") for c in ints})


# ---------------------------------------------------------------- collection
@register("p5_period_discards", f"""
SELECT periodo, CASE WHEN type <> 'ping' THEN '{K.REASON_TYPE}' WHEN periodo IS NULL THEN '{K.REASON_WINDOW}' END AS motivo,
  count(*) AS n FROM tagged GROUP BY ALL""")
def p5_period_discards(spark, sf):
    rows = collection.with_period(adapter.pings(spark, sf), adapter.PERIODS)
    reason = collection.discard_reason(adapter.PERIODS).alias("motivo")
    return rows.groupBy("periodo", reason).agg(F.count(F.lit(1)).alias("n"))


@register("p6_fetch_counters", """
SELECT id_fluxo, count(*) FILTER (own AND inside) AS n_mantidas, count(*) FILTER (NOT own) AS n_outra_probe,
  count(*) FILTER (own AND NOT inside) AS n_fora_da_janela, count(*) FILTER (own AND inside AND af <> 4) AS n_af_divergente
FROM (SELECT *, probe_id = msm_id % 3 AS own, periodo IS NOT NULL AND periodo = 'B' AS inside FROM tagged) GROUP BY id_fluxo""")
def p6_fetch_counters(spark, sf):
    return collection.fetch_counters(adapter.pings(spark, sf), adapter.PERIODS[1:], F.col("msm_id") % 3)


@register("w7_repeats", """
SELECT probe_id, msm_id, timestamp, count(*) - 1 AS n_descartadas FROM tagged WHERE periodo IS NOT NULL
GROUP BY ALL HAVING count(*) > 1""")
def w7_repeats(spark, sf):
    rows = collection.with_period(adapter.pings(spark, sf), adapter.PERIODS).where("periodo is not null")
    return collection.repeats(rows)


@register("w7_first_wins", "SELECT event_id, probe_id, msm_id, timestamp, periodo FROM collected")
def w7_first_wins(spark, sf):
    rows = collection.with_period(adapter.pings(spark, sf), adapter.PERIODS).where("periodo is not null")
    return collection.first_wins(rows).select("event_id", "probe_id", "msm_id", "timestamp", "periodo")


@register("g6_usage", "SELECT id_fluxo, periodo, linhas, ttl_validos, round(esperado, 6) AS esperado, cobertura, motivo, usado FROM usage_tight",
          {"usage_tight": usage_sql("collected", 2100.0)})
def g6_usage(spark, sf):
    use = collection.usage(stages(spark, sf).collected, adapter.PERIODS, 2100.0)
    return use.select("id_fluxo", "periodo", "linhas", "ttl_validos", F.round("esperado", 6).alias("esperado"),
                      "cobertura", "motivo", "usado")


FLOW_GRID = {
    # flows that are listed but never answer, flows whose measurement is blocked, and a network error in one period
    "listed": "SELECT DISTINCT probe_id, anchor_id, id_fluxo FROM tagged UNION SELECT DISTINCT probe_id, anchor_id + 100, probe_id::VARCHAR || '_' || (anchor_id + 100)::VARCHAR FROM tagged",
    "failed": f"""SELECT id_fluxo, periodo, CASE WHEN anchor_id = 101 THEN '{K.REASON_AF}' ELSE 'erro_rede' END AS motivo
  FROM listed, (VALUES ('A'), ('B')) p(periodo) WHERE anchor_id = 101 AND probe_id < 3 OR probe_id = 4 AND periodo = 'B'""",
    "listed_use": usage_sql("collected", 2100.0),
}


@register("g6_flow_grid", f"""
SELECT l.id_fluxo, p.periodo, CASE WHEN f.motivo IS NULL THEN coalesce(u.linhas, 0) ELSE 0 END AS linhas, CASE WHEN f.motivo IS NULL THEN coalesce(u.ttl_validos, 0) ELSE 0 END AS ttl_validos,
  CASE WHEN f.motivo IS NULL THEN coalesce(u.cobertura, 0.0) END AS cobertura, coalesce(f.motivo, u.motivo, '{K.REASON_EMPTY}') AS motivo, f.motivo IS NULL AND coalesce(u.usado, false) AS usado
FROM listed l CROSS JOIN (VALUES ('A'), ('B')) p(periodo) LEFT JOIN listed_use u ON u.id_fluxo = l.id_fluxo AND u.periodo = p.periodo
LEFT JOIN failed f ON f.id_fluxo = l.id_fluxo AND f.periodo = p.periodo""", FLOW_GRID)
def g6_flow_grid(spark, sf):
    """Every listed flow in every period, with the reason of those that were blocked, failed or stayed empty."""
    seen = stages(spark, sf).raw.select("probe_id", "anchor_id", "id_fluxo").distinct()
    other = seen.withColumn("anchor_id", F.col("anchor_id") + 100).withColumn("id_fluxo", F.concat_ws("_", "probe_id", "anchor_id"))
    flows = seen.unionByName(other)
    each = flows.withColumn("periodo", F.explode(F.array(F.lit("A"), F.lit("B"))))
    blocked, lost = (F.col("anchor_id") == 101) & (F.col("probe_id") < 3), (F.col("probe_id") == 4) & (F.col("periodo") == "B")
    problems = each.where(blocked | lost).select("id_fluxo", "periodo", F.when(F.col("anchor_id") == 101, K.REASON_AF).otherwise("erro_rede").alias("motivo"))
    use = collection.usage(stages(spark, sf).collected, adapter.PERIODS, 2100.0, flows=flows, problems=problems)
    return use.select("id_fluxo", "periodo", "linhas", "ttl_validos", "cobertura", "motivo", "usado")


@register("g7_flow_classes", """
SELECT id_fluxo, CASE WHEN a AND b THEN 'A+B' WHEN b THEN 'B' WHEN a THEN 'A' ELSE 'nenhum' END AS classe_fluxo FROM (
  SELECT id_fluxo, bool_or(usado AND periodo = 'A') AS a, bool_or(usado AND periodo = 'B') AS b FROM usage_tight GROUP BY id_fluxo)""",
          {"usage_tight": usage_sql("collected", 2100.0)})
def g7_flow_classes(spark, sf):
    use = collection.usage(stages(spark, sf).collected, adapter.PERIODS, 2100.0)
    return collection.flow_classes(use).select("id_fluxo", "classe_fluxo")


@register("p7_universe", """
SELECT u.id_fluxo, classe_fluxo IN ('A+B', 'A') AS no_universo, classe_fluxo,
  string_agg(periodo || ': ' || motivo, '; ' ORDER BY periodo) AS motivos
FROM usage_tight u JOIN (SELECT id_fluxo, CASE WHEN a AND b THEN 'A+B' WHEN b THEN 'B' WHEN a THEN 'A' ELSE 'nenhum' END AS classe_fluxo FROM (
  SELECT id_fluxo, bool_or(usado AND periodo = 'A') AS a, bool_or(usado AND periodo = 'B') AS b FROM usage_tight GROUP BY id_fluxo)) c USING (id_fluxo)
GROUP BY ALL""", {"usage_tight": usage_sql("collected", 2100.0)})
def p7_universe(spark, sf):
    use = collection.usage(stages(spark, sf).collected, adapter.PERIODS, 2100.0)
    classes = collection.flow_classes(use)
    # two rows per flow
    why = use.groupBy("id_fluxo").agg(F.array_join(F.sort_array(F.collect_list(
        F.concat_ws(": ", "periodo", "motivo"))), "; ").alias("motivos"))
    return classes.join(why, "id_fluxo").select(
        "id_fluxo", F.col("classe_fluxo").isin("A+B", "A").alias("no_universo"), "classe_fluxo", "motivos")


@register("g8_high_loss", """
SELECT id_fluxo, enviados, recebidos, round((enviados - recebidos) / enviados, 6) AS fracao_perda FROM (
  SELECT id_fluxo, sum(sent)::BIGINT AS enviados, sum(rcvd)::BIGINT AS recebidos FROM pings GROUP BY id_fluxo)
WHERE (enviados - recebidos) / enviados >= 0.1""")
def g8_high_loss(spark, sf):
    return rounded(collection.high_loss(adapter.pings(spark, sf), 0.1))


@register("g9_exclusion_ledger", f"""
SELECT anchor_id, probe_id, msm_id, id_fluxo, motivo, sum(n)::BIGINT AS n FROM (
  SELECT anchor_id, probe_id, msm_id, id_fluxo, '{K.REASON_TYPE}' AS motivo, 1 AS n FROM used WHERE type <> 'ping'
  UNION ALL SELECT anchor_id, probe_id, msm_id, id_fluxo, '{K.REASON_AF}', count(*) FROM used WHERE af <> 4 GROUP BY ALL)
GROUP BY ALL""")
def g9_exclusion_ledger(spark, sf):
    used = stages(spark, sf).used
    by_type = used.withColumn("motivo", collection.discard_reason(adapter.PERIODS)).where("motivo is not null")
    by_family = used.where(F.col("af") != 4).groupBy("anchor_id", "probe_id", "msm_id", "id_fluxo").agg(
        F.count(F.lit(1)).alias("n")).withColumn("motivo", F.lit(K.REASON_AF))
    return collection.exclusion_ledger(by_type, by_family)


@register("p13_losses_outside_set", """
SELECT id_fluxo, timestamp, msm_id, round(perda_pct, 6) AS perda_pct FROM processed
WHERE least(abs(perda_pct), abs(perda_pct - 100.0 / 3), abs(perda_pct - 200.0 / 3), abs(perda_pct - 100)) > 0.01""")
def p13_losses_outside_set(spark, sf):
    from rttscope.operators.quality import losses_outside_set
    return rounded(losses_outside_set(stages(spark, sf).processed).select("id_fluxo", "timestamp", "msm_id", "perda_pct"))


# ---------------------------------------------------------------- instant metrics
@register("f3_packet_rtts", """
SELECT event_id, len(list_filter(r, lambda x: x IS NOT NULL)) AS n_rtts, round(list_min(r), 6) AS menor, round(list_max(r), 6) AS maior,
  round(list_sum(r) / len(list_filter(r, lambda x: x IS NOT NULL)), 6) AS media, contains(result, '"x"') AS tem_timeout
FROM (SELECT *, list_transform(json_extract(result, '$[*].rtt'), lambda x: CAST(x AS DOUBLE)) AS r FROM pings)""")
def f3_packet_rtts(spark, sf):
    from rttscope.functions.parse import has_timeout, mean_of, packet_rtts
    rows = adapter.pings(spark, sf).withColumn("r", packet_rtts("result"))
    return rounded(rows.select("event_id", F.size("r").cast("long").alias("n_rtts"), F.array_min("r").alias("menor"),
                               F.array_max("r").alias("maior"), mean_of(F.col("r")).alias("media"),
                               has_timeout("result").alias("tem_timeout")))


@register("f5_instant_metrics", """
SELECT event_id, periodo, round(rtt_min, 6) AS rtt_min, round(rtt_max, 6) AS rtt_max, round(rtt_avg, 6) AS rtt_avg,
  round(perda_pct, 6) AS perda_pct, round(jitter_ms, 6) AS jitter_ms, round(latencia_ms, 6) AS latencia_ms FROM instants""")
def f5_instant_metrics(spark, sf):
    return rounded(stages(spark, sf).instants.select(
        "event_id", "periodo", "rtt_min", "rtt_max", "rtt_avg", "perda_pct", "jitter_ms", "latencia_ms"))


@register("p23_valid_rtts", """
SELECT id_fluxo, count(*) AS linhas, count(*) FILTER (min >= 0 AND avg >= 0 AND max >= 0 AND NOT contains(result, '"x"')) AS rtts_validos
FROM pings GROUP BY id_fluxo""")
def p23_valid_rtts(spark, sf):
    from rttscope.functions.parse import has_timeout
    valid = (F.col("min") >= 0) & (F.col("avg") >= 0) & (F.col("max") >= 0) & ~has_timeout("result")
    return adapter.pings(spark, sf).groupBy("id_fluxo").agg(
        F.count(F.lit(1)).alias("linhas"), F.count_if(valid).alias("rtts_validos"))


# ---------------------------------------------------------------- baselines
@register("g1_ttl_baseline", """
SELECT anchor_id, probe_id, median(ttl) AS ttl_baseline, count(ttl) AS n_amostras_A, min(ttl) AS ttl_min_A,
  max(ttl) AS ttl_max_A, count(DISTINCT ttl) AS n_ttl_distintos_A
FROM instants WHERE periodo = 'A' GROUP BY ALL HAVING count(ttl) >= 30""")
def g1_ttl_baseline(spark, sf):
    return baseline.ttl_baseline(stages(spark, sf).instants.where(A))


@register("g2_rtt_baseline", f"SELECT {', '.join(f'round({c}, 9) AS {c}' if c.startswith(('mediana', 'p9')) else c for c in K.BASELINE_COLUMNS)} FROM baseline")
def g2_rtt_baseline(spark, sf):
    table = baseline.rtt_baseline(stages(spark, sf).instants.where(A), baseline.universe(stages(spark, sf).classes))
    return rounded(table, 9)


@register("g5_loss_share", """
SELECT id_fluxo, round(100.0 * count(*) FILTER (rcvd < sent) / count(*), 6) AS pct_execucoes_com_perda,
  count(DISTINCT msm_id) AS n_msm, count(*) AS n_execucoes FROM instants WHERE periodo = 'A' GROUP BY id_fluxo""")
def g5_loss_share(spark, sf):
    return baseline.loss_share(stages(spark, sf).instants.where(A))


@register("j10_compare_ttl", """
SELECT b.anchor_id, b.probe_id, b.id_fluxo, CASE WHEN o.anchor_id IS NULL THEN 'ausente' ELSE concat_ws(',',
  CASE WHEN b.ttl_baseline IS DISTINCT FROM o.tb THEN 'ttl_baseline' END, CASE WHEN b.ttl_min_A IS DISTINCT FROM o.tmin THEN 'ttl_min_A' END,
  CASE WHEN b.ttl_max_A IS DISTINCT FROM o.tmax THEN 'ttl_max_A' END, CASE WHEN b.n_ttl_distintos_A IS DISTINCT FROM o.td THEN 'n_ttl_distintos_A' END) END AS diferenca
FROM baseline b LEFT JOIN (SELECT anchor_id, probe_id, median(ttl) AS tb, min(ttl) AS tmin, max(ttl) AS tmax, count(DISTINCT ttl) AS td
  FROM instants WHERE periodo = 'B' AND probe_id <> 3 GROUP BY ALL HAVING count(ttl) >= 30) o
  ON o.anchor_id = b.anchor_id AND o.probe_id = b.probe_id WHERE diferenca <> ''""")
def j10_compare_ttl(spark, sf):
    s = stages(spark, sf)
    return baseline.compare_ttl(s.baseline, baseline.ttl_baseline(s.instants.where(B).where("probe_id <> 3")))


# ---------------------------------------------------------------- joins with the baseline, labels
@register("j2_processed", """
SELECT anchor_id, probe_id, round(rtt_min, 6) AS rtt_min, round(rtt_max, 6) AS rtt_max, round(rtt_avg, 6) AS rtt_avg,
  round(perda_pct, 6) AS perda_pct, round(jitter_ms, 6) AS jitter_ms, ttl, ttl_baseline, delta_ttl, ttl_changed::BIGINT AS ttl_changed,
  round(latencia_ms, 6) AS latencia_ms, timestamp FROM processed""")
def j2_processed(spark, sf):
    return rounded(stages(spark, sf).processed.select(*K.DATASET_COLUMNS)).withColumn(
        "ttl_changed", F.col("ttl_changed").cast("long"))


@register("j1_labelled_audit", """
SELECT anchor_id, probe_id, timestamp, round(perda_pct, 6) AS perda_pct, round(latencia_ms, 6) AS latencia_ms, round(jitter_ms, 6) AS jitter_ms,
  round(p95_rtt_A, 9) AS p95_rtt_A, round(p99_rtt_A, 9) AS p99_rtt_A, round(p95_jitter_A, 9) AS p95_jitter_A, classe, motivo_rotulagem FROM labelled""")
def j1_labelled_audit(spark, sf):
    rows = stages(spark, sf).labelled.select(*K.AUDIT_COLUMNS)
    limits = {c: F.round(c, 9) for c in ("p95_rtt_A", "p99_rtt_A", "p95_jitter_A")}
    plain = {c: F.round(c, 6) for c in ("perda_pct", "latencia_ms", "jitter_ms")}
    return rows.withColumns({**limits, **plain})


@register("p11_stale_flows", """
SELECT id_fluxo, round(avg(CAST(motivo_rotulagem = 'latencia_acima_p99' AS INTEGER)), 6) AS fracao, count(*) AS n
FROM labelled WHERE status_baseline = 'VALIDO' GROUP BY id_fluxo HAVING avg(CAST(motivo_rotulagem = 'latencia_acima_p99' AS INTEGER)) >= 0.01""")
def p11_stale_flows(spark, sf):
    # a low share, since no derived flow ever reaches the default one half
    stale = dataset.stale_flows(stages(spark, sf).labelled, 0.01)
    return rounded(stale.select(F.concat_ws("_", "probe_id", "anchor_id").alias("id_fluxo"), "fracao", "n"))


@register("p10_kept_series", """
SELECT id_fluxo, count(*) AS n FROM labelled WHERE status_baseline = 'VALIDO' AND id_fluxo NOT IN (
  SELECT id_fluxo FROM labelled WHERE status_baseline = 'VALIDO' GROUP BY id_fluxo
  HAVING avg(CAST(motivo_rotulagem = 'latencia_acima_p99' AS INTEGER)) >= 0.01) GROUP BY id_fluxo""")
def p10_kept_series(spark, sf):
    rows = stages(spark, sf).labelled
    return dataset.kept_series(rows, dataset.stale_flows(rows, 0.01)).groupBy("id_fluxo").agg(F.count(F.lit(1)).alias("n"))


@register("p12_discards", "SELECT motivo_descarte, count(*) AS n FROM candidates GROUP BY ALL")
def p12_discards(spark, sf):
    return stages(spark, sf).candidates.groupBy("motivo_descarte").agg(F.count(F.lit(1)).alias("n"))


@register("g10_exclusions", """
SELECT id_fluxo, motivo, count(*) AS n_linhas FROM (
  SELECT id_fluxo, CASE WHEN status_baseline IS NULL THEN 'baseline_nao_encontrado' WHEN status_baseline <> 'VALIDO' THEN 'baseline_insuficiente'
    WHEN id_fluxo IN (SELECT id_fluxo FROM stale) THEN 'baseline_desatualizado' END AS motivo FROM labelled
  UNION ALL SELECT id_fluxo, motivo_descarte FROM candidates
  UNION ALL SELECT id_fluxo, 'embargo' FROM split_rows WHERE split = 'embargo') WHERE motivo IS NOT NULL GROUP BY ALL""")
def g10_exclusions(spark, sf):
    s = stages(spark, sf)
    return dataset.exclusions(s.labelled, s.stale, s.split, s.candidates)


@register("p14_severe_unlabelled", """
SELECT id_fluxo, count(*) AS n FROM (SELECT *, CASE WHEN id_fluxo IN ('0_0', '1_1') THEN NULL ELSE classe END AS c FROM labelled)
WHERE c IS NULL AND perda_pct >= 66.65 GROUP BY id_fluxo""")
def p14_severe_unlabelled(spark, sf):
    # two flows are treated as having no baseline, so the count is not empty
    rows = stages(spark, sf).processed.withColumn(
        "status_baseline", F.when(~F.col("id_fluxo").isin("0_0", "1_1"), F.col("status_baseline")))
    return dataset.severe_unlabelled(dataset.labelled(rows))


@register("p15_zero_jitter_limit", """
SELECT DISTINCT id_fluxo FROM (SELECT id_fluxo, quantile_cont(jitter_ms, 0.95) AS p FROM instants
  WHERE periodo = 'A' AND rcvd = 1 GROUP BY id_fluxo) WHERE p = 0""")
def p15_zero_jitter_limit(spark, sf):
    # executions with one packet back have zero jitter by definition
    rows = stages(spark, sf).instants.where(A).where("rcvd = 1")
    return dataset.zero_jitter_limit(baseline.rtt_baseline(rows, minimum=1))


@register("j18_pairs_without_baseline", """
SELECT DISTINCT anchor_id, probe_id FROM instants WHERE periodo = 'B' AND id_fluxo NOT IN (
  SELECT id_fluxo FROM instants WHERE periodo = 'A' GROUP BY id_fluxo HAVING count(ttl) >= 480)""")
def j18_pairs_without_baseline(spark, sf):
    rows = stages(spark, sf).instants
    base = baseline.ttl_baseline(rows.where(A), 480)
    return rows.where(B).join(base, ["anchor_id", "probe_id"], "left_anti").select("anchor_id", "probe_id").distinct()


@register("j20_valid_baseline", """
SELECT p.event_id, b.status_baseline IS NOT NULL AS tem_baseline FROM collected p
LEFT JOIN (SELECT * FROM baseline WHERE status_baseline = 'VALIDO' AND n_rtt_validos_A >= 460) b USING (id_fluxo) WHERE periodo = 'B'""")
def j20_valid_baseline(spark, sf):
    s = stages(spark, sf)
    valid = s.baseline.where((F.col("status_baseline") == K.STATUS_VALID) & (F.col("n_rtt_validos_A") >= 460))
    return s.collected.where(B).join(valid.select("id_fluxo", "status_baseline"), "id_fluxo", "left").select(
        "event_id", F.col("status_baseline").isNotNull().alias("tem_baseline"))


# ---------------------------------------------------------------- windows
@register("w1_rolling", "SELECT id_fluxo, timestamp, msm_id, pos, " + ", ".join(
    f"round({f}_w{n}::DOUBLE, 6) AS {f}_w{n}" for n in K.WINDOWS for f in K.WINDOW_FEATURES) + " FROM candidates")
def w1_rolling(spark, sf):
    cols = [f"{f}_w{n}" for n in K.WINDOWS for f in K.WINDOW_FEATURES]
    return rounded(stages(spark, sf).candidates.select("id_fluxo", "timestamp", "msm_id", "pos", *cols))


@register("w4_loss_streak", "SELECT id_fluxo, timestamp, msm_id, perdas_consecutivas FROM candidates")
def w4_loss_streak(spark, sf):
    return stages(spark, sf).candidates.select("id_fluxo", "timestamp", "msm_id", "perdas_consecutivas")


@register("w5_target_gap", "SELECT id_fluxo, timestamp, msm_id, classe, alvo, gap_s FROM candidates")
def w5_target_gap(spark, sf):
    return stages(spark, sf).candidates.select("id_fluxo", "timestamp", "msm_id", "classe", "alvo", "gap_s")


@register("w6_gap_flag", """
SELECT id_fluxo, timestamp, msm_id, coalesce(timestamp - lag(timestamp) OVER (PARTITION BY id_fluxo ORDER BY timestamp, msm_id) > 600, false) AS lacuna,
  row_number() OVER (PARTITION BY id_fluxo ORDER BY timestamp, msm_id) <= 12 AS aquecimento FROM instants WHERE periodo = 'B'""")
def w6_gap_flag(spark, sf):
    from rttscope.operators.online import gap_and_warmup
    return gap_and_warmup(stages(spark, sf).instants.where(B)).select("id_fluxo", "timestamp", "msm_id", "lacuna", "aquecimento")


@register("w10_transition_runs", """
SELECT id_fluxo, min(timestamp) AS inicio, min(pos) AS posicao FROM (
  SELECT *, list(classe) OVER f AS cs, count(*) OVER f AS k FROM candidates
  WINDOW f AS (PARTITION BY id_fluxo ORDER BY timestamp, msm_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
WHERE k = 8 AND regexp_matches(list_aggregate(list_transform(cs, lambda x: substr(x, 1, 1)), 'string_agg', ''), 'O.*R.*F')
GROUP BY id_fluxo""")
def w10_transition_runs(spark, sf):
    from rttscope.operators.picks import transition_runs
    return transition_runs(stages(spark, sf).candidates.drop("pos"), ["id_fluxo"])


@register("w12_history_cap", """
SELECT id_fluxo, timestamp, msm_id FROM (SELECT *, row_number() OVER (PARTITION BY id_fluxo ORDER BY timestamp DESC, msm_id DESC) AS r
  FROM instants WHERE periodo = 'B') WHERE r <= 48""")
def w12_history_cap(spark, sf):
    from rttscope.operators.online import newest_rows
    return newest_rows(stages(spark, sf).instants.where(B)).select("id_fluxo", "timestamp", "msm_id")


@register("w13_latest_row", """
SELECT id_fluxo, timestamp, msm_id FROM (SELECT *, row_number() OVER (PARTITION BY id_fluxo ORDER BY timestamp DESC, msm_id DESC) AS r
  FROM instants WHERE periodo = 'B') WHERE r = 1""")
def w13_latest_row(spark, sf):
    from rttscope.operators.online import newest_rows
    return newest_rows(stages(spark, sf).instants.where(B), 1).select("id_fluxo", "timestamp", "msm_id")


# ---------------------------------------------------------------- features, split
@register("f12_instant_features", "SELECT id_fluxo, timestamp, msm_id, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("razao_rtt_p95", "razao_rtt_p99", "razao_jitter_p95", "amplitude_rtt_rel"))
    + ", delta_ttl_clip, ttl_reset::BIGINT AS ttl_reset, rtt_ausente::BIGINT AS rtt_ausente FROM featured")
def f12_instant_features(spark, sf):
    from rttscope.operators.features import instant_features
    rows = instant_features(stages(spark, sf).series)
    return rounded(rows.select("id_fluxo", "timestamp", "msm_id", "razao_rtt_p95", "razao_rtt_p99", "razao_jitter_p95",
                               "amplitude_rtt_rel", "delta_ttl_clip", F.col("ttl_reset").cast("long").alias("ttl_reset"),
                               F.col("rtt_ausente").cast("long").alias("rtt_ausente")))


@register("f16_split", "SELECT split, count(*) AS linhas, min(timestamp) AS inicio, max(timestamp) AS fim FROM split_rows GROUP BY split")
def f16_split(spark, sf):
    from rttscope.operators.quality import split_summary
    return split_summary(stages(spark, sf).split)


@register("g24_split_summary", "SELECT split, count(*) AS linhas, min(timestamp) AS inicio, max(timestamp) AS fim FROM final GROUP BY split")
def g24_split_summary(spark, sf):
    from rttscope.operators.quality import split_summary
    return split_summary(stages(spark, sf).final)
