"""Queries of drift: reference, PSI, KS, chi-square, JS, blocks, report, calibration."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators import drift, metrics
from rttscope.plans.catalog import register, rounded, stages
from rttscope.plans.queries_eval import rule_forecast
from rttscope.session import materialise
from rttscope.sources import adapter

END = adapter.B_END
HOLIDAYS = ["2024-01-25", "2024-01-28"]
PAIRS = ", ".join(f"{{'feature': '{c}', 'valor': CAST({c} AS DOUBLE)}}" for c in K.FEATURES)
QS = "[" + ", ".join(f"{i / 10}::DOUBLE" for i in range(11)) + "]"


def _long(rows, keys):
    head = "".join(f"{k}, " for k in keys)
    return f"SELECT {head}u.feature AS feature, u.valor AS valor FROM (SELECT {head}unnest([{PAIRS}]) AS u FROM {rows})"


BIN = "CASE WHEN len(bordas) < 2 THEN 0 ELSE len(list_filter(bordas[2:len(bordas) - 1], lambda e: e <= valor)) END"


def _props(long, edges, keys, join="feature"):
    """Floored proportions as rows (keys, feature, b, p), every bin present."""
    ks = "".join(f"{k}, " for k in keys)
    gs = "".join(f"g.{k}, " for k in keys)
    on = " AND ".join([f"c.{k} = g.{k}" for k in keys] + ["c.feature = g.feature", "c.b = g.b"])
    return f"""
  SELECT {ks}feature, b, p / sum(p) OVER (PARTITION BY {ks}feature) AS p, tot, um, igual FROM (
    SELECT {gs}g.feature, g.b, greatest(coalesce(c.c, 0)::DOUBLE, 1e-6) AS p, g.tot, g.um, g.igual FROM (
      SELECT {ks}feature, unnest(range(0, greatest(max(len(bordas)) - 1, 1))) AS b, count(*) AS tot, max(len(bordas)) < 2 AS um,
        bool_and(valor = bordas[1]) AS igual FROM {long} JOIN {edges} USING ({join}) GROUP BY {ks}feature) g
    LEFT JOIN (SELECT {ks}feature, {BIN} AS b, count(*) AS c FROM {long} JOIN {edges} USING ({join}) GROUP BY ALL) c ON {on})"""


def _psi(cur, ref, keys, on="feature, b"):
    ks = "".join(f"{k}, " for k in keys)
    return f"""
  SELECT {ks}feature, max(tot) AS n, CASE WHEN bool_or(um) THEN CASE WHEN bool_and(igual) THEN 0.0 ELSE 1.0 END ELSE sum((p - q) * ln(p / q)) END AS psi
  FROM (SELECT c.*, r.p AS q FROM {cur} c JOIN {ref} r USING ({on})) GROUP BY {ks}feature"""


def status(v):
    return f"CASE WHEN {v} IS NULL THEN 'amostra_insuficiente' WHEN {v} < 0.1 THEN 'estavel' WHEN {v} <= 0.25 THEN 'atencao' ELSE 'alerta' END"


def rank(s):
    return f"CASE {s} WHEN 'estavel' THEN 1 WHEN 'atencao' THEN 2 WHEN 'alerta' THEN 3 ELSE 0 END"


DRIFT_CTES = {
    "preds": """
  SELECT * REPLACE (""" + ", ".join(f"CAST(printf('%.5e', CAST({c} AS DOUBLE)) AS DOUBLE) AS {c}" for c in K.FEATURES) + """), id_fluxo AS fluxo_id, CASE WHEN perdas_consecutivas >= 2 THEN 'FALHA' WHEN perda_media_w3 > 0 THEN 'RISCO' ELSE 'OK' END AS classe_prevista,
    alvo AS rotulo_real FROM final""",
    "ref_rows": "SELECT * FROM preds WHERE split IN ('treino', 'validacao')",
    "ref_long": _long("ref_rows", []),
    "ref_edges": f"SELECT feature, list_sort(list_distinct(quantile_cont(valor, {QS}))) AS bordas FROM ref_long GROUP BY feature",
    "ref_props": _props("ref_long", "ref_edges", []),
    "ref_floored": """
  SELECT feature, b, greatest(p, 1e-6) / sum(greatest(p, 1e-6)) OVER (PARTITION BY feature) AS p FROM ref_props""",
    "tagged_rows": f"""
  SELECT *, '24h' AS janela, 'corrente' AS papel FROM preds WHERE timestamp >= {END - 24 * 3600} AND timestamp < {END}
  UNION ALL SELECT *, '7d', 'corrente' FROM preds WHERE timestamp >= {END - 168 * 3600} AND timestamp < {END}
  UNION ALL SELECT *, '24h', 'equivalente' FROM preds WHERE timestamp >= {END - 7 * 86400 - 24 * 3600} AND timestamp < {END - 7 * 86400}
  UNION ALL SELECT *, '7d', 'equivalente' FROM preds WHERE timestamp >= {END - 7 * 86400 - 168 * 3600} AND timestamp < {END - 7 * 86400}""",
    "cur_long": _long("(SELECT * FROM tagged_rows WHERE papel = 'corrente')", ["janela"]),
    "cur_props": _props("cur_long", "ref_edges", ["janela"]),
    "cur_psi": _psi("cur_props", "ref_floored", ["janela"]),
    "eq_long": _long("(SELECT * FROM tagged_rows WHERE papel = 'equivalente')", ["janela"]),
    "eq_edges": f"SELECT janela, feature, list_sort(list_distinct(quantile_cont(valor, {QS}))) AS bordas FROM eq_long GROUP BY ALL",
    "eq_props": _props("eq_long", "eq_edges", ["janela"], "janela, feature"),
    "now_props": _props("cur_long", "eq_edges", ["janela"], "janela, feature"),
    "season_psi": _psi("now_props", "eq_props", ["janela"], "janela, feature, b"),
    "slice_rows": """
  SELECT *, CASE WHEN razao_rtt_p95 = -1 THEN 'sem_rtt' WHEN razao_rtt_p95 < 0.8 THEN 'abaixo' WHEN razao_rtt_p95 <= 1.2 THEN 'tipica' ELSE 'alta' END AS faixa
  FROM tagged_rows WHERE papel = 'corrente'""",
    "sliced_long": _long("""(SELECT *, 'anchor' AS tipo, anchor_id::VARCHAR AS chave FROM slice_rows
    UNION ALL SELECT s.*, 'continente', coalesce(a.continente, 'desconhecido') FROM slice_rows s LEFT JOIN (
      SELECT anchor_id, c.continent AS continente FROM anchor_dim JOIN country_dim c USING (country) WHERE anchor_id <> 0) a USING (anchor_id)
    UNION ALL SELECT *, 'faixa_rtt', faixa FROM slice_rows)""", ["janela", "tipo", "chave"]),
    "slice_props": _props("sliced_long", "ref_edges", ["janela", "tipo", "chave"]),
    "slice_psi": _psi("slice_props", "ref_floored", ["janela", "tipo", "chave"]),
    "performance": """
  SELECT janela, n, (2.0 * t0 / nullif(s0 + c0, 0) + coalesce(2.0 * t1 / nullif(s1 + c1, 0), 0) + coalesce(2.0 * t2 / nullif(s2 + c2, 0), 0)) / 3 AS macro_f1,
    coalesce(t2 / nullif(s2, 0), 0) AS recall_falha FROM (SELECT janela, count(*) AS n,
    count(*) FILTER (rotulo_real = 'OK' AND classe_prevista = 'OK') AS t0, count(*) FILTER (rotulo_real = 'OK') AS s0, count(*) FILTER (classe_prevista = 'OK') AS c0,
    count(*) FILTER (rotulo_real = 'RISCO' AND classe_prevista = 'RISCO') AS t1, count(*) FILTER (rotulo_real = 'RISCO') AS s1, count(*) FILTER (classe_prevista = 'RISCO') AS c1,
    count(*) FILTER (rotulo_real = 'FALHA' AND classe_prevista = 'FALHA') AS t2, count(*) FILTER (rotulo_real = 'FALHA') AS s2, count(*) FILTER (classe_prevista = 'FALHA') AS c2
    FROM tagged_rows WHERE papel = 'corrente' GROUP BY janela)""",
}
JS = " + ".join(
    f"(CASE WHEN r.p{i} > 0 THEN r.p{i} * log2(r.p{i} / ((r.p{i} + c.p{i}) / 2)) ELSE 0 END + CASE WHEN c.p{i} > 0 THEN c.p{i} * log2(c.p{i} / ((r.p{i} + c.p{i}) / 2)) ELSE 0 END) / 2"
    for i in range(3))
MIX = ", ".join(f"avg((classe_prevista = '{c}')::INTEGER) AS p{i}" for i, c in enumerate(K.CLASSES))
DRIFT_CTES["mix"] = f"""
  SELECT janela, n, js, CASE WHEN n < 30 THEN 'amostra_insuficiente' WHEN js >= 0.1 THEN 'alerta' WHEN js >= 0.05 THEN 'atencao' ELSE 'estavel' END AS status
  FROM (SELECT c.janela, c.n, {JS} AS js FROM (SELECT janela, count(*) AS n, {MIX} FROM tagged_rows WHERE papel = 'corrente' GROUP BY janela) c, (SELECT {MIX} FROM ref_rows) r)"""


class Drift:
    """The drift inputs of one folder: stored predictions and the stored reference."""

    _MADE: dict = {}

    def __new__(cls, spark, sf):
        key = (spark.sparkContext.applicationId, sf)
        if key not in cls._MADE:
            made = super().__new__(cls)
            made.spark, made.sf = spark, sf
            cls._MADE[key] = made
        return cls._MADE[key]

    @cached_property
    def preds(self):
        final = rule_forecast(self.spark, self.sf).withColumnRenamed("previsto", "classe_prevista")
        return materialise(final.withColumns({
            "fluxo_id": F.col("id_fluxo"), "rotulo_real": F.col("alvo")}), "predictions")

    @cached_property
    def ref(self):
        # one row per feature
        return materialise(drift.reference(self.preds, ["id_fluxo", "timestamp"]), "reference")

    @cached_property
    def features(self):
        # one row per window and feature, read by the alerts and the status row
        windows = self.windows
        return materialise(drift.seasonal_block(windows, drift.feature_block(windows, self.ref)), "drift-features")

    @property
    def continents(self):
        return adapter.anchors(self.spark, self.sf).where("anchor_id <> 0").join(
            adapter.countries(self.spark, self.sf).select("country", F.col("continent").alias("continente")), "country"
        ).select("anchor_id", "continente")

    @property
    def ref_props(self):
        rows = self.preds.where(F.col("split").isin("treino", "validacao"))
        return rows.agg(*metrics.proportions("classe_prevista"))

    @property
    def windows(self):
        return drift.tagged_windows(self.preds, END)


def text(array, digits=6):
    return F.array_join(F.transform(array, lambda x: F.format_string(f"%.{digits}f", x)), ",")


@register("d12_reference", """
SELECT e.feature, l.n AS n_ref, 0.0::DOUBLE AS taxa_nulos_ref, round(l.s, 6) AS taxa_sentinela_ref,
  array_to_string(list_transform(bordas, lambda x: printf('%.9f', x)), ',') AS bordas,
  (SELECT string_agg(printf('%.6f', p), ',' ORDER BY b) FROM ref_props p WHERE p.feature = e.feature) AS proporcao
FROM ref_edges e JOIN (SELECT feature, count(*) AS n, avg((valor = -1)::INTEGER) AS s FROM ref_long GROUP BY feature) l USING (feature)""", DRIFT_CTES)
def d12_reference(spark, sf):
    return rounded(Drift(spark, sf).ref).withColumns({"bordas": text(F.col("bordas"), 9), "proporcao": text(F.col("proporcao"))})


@register("d6_feature_block", f"""
SELECT janela, feature, n, round(psi, 6) AS psi, 0.0::DOUBLE AS taxa_nulos, CASE WHEN n < 30 THEN 'amostra_insuficiente' ELSE {status('psi')} END AS status_psi,
  CASE WHEN n < 30 THEN 'amostra_insuficiente' ELSE 'estavel' END AS status_qualidade FROM cur_psi""", DRIFT_CTES)
def d6_feature_block(spark, sf):
    d = Drift(spark, sf)
    out = drift.feature_block(d.windows, d.ref)
    return rounded(out.select("janela", "feature", "n", "psi", "taxa_nulos", "status_psi", "status_qualidade"))


@register("d1_psi_raw", "SELECT janela, feature, round(psi, 6) AS psi FROM season_psi", DRIFT_CTES)
def d1_psi_raw(spark, sf):
    long = drift.unpivot(Drift(spark, sf).windows, ["janela", "papel"])
    return rounded(drift.psi_between(
        long.where("papel = 'equivalente'").drop("papel"), long.where("papel = 'corrente'").drop("papel"), ["janela"]))


# both distribution functions at every value, over all reference rows; then the largest gap
KS_CTES = {**DRIFT_CTES, "ks_ref": _long("ref_rows", []), "ks_gap": """
  SELECT feature, max(na) AS na, max(nb) AS nb, max(abs(fa - fb)) AS d FROM (
    SELECT feature, sum(a) OVER p AS na, sum(b) OVER p AS nb, sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb
    FROM (SELECT feature, valor, sum(a) AS a, sum(b) AS b FROM (
      SELECT feature, valor, 1 AS a, 0 AS b FROM ks_ref UNION ALL SELECT feature, valor, 0, 1 FROM cur_long WHERE janela = '7d') GROUP BY ALL)
    WINDOW w AS (PARTITION BY feature ORDER BY valor), p AS (PARTITION BY feature)) GROUP BY feature"""}


def ks_rows(spark, sf):
    d = Drift(spark, sf)
    ref = drift.unpivot(d.preds.where(F.col("split").isin("treino", "validacao")), [])
    cur = drift.unpivot(drift.trailing(d.preds, END, 168), [])
    return rounded(drift.ks(ref, cur, ["feature"]))


@register("d3_ks", "SELECT feature, round(d, 6) AS ks FROM ks_gap", KS_CTES)
def d3_ks(spark, sf):
    return ks_rows(spark, sf).select("feature", "ks")


@register("d3_ks_p_values", """
SELECT feature, round(d, 6) AS ks, round(CASE WHEN d = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(
  [CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * (na * nb / (na + nb)) * d * d) for k in range(1, 101)]))) END, 6) AS ks_p
FROM (SELECT feature, d, na::DOUBLE AS na, nb::DOUBLE AS nb FROM ks_gap)""", KS_CTES)
def d3_ks_p_values(spark, sf):
    return ks_rows(spark, sf)


CHI = " + ".join(f"pow(c.k{i} - greatest(r.k{i} / r.t * c.t, 1e-6), 2) / greatest(r.k{i} / r.t * c.t, 1e-6)" for i in range(3))
KS3 = ", ".join(f"count(*) FILTER (classe_prevista = '{c}')::DOUBLE AS k{i}" for i, c in enumerate(K.CLASSES))


@register("d4_chi_square", f"""
SELECT janela, round(x, 6) AS qui2, round(exp(-x / 2), 6) AS p FROM (SELECT janela, {CHI} AS x FROM (
  SELECT janela, count(*)::DOUBLE AS t, {KS3} FROM tagged_rows WHERE papel = 'corrente' GROUP BY janela) c, (SELECT count(*)::DOUBLE AS t, {KS3} FROM ref_rows) r)""", DRIFT_CTES)
def d4_chi_square(spark, sf):
    d = Drift(spark, sf)
    counts = [F.count_if(F.col("classe_prevista") == c).cast("double").alias(f"c{i}") for i, c in enumerate(K.CLASSES)]
    ref = d.preds.where(F.col("split").isin("treino", "validacao")).agg(*counts)
    cur = d.windows.where("papel = 'corrente'").groupBy("janela").agg(*counts)
    rows = cur.withColumns({f"r{i}": ref.select(f"c{i}").scalar() for i in range(3)})
    stat, p = drift.chi_square([F.col(f"r{i}") for i in range(3)], [F.col(f"c{i}") for i in range(3)])
    return rounded(rows.select("janela", stat.alias("qui2"), p.alias("p")))


@register("d8_prediction_block", "SELECT janela, n, round(js, 6) AS js, status FROM mix", DRIFT_CTES)
def d8_prediction_block(spark, sf):
    d = Drift(spark, sf)
    return rounded(drift.prediction_block(d.windows, d.ref_props).select("janela", "n", "js", "status"))


@register("d9_performance_block", """
SELECT janela, n, round(macro_f1, 6) AS macro_f1, round(recall_falha, 6) AS recall_falha,
  CASE WHEN n < 30 THEN 'amostra_insuficiente' WHEN macro_f1 < 0.6 OR recall_falha < 0.5 THEN 'alerta' ELSE 'estavel' END AS status FROM performance""", DRIFT_CTES)
def d9_performance_block(spark, sf):
    return rounded(drift.performance_block(Drift(spark, sf).windows))


SEASON = f"""
SELECT c.janela, c.feature, c.psi, c.n, CASE WHEN c.n >= 30 AND ne >= 30 THEN s.psi END AS psi_sazonal,
  CASE WHEN c.n < 30 THEN 'amostra_insuficiente' ELSE {status('c.psi')} END AS st, CASE WHEN c.n >= 30 AND ne >= 30 THEN {status('s.psi')} END AS ss
FROM cur_psi c LEFT JOIN season_psi s USING (janela, feature) JOIN (
  SELECT janela, count(*) FILTER (papel = 'equivalente') AS ne FROM tagged_rows GROUP BY janela) w USING (janela)"""
DRIFT_CTES["season"] = SEASON
FINAL_STATUS = "CASE WHEN ss = 'estavel' AND st IN ('atencao', 'alerta') THEN 'estavel' ELSE st END"


@register("d10_seasonal", f"""
SELECT janela, feature, round(psi_sazonal, 6) AS psi_sazonal, ss AS status_sazonal, st AS status_psi, {FINAL_STATUS} AS status_final FROM season""", DRIFT_CTES)
def d10_seasonal(spark, sf):
    d = Drift(spark, sf)
    windows = d.windows
    out = drift.seasonal_block(windows, drift.feature_block(windows, d.ref))
    return rounded(out.select("janela", "feature", "psi_sazonal", "status_sazonal", "status_psi", "status_final"))


SLICE_STATUS = f"""SELECT janela, tipo, chave, max(n) AS n, CASE WHEN max(n) < 30 THEN 'amostra_insuficiente' ELSE
  ['amostra_insuficiente', 'estavel', 'atencao', 'alerta'][max({rank(status('psi'))}) + 1] END AS status FROM slice_psi GROUP BY ALL"""


@register("g22_drift_slices", SLICE_STATUS, DRIFT_CTES)
def g22_drift_slices(spark, sf):
    d = Drift(spark, sf)
    return drift.slice_block(d.windows, d.ref, d.continents)


ROUTES = """SELECT id_fluxo AS fluxo_id, count(*) AS n, quantile_cont(razao_rtt_p95, 0.5) AS razao_mediana, quantile_cont(perda_pct, 0.5) AS perda_mediana,
  'mudanca_de_rota_provavel' AS status FROM preds GROUP BY id_fluxo HAVING count(*) >= 30 AND quantile_cont(razao_rtt_p95, 0.5) > {} AND quantile_cont(perda_pct, 0.5) < 5"""


@register("g23_route_changes", "SELECT fluxo_id, n, round(razao_mediana, 9) AS razao_mediana, perda_mediana, status FROM (" + ROUTES.format(0.25) + ")", DRIFT_CTES)
def g23_route_changes(spark, sf):
    # a low ratio limit, since no derived flow shifts its route
    return rounded(drift.route_changes(Drift(spark, sf).preds, ratio_limit=0.25), 9)


@register("d11_report", f"""
SELECT janela, 'data_drift' AS bloco, feature AS chave, n, round(psi, 6) AS valor, {FINAL_STATUS} AS status FROM season
UNION ALL SELECT janela, 'qualidade_dados', feature, n, 0.0, CASE WHEN n < 30 THEN 'amostra_insuficiente' ELSE 'estavel' END FROM season
UNION ALL SELECT janela, 'predicao', 'classes', n, round(js, 6), status FROM mix
UNION ALL SELECT janela, 'desempenho', 'macro_f1', n, round(macro_f1, 6), CASE WHEN n < 30 THEN 'amostra_insuficiente' WHEN macro_f1 < 0.6 OR recall_falha < 0.5 THEN 'alerta' ELSE 'estavel' END FROM performance
UNION ALL SELECT janela, 'fatia', tipo || ':' || chave, n, NULL, status FROM ({SLICE_STATUS})
UNION ALL SELECT 'tudo', 'rota', fluxo_id, n, round(razao_mediana, 6), status FROM ({ROUTES.format(1.5)})""", DRIFT_CTES)
def d11_report(spark, sf):
    d = Drift(spark, sf)
    return rounded(drift.report(d.preds, d.ref, d.ref_props, END, d.continents))


@register("p18_trailing_window", f"""
SELECT id_fluxo, timestamp FROM preds WHERE timestamp >= {END - 168 * 3600} AND timestamp < {END}
  AND strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') NOT IN ('2024-01-25', '2024-01-28')""", DRIFT_CTES)
def p18_trailing_window(spark, sf):
    return drift.trailing(Drift(spark, sf).preds, END, 168, HOLIDAYS).select("id_fluxo", "timestamp")


@register("j14_week_pairs", """
SELECT janela, count(*) FILTER (papel = 'corrente') AS n_corrente, count(*) FILTER (papel = 'equivalente') AS n_equivalente FROM tagged_rows GROUP BY janela""", DRIFT_CTES)
def j14_week_pairs(spark, sf):
    return Drift(spark, sf).windows.groupBy("janela").agg(
        F.count_if(F.col("papel") == "corrente").alias("n_corrente"), F.count_if(F.col("papel") == "equivalente").alias("n_equivalente"))


CALIB = {**DRIFT_CTES,
    "all_long": _long("ref_rows", ["id_fluxo"]),
    "members": """
  SELECT id_fluxo, bloco FROM (SELECT *, row_number() OVER (PARTITION BY bloco ORDER BY md5(concat_ws('|', '42', bloco::VARCHAR, id_fluxo)), id_fluxo) AS r
    FROM (SELECT DISTINCT id_fluxo, unnest(range(1, 31)) AS bloco FROM ref_rows)) WHERE r <= 8""",
    "block_long": "SELECT bloco, feature, valor FROM all_long JOIN members USING (id_fluxo)",
    "block_props": _props("block_long", "ref_edges", ["bloco"]),
    "block_psi": _psi("block_props", "ref_props", ["bloco"]),
    "calib": "SELECT feature, count(*) AS blocos, quantile_cont(psi, 0.5) AS mediana, quantile_cont(psi, 0.95) AS p95 FROM block_psi GROUP BY feature",
}


@register("d13_calibration", "SELECT feature, blocos, round(mediana, 6) AS mediana, round(p95, 6) AS p95 FROM calib", CALIB)
def d13_calibration(spark, sf):
    d = Drift(spark, sf)
    rows = d.preds.where(F.col("split").isin("treino", "validacao"))
    return rounded(drift.calibration(rows, d.ref.select("feature", "bordas")))


@register("d13_calibration_advice", """
SELECT round(quantile_cont(p95, 0.5), 6) AS sugestao_atencao, round(greatest(0.25, 2 * quantile_cont(p95, 0.5)), 6) AS sugestao_alerta FROM calib""", CALIB)
def d13_calibration_advice(spark, sf):
    d = Drift(spark, sf)
    rows = d.preds.where(F.col("split").isin("treino", "validacao"))
    return rounded(drift.calibration_advice(drift.calibration(rows, d.ref.select("feature", "bordas"))))
