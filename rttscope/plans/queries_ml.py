"""Queries of the model steps; values depend on the fitted models, so most are rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators import metrics, models, picks, saved_models, scoring
from rttscope.plans.bayes_sql import NB, NB_IMPORTANCE
from rttscope.plans.catalog import register, rounded, stages
from rttscope.plans.queries_eval import SLICE_CTES, confusion_sql, rule_forecast, scores_sql
from rttscope.session import materialise, work_path


def published(spark, sf):
    return stages(spark, sf).published


def _fit(spark, sf, family="arvore_decisao", **params):
    rows = models.vectors(published(spark, sf).where("split = 'treino'"))
    point = {"max_depth": 5, "min_samples_leaf": 20, "class_weight": None, **params}
    return models.build(family, point).fit(models.weighted(rows, point["class_weight"]))


NB_GRID = {
    **NB,
    "nb_points": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {p['params']['var_smoothing']!r}::DOUBLE, '{models.parameter_text(p['params'])}')" for i, p in enumerate(models.candidates(("naive_bayes",)))) + ") t(k, s, texto)",
    "nb_guess": """
  SELECT split, rn, k, any_value(alvo) AS alvo, arg_max(c, j) AS previsto FROM (
    SELECT split, rn, k, any_value(l.alvo) AS alvo, s.c, max(p) + sum(-0.5 * ln(2 * pi() * (v + s * e)) - pow(valor - m, 2) / (2 * (v + s * e))) AS j
    FROM nb_long l JOIN (SELECT c, feature, m, v - (SELECT e FROM nb_extra) AS v FROM nb_stats) s USING (feature) JOIN nb_prior r ON r.c = s.c
      CROSS JOIN nb_points CROSS JOIN (SELECT e * 1e9 AS e FROM nb_extra) WHERE split <> 'teste' GROUP BY split, rn, k, s.c) GROUP BY split, rn, k""",
    "nb_conf": confusion_sql("nb_guess", ["k", "split"], "alvo", "previsto"),
    "nb_scores": scores_sql("nb_conf", ["k", "split"], "skip", 15),
}


@register("m3_grid_naive_bayes", """
SELECT k AS candidato, 'naive_bayes' AS familia, texto AS hiperparametros, k AS ordem, 0 AS simplicidade, 0 AS profundidade, 0 AS arvores, NULL::INTEGER AS max_bins,
  round(t.macro_f1, 6) AS macro_f1_treino, round(v.macro_f1, 6) AS macro_f1_validacao, round(v.f1_FALHA, 6) AS f1_falha_validacao,
  round(v.recall_FALHA, 6) AS recall_falha_validacao, round(t.macro_f1 - v.macro_f1, 6) AS gap
FROM nb_points JOIN (SELECT * FROM nb_scores WHERE split = 'treino') t USING (k) JOIN (SELECT * FROM nb_scores WHERE split = 'validacao') v USING (k)""", NB_GRID)
def m3_grid_naive_bayes(spark, sf):
    return rounded(stages(spark, sf).grid("naive_bayes"))


@register("m2_gaussian_nb", """
SELECT id_fluxo, timestamp, arg_max(c, j) AS previsto FROM (
  SELECT id_fluxo, timestamp, rn, s.c, max(p) + sum(-0.5 * ln(2 * pi() * v) - pow(valor - m, 2) / (2 * v)) AS j
  FROM nb_long JOIN nb_stats s USING (feature) JOIN nb_prior r ON r.c = s.c WHERE split = 'validacao' GROUP BY ALL) GROUP BY id_fluxo, timestamp, rn""", NB)
def m2_gaussian_nb(spark, sf):
    rows = published(spark, sf)
    stats = models.GaussianNB.statistics(rows.where("split = 'treino'"))
    model = models.GaussianNB(stats, 1e-9, K.FEATURES)
    return models.predicted(model, rows.where("split = 'validacao'")).select("id_fluxo", "timestamp", "previsto")


@register("m3_grid_tree")
def m3_grid_tree(spark, sf):
    return rounded(stages(spark, sf).grid("arvore_decisao"))


@register("m2_random_forest")
def m2_random_forest(spark, sf):
    """All 24 forests of the grid."""
    return rounded(stages(spark, sf).grid("random_forest"))


@register("k11_winner")
def k11_winner(spark, sf):
    return rounded(models.winner(stages(spark, sf).grid(*K.FAMILIES)))


@register("m4_time_order", """
SELECT caso, max(timestamp) FILTER (split = 'treino') AS ultimo_treino, min(timestamp) FILTER (split = 'validacao') AS primeira_validacao, count(*) FILTER (split = 'teste') AS linhas_teste,
  caso <> 'invertido' AS em_ordem, caso = 'ajuste' AS permitido FROM (
  SELECT 'ajuste' AS caso, timestamp, split FROM final WHERE split <> 'teste' UNION ALL SELECT 'com_teste', timestamp, split FROM final
  UNION ALL SELECT 'invertido', timestamp, CASE split WHEN 'treino' THEN 'validacao' ELSE 'treino' END FROM final WHERE split <> 'teste') GROUP BY caso""")
def m4_time_order(spark, sf):
    """What a fit may see: the rows as they are fitted, with test rows, and with the two splits changed over."""
    rows = stages(spark, sf).final.select("timestamp", "split")
    fit = rows.where("split <> 'teste'")
    swapped = fit.withColumn("split", F.when(F.col("split") == "treino", "validacao").otherwise("treino"))
    cases = [models.time_order(df).withColumn("caso", F.lit(name)) for name, df in (("ajuste", fit), ("com_teste", rows), ("invertido", swapped))]
    return cases[0].unionByName(cases[1]).unionByName(cases[2])


@register("m5_test_evaluation")
def m5_test_evaluation(spark, sf):
    out = models.evaluate_test(stages(spark, sf).model, published(spark, sf))
    return rounded(out.select("split", "fatia", "n", "macro_f1", "macro_f1_persistencia", "ganho", "recall_falha", "acuracia"))


@register("m1_persistence", "SELECT id_fluxo, timestamp, classe_atual AS previsto FROM final")
def m1_persistence(spark, sf):
    return stages(spark, sf).final.select("id_fluxo", "timestamp", F.col("classe_atual").alias("previsto"))


@register("m6_tree_nodes")
def m6_tree_nodes(spark, sf):
    rows = published(spark, sf).where("split = 'treino'")
    return rounded(models.node_table(_fit(spark, sf, max_depth=3, min_samples_leaf=1), rows))


@register("m6_purest_leaf")
def m6_purest_leaf(spark, sf):
    rows = published(spark, sf).where("split = 'treino'")
    return rounded(models.purest_leaf(models.node_table(_fit(spark, sf, max_depth=3, min_samples_leaf=1), rows)))


@register("v8_tree_checks", """
SELECT count(*) FILTER (split = 'treino')::BIGINT AS linhas_nas_folhas, count(*) FILTER (split = 'treino' AND alvo = 'FALHA')::BIGINT AS falhas_nas_folhas,
  count(*) FILTER (split = 'treino')::BIGINT AS linhas_na_raiz, true AS profundidade_ok, true AS folhas_somam, true AS features_ok FROM final""")
def v8_tree_checks(spark, sf):
    rows = published(spark, sf).where("split = 'treino'")
    nodes = materialise(models.node_table(_fit(spark, sf, max_depth=3, min_samples_leaf=1), rows), "tree-nodes")
    leaves = nodes.agg(
        F.sum(F.when(F.col("folha"), F.col("linhas"))).alias("linhas_nas_folhas"), F.sum(F.when(F.col("folha"), F.col("n_FALHA"))).alias("falhas_nas_folhas"),
        F.max(F.when(F.col("no") == 0, F.col("linhas"))).alias("linhas_na_raiz"))
    return leaves.join(models.tree_checks(nodes, rows.count(), 3))  # one row each


def _flags(forecasts):
    """Flags of the validation and of the test split for rows with a forecast, in one table."""
    keys = ["split", "fatia"]
    mine = metrics.sliced_scores(forecasts, ["split"])
    base = metrics.sliced_scores(forecasts.withColumn("previsto", F.col("classe_atual")), ["split"])
    table = materialise(metrics.gain(mine, base, keys).select(*keys, "macro_f1", F.col("recall_FALHA").alias("recall_falha"), "ganho"), "slice-metrics")
    general = lambda split: table.where((F.col("split") == split) & (F.col("fatia") == "geral")).select("macro_f1").scalar()
    share = metrics.dominant_anchor(forecasts.where("split = 'validacao'"), []).select("fracao_dominante").scalar()
    valid = table.where("split = 'validacao'").withColumns({"macro_f1_treino": general("treino"), "fracao_dominante": share})
    valid = metrics.metric_flags(valid.withColumn("gap", F.col("macro_f1_treino") - F.col("macro_f1")))
    test = metrics.test_flags(table.where("split = 'teste'").withColumn("macro_f1_validacao", general("validacao")))
    return valid.unionByName(test, allowMissingColumns=True)


FLAG_CTES = {
    **SLICE_CTES, "rule_scores": scores_sql("trend_conf", ["split", "fatia"], "skip", 15), "base_scores": scores_sql("sliced_conf", ["split", "fatia"], "skip", 15),
    "flag_rows": """
  SELECT m.split, m.fatia, m.macro_f1, m.recall_FALHA AS recall_falha, CASE WHEN m.fatia <> 'transicoes' THEN m.macro_f1 - b.macro_f1 END AS ganho,
    max(m.macro_f1) FILTER (m.split = 'treino' AND m.fatia = 'geral') OVER () AS treino, max(m.macro_f1) FILTER (m.split = 'validacao' AND m.fatia = 'geral') OVER () AS validacao,
    (SELECT fracao FROM dominant WHERE split = 'validacao' AND r = 1) AS fracao
  FROM rule_scores m JOIN base_scores b USING (split, fatia)""",
}


@register("m7_rule_flags", f"""
SELECT split, fatia, coalesce(fatia = 'geral' AND treino - macro_f1 > {K.OVERFIT_GAP}, false) AS sobreajuste, coalesce(fatia = 'geral' AND treino < {K.LOW_MACRO_F1} AND macro_f1 < {K.LOW_MACRO_F1}, false) AS fraco,
  coalesce(fatia = 'geral' AND recall_falha < {K.LOW_FAIL_RECALL}, false) AS recall_baixo, coalesce(fatia = 'inicio_falha' AND recall_falha < {K.LOW_ONSET_RECALL}, false) AS inicio_baixo,
  coalesce(fatia = 'geral' AND ganho < {K.SMALL_GAIN}, false) AS ganho_pequeno,
  coalesce(fatia = 'sem_anchor_dominante' AND (coalesce(fracao > {K.DOMINANT_SHARE}, false) OR coalesce(ganho < {K.SMALL_GAIN}, false)), false) AS depende_de_anchor,
  coalesce(fatia <> 'transicoes' AND ganho < 0, false) AS pior_que_persistencia, NULL::BOOLEAN AS queda_no_teste
FROM flag_rows WHERE split = 'validacao'
UNION ALL SELECT split, fatia, NULL, NULL, NULL, coalesce(fatia = 'inicio_falha' AND recall_falha < {K.LOW_ONSET_RECALL}, false), coalesce(fatia = 'geral' AND ganho < {K.SMALL_GAIN}, false),
  NULL, coalesce(fatia <> 'transicoes' AND ganho < 0, false), coalesce(fatia = 'geral' AND validacao - macro_f1 > {K.TEST_DROP}, false) FROM flag_rows WHERE split = 'teste'""", FLAG_CTES)
def m7_rule_flags(spark, sf):
    """The flags of a fixed rule as forecaster, whose metrics SQL can follow."""
    return _flags(rule_forecast(spark, sf)).select(
        "split", "fatia", "sobreajuste", "fraco", "recall_baixo", "inicio_baixo", "ganho_pequeno", "depende_de_anchor", "pior_que_persistencia", "queda_no_teste")


@register("m7_metric_flags")
def m7_metric_flags(spark, sf):
    """The flags of the grid's winner on the validation and the test split."""
    return rounded(_flags(models.predicted(stages(spark, sf).model, models.vectors(published(spark, sf)))))


@register("m8_batch_scoring")
def m8_batch_scoring(spark, sf):
    out = models.score(stages(spark, sf).model, published(spark, sf).where("split = 'teste'"))
    total = F.aggregate(F.map_values("proba"), F.lit(0.0), lambda a, x: a + x)
    each = [F.round(F.col("proba")[c], 6).alias(f"proba_{c}") for c in K.CLASSES]
    return out.select("id_fluxo", "timestamp", "classe_prevista", *each, F.round(total, 6).alias("soma"))


@register("d14_permutation_importance")
def d14_permutation_importance(spark, sf):
    final = published(spark, sf)
    key = ["id_fluxo", "timestamp"]
    sample = materialise(picks.hashed_sample(final.where("split = 'treino'"), 200, key), "sample")
    return rounded(models.permutation_importance(stages(spark, sf).model, sample, key))


@register("d14_importance_bayes", "SELECT feature, round(importancia, 6) + 0.0 AS importancia FROM nb_importance", NB_IMPORTANCE)
def d14_importance_bayes(spark, sf):
    """The importance that the drift alerts use, of the naive Bayes forecaster, whose scores SQL can follow."""
    return stages(spark, sf).importance.select("feature", (F.round("importancia", 6) + 0.0).alias("importancia"))


@register("j16_recorded_vs_rescored", "SELECT id_fluxo, timestamp, timestamp % 50 <> 0 AS igual, true AS mesmo_modelo FROM final")
def j16_recorded_vs_rescored(spark, sf):
    """A tree is stored, its predictions of all rows recorded with its digest, a few changed, and all scored again with the stored files."""
    rows = materialise(published(spark, sf).withColumn("linha", F.monotonically_increasing_id()), "rescore-rows")
    path = work_path(spark, "stored-model")
    digest = saved_models.save(_fit(spark, sf), spark, path)
    scored = saved_models.KINDS["arvore_decisao"].load(path)
    changed = F.when(F.col("timestamp") % 50 == 0, F.when(F.col("previsto") == "OK", "FALHA").otherwise("OK")).otherwise(F.col("previsto"))
    recorded = models.predicted(scored, models.vectors(rows)).select("linha", "id_fluxo", "timestamp", changed.alias("classe_prevista"), F.lit(digest).alias("modelo_hash"))
    recorded = materialise(recorded, "recorded")
    again = saved_models.rescored(spark, path, "arvore_decisao", recorded, rows)
    same = (F.col("modelo_hash") == saved_models.digest(spark, path)).alias("mesmo_modelo")
    return scoring.compare_scores(recorded, again, ("linha",)).select("id_fluxo", "timestamp", "igual", same)
