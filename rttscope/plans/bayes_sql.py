"""SQL of the Gaussian naive Bayes forecaster and of its permutation importance."""

from __future__ import annotations

from rttscope import contract as K
from rttscope.plans.queries_eval import confusion_sql, scores_sql

NB = {
    "pub": "SELECT id_fluxo, timestamp, split, alvo, " + ", ".join(
        f"CAST(printf('%.5e', CAST({c} AS DOUBLE)) AS DOUBLE) AS {c}" for c in K.FEATURES) + " FROM final",
    "nb_long": "SELECT id_fluxo, timestamp, split, alvo, rn, u.feature AS feature, u.valor AS valor FROM (SELECT id_fluxo, timestamp, split, alvo, "
    "rn, unnest([" + ", ".join(f"{{'feature': '{c}', 'valor': {c}}}" for c in K.FEATURES) + "]) AS u FROM (SELECT *, row_number() OVER () AS rn FROM pub))",
    "nb_extra": "SELECT 1e-9::DOUBLE * max(v) AS e FROM (SELECT var_pop(valor) AS v FROM nb_long WHERE split = 'treino' GROUP BY feature)",
    "nb_stats": "SELECT alvo AS c, feature, avg(valor) AS m, var_pop(valor) + (SELECT e FROM nb_extra) AS v FROM nb_long WHERE split = 'treino' GROUP BY ALL",
    "nb_prior": "SELECT alvo AS c, ln(count(*)::DOUBLE / (SELECT count(*) FROM pub WHERE split = 'treino')) AS p FROM pub WHERE split = 'treino' GROUP BY alvo",
}

_TERM = "-0.5 * ln(2 * pi() * v) - pow({x} - m, 2) / (2 * v)"
#: Seeded shuffles of one feature at a time among 200 training rows; a replica's joint density differs in one term.
NB_IMPORTANCE = {
    **NB,
    "imp_sample": "SELECT *, row_number() OVER (ORDER BY id_fluxo, timestamp) AS place FROM (SELECT * FROM pub WHERE split = 'treino' "
    f"ORDER BY md5(concat_ws('|', '{K.SEED}', id_fluxo, timestamp::VARCHAR)), id_fluxo, timestamp LIMIT {K.LEAK_SAMPLE})",
    "imp_long": "SELECT id_fluxo, timestamp, alvo, place, u.feature AS feature, u.valor AS valor FROM (SELECT id_fluxo, timestamp, alvo, place, unnest(["
    + ", ".join(f"{{'feature': '{c}', 'valor': {c}}}" for c in K.FEATURES) + "]) AS u FROM imp_sample)",
    "imp_joint": f"""
  SELECT place, any_value(l.alvo) AS alvo, s.c, max(p) + sum({_TERM.format(x='valor')}) AS j
  FROM imp_long l JOIN nb_stats s USING (feature) JOIN nb_prior r ON r.c = s.c GROUP BY place, s.c""",
    "imp_dealt": f"""
  SELECT feature, r, valor, row_number() OVER (PARTITION BY feature, r ORDER BY md5(concat_ws('|', '{K.SEED}', feature, r::VARCHAR, id_fluxo, timestamp::VARCHAR)), id_fluxo, timestamp) AS place
  FROM imp_long, (VALUES (1), (2), (3)) t(r)""",
    "imp_guess": f"""
  SELECT '_base' AS f, 0 AS r, place, any_value(alvo) AS alvo, arg_max(c, j) AS previsto FROM imp_joint GROUP BY place
  UNION ALL SELECT feature, r, place, any_value(alvo), arg_max(c, j) FROM (
    SELECT l.feature, d.r, l.place, o.alvo, o.c, o.j - ({_TERM.format(x='l.valor')}) + ({_TERM.format(x='d.valor')}) AS j
    FROM imp_long l JOIN imp_dealt d ON d.feature = l.feature AND d.place = l.place JOIN imp_joint o ON o.place = l.place JOIN nb_stats s ON s.feature = l.feature AND s.c = o.c)
  GROUP BY feature, r, place""",
    "imp_conf": confusion_sql("imp_guess", ["f", "r"], "alvo", "previsto"),
    "imp_scores": scores_sql("imp_conf", ["f", "r"], "zero", 15),
    "nb_importance": "SELECT f AS feature, round((SELECT macro_f1 FROM imp_scores WHERE f = '_base') - avg(macro_f1), 9) + 0.0 AS importancia FROM imp_scores WHERE f <> '_base' GROUP BY f",
}
