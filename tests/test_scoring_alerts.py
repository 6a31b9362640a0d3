import pytest
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope import schemas
from rttscope.operators import alerts, metrics, picks, scoring, selection


def log_row(spark, **kw):
    base = {
        "run_id": "r1", "ts_previsao": "2024-01-01T00:00:00Z", "fluxo_id": "1_2", "anchor_id": 2, "modelo_versao": "v",
        "modelo_hash": "sha256:h", "features": {n: 0.0 for n in K.FEATURES}, "proba": {"OK": 0.6, "RISCO": 0.3, "FALHA": 0.1},
        "classe_prevista": "OK", "classe_atual": "OK", "latencia_inferencia_ms": 1, "rotulo_real": None, "ts_rotulo": None,
    }
    base.update(kw)
    return tuple(base[f] for f in K.LOG_FIELDS)


def logs(spark, *rows):
    return spark.createDataFrame([log_row(spark, **r) for r in rows], schemas.PREDICTION)


def test_contract_accepts_and_quarantines(spark):
    df = logs(spark, {}, {"run_id": "r2", "proba": {"OK": 0.9, "RISCO": 0.3, "FALHA": 0.1}}, {"run_id": "r3", "classe_prevista": "X"},
              {"run_id": "r4", "features": {"perda_pct": 1.0}}, {"run_id": "r5", "proba": {"OK": 1.0}}, {})
    good, bad = scoring.accept(df)
    assert [r.run_id for r in good.collect()] == ["r1"]
    assert {r.run_id: r.motivos for r in bad.collect()} == {
        "r2": "proba nao soma 1", "r3": "classe invalida", "r4": "feature ausente", "r5": "proba nao soma 1"}
    again, _ = scoring.accept(df, good)
    assert again.count() == 0


def test_late_label_fills_once(spark):
    df = logs(spark, {}, {"run_id": "r2", "rotulo_real": "FALHA"}, {"run_id": "r3"})
    labels = spark.createDataFrame([
        ("r1", "1_2", "2024-01-01T00:00:00Z", "RISCO", "t2"), ("r1", "1_2", "2024-01-01T00:00:00Z", "OK", "t1"),
        ("r2", "1_2", "2024-01-01T00:00:00Z", "OK", "t1"), ("r3", "1_2", "2024-01-01T00:00:00Z", "NADA", "t1"),
        ("r9", "1_2", "2024-01-01T00:00:00Z", "OK", "t1")], "run_id string, fluxo_id string, ts_previsao string, rotulo string, ts string")
    got = {r.run_id: (r.rotulo_real, r.ts_rotulo) for r in scoring.attach_labels(df, labels).collect()}
    assert got == {"r1": ("OK", "t1"), "r2": ("FALHA", None), "r3": (None, None)}


def test_audit_verdicts(spark):
    ok = {"rotulo_real": "OK"}
    assert scoring.audit(logs(spark, ok)).first().veredito == "PASSOU"
    assert scoring.audit(logs(spark, {})).first().veredito == "ATENCAO"
    assert scoring.audit(logs(spark, ok, ok)).first().veredito == "FALHOU"
    assert scoring.audit(logs(spark, ok).where("false")).first().veredito == "ATENCAO"


def test_verdict_and_gate(spark):
    s = spark.createDataFrame([("geral", "calculado", 0.8, 0.7, 0.05), ("transicoes", "calculado", 0.3, 0.2, None)],
                              "fatia string, status string, macro_f1 double, recall_falha double, ganho double")
    floors = {"macro_f1_transicoes": 0.25, "recall_falha": 0.5, "ganho_sobre_persistencia": 0.03}
    assert scoring.verdict(s, floors, other_slices_ok=True).first().veredito == "PASSOU"
    assert scoring.verdict(s, floors).first().veredito == "ATENCAO"
    assert scoring.verdict(s, {**floors, "recall_falha": 0.9}).first().veredito == "FALHOU"
    assert scoring.verdict(s, {**floors, "recall_falha": None}).first().veredito == "INCONCLUSIVO"
    small = s.withColumn("status", F.when(F.col("fatia") == "geral", "INCONCLUSIVO").otherwise("calculado"))
    assert scoring.verdict(small, floors, other_slices_ok=True).first().veredito == "ATENCAO"
    c = spark.createDataFrame([("a", 1.0), ("b", 0.1)], "metrica string, valor double")
    f = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("z", 0.1)], "metrica string, piso double")
    assert tuple(scoring.gate(c, f).first()) == (False, "b,z")
    assert tuple(scoring.gate(c, f.where("metrica = 'a'")).first()) == (True, "")
    assert scoring.gate(c, f.where("metrica = 'a'"), new_test_set=False).first().promove is False


@pytest.mark.parametrize("scores,expected", [
    ([0.9, 0.5, 0.5, 0.5], True), ([0.5, 0.5, 0.7], False), ([0.5, 0.5], False), ([0.5, None, 0.5], False)])
def test_three_low_windows(spark, scores, expected):
    df = spark.createDataFrame([(i, s, "calculado") for i, s in enumerate(scores)], "dia int, macro_f1 double, status string")
    assert alerts.low_runs(df, "dia").first().abaixo is expected
    assert (alerts.performance_alerts(df, "dia", "2024-01-01T00:00:00Z").count() == 1) is expected


def test_insufficient_window_breaks_the_run(spark):
    df = spark.createDataFrame([(0, 0.1, "calculado"), (1, 0.1, "amostra_insuficiente"), (2, 0.1, "calculado")],
                               "dia int, macro_f1 double, status string")
    assert alerts.low_runs(df, "dia").first().abaixo is False


def test_cooldown(spark):
    new = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c"), ("r", "d")], "regra string, chave string")
    old = spark.createDataFrame([("r", "a", "2024-01-01T20:00:00Z", "aberto"), ("r", "b", "2023-12-30T00:00:00Z", "aberto"),
                                 ("r", "c", "2024-01-01T20:00:00Z", "resolvido")], "regra string, chave string, ts string, status string")
    got = {r.chave for r in alerts.outside_cooldown(new, old, "2024-01-02T00:00:00Z").collect()}
    assert got == {"b", "c", "d"}


def test_metric_conventions(spark):
    df = spark.createDataFrame([("OK", "OK"), ("OK", "RISCO"), ("RISCO", "RISCO")], "alvo string, previsto string")
    wide = metrics.confusion(df, [])
    skip, zero = metrics.scores(wide, "skip").first(), metrics.scores(wide, "zero").first()
    assert skip.f1_FALHA is None and skip.macro_f1 == pytest.approx(2 / 3)
    assert zero.f1_FALHA == 0 and zero.macro_f1 == pytest.approx(4 / 9)
    assert zero.acuracia == pytest.approx(2 / 3)


def test_dominant_anchor_tie_takes_smallest_text_id(spark):
    df = spark.createDataFrame([(10, "FALHA"), (9, "FALHA"), (9, "OK")], "anchor_id long, alvo string")
    row = metrics.dominant_anchor(df, []).first()
    assert (row.anchor_dominante, row.fracao_dominante) == ("10", 0.5)


def test_single_owner_rules(spark):
    m = spark.createDataFrame([(1, 5, False), (1, 7, True), (2, 9, True), (2, 4, True), (3, 8, False), (3, 6, False)],
                              "msm_id long, a_id long, por_nome boolean")
    assert {r.msm_id: r.a_id for r in selection.single_owner(m).collect()} == {1: 7, 2: 4, 3: 6}


def test_probe_pick_sizes(spark):
    rows = [(a, p, p % 3, "curta", "X", f"C{p % 4}", False, 1, 1.0) for a, n in ((1, 2), (2, 4), (3, 9)) for p in range(n)]
    df = spark.createDataFrame(rows, "anchor_id long, probe_id long, asn_v4 long, distance_band string, continent string,"
                               "country string, is_anchor boolean, measurement_id long, distancia_km double").withColumn("coords", F.lit(1))
    got = selection.pick_probes(df).collect()
    sizes = {a: len({r.probe_id for r in got if r.anchor_id == a}) for a in (1, 2, 3)}
    assert sizes == {1: 1, 2: 4, 3: 5} and all(r.poucas_origens == (r.anchor_id == 1) for r in got)
    # a new ASN is preferred while one is left
    first = sorted((r.ordem, r.asn_v4) for r in got if r.anchor_id == 3)[:3]
    assert len({asn for _, asn in first}) == 3


def test_transition_run_across_chunks(spark):
    classes = ["OK", "RISCO", "OK", "FALHA", "OK", "OK", "OK", "OK", "OK"]
    df = spark.createDataFrame([("f", i * 50_000, 1, c) for i, c in enumerate(classes)],
                               "id_fluxo string, timestamp long, msm_id long, classe string")
    assert picks.transition_runs(df, ["id_fluxo"]).first().posicao == 1
    assert picks.transition_runs(df.where("classe <> 'RISCO'"), ["id_fluxo"]).count() == 0
