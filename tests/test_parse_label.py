import statistics

import pytest
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions import geo, label, parse, privacy


def test_malformed_result_texts(spark):
    texts = ["", "null", "{}", "[1]", '[{"rtt":"5"}]', '[{"rtt":true}]', '[{"rtt":5.5},{"x":"*"},{"rtt":null},7]',
             '[{"late":1},{"rtt":2}]', "[{", None, '[{"x":null}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, result string")
    got = {r.i: (r.r, r.t) for r in df.select(
        "i", parse.packet_rtts("result").alias("r"), parse.has_timeout("result").alias("t")).collect()}
    assert [got[i][0] for i in range(6)] == [[]] * 6
    assert got[6] == ([5.5], True) and got[7] == ([2.0], False)
    assert got[8] == ([], False) and got[9] == ([], False) and got[10] == ([], True)


def test_instant_metrics(spark):
    rows = [
        (1, 3, 3, 5.0, 7.0, 6.0, '[{"rtt":5},{"rtt":6},{"rtt":7}]'), (2, 3, 0, -1.0, -1.0, -1.0, '[{"x":"*"}]'),
        (3, 3, 2, None, None, None, '[{"rtt":4},{"rtt":8},{"x":"*"}]'), (4, 0, 0, None, None, None, "[]"),
        (5, 3, 1, 9.0, 9.0, 9.0, '[{"rtt":9}]'), (6, 3, None, None, None, None, "[]"),
    ]
    df = spark.createDataFrame(rows, "i int, sent long, rcvd long, min double, max double, avg double, result string")
    got = {r.i: r for r in parse.instant_metrics(df).collect()}
    assert got[1].jitter_ms == pytest.approx(statistics.pstdev([5, 6, 7]), abs=1e-9)
    assert got[2].rtt_avg is None and got[2].jitter_ms is None and got[2].perda_pct == 100
    assert (got[3].rtt_min, got[3].rtt_max, got[3].rtt_avg) == (4.0, 8.0, 6.0)
    assert got[4].perda_pct is None and got[5].jitter_ms == 0 and got[6].perda_pct is None


CASES = [
    (None, 0.0, 5.0, 0.1, None, K.REASON_NO_BASELINE), ("INSUFICIENTE", 0.0, 5.0, 0.1, None, K.REASON_SHORT_BASELINE),
    ("VALIDO", None, 5.0, 0.1, None, K.REASON_NO_LOSS), ("VALIDO", 100.0, None, None, "FALHA", K.REASON_SEVERE_LOSS),
    ("VALIDO", 66.66, 5.0, 0.1, "FALHA", K.REASON_SEVERE_LOSS), ("VALIDO", 33.33, 25.0, 0.1, "FALHA", K.REASON_P99),
    ("VALIDO", 33.33, 15.0, 0.1, "RISCO", K.REASON_PARTIAL_LOSS), ("VALIDO", 0.0, 20.0, 0.1, "RISCO", K.REASON_P95),
    ("VALIDO", 0.0, 20.01, 0.1, "FALHA", K.REASON_P99), ("VALIDO", 0.0, 10.0, 0.1, "OK", K.REASON_NONE),
    ("VALIDO", 0.0, 10.01, 0.1, "RISCO", K.REASON_P95), ("VALIDO", 0.0, 5.0, 1.0, "OK", K.REASON_NONE),
    ("VALIDO", 0.0, 5.0, 1.01, "RISCO", K.REASON_JITTER), ("VALIDO", 0.0, None, None, "OK", K.REASON_NONE),
]


def test_label_truth_table(spark):
    df = spark.createDataFrame([(i, *c[:4], 10.0, 20.0, 1.0) for i, c in enumerate(CASES)],
                               "i int, status_baseline string, perda_pct double, latencia_ms double, jitter_ms double,"
                               "p95_rtt_A double, p99_rtt_A double, p95_jitter_A double")
    out = df.withColumn("motivo_rotulagem", label.label_reason()).withColumn("classe", label.label_class())
    got = {r.i: (r.classe, r.motivo_rotulagem) for r in out.collect()}
    assert got == {i: (c[4], c[5]) for i, c in enumerate(CASES)}


def test_zero_jitter_limit_fires_on_any_jitter(spark):
    df = spark.createDataFrame([("VALIDO", 0.0, 5.0, 0.001, 10.0, 20.0, 0.0)],
                               "status_baseline string, perda_pct double, latencia_ms double, jitter_ms double,"
                               "p95_rtt_A double, p99_rtt_A double, p95_jitter_A double")
    assert df.select(label.label_reason()).first()[0] == K.REASON_JITTER


def test_split_tag_boundaries(spark):
    day = 86400
    ts = [0, 5 * day - 1, 5 * day, 5 * day + 3599, 5 * day + 3600, 6 * day - 1, 6 * day, 6 * day + 3600]
    df = spark.createDataFrame([(t,) for t in ts], "t long")
    got = [r[0] for r in df.select(label.split_tag(F.col("t"), F.lit(0), 5, 6, 60)).collect()]
    assert got == ["treino", "treino", "embargo", "embargo", "validacao", "validacao", "embargo", "teste"]


def test_missing_coordinates_have_no_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0), (90.0, 0.0), (None, 0.0), (200.0, 0.0)], "lon double, lat double")
    here = F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    km = geo.haversine_km(here, geo.coordinates(F.col("lon"), F.col("lat")))
    got = [(r[0], r[1]) for r in df.select(km, geo.distance_band(km)).collect()]
    assert got == [(0.0, "curta"), (10007.5, "longa"), (None, None), (None, None)]


def test_jitter_takes_the_mean_from_its_column(spark):
    texts = ['[{"rtt":1.5},{"rtt":4},{"x":"*"},{"rtt":9.25}]', '[{"rtt":7}]', '[{"x":"*"}]', "[]", "no json", None]
    rows = spark.createDataFrame([(t, 3, 3, None, None, None) for t in texts], "result string, sent int, rcvd int, min double, max double, avg double")
    out = parse.instant_metrics(rows).select("jitter_ms")
    want = [round(statistics.pstdev([1.5, 4, 9.25]), 9), 0.0, None, None, None, None]
    assert [r.jitter_ms for r in out.collect()] == want
    # one pass for the mean and one for the spread, none inside the other
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2


def test_pseudonym_needs_a_salt(spark):
    df = spark.createDataFrame([("7", "a")], "probe_id string, anchor_id string")
    salted = privacy.pseudonymise(df, ["probe_id"], "s").first()
    blank = privacy.pseudonymise(df, ["probe_id"], None).first()
    assert len(salted.probe_id_hash) == 64 and salted.anchor_id == "a"
    assert blank.probe_id_hash is None and "sal ausente" in blank.privacidade


def test_near(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-7, True), (1.0, 1.1, False), (1e9, 1e9 + 10, True), (None, None, True),
                                (None, 1.0, False)], "a double, b double, w boolean")
    assert all(r[0] == r[1] for r in df.select(label.near(F.col("a"), F.col("b")), "w").collect())
