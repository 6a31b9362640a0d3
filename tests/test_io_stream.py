import pytest
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope import schemas
from rttscope.sources import adapter, readers, sinks
from rttscope.plans.stages import Stages
from rttscope.session import shared_dir, work_path
from rttscope.streaming import scorer


def test_wrong_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id_fluxo,outra\n1_2,x\n")
    with pytest.raises(Exception):
        readers.read_raw(spark, str(tmp_path / "a.csv")).collect()


def test_required_forbidden_and_difference():
    assert readers.compare_names(["a", "b"], ["b", "c"]) == {"faltam": ["c"], "sobram": ["a"]}


def test_forbidden_columns_are_refused(spark):
    df = spark.range(1).withColumn("classe", F.lit("OK"))
    with pytest.raises(readers.ContractError):
        readers.model_input(df, ("classe",))
    with pytest.raises(readers.ContractError):
        readers.model_input(df, ("perda_pct",))


def test_period_windows(spark):
    def read(rows, **options):
        table = spark.createDataFrame([(r["nome"], r["inicio"], r["fim"]) for r in rows], "nome string, inicio string, fim string")
        return readers.period_windows(table, **options)

    good = [{"nome": "A", "inicio": "2024-01-01T00:00:00Z", "fim": "2024-01-02T00:00:00+00:00"},
            {"nome": "B", "inicio": "2024-01-02T00:00:00", "fim": "2024-01-03T00:00:00Z"}]
    assert read(good) == (("A", 1704067200, 1704153600), ("B", 1704153600, 1704240000))
    assert read([{**good[0], "inicio": "1704067200", "fim": "1704153600.7"}, good[1]])[0] == ("A", 1704067200, 1704153600)
    for bad in (good[:1], [good[0], {**good[1], "inicio": "2024-01-01T12:00:00Z"}], [good[0], {**good[1], "fim": None}], [good[0], {**good[1], "fim": "amanhã"}],
                [{**good[0], "fim": "2023-01-01T00:00:00Z"}, good[1]]):
        with pytest.raises(readers.ContractError):
            read(bad)
    with pytest.raises(readers.ContractError):
        read(good, zone_required=True)


def test_collection_window():
    assert readers.collection_window(now="2024-01-02T05:59:00Z") == (1704085200, 1704171600)
    assert readers.collection_window("1704067200", "2024-01-01T01:00:00Z") == (1704067200, 1704070800)
    with pytest.raises(readers.ContractError):
        readers.collection_window("2024-01-01T00:00:00Z", None)


def test_result_documents_and_bodies(spark, tmp_path):
    (tmp_path / "66.json").write_text('[{"timestamp":1,"prb_id":2,"sent":3,"rcvd":3,"avg":1.5,"result":[{"rtt":1.5}]},'
                                      '{"timestamp":2,"prb_id":2,"offline":true}]')
    rows = readers.read_result_documents(spark, str(tmp_path / "66.json")).orderBy("timestamp").collect()
    assert [r.msm_arquivo for r in rows] == [66, 66] and rows[0].result == '[{"rtt":1.5}]' and rows[1].offline
    df = spark.createDataFrame([('[{"a":1}]',), ('{"results":[{"a":1},{"a":2}],"next":null}',), ('{"e":1}',), ("x",)], "c string")
    good, bad = readers.unwrap_body(df, "c")
    assert good.count() == 3 and bad.count() == 2


def test_csv_cells(spark, tmp_path):
    df = spark.createDataFrame([(True, 1.50, None, [1, 2]), (False, 2.0, "a", [])], "b boolean, d double, t string, l array<int>")
    got = [tuple(r) for r in sinks.rendered(df).collect()]
    assert got == [("true", "1.5", None, "[1,2]"), ("false", "2", "a", "[]")]


def test_retention_dry_run_keeps_everything(spark, tmp_path):
    from datetime import date
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01")], "x int, data string")
    df.write.partitionBy("data").parquet(str(tmp_path / "in"))
    gone = sinks.rewrite_kept(spark, str(tmp_path / "in"), str(tmp_path / "out"), date(2024, 4, 1), 60)
    assert [r.data for r in gone.collect()] == ["2024-01-01"] and not (tmp_path / "out").exists()
    sinks.rewrite_kept(spark, str(tmp_path / "in"), str(tmp_path / "out"), date(2024, 4, 1), 60, dry_run=False)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def message(i, flow, ts, rcvd=3, cents=1000):
    probe, anchor = map(int, flow.split("_"))
    avg = cents / 100 if rcvd else -1.0
    result = "[" + ",".join(['{"rtt":%s}' % avg] * rcvd + ['{"x":"*"}'] * (3 - rcvd)) + "]"
    return (i, probe, anchor, flow, 7, ts, 3, rcvd, 54 if rcvd else None, result, avg, avg, avg, "ping", 4)


SCHEMA = ("event_id long, probe_id long, anchor_id long, id_fluxo string, msm_id long, timestamp long, sent long, rcvd long,"
          "ttl long, result string, min double, max double, avg double, type string, af int")
PROFILE = "anchor_id long, probe_id long, ttl_baseline double, p95_rtt_A double, p99_rtt_A double, p95_jitter_A double, status_baseline string"


def stream(spark, batches, profile, **settings):
    job = scorer.Scorer(spark, spark.createDataFrame(profile, PROFILE), work_path(spark, "t"), (0, 10**9), **settings)
    for n, rows in enumerate(batches):
        job(spark.createDataFrame(rows, SCHEMA), n)
    return job


def test_stream_batches_equal_one_batch(spark):
    rows = [message(i, f, 1000 + 240 * i, rcvd=(0 if i % 7 in (3, 4, 5) else 3), cents=900 + 13 * i % 400)
            for i in range(70) for f in ("1_1", "2_1")]
    profile = [(1, 1, 54.0, 11.0, 12.0, 1.0, "VALIDO"), (1, 2, 54.0, 10.0, 12.5, 1.0, "VALIDO")]
    cols = ["id_fluxo", "timestamp", "classe", "estado", "previsto", "pos", *K.FEATURES]
    parts = stream(spark, [rows[:20], rows[20:24], rows[24:131], rows[131:]], profile)
    whole = stream(spark, [rows], profile)
    a = sorted(map(str, parts.read("forecasts").select(*cols).collect()))
    assert a == sorted(map(str, whole.read("forecasts").select(*cols).collect())) and len(a) == 140
    closed = ["id_fluxo", "timestamp", "previsto", "real", "acerto", "lacuna"]
    assert sorted(map(str, parts.read("closed").select(*closed).collect())) == sorted(map(str, whole.read("closed").select(*closed).collect()))
    assert {r.estado for r in parts.read("forecasts").where("pos < 12").collect()} == {"aquecimento"}


def test_long_loss_streak_outlives_the_history_cap(spark):
    rows = [message(i, "1_1", 1000 + 240 * i, rcvd=0) for i in range(120)]
    job = stream(spark, [rows[:60], rows[60:61], rows[61:]], [(1, 1, 54.0, 11.0, 12.0, 1.0, "VALIDO")])
    got = {r.timestamp: (r[K.STREAK_FEATURE], r.pos) for r in job.read("forecasts").collect()}
    assert all(got[1000 + 240 * i] == (i + 1, i + 1) for i in range(120))


def test_duplicates_late_rows_and_replay(spark):
    rows = [message(i, "1_1", 1000 + 240 * i) for i in range(30)]
    profile = [(1, 1, 54.0, 11.0, 12.0, 1.0, "VALIDO")]
    late = message(99, "1_1", 1000 + 240 * 5 + 7)
    job = stream(spark, [rows[:20], [rows[19], message(98, "1_1", rows[20][5]), *rows[20:], late]], profile)
    out = job.read("forecasts")
    assert out.count() == 31 and out.where("timestamp = %d" % late[5]).count() == 1
    assert [tuple(r) for r in job.read("quarantine").select("event_id", "motivo").collect()] == [(98, "timestamp_duplicado")]
    before = sorted(map(str, out.collect()))
    job(spark.createDataFrame([rows[19], message(98, "1_1", rows[20][5]), *rows[20:], late], SCHEMA), 1)  # the same batch again
    assert sorted(map(str, job.read("forecasts").collect())) == before


def test_a_row_sent_again_after_the_history_cap_is_not_scored_twice(spark):
    rows = [message(i, "1_1", 1000 + 240 * i) for i in range(70)]
    job = stream(spark, [rows, rows[:3]], [(1, 1, 54.0, 11.0, 12.0, 1.0, "VALIDO")])
    assert job.read("forecasts").count() == 70


def test_items_refused_by_the_live_path(spark):
    rows = [message(i, "1_1", 1000 + 240 * i) for i in range(5)]
    untyped = (*rows[0][:13], None, 4)
    other = (11, 9, *rows[1][2:])
    negative = (*rows[2][:12], -5.0, "ping", 4)
    silent = (*rows[3][:9], "[]", None, None, None, "ping", 4)
    job = stream(spark, [[untyped, other, negative, silent]], [(1, 1, 54.0, 11.0, 12.0, 1.0, "VALIDO")])
    assert [r.timestamp for r in job.read("forecasts").collect()] == [1000]
    assert sorted(r.motivo for r in job.read("quarantine").collect()) == ["latencia_ausente", "latencia_negativa", "probe_diferente"]


def test_fallback_baseline_is_frozen(spark):
    rows = [message(i, "3_1", 1000 + 240 * i, cents=1000 + i) for i in range(80)]
    profile = [(1, 1, 54.0, 11.0, 12.0, 1.0, "VALIDO")]
    cols = ["timestamp", "estado", "previsto", "classe", "p95_rtt_A", "origem_baseline"]
    parts = [stream(spark, cut, profile).read("forecasts") for cut in ([rows], [rows[:20], rows[20:40], rows[40:]])]
    one, three = (sorted(map(str, out.select(*cols).collect())) for out in parts)
    assert one == three and len(one) == 80
    first = rows[29][5]  # the thirtieth RTT
    assert {r.estado for r in parts[0].where(f"timestamp < {first}").collect()} == {"aquecimento"}
    limits = {(r.p95_rtt_A, r.origem_baseline) for r in parts[0].where(f"timestamp >= {first}").collect()}
    assert len(limits) == 1 and next(iter(limits))[1] == "historico"


ONE = [(1, 1, 54.0, 11.0, 12.0, 1.0, "VALIDO")]


def folders(path):
    import os

    return sorted(f for f in os.listdir(path) if f.startswith("batch=")) if os.path.isdir(path) else []


def test_increments_and_snapshots_equal_one_batch(spark):
    """Batches of few flows each: what is left does not grow, and a flow that pauses keeps its state."""
    import glob

    rows = [message(i, f, 1000 + 240 * i, rcvd=(0 if i % 5 == 3 else 3)) for i in range(8) for f in ("1_1", "2_1", "3_1")]
    profile = [*ONE, (1, 2, 54.0, 10.0, 12.5, 1.0, "VALIDO")]
    cuts = [[r for r in rows if r[0] == i and (r[3] != "2_1" or i < 2 or i > 6)] for i in range(8)]
    before = len(glob.glob(f"{shared_dir(spark)}/stream-*")) + len(glob.glob(f"{shared_dir(spark)}/series-chunks*"))
    parts = stream(spark, cuts, profile, compact=3, cap=12, min_rtts=5)
    cols = ["id_fluxo", "timestamp", "classe", "estado", "previsto", "pos", "origem_baseline", *K.FEATURES]
    whole = stream(spark, [[r for c in cuts for r in c]], profile, cap=12, min_rtts=5)
    a, b = (sorted(map(str, job.read("forecasts").select(*cols).collect())) for job in (parts, whole))
    assert a == b and len(a) == 8 * 2 + 3
    assert len(folders(f"{parts.path}/state")) <= 4
    assert len(glob.glob(f"{shared_dir(spark)}/stream-*")) + len(glob.glob(f"{shared_dir(spark)}/series-chunks*")) == before
    # the last batch touched two flows; its increment holds just these until the snapshot
    last = spark.read.parquet(f"{whole.path}/state/batch=0")
    assert {r.id_fluxo for r in last.select("id_fluxo").distinct().collect()} == {"1_1", "2_1", "3_1"}


def test_an_increment_holds_only_flows_of_its_batch(spark):
    rows = [message(i, f, 1000 + 240 * i) for i in range(4) for f in ("1_1", "2_1", "3_1")]
    job = stream(spark, [rows, [message(9, "2_1", 9000)]], ONE, compact=100)
    second = spark.read.parquet(f"{job.path}/state/batch=1")
    assert {r.id_fluxo for r in second.collect()} == {"2_1"} and second.count() == 5


def test_a_failing_flow_leaves_one_error_row(spark):
    rows = [message(i, f"{k}_1", 1000 + 240 * i) for i in range(3) for k in range(1, 8)]

    def breaks(df):
        broken = (F.col("id_fluxo") == "4_1") & (F.col("timestamp") >= 1240)
        return df.withColumn("previsto", F.when(broken, F.raise_error(F.lit("sem modelo"))).otherwise(F.col("classe")))

    profile = [(1, k, 54.0, 11.0, 12.0, 1.0, "VALIDO") for k in range(1, 8)]
    cuts = [[r for r in rows if r[0] == i] for i in range(3)]
    job = stream(spark, cuts, profile, forecast=breaks, warmup=1)
    errors = job.read("errors").orderBy("batch").collect()
    assert [(r.id_fluxo, r.batch) for r in errors] == [("4_1", 1), ("4_1", 2)] and all("sem modelo" in r.erro for r in errors)
    got = {r.id_fluxo: r["count"] for r in job.read("forecasts").groupBy("id_fluxo").count().collect()}
    assert got == {f"{k}_1": 1 if k == 4 else 3 for k in range(1, 8)}
    good = stream(spark, cuts, profile, warmup=1)
    cols = ["id_fluxo", "timestamp", "previsto", "pos", *K.FEATURES]
    a, b = (sorted(map(str, j.read("forecasts").where("id_fluxo <> '4_1'").select(*cols).collect())) for j in (job, good))
    assert a == b and good.read("errors").count() == 0
    with pytest.raises(Exception, match="sem modelo"):
        stream(spark, cuts, profile, forecast=lambda df: df.withColumn("previsto", F.raise_error(F.lit("sem modelo"))), max_errors=2)


def test_timeouts_can_count_as_loss_alone(spark):
    partly = message(0, "1_1", 1000, rcvd=2)
    kept, dropped = (stream(spark, [[partly]], ONE, timeout_is_loss=x).read("forecasts").first() for x in (False, True))
    assert kept.rtt_avg == 10.0 and dropped.rtt_avg is None and kept.perda_pct == dropped.perda_pct


def test_messages_are_stored_once_however_late(spark):
    store = scorer.MessageStore(spark, work_path(spark, "m"), F.lit(1), 0, 10**7)
    rows = [message(i, "1_1", 1000 + 40_000 * i) for i in range(40)]
    for n in range(20):
        store(spark.createDataFrame(rows[2 * n : 2 * n + 2] + [rows[0], rows[2 * n], message(0, "2_1", 5)], SCHEMA), n)
    store(spark.createDataFrame(rows[38:] + [rows[0], rows[38]], SCHEMA), 19)  # the same batch again
    late = message(99, "1_1", 1001)
    store(spark.createDataFrame([late, late, rows[3]], SCHEMA), 20)
    got = sorted(r.timestamp for r in store.read().collect())
    assert got == sorted([r[5] for r in rows] + [1001])


def test_upsert_keeps_labels(spark):
    stored = spark.createDataFrame([("f", 1, "OK", "RISCO")], "id_fluxo string, timestamp long, previsto string, real string")
    new = spark.createDataFrame([("f", 1, "FALHA"), ("f", 2, "OK")], "id_fluxo string, timestamp long, previsto string")
    got = sorted(tuple(r) for r in scorer.upsert_forecasts(stored, new).collect())
    assert got == [("f", 1, "FALHA", "RISCO"), ("f", 2, "OK", None)]


def test_tiny_chunks_do_not_change_the_dataset(spark, sf, monkeypatch):
    from rttscope.operators import series
    plain = Stages.of(spark, sf).final.select("id_fluxo", "timestamp", *K.FEATURES, "alvo")
    a = sorted(map(str, plain.collect()))
    monkeypatch.setattr(series.series_windows, "__defaults__", (None, 3600))
    b = sorted(map(str, Stages.of(spark, sf).final.select("id_fluxo", "timestamp", *K.FEATURES, "alvo").collect()))
    assert a == b and len(a) > 0


def test_six_significant_digits_as_text(spark):
    rows = [0.0, 1.0, -1.0, 100.0, 0.005328219, 0.0969391, 33.3333333, 0.00012345678, 0.000012345678, 1234567.0, 0.1, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, x double")
    got = [r.t for r in df.select("i", sinks.short_text("x").alias("t")).orderBy("i").collect()]
    assert got == [None if v is None or v != v else f"{v:.6g}" for v in rows]
