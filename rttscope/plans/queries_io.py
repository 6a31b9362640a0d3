"""Queries of sources and sinks: each writes derived rows to the shared folder and reads them back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope import schemas
from rttscope.operators import collection, quality
from rttscope.plans.catalog import register, rounded, stages
from rttscope.plans.queries_drift import Drift
from rttscope.plans.queries_prod import ALL_CTES, ITEM_CTES, PROD_CTES, all_alerts, collection_log, items, scored_rows
from rttscope.session import work_path
from rttscope.sources import adapter, readers, sinks


def raw_table(spark, sf):
    """The 19-column raw table of the derived pings, as text-ready rows."""
    rows = collection.with_period(adapter.pings(spark, sf), adapter.PERIODS)
    return rows.select(
        "id_fluxo", "periodo", "anchor_id", F.concat(F.lit("10.0.0."), "anchor_id").alias("anchor_ip"), "probe_id",
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("172.16.0."), "probe_id")).alias("probe_ip"), "msm_id", "ttl", "result",
        F.lit(0).alias("dup"), "rcvd", "sent", "min", "max", "avg", "timestamp", "type", F.lit(3).alias("packets"),
        F.lit(K.INTERVAL_S).alias("interval"))


@register("s1_raw_csv", """
SELECT id_fluxo, periodo, anchor_id, '10.0.0.' || anchor_id AS anchor_ip, probe_id, CASE WHEN event_id % 3 <> 0 THEN '172.16.0.' || probe_id END AS probe_ip, msm_id, ttl, result,
  0 AS dup, rcvd, sent, round(min, 6) AS min, round(max, 6) AS max, round(avg, 6) AS avg, timestamp, type, 3 AS packets, 240 AS interval FROM tagged""")
def s1_raw_csv(spark, sf):
    path = work_path(spark, "raw-csv")
    sinks.write_csv(raw_table(spark, sf), path, list(K.RAW_COLUMNS))
    return readers.read_raw(spark, path).select(*K.RAW_COLUMNS)


@register("s3_split_scan", "SELECT split, count(*) AS n FROM final WHERE split <> 'teste' GROUP BY split")
def s3_split_scan(spark, sf):
    path = work_path(spark, "final")
    sinks.write_final(stages(spark, sf).final, path)
    rows = readers.read_splits(spark, path, ["treino", "validacao"])
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("s4_replay_scan", f"""
SELECT event_id, timestamp FROM collected WHERE id_fluxo = '1_1' AND timestamp >= {adapter.B_END - 72 * 3600} AND timestamp < {adapter.B_END}""")
def s4_replay_scan(spark, sf):
    rows = readers.replay(stages(spark, sf).collected, "1_1", (adapter.B_START, adapter.B_END), 72)
    return rows.select("event_id", "timestamp")


@register("s2_text_blanks", """
SELECT unnest(['id_fluxo', 'probe_ip', 'ttl', 'type']) AS coluna, unnest([0, count(*) FILTER (event_id % 3 = 0), count(*) FILTER (ttl IS NULL), 0])::BIGINT AS n FROM tagged""")
def s2_text_blanks(spark, sf):
    """The raw table read as text: blanks stay blank, and a column that is not there is refused."""
    path = work_path(spark, "raw-text")
    sinks.write_csv(raw_table(spark, sf), path, list(K.RAW_COLUMNS))
    names = ["id_fluxo", "probe_ip", "ttl", "type"]
    rows = readers.require_columns(readers.read_csv(spark, path, schemas.RAW_TEXT), names, "raw table")
    blank = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).alias(c) for c in names]
    return quality.nulls_per_column(rows.select(*blank), names)


@register("s5_result_documents", "SELECT msm_id AS msm_arquivo, count(*) AS n, sum(rcvd)::BIGINT AS recebidos, count(*) FILTER (ttl IS NULL) AS sem_ttl FROM pings GROUP BY msm_id")
def s5_result_documents(spark, sf):
    """One JSON array per measurement and day, as offline collections store them, read through the reader."""
    path = work_path(spark, "documents")
    item = F.to_json(F.struct("timestamp", F.col("probe_id").alias("prb_id"), "msm_id", "sent", "rcvd", "min", "max", "avg", "ttl"))
    day = F.floor(F.col("timestamp") / 86400)
    docs = adapter.pings(spark, sf).groupBy("msm_id", day.alias("dia")).agg(F.collect_list(item).alias("itens"))
    text = F.concat(F.lit("["), F.array_join("itens", ","), F.lit("]")).alias("value")
    docs.select(F.concat_ws("/", "msm_id").alias("medicao"), "dia", text).repartition("medicao", "dia").write.partitionBy("dia", "medicao").option("maxRecordsPerFile", 1).text(path)
    got = readers.read_result_documents(spark, path)
    return got.groupBy("msm_arquivo").agg(F.count(F.lit(1)).alias("n"), F.sum("rcvd").alias("recebidos"), F.count_if(F.col("ttl").isNull()).alias("sem_ttl"))


@register("s6_unwrap_bodies", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 3 END AS n_itens, CASE WHEN event_id % 4 = 3 THEN 'corpo inesperado' END AS motivo FROM pings""")
def s6_unwrap_bodies(spark, sf):
    e = F.col("event_id")
    body = (F.when(e % 4 == 0, F.concat(F.lit('{"results":'), "result", F.lit(',"next":null}')))
            .when(e % 4 == 3, F.lit('{"detail":"erro"}')).otherwise(F.col("result")))
    good, bad = readers.unwrap_body(adapter.pings(spark, sf).select("event_id", body.alias("corpo")), "corpo")
    counted = good.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_itens")).withColumn("motivo", F.lit(None).cast("string"))
    return counted.unionByName(bad.select("event_id", F.lit(None).cast("long").alias("n_itens"), "motivo"))


@register("s7_log_folder", """
SELECT fluxo, 2 * count(*) AS linhas, 2 * sum(ok)::BIGINT AS ok FROM (SELECT t2 // 86400 AS arquivo, id_fluxo AS fluxo, count(*) FILTER (situacao = 'ok') AS ok
  FROM classified_items WHERE t2 IS NOT NULL GROUP BY ALL) GROUP BY fluxo""",
          ITEM_CTES)
def s7_log_folder(spark, sf):
    path = work_path(spark, "collection-log")
    log = collection_log(spark, sf).select(
        F.concat(F.lit("run-"), F.col("arquivo").cast("string")).alias("run_id"), "fluxo_id",
        F.struct("ok", "timeout", "invalida", "sem_resultado", "probe_offline").alias("situacoes"))
    sinks.append_json(log, path)
    got = readers.read_log(spark, path, schemas.COLLECTION_LOG)
    return got.where("arquivo is not null").groupBy(F.col("fluxo_id").alias("fluxo")).agg(
        F.count(F.lit(1)).alias("linhas"), F.sum("situacoes.ok").alias("ok"))


@register("s15_prediction_partitions", """
SELECT substr(ts_previsao, 1, 10) AS data, count(*) AS n, count(*) FILTER (m2) AS soma_errada FROM logrows WHERE substr(ts_previsao, 1, 10) >= '2024-01-20' GROUP BY data""", PROD_CTES)
def s15_prediction_partitions(spark, sf):
    path = work_path(spark, "predictions")
    log = scored_rows(spark, sf)[1]
    sinks.write_predictions(log, path)
    # writing a day again replaces it and leaves the rest alone
    sinks.write_predictions(log.where(F.substring("ts_previsao", 1, 10) == "2024-01-22"), path)
    rows = readers.read_predictions(spark, path, start="2024-01-20")
    total = F.aggregate(F.map_values("proba"), F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy(F.col("data").cast("string").alias("data")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) > 1e-6).alias("soma_errada"))


@register("s8_parsed_maps", "SELECT fluxo_id, timestamp, u.mapa AS mapa, u.chave AS chave, round(u.valor, 3) AS valor FROM (SELECT fluxo_id, timestamp, unnest([" + ", ".join(
    [f"{{'mapa': 'features', 'chave': '{c}', 'valor': {c}::DOUBLE}}" for c in K.FEATURES]
    + [f"{{'mapa': 'proba', 'chave': '{c}', 'valor': (CASE WHEN prevista = '{c}' OR prevista = 'OUTRA' AND '{c}' = 'OK' THEN 0.8 ELSE resto END)::DOUBLE}}" for c in K.CLASSES])
    + "]) AS u FROM scored)", PROD_CTES)
def s8_parsed_maps(spark, sf):
    """Every entry of both maps, from their JSON text."""
    log = scored_rows(spark, sf)[1].withColumns({c: F.to_json(c) for c in ("features", "proba")})
    rows = readers.parse_maps(log).select("fluxo_id", F.unix_seconds(F.to_timestamp("ts_previsao")).alias("timestamp"), "features", "proba")

    def entries(name):
        return F.transform(F.map_entries(name), lambda e: F.struct(F.lit(name).alias("mapa"), e["key"].alias("chave"), F.round(e["value"], 3).alias("valor")))

    return rows.select("fluxo_id", "timestamp", F.inline(F.concat(entries("features"), entries("proba"))))


@register("u4_feature_names", """
SELECT 'perda_pct' AS nome, 'falta' AS lado, count(*) AS n FROM preds WHERE timestamp % 71 = 0 UNION ALL SELECT 'perda', 'sobra', count(*) FROM preds WHERE timestamp % 71 = 0
UNION ALL SELECT 'rtt_ausente', 'falta', count(*) FROM preds WHERE timestamp % 73 = 0""", PROD_CTES)
def u4_feature_names(spark, sf):
    """Names of the logged features against the contract, both ways; some rows have one renamed or dropped."""
    t = F.unix_seconds(F.to_timestamp("ts_previsao"))
    names = F.map_keys("features")
    names = F.when(t % 71 == 0, F.array_union(F.array_remove(names, "perda_pct"), F.array(F.lit("perda")))).otherwise(names)
    names = F.when(t % 73 == 0, F.array_remove(names, "rtt_ausente")).otherwise(names)
    rows = scored_rows(spark, sf)[1].select(names.alias("nomes"))
    return readers.name_differences(rows, F.col("nomes")).groupBy("nome", "lado").agg(F.count(F.lit(1)).alias("n"))


DAY_PERIODS = {
    "day_spans": """
  SELECT event_id_group AS documento, dia, min(timestamp) AS i, max(timestamp) + 1 AS f FROM (SELECT timestamp, probe_id AS event_id_group, timestamp // 86400 AS dia FROM pings) GROUP BY ALL""",
    "day_rows": """
  SELECT documento, dia, i, f, CASE WHEN documento = 0 AND dia % 2 = 1 THEN 'B' WHEN documento = 0 THEN 'A' ELSE 'D' || dia::VARCHAR END AS nome, documento % 2 = 1 AS exige,
    CASE WHEN dia % 11 = 0 THEN NULL WHEN dia % 7 = 0 THEN i - 86400 WHEN dia % 5 = 0 THEN f + 172800 ELSE f END AS fim, dia % 13 = 0 AS ruim, dia % 3 = 0 AS sem_fuso FROM day_spans""",
    "day_told": """
  SELECT *, CASE WHEN fim IS NULL THEN 'limite ausente' WHEN exige AND (sem_fuso OR ruim) THEN 'instante sem fuso' WHEN ruim THEN 'instante invalido' WHEN fim <= i THEN 'invertido' END AS motivo FROM day_rows""",
}


@register("s9_period_checks", """
SELECT documento, nome, CASE WHEN NOT ruim THEN i END AS inicio, fim, coalesce(motivo, CASE WHEN max(CASE WHEN motivo IS NULL THEN fim END) OVER w > i THEN 'sobreposto' END) AS motivo
FROM day_told WINDOW w AS (PARTITION BY documento ORDER BY CASE WHEN NOT ruim THEN i END NULLS FIRST, fim NULLS FIRST, nome ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
UNION ALL SELECT documento, nome, NULL, NULL, 'periodo ausente' FROM (SELECT DISTINCT documento FROM day_rows WHERE documento <> 0), (VALUES ('A'), ('B')) p(nome)""", DAY_PERIODS)
def s9_period_checks(spark, sf):
    """Documents of daily windows, many of them wrong on purpose: every row with the reason against it."""
    t, day = F.col("timestamp"), F.col("dia")
    spans = adapter.pings(spark, sf).select(F.col("probe_id").alias("documento"), t, F.floor(t / 86400).alias("dia")).groupBy("documento", "dia").agg(F.min(t).alias("i"), (F.max(t) + 1).alias("f"))
    end = F.when(day % 11 == 0, None).when(day % 7 == 0, F.col("i") - 86400).when(day % 5 == 0, F.col("f") + 172800).otherwise(F.col("f"))
    zone = F.when(day % 3 == 0, "").otherwise("Z")
    text = lambda c: F.concat(F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss"), zone)
    name = F.when(F.col("documento") == 0, F.when(day % 2 == 1, "B").otherwise("A")).otherwise(F.concat(F.lit("D"), day.cast("string")))
    rows = spans.select("documento", name.alias("nome"), F.when(day % 13 == 0, "amanhã").otherwise(text(F.col("i"))).alias("inicio"), text(end).alias("fim"))
    strict, free = (readers.checked_periods(rows.where(F.col("documento") % 2 == k), ("documento",), zone_required=bool(k)) for k in (1, 0))
    return strict.unionByName(free)


@register("s17_json_export", """
SELECT fluxo_id, count(*) AS n, min(ts_previsao) AS inicio, max(ts_previsao) AS fim FROM logrows WHERE substr(ts_previsao, 1, 10) BETWEEN '2024-01-18' AND '2024-01-24' GROUP BY fluxo_id""", PROD_CTES)
def s17_json_export(spark, sf):
    source, target = work_path(spark, "predictions"), work_path(spark, "export")
    sinks.write_predictions(scored_rows(spark, sf)[1], source)
    sinks.export_json(spark.read.parquet(source), target, "2024-01-18", "2024-01-24")
    rows = spark.read.schema(schemas.PREDICTION).json(target)
    return rows.groupBy("fluxo_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_previsao").alias("inicio"), F.max("ts_previsao").alias("fim"))


@register("s10_anchor_continents", "SELECT anchor_id, continent AS continente FROM anchor_dim JOIN country_dim USING (country)")
def s10_anchor_continents(spark, sf):
    path = work_path(spark, "anchors-doc")
    c = adapter.countries(spark, sf).select("country", "continent")
    # one document per anchor, each with the anchors array of the contract
    docs = adapter.anchors(spark, sf).join(c, "country").select(F.col("anchor_id").alias("id"), "continent")
    docs.select(F.array(F.struct("id", "continent")).alias("anchors")).write.json(path)
    return readers.anchor_continents(spark, path)


@register("s11_ttl_dimension", """
SELECT anchor_id, probe_id, median(ttl) AS ttl_baseline, count(ttl) AS n_amostras_A, min(ttl)::DOUBLE AS ttl_min_A, max(ttl)::DOUBLE AS ttl_max_A,
  count(DISTINCT ttl) AS n_ttl_distintos_A FROM instants WHERE periodo = 'A' GROUP BY ALL HAVING count(ttl) >= 30""")
def s11_ttl_dimension(spark, sf):
    from pyspark.sql import types as T
    from rttscope.functions.parse import number, whole
    from rttscope.operators import baseline
    path = work_path(spark, "ttl-csv")
    table = baseline.ttl_baseline(stages(spark, sf).instants.where("periodo = 'A'"))
    sinks.write_csv(table, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in table.columns])
    text = readers.read_csv(spark, path, schema)
    return text.select(whole("anchor_id").alias("anchor_id"), whole("probe_id").alias("probe_id"),
                       *[number(c).alias(c) for c in ("ttl_baseline", "ttl_min_A", "ttl_max_A")],
                       *[whole(c).alias(c) for c in ("n_amostras_A", "n_ttl_distintos_A")])


@register("s13_cells", """
SELECT event_id, CASE WHEN type = 'ping' THEN 'true' ELSE 'false' END AS e_ping, CASE WHEN rcvd = 0 THEN '-1' WHEN min IS NULL THEN NULL
  ELSE rtrim(rtrim(printf('%.6f', min), '0'), '.') END AS min FROM pings""")
def s13_cells(spark, sf):
    rows = adapter.pings(spark, sf).select("event_id", (F.col("type") == "ping").alias("e_ping"), "min")
    return sinks.rendered(rows).withColumn("event_id", F.col("event_id").cast("long"))


@register("s14_final_csv", f"""
SELECT id_fluxo, anchor_id, probe_id, timestamp, split, classe_atual, alvo, {', '.join(f"CAST(printf('%.5e', {c}::DOUBLE) AS DOUBLE) AS {c}" for c in K.FEATURES)} FROM final""")
def s14_final_csv(spark, sf):
    from pyspark.sql import types as T
    from rttscope.functions.parse import number, whole
    path = work_path(spark, "final-csv")
    final = stages(spark, sf).final
    sinks.write_final_csv(final, path)
    text = readers.read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in final.columns]))
    return text.select("id_fluxo", "split", "classe_atual", "alvo", *[whole(c).alias(c) for c in ("anchor_id", "probe_id", "timestamp")],
                       *[number(c).alias(c) for c in K.FEATURES])


@register("s19_event_log", """
SELECT strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d') AS dia, coalesce(situacao, 'ok') AS situacao, count(*) AS n FROM classified_items GROUP BY ALL""",
          ITEM_CTES)
def s19_event_log(spark, sf):
    path = work_path(spark, "events")
    ts = adapter.pings(spark, sf).select("event_id", F.col("timestamp").alias("_t"))
    rows = items(spark, sf).select("event_id", "situacao").join(ts, "event_id")
    sinks.append_events(rows.select("event_id", "situacao", "_t"), path, F.to_date(F.timestamp_seconds("_t")).cast("string"))
    return spark.read.parquet(path).groupBy(F.col("dia").cast("string").alias("dia"), "situacao").agg(F.count(F.lit(1)).alias("n"))


@register("s20_expired_days", "SELECT substr(ts_previsao, 1, 10) AS data, count(*) AS n FROM logrows WHERE substr(ts_previsao, 1, 10) < '2024-01-21' GROUP BY data", PROD_CTES)
def s20_expired_days(spark, sf):
    rows = sinks.with_day(scored_rows(spark, sf)[1])
    return sinks.expired_days(rows, date(2024, 4, 20), 90)


@register("s23_summary_tables", f"""
SELECT classe_atual AS classe, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in K.FEATURES)} FROM final GROUP BY classe_atual""")
def s23_summary_tables(spark, sf):
    path = work_path(spark, "summary")
    table = stages(spark, sf).final.groupBy(F.col("classe_atual").alias("classe")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in K.FEATURES])
    table.write.parquet(path)
    return rounded(spark.read.schema(table.schema).parquet(path))


@register("l5_alert_append", "SELECT '2024-01-31' AS data, regra, count(*) AS n FROM alert_rows GROUP BY ALL",
          ALL_CTES)
def l5_alert_append(spark, sf):
    path = work_path(spark, "alerts")
    sinks.append_alerts(all_alerts(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("data").cast("string").alias("data"), "regra").agg(F.count(F.lit(1)).alias("n"))


@register("p26_narrowed_metadata", """
SELECT msm_id AS id, interval, is_public, packets, target, target_ip, type, af, status FROM msm_dim""")
def p26_narrowed_metadata(spark, sf):
    m = adapter.measurements(spark, sf)
    # even ids carry the status as an object, odd ones as plain text
    doc = F.when(F.col("msm_id") % 2 == 0, F.to_json(F.struct(
        F.col("msm_id").alias("id"), "interval", "is_public", "packets", "target", "target_ip", "type", "af",
        F.struct(F.col("status").alias("name")).alias("status")))).otherwise(F.to_json(F.struct(
            F.col("msm_id").alias("id"), "interval", "is_public", "packets", "target", "target_ip", "type", "af", "status")))
    return readers.narrow_measurement(m.select(doc.alias("doc")), "doc")


@register("p26_narrowed_anchors", """
SELECT anchor_id AS id, fqdn, CASE WHEN trim(hostname) = '' THEN NULL ELSE hostname END AS hostname, ip_v4, asn_v4, country, lon, lat, is_disabled FROM anchor_dim""")
def p26_narrowed_anchors(spark, sf):
    """Anchor objects as the source writes them: nested geometry, a padded country, fields left out."""
    a = adapter.anchors(spark, sf)
    host = F.when(F.trim("hostname") != "", F.col("hostname"))
    off = F.when(F.col("is_disabled"), F.lit(True))  # left out where false
    doc = F.to_json(F.struct(
        F.col("anchor_id").alias("id"), "fqdn", host.alias("hostname"), "ip_v4", F.col("asn_v4").alias("as_v4"), F.concat(F.lit(" "), F.lower("country")).alias("country"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), off.alias("is_disabled"), F.lit("x").alias("extra")))
    return readers.narrow_anchor(a.select(doc.alias("doc")), "doc")


FLOW_ROWS = """
  SELECT t.*, CASE WHEN event_id % 3 <> 0 THEN '172.16.0.' || probe_id::VARCHAR END AS probe_ip FROM tagged t"""


@register("j9_enriched_rows", """
SELECT t.event_id, m.packets, coalesce(m.interval, 240) AS interval, coalesce(a.ip_v4, '0.0.0.0') AS anchor_ip FROM tagged t
LEFT JOIN msm_dim m ON m.msm_id = t.anchor_id * 10 + t.probe_id % 2 LEFT JOIN anchor_dim a ON a.anchor_id = t.anchor_id""")
def j9_enriched_rows(spark, sf):
    rows = adapter.pings(spark, sf).withColumn("msm_id", F.col("anchor_id") * 10 + F.col("probe_id") % 2)
    out = collection.enrich(rows, adapter.measurements(spark, sf), adapter.anchors(spark, sf), K.INTERVAL_S, "0.0.0.0")
    return out.select("event_id", "packets", "interval", "anchor_ip")


@register("j19_origin_addresses", """
SELECT f.id_fluxo, coalesce(arg_max(probe_ip, timestamp) FILTER (probe_ip IS NOT NULL), max(p.address_v4)) AS origem FROM flow_rows f
LEFT JOIN probe_dim p USING (probe_id) GROUP BY f.id_fluxo""", {"flow_rows": FLOW_ROWS})
def j19_origin_addresses(spark, sf):
    rows = adapter.pings(spark, sf).withColumn("probe_ip", F.when(
        F.col("event_id") % 3 != 0, F.concat(F.lit("172.16.0."), F.col("probe_id").cast("string"))))
    return collection.origin_address(rows, adapter.probes(spark, sf))


@register("j21_family_check", """
SELECT id_fluxo, count(*) FILTER (m.af IS DISTINCT FROM 4) AS violacoes FROM (SELECT DISTINCT id_fluxo, anchor_id, probe_id FROM pings) f
LEFT JOIN msm_dim m ON m.msm_id = f.anchor_id * 10 + f.probe_id % 2 GROUP BY id_fluxo""")
def j21_family_check(spark, sf):
    flows = adapter.pings(spark, sf).select("id_fluxo", "anchor_id", "probe_id").distinct().withColumn(
        "msm_id", F.col("anchor_id") * 10 + F.col("probe_id") % 2)
    return collection.family_violations(flows, adapter.measurements(spark, sf))


@register("j11_flow_continents", """
SELECT id_fluxo, coalesce(c.continent, 'desconhecido') AS continente FROM (SELECT DISTINCT id_fluxo, anchor_id FROM pings) f
LEFT JOIN (SELECT * FROM anchor_dim WHERE anchor_id <> 0) a USING (anchor_id) LEFT JOIN country_dim c USING (country)""")
def j11_flow_continents(spark, sf):
    flows = adapter.pings(spark, sf).select("id_fluxo", "anchor_id").distinct()
    known = Drift(spark, sf).continents
    return flows.join(known, "anchor_id", "left").select(
        "id_fluxo", F.coalesce("continente", F.lit(K.UNKNOWN_CONTINENT)).alias("continente"))
