"""Queries of the selection steps: anchors, measurements, probes, flow list."""

from __future__ import annotations

from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions.parse import slugs
from rttscope.functions.geo import distance_band, haversine_km
from rttscope.operators import quality, selection
from rttscope.plans.catalog import register, rounded, stages
from rttscope.session import materialise
from rttscope.sources import adapter

SUITED = "type = 'ping' AND af = 4 AND is_public AND status = 'Ongoing' AND msm_id IS NOT NULL AND interval IS NOT NULL"


def _haversine(lon1, lat1, lon2, lat2):
    return (
        f"CASE WHEN {lon1} IS NOT NULL AND {lon2} IS NOT NULL THEN round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))), 1) END"
    )


def _band(km):
    return f"CASE WHEN {km} < 4000 THEN 'curta' WHEN {km} < 10000 THEN 'media' WHEN {km} IS NOT NULL THEN 'longa' END"


SELECT_CTES = {
    "mesh": f"""
  SELECT anchor_id, list(msm_id ORDER BY msm_id) AS ids, first(interval ORDER BY msm_id) AS interval_segundos
  FROM msm_dim WHERE is_mesh AND {SUITED} GROUP BY anchor_id""",
    "classified": """
  SELECT a.* EXCLUDE (hostname), coalesce(nullif(trim(hostname), ''), nullif(split_part(trim(fqdn), '.', 1), '')) AS hostname,
    c.continent, c.region, m.ids, m.interval_segundos,
    CASE WHEN is_disabled THEN 'desativada' WHEN ip_v4 IS NULL THEN 'sem_ipv4' WHEN asn_v4 IS NULL THEN 'sem_asn_v4'
      WHEN m.ids IS NULL THEN 'sem_mesh_ipv4' WHEN c.continent IS NULL THEN 'pais_desconhecido'
      WHEN lon IS NULL OR lat IS NULL OR abs(lon) > 180 OR abs(lat) > 90 THEN 'sem_coordenadas'
      WHEN coalesce(nullif(trim(hostname), ''), fqdn) IS NULL THEN 'sem_hostname' ELSE 'elegivel' END AS motivo
  FROM anchor_dim a LEFT JOIN mesh m USING (anchor_id) LEFT JOIN country_dim c USING (country)""",
    "matched": """
  SELECT msm_id, a_id, interval, bool_or(por_nome) AS por_nome FROM (
    SELECT msm_id, interval, a.anchor_id AS a_id, true AS por_nome FROM msm_dim m JOIN anchor_dim a ON lower(m.target) = lower(a.fqdn)
    UNION ALL SELECT msm_id, interval, a.anchor_id, false FROM msm_dim m JOIN anchor_dim a ON m.target_ip = a.ip_v4) GROUP BY ALL""",
    "owned": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msm_id ORDER BY CASE WHEN nm = 1 AND NOT por_nome THEN 1 ELSE 0 END, a_id) AS nth
    FROM (SELECT *, count(*) FILTER (por_nome) OVER (PARTITION BY msm_id) AS nm FROM matched)) WHERE nth = 1""",
    "cand": f"""
  SELECT s.anchor_id, p.*, s.measurement_id, s.n_msm, {_haversine('t.lon', 't.lat', 'p.lon', 'p.lat')} AS distancia_km,
    {_band(_haversine('t.lon', 't.lat', 'p.lon', 'p.lat'))} AS distance_band,
    md5(concat_ws('|', '42', s.anchor_id::VARCHAR, p.probe_id::VARCHAR)) AS draw,
    count(p.lon) OVER (PARTITION BY s.anchor_id) AS n_cand
  FROM (SELECT o.a_id AS anchor_id, probe_id, min(msm_id) AS measurement_id, count(DISTINCT msm_id) AS n_msm
    FROM participant_dim JOIN owned o USING (msm_id) GROUP BY ALL) s
  JOIN probe_dim p USING (probe_id) JOIN (SELECT * FROM classified WHERE motivo = 'elegivel') t ON t.anchor_id = s.anchor_id
  WHERE p.is_public AND p.status = 'Connected' AND p.address_v4 IS NOT NULL""",
}


def _greedy() -> dict[str, str]:
    """Five chained rounds of the diversity pick."""
    out = {"st0": """
  SELECT anchor_id, n_cand, CASE WHEN n_cand < 3 THEN 1 WHEN n_cand < 5 THEN n_cand ELSE 5 END AS quota,
    CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS asns, CAST([] AS VARCHAR[]) AS bands, CAST([] AS VARCHAR[]) AS conts,
    CAST([] AS VARCHAR[]) AS ctrs, 0 AS common FROM (SELECT DISTINCT anchor_id, n_cand FROM cand WHERE lon IS NOT NULL)"""}
    for t in range(K.MAX_PROBES):
        out[f"st{t + 1}"] = f"""
  SELECT s.anchor_id, s.n_cand, s.quota, CASE WHEN b.pid IS NULL THEN s.ids ELSE list_append(s.ids, b.pid) END AS ids,
    CASE WHEN b.asn IS NULL THEN s.asns ELSE list_append(s.asns, b.asn) END AS asns,
    CASE WHEN b.pid IS NULL THEN s.bands ELSE list_append(s.bands, b.band) END AS bands,
    CASE WHEN b.pid IS NULL THEN s.conts ELSE list_append(s.conts, b.cont) END AS conts,
    CASE WHEN b.pid IS NULL THEN s.ctrs ELSE list_append(s.ctrs, b.ctr) END AS ctrs, s.common + coalesce(b.com, 0) AS common
  FROM st{t} s LEFT JOIN (
    SELECT s.anchor_id, c.probe_id AS pid, c.asn_v4 AS asn, c.distance_band AS band, c.continent AS cont, c.country AS ctr,
      (NOT c.is_anchor)::INTEGER AS com, row_number() OVER (PARTITION BY s.anchor_id ORDER BY
        CASE WHEN s.common < 1 THEN c.is_anchor::INTEGER ELSE 0 END,
        coalesce(list_contains(s.asns, c.asn_v4), false), list_contains(s.bands, c.distance_band),
        list_contains(s.conts, c.continent), list_contains(s.ctrs, c.country), c.draw, c.probe_id) AS r
    FROM st{t} s JOIN cand c ON c.anchor_id = s.anchor_id
    WHERE c.lon IS NOT NULL AND s.quota > {t} AND NOT list_contains(s.ids, c.probe_id)) b ON b.anchor_id = s.anchor_id AND b.r = 1"""
    out["chosen"] = """
  SELECT anchor_id, unnest(ids) AS probe_id, generate_subscripts(ids, 1) - 1 AS ordem, n_cand FROM st5"""
    return out


SELECT_CTES.update(_greedy())


class _Chain:
    """The selection tables of one folder, in order."""

    def __init__(self, spark, sf):
        self.anchors, self.msm = adapter.anchors(spark, sf), adapter.measurements(spark, sf)
        self.probes, self.parts = adapter.probes(spark, sf), adapter.participants(spark, sf)
        self.countries = adapter.countries(spark, sf)

    @property
    def classified(self):
        return selection.classify_anchors(self.anchors, selection.mesh_by_anchor(self.msm), self.countries)

    @property
    def eligible(self):
        return self.classified.where("motivo = 'elegivel'")

    @property
    def matched(self):
        return selection.match_targets(self.msm, self.anchors)

    @property
    def owned(self):
        return selection.single_owner(self.matched)

    @property
    def candidates(self):
        return selection.probe_candidates(self.parts, self.probes, self.eligible, self.owned)

    @property
    def chosen(self):
        return selection.pick_probes(materialise(self.candidates, "candidates"))


@register("p1_anchor_reasons", "SELECT motivo, count(*) AS n FROM classified GROUP BY motivo", SELECT_CTES)
def p1_anchor_reasons(spark, sf):
    return _Chain(spark, sf).classified.groupBy("motivo").agg(F.count(F.lit(1)).alias("n"))


@register("p1_eligible_anchors", """
SELECT anchor_id, hostname, ip_v4, country, asn_v4, continent, region, lon, lat, interval_segundos FROM classified WHERE motivo = 'elegivel'""", SELECT_CTES)
def p1_eligible_anchors(spark, sf):
    return _Chain(spark, sf).eligible.select(
        "anchor_id", "hostname", "ip_v4", "country", "asn_v4", "continent", "region",
        F.col("coords.lon").alias("lon"), F.col("coords.lat").alias("lat"), "interval_segundos")


@register("p2_suited_measurements", f"SELECT msm_id, coalesce({SUITED}, false) AS adequada FROM msm_dim")
def p2_suited_measurements(spark, sf):
    ok = F.coalesce(selection.suited_measurement(), F.lit(False)).alias("adequada")
    return adapter.measurements(spark, sf).select("msm_id", ok)


@register("p3_mesh_by_anchor", "SELECT anchor_id, array_to_string(ids, ',') AS medicoes, interval_segundos FROM mesh", SELECT_CTES)
def p3_mesh_by_anchor(spark, sf):
    mesh = selection.mesh_by_anchor(adapter.measurements(spark, sf))
    return mesh.select("anchor_id", F.array_join(F.transform("medicoes", lambda m: m["msm_id"].cast("string")), ",").alias("medicoes"),
                       F.col("medicoes")[0]["interval"].alias("interval_segundos"))


@register("p4_eligible_probes", """
SELECT probe_id, is_public AND status = 'Connected' AND address_v4 IS NOT NULL AND probe_id <> 7 AS elegivel FROM probe_dim""")
def p4_eligible_probes(spark, sf):
    return adapter.probes(spark, sf).select("probe_id", selection.eligible_probe(F.lit(7)).alias("elegivel"))


@register("p22_block_reason", f"""
SELECT msm_id, CASE WHEN af <> 4 THEN '{K.REASON_AF}' WHEN type <> 'ping' OR status <> 'Ongoing' THEN '{K.REASON_MSM_TYPE}'
  WHEN a.is_disabled THEN '{K.REASON_ANCHOR_OFF}' END AS motivo FROM msm_dim m JOIN anchor_dim a USING (anchor_id)""")
def p22_block_reason(spark, sf):
    c = _Chain(spark, sf)
    return c.msm.join(c.anchors.select("anchor_id", "is_disabled"), "anchor_id").select(
        "msm_id", selection.block_reason().alias("motivo"))


@register("p24_probe_candidates", "SELECT anchor_id, probe_id, measurement_id, n_msm, distancia_km, distance_band, continent FROM cand", SELECT_CTES)
def p24_probe_candidates(spark, sf):
    return _Chain(spark, sf).candidates.select(
        "anchor_id", "probe_id", "measurement_id", "n_msm", "distancia_km", "distance_band", "continent")


@register("p24_without_coordinates", "SELECT anchor_id, count(*) AS n, count(*) FILTER (lon IS NULL) AS sem_coordenadas FROM cand GROUP BY anchor_id", SELECT_CTES)
def p24_without_coordinates(spark, sf):
    return _Chain(spark, sf).candidates.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("coords").isNull()).alias("sem_coordenadas"))


@register("j3_anchors_with_mesh", "SELECT anchor_id, country, len(ids) AS n_medicoes FROM anchor_dim JOIN mesh USING (anchor_id)", SELECT_CTES)
def j3_anchors_with_mesh(spark, sf):
    c = _Chain(spark, sf)
    return c.anchors.join(selection.mesh_by_anchor(c.msm), "anchor_id").select(
        "anchor_id", "country", F.size("medicoes").cast("long").alias("n_medicoes"))


@register("j4_match_targets", "SELECT msm_id, a_id, por_nome FROM matched", SELECT_CTES)
def j4_match_targets(spark, sf):
    return _Chain(spark, sf).matched.select("msm_id", "a_id", "por_nome")


@register("j5_single_owner", "SELECT msm_id, a_id FROM owned", SELECT_CTES)
def j5_single_owner(spark, sf):
    return _Chain(spark, sf).owned.select("msm_id", "a_id")


@register("j6_mesh_differences", """
SELECT a_id, msm_id, 'faltante' AS situacao FROM (SELECT anchor_id AS a_id, unnest(ids) AS msm_id FROM mesh EXCEPT SELECT a_id, msm_id FROM owned)
UNION ALL SELECT a_id, msm_id, 'adicional' FROM (SELECT a_id, msm_id FROM owned EXCEPT SELECT anchor_id, unnest(ids) FROM mesh)""", SELECT_CTES)
def j6_mesh_differences(spark, sf):
    c = _Chain(spark, sf)
    expected = selection.mesh_by_anchor(c.msm).select(F.col("anchor_id").alias("a_id"), F.explode("medicoes.msm_id").alias("msm_id"))
    return selection.mesh_differences(expected, c.owned.select("a_id", "msm_id"))


@register("j7_participants", """
SELECT o.a_id AS anchor_id, probe_id, min(msm_id) AS measurement_id, count(DISTINCT msm_id) AS n_msm
FROM participant_dim JOIN owned o USING (msm_id) JOIN probe_dim USING (probe_id) GROUP BY ALL""", SELECT_CTES)
def j7_participants(spark, sf):
    c = _Chain(spark, sf)
    linked = c.parts.join(c.owned.select("msm_id", F.col("a_id").alias("anchor_id")), "msm_id").join(
        c.probes.select("probe_id"), "probe_id")
    return linked.groupBy("anchor_id", "probe_id").agg(
        F.min("msm_id").alias("measurement_id"), F.count_distinct("msm_id").alias("n_msm"))


@register("j8_flow_list", """
SELECT c.probe_id::VARCHAR || '_' || c.anchor_id::VARCHAR AS id_fluxo, k.measurement_id, false AS repetido, m.msm_id IS NULL AS ausente, m.af, m.interval
FROM chosen c JOIN cand k ON k.anchor_id = c.anchor_id AND k.probe_id = c.probe_id
LEFT JOIN (SELECT * FROM msm_dim WHERE msm_id % 4 <> 0) m ON m.msm_id = k.measurement_id""", SELECT_CTES)
def j8_flow_list(spark, sf):
    c = _Chain(spark, sf)
    flows = selection.flow_list(c.chosen, c.msm.where("msm_id % 4 <> 0"))
    return flows.select("id_fluxo", "measurement_id", "repetido", "ausente", "af", "interval")


@register("j22_published", "SELECT a_id, count(*) AS n_medicoes, string_agg(msm_id::VARCHAR, ',' ORDER BY msm_id) AS medicoes FROM owned GROUP BY a_id", SELECT_CTES)
def j22_published(spark, sf):
    out = selection.published(_Chain(spark, sf).owned)
    return out.withColumn("medicoes", F.array_join(F.transform("medicoes", lambda m: m["msm_id"].cast("string")), ","))


@register("u1_search_union", """
SELECT msm_id, lower(type) AS type FROM (SELECT * FROM msm_dim WHERE target LIKE '%.%' UNION SELECT * FROM msm_dim WHERE target_ip IS NOT NULL)""")
def u1_search_union(spark, sf):
    m = adapter.measurements(spark, sf)
    both = m.where("target like '%.%'").unionByName(m.where("target_ip is not null")).dropDuplicates(["msm_id"])
    return both.select("msm_id", F.lower("type").alias("type"))


PICKED = {
    "home_anchor": "SELECT lon, lat, anchor_id FROM classified WHERE motivo = 'elegivel' AND country = 'BR' ORDER BY md5(concat_ws('|', '42', anchor_id::VARCHAR)), anchor_id LIMIT 1",
    "open_countries": """
  SELECT *, row_number() OVER (PARTITION BY continent ORDER BY country) AS nth FROM (
    SELECT DISTINCT country, continent FROM classified WHERE motivo = 'elegivel')""",
    # few networks shared by many countries could leave a country empty; that bound is min(networks x 2, countries)
    "places": """
  SELECT least(30, (SELECT count(*) FROM open_countries WHERE continent <> 'Europa' OR nth <= 6),
    2 * (SELECT count(DISTINCT asn_v4) FROM classified WHERE motivo = 'elegivel')) AS n""",
}


@register("k4_rules", """
SELECT (SELECT n FROM places) AS lugares, (SELECT n FROM places) AS paises, 1 AS da_casa, true AS origem_sorteada, true AS todas_elegiveis,
  true AS asn_no_limite, (SELECT count(DISTINCT continent) FROM open_countries) AS continentes, true AS europa_no_teto, true AS cotas_cumpridas,
  (SELECT count(DISTINCT b) FROM (SELECT """ + _band(_haversine('o.lon', 'o.lat', 'c.lon', 'c.lat')) + """ AS b FROM classified c, home_anchor o WHERE motivo = 'elegivel')) AS faixas,
  true AS distancias_certas""", {**SELECT_CTES, **PICKED})
def k4_rules(spark, sf):
    """The choice against its rules: counts beside what the eligible anchors allow, every anchor looked up again."""
    eligible = materialise(_Chain(spark, sf).eligible, "eligible")
    chosen = selection.pick_anchors(eligible)
    there = eligible.select("anchor_id", F.col("asn_v4").alias("asn"), F.col("country").alias("pais"), F.col("coords").alias("onde"))
    home = chosen.where("country = 'BR'").select(F.col("anchor_id").alias("home_id"), F.col("coords").alias("home_at"))
    drawn = eligible.where("country = 'BR'").selectExpr("min_by(anchor_id, struct(md5(concat_ws('|', '42', cast(anchor_id as string))), anchor_id)) as drawn")
    rows = chosen.join(there, "anchor_id", "left").join(home.join(drawn), F.lit(True))  # one row
    km = haversine_km(F.col("home_at"), F.col("onde"))
    right = (F.abs(km - F.col("distancia_km")) < 1e-9) & (distance_band(km) == F.col("faixa_distancia"))
    per = rows.groupBy("asn_v4").agg(F.count("*").alias("k")).agg(F.max("k") <= 2).scalar()
    open_ = eligible.groupBy("continent").agg(F.count_distinct("country").alias("paises"))
    quota = F.create_map(*[F.lit(x) for kv in K.CONTINENT_QUOTAS.items() for x in kv])[F.col("continent")]
    short = open_.join(chosen.groupBy("continent").agg(F.count("*").alias("k")), "continent", "left").where(
        F.coalesce("k", F.lit(0)) < F.least("paises", F.greatest(F.coalesce(quota, F.lit(0)), F.lit(1))))
    return rows.agg(
        F.count("*").alias("lugares"), F.count_distinct("country").alias("paises"), F.count_if(F.col("country") == "BR").alias("da_casa"),
        F.bool_and(F.expr("home_id = drawn")).alias("origem_sorteada"), F.bool_and(F.expr("asn = asn_v4 and pais = country")).alias("todas_elegiveis"), F.first(per).alias("asn_no_limite"),
        F.count_distinct("continent").alias("continentes"), (F.count_if(F.col("continent") == K.EUROPE) <= K.MAX_EUROPE).alias("europa_no_teto"),
        F.first(short.agg(F.count("*") == 0).scalar()).alias("cotas_cumpridas"), F.count_distinct("faixa_distancia").alias("faixas"), F.bool_and(right).alias("distancias_certas"))


@register("k4_quota_anchors", """
SELECT country, continent, 1 AS lugares, true AS elegivel, country = 'BR' AS origem, CASE WHEN country = 'BR' THEN 0.0::DOUBLE END AS distancia_km
FROM open_countries WHERE continent <> 'Europa' OR nth <= 6""", {**SELECT_CTES, **PICKED})
def k4_quota_anchors(spark, sf):
    """One place per country; the check expects every country that has an eligible anchor, which are fewer than the places."""
    eligible = materialise(_Chain(spark, sf).eligible, "eligible")
    chosen = selection.pick_anchors(eligible)
    there = eligible.select("anchor_id", "country", F.lit(True).alias("elegivel"))
    rows = chosen.join(there, ["anchor_id", "country"], "left").withColumn("origem", F.col("country") == "BR")
    return rows.groupBy("country", "continent", "origem").agg(
        F.count("*").cast("int").alias("lugares"), F.bool_and(F.coalesce("elegivel", F.lit(False))).alias("elegivel"), F.max(F.when(F.col("origem"), F.col("distancia_km"))).alias("distancia_km"))


@register("k5_selection_criteria", """
SELECT n = 30 AS total_ok, true AS pais_unico, true AS um_da_casa,
  (SELECT count(DISTINCT b) = 3 FROM (SELECT """ + _band(_haversine('o.lon', 'o.lat', 'c.lon', 'c.lat')) + """ AS b FROM classified c, home_anchor o WHERE motivo = 'elegivel')) AS tres_faixas,
  true AS teto_europa, true AS asn_ok FROM places""", {**SELECT_CTES, **PICKED})
def k5_selection_criteria(spark, sf):
    chosen = selection.pick_anchors(materialise(_Chain(spark, sf).eligible, "eligible"))
    return selection.selection_criteria(chosen, asn_limit=K.MAX_PER_ASN_FALLBACK)


@register("k6_probe_choice", "SELECT anchor_id, probe_id, ordem, n_cand AS n_candidatas, n_cand < 3 AS poucas_origens FROM chosen", SELECT_CTES)
def k6_probe_choice(spark, sf):
    return _Chain(spark, sf).chosen.select("anchor_id", "probe_id", "ordem", "n_candidatas", "poucas_origens")


@register("k7_validate_probes", """
SELECT t.anchor_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'sem_probe' ELSE '' END AS problemas
FROM (SELECT anchor_id FROM classified WHERE motivo = 'elegivel') t LEFT JOIN (SELECT anchor_id, count(*) AS n FROM chosen GROUP BY anchor_id) c USING (anchor_id)""", SELECT_CTES)
def k7_validate_probes(spark, sf):
    c = _Chain(spark, sf)
    return selection.validate_probes(materialise(c.chosen, "chosen"), c.eligible)


@register("k15_anchor_sample", """
SELECT anchor_id, n_medicoes, list_aggregate(ids[1:1], 'string_agg', ',') AS medicoes FROM (
  SELECT anchor_id, len(ids) AS n_medicoes, ids, row_number() OVER (ORDER BY md5(concat_ws('|', '42', anchor_id::VARCHAR)), anchor_id) AS h,
    row_number() OVER (ORDER BY (country <> 'BR')::INTEGER, anchor_id) AS f FROM classified WHERE motivo = 'elegivel')
WHERE h <= 4 OR f = 1""", SELECT_CTES)
def k15_anchor_sample(spark, sf):
    out = selection.anchor_sample(_Chain(spark, sf).eligible, 5, 1)
    return out.select("anchor_id", F.col("n_medicoes").cast("long").alias("n_medicoes"),
                      F.array_join(F.transform("medicoes", lambda m: m["msm_id"].cast("string")), ",").alias("medicoes"))


@register("f17_distances", f"""
SELECT a.anchor_id, {_haversine('0.0', '0.0', 'a.lon', 'a.lat')} AS km, {_band(_haversine('0.0', '0.0', 'a.lon', 'a.lat'))} AS faixa FROM anchor_dim a""")
def f17_distances(spark, sf):
    from rttscope.functions.geo import coordinates
    here = F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    rows = adapter.anchors(spark, sf).withColumn("km", haversine_km(here, coordinates(F.col("lon"), F.col("lat"))))
    return rows.select("anchor_id", "km", distance_band(F.col("km")).alias("faixa"))


@register("f27_country_map", "SELECT anchor_id, country, continent, region FROM anchor_dim LEFT JOIN country_dim USING (country)")
def f27_country_map(spark, sf):
    c = adapter.countries(spark, sf).select("country", "continent", "region")
    return adapter.anchors(spark, sf).join(c, "country", "left").select("anchor_id", "country", "continent", "region")


@register("f28_tag_slugs", """
SELECT s AS slug, count(*) AS n FROM (SELECT unnest(['seg-' || lower(c_mktsegment), 'home']) AS s FROM customer) GROUP BY s""")
def f28_tag_slugs(spark, sf):
    tags = adapter.probes(spark, sf).select(F.explode(slugs("tags")).alias("slug"))
    return tags.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


@register("g25_strata", """
SELECT 'continent' AS dimensao, continent AS valor, count(*) AS n FROM classified WHERE motivo = 'elegivel' GROUP BY ALL
UNION ALL SELECT 'region', region, count(*) FROM classified WHERE motivo = 'elegivel' GROUP BY ALL
UNION ALL SELECT 'asn_v4', asn_v4::VARCHAR, count(*) FROM classified WHERE motivo = 'elegivel' GROUP BY ALL
UNION ALL SELECT 'interval_segundos', interval_segundos::VARCHAR, count(*) FROM classified WHERE motivo = 'elegivel' GROUP BY ALL""", SELECT_CTES)
def g25_strata(spark, sf):
    return quality.strata(_Chain(spark, sf).eligible, ["continent", "region", "asn_v4", "interval_segundos"])


STRATA = ("continent", "region", "asn_v4", "interval_segundos", "faixa")


@register("g25_strata_summary", " UNION ALL ".join(f"""
SELECT '{d}' AS dimensao, sum(n)::BIGINT AS linhas, count(*) AS n_valores, max(n) AS maior, max(paises) AS mais_paises FROM (
  SELECT {d}, count(*) AS n, count(DISTINCT country) AS paises FROM banded_anchors WHERE {d} IS NOT NULL GROUP BY {d})""" for d in STRATA) + """
UNION ALL SELECT 'intervalos_divergentes', count(*) FILTER (k > 1), count(*), max(k), count(DISTINCT country) FILTER (k > 1) FROM (
  SELECT c.anchor_id, any_value(c.country) AS country, count(DISTINCT m.interval) AS k FROM classified c JOIN msm_dim m ON m.anchor_id = c.anchor_id AND m.is_mesh AND """
    + SUITED.replace("interval IS", "m.interval IS").replace("msm_id IS", "m.msm_id IS") + """ WHERE motivo = 'elegivel' GROUP BY c.anchor_id)""", {**SELECT_CTES, **PICKED, "banded_anchors": f"""
  SELECT c.*, {_band(_haversine('o.lon', 'o.lat', 'c.lon', 'c.lat'))} AS faixa FROM classified c, home_anchor o WHERE motivo = 'elegivel'"""})
def g25_strata_summary(spark, sf):
    """Strata of the eligible anchors: values, the largest, countries, and anchors whose mesh measurements differ in interval."""
    eligible = materialise(_Chain(spark, sf).eligible, "eligible")
    home = eligible.where("country = 'BR'").selectExpr("min_by(coords, struct(md5(concat_ws('|', '42', cast(anchor_id as string))), anchor_id)) as c").scalar()
    rows = eligible.withColumn("faixa", distance_band(haversine_km(home, F.col("coords"))))
    kinds = F.size(F.array_distinct(F.transform("medicoes", lambda m: m["interval"])))
    counted = eligible.select("country", kinds.alias("k")).agg(
        F.count_if(F.col("k") > 1).alias("linhas"), F.count(F.lit(1)).alias("n_valores"), F.max("k").cast("long").alias("maior"),
        F.count_distinct(F.when(F.col("k") > 1, F.col("country"))).alias("mais_paises"))
    return quality.strata_summary(rows, list(STRATA)).unionByName(counted.withColumn("dimensao", F.lit("intervalos_divergentes")))


@register("g32_selection_totals", """
SELECT '2' AS stage, '' AS key, unnest(['medicoes', 'aptas', 'com_anchor', 'anchors_com_mesh']) AS metric, unnest([a, b, c, d])::DOUBLE AS value FROM (
  SELECT (SELECT count(*) FROM msm_dim) AS a, (SELECT count(*) FROM msm_dim WHERE """ + SUITED + """) AS b, (SELECT count(*) FROM owned) AS c, (SELECT count(*) FROM mesh) AS d)
UNION ALL SELECT '3', '', unnest(['candidatas', 'anchors', 'fluxos', 'probes']), unnest([a, b, c, d])::DOUBLE FROM (
  SELECT (SELECT count(*) FROM cand) AS a, (SELECT count(DISTINCT anchor_id) FROM chosen) AS b, (SELECT count(*) FROM chosen) AS c, (SELECT count(DISTINCT probe_id) FROM chosen) AS d)
UNION ALL SELECT '3', anchor_id::VARCHAR, 'poucas_origens', count(*)::DOUBLE FROM chosen WHERE n_cand < 3 GROUP BY anchor_id""", SELECT_CTES)
def g32_selection_totals(spark, sf):
    """Totals of the measurement and probe steps in the long layout."""
    c = _Chain(spark, sf)
    one = F.count(F.lit(1))
    found = materialise(c.candidates, "candidates")
    chosen = materialise(selection.pick_probes(found), "chosen")
    parts = [
        quality.long_metrics(c.msm, "2", {"medicoes": one, "aptas": F.count_if(selection.suited_measurement())}),
        quality.long_metrics(c.owned, "2", {"com_anchor": one}), quality.long_metrics(selection.mesh_by_anchor(c.msm), "2", {"anchors_com_mesh": one}),
        quality.long_metrics(found, "3", {"candidatas": one}),
        quality.long_metrics(chosen, "3", {"anchors": F.count_distinct("anchor_id"), "fluxos": one, "probes": F.count_distinct("probe_id")}),
        quality.long_metrics(chosen.where("poucas_origens"), "3", {"poucas_origens": one}, ["anchor_id"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("p20_constants", " UNION ALL ".join(
    f"SELECT '{c}' AS coluna, count(DISTINCT {c}) AS n_valores, min({c}::VARCHAR) AS primeiro, max({c}::VARCHAR) AS ultimo, count(DISTINCT {c}) > 1 AS divergente, CASE WHEN count(DISTINCT {c}) <= 20 THEN array_to_string(list_sort(list(DISTINCT {c}::VARCHAR)), ',') END AS valores FROM msm_dim"
    for c in adapter.MEASUREMENT_COLUMNS))
def p20_constants(spark, sf):
    return quality.constants(adapter.measurements(spark, sf), list(adapter.MEASUREMENT_COLUMNS)).withColumn("valores", F.array_join("valores", ","))


@register("p21_live_checklist", """
SELECT c.probe_id::VARCHAR || '_' || c.anchor_id::VARCHAR AS id_fluxo, p.status = 'Connected' AS probe_conectada, NOT a.is_disabled AS anchor_ativa,
  coalesce(a.ip_v4 = CASE WHEN c.anchor_id % 3 = 0 THEN '0.0.0.0' ELSE a.ip_v4 END, false) AS mesmo_ip, m.status = 'Ongoing' AS medicao_em_andamento,
  p.status = 'Connected' AND NOT a.is_disabled AND coalesce(a.ip_v4 = CASE WHEN c.anchor_id % 3 = 0 THEN '0.0.0.0' ELSE a.ip_v4 END, false) AND m.status = 'Ongoing' AS apto
FROM chosen c JOIN cand k ON k.anchor_id = c.anchor_id AND k.probe_id = c.probe_id JOIN probe_dim p ON p.probe_id = c.probe_id
JOIN anchor_dim a ON a.anchor_id = c.anchor_id JOIN msm_dim m ON m.msm_id = k.measurement_id""", SELECT_CTES)
def p21_live_checklist(spark, sf):
    c = _Chain(spark, sf)
    flows = c.chosen.withColumn("id_fluxo", F.concat_ws("_", "probe_id", "anchor_id")).join(
        c.anchors.select("anchor_id", "ip_v4"), "anchor_id").withColumn(
        # every third anchor is given an address that changed since the flow was chosen
        "anchor_ip", F.when(F.col("anchor_id") % 3 == 0, "0.0.0.0").otherwise(F.col("ip_v4"))).drop("ip_v4")
    out = selection.live_checklist(flows, c.probes, c.anchors, c.msm)
    return out.select("id_fluxo", "probe_conectada", "anchor_ativa", "mesmo_ip", "medicao_em_andamento", "apto")


@register("p19_local_candidates", """
SELECT id_fluxo, classe_fluxo, concat_ws('; ', CASE WHEN coalesce(n_rtt_validos_A, 0) < 460 THEN 'baseline não é VALIDO' END,
  CASE WHEN probe_id = 2 THEN 'fluxo excluído' END) AS motivos, coalesce(n_rtt_validos_A, 0) >= 460 AND probe_id <> 2 AS candidato
FROM classes LEFT JOIN (SELECT id_fluxo, n_rtt_validos_A FROM baseline) USING (id_fluxo)""")
def p19_local_candidates(spark, sf):
    s = stages(spark, sf)
    base = s.baseline.where("n_rtt_validos_A >= 460")
    return selection.local_candidates(s.classes, base, s.classes.where("probe_id = 2"))
