"""Choice of anchors, measurements and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions.geo import coordinates, distance_band, haversine_km
from rttscope.functions.label import first_match
from rttscope.functions.parse import text_or_null
from rttscope.functions.privacy import seeded_order
from rttscope.operators.assignment import assign
from rttscope.session import materialise


# ---------------------------------------------------------------- measurements
def suited_measurement() -> Column:
    """Public, ongoing IPv4 ping with an id and an interval."""
    c = F.col
    return (
        (c("type") == K.PING) & (c("af") == K.ADDRESS_FAMILY) & c("is_public")
        & (c("status") == K.STATUS_ONGOING) & c("msm_id").isNotNull() & c("interval").isNotNull()
    )


def block_reason(af="af", type_="type", status="status", disabled="is_disabled") -> Column:
    """Why a measurement may not be used: family, then type or status, then its anchor."""
    return first_match([
        (~F.col(af).eqNullSafe(K.ADDRESS_FAMILY), K.REASON_AF),
        (~(F.col(type_).eqNullSafe(K.PING) & F.col(status).eqNullSafe(K.STATUS_ONGOING)), K.REASON_MSM_TYPE),
        (~F.col(disabled).eqNullSafe(False), K.REASON_ANCHOR_OFF),
    ])


def mesh_by_anchor(msm: DataFrame) -> DataFrame:
    """Suited mesh measurements per anchor, the anchor id taken from the target address.

    An anchor has a handful of measurements, so the sorted list stays small.
    """
    target = F.regexp_extract("target_url", r"/(\d+)/?$", 1).try_cast("bigint")
    rows = msm.where(F.col("is_mesh") & suited_measurement()).withColumn("anchor_id", target)
    return rows.where("anchor_id is not null").groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("msm_id", "interval"))).alias("medicoes")
    )


def match_targets(msm: DataFrame, anchors: DataFrame) -> DataFrame:
    """Measurements of each anchor by name or by address: two equi joins, then a union."""
    left = msm.withColumn("_name", F.lower("target"))
    right = anchors.select(F.col("anchor_id").alias("a_id"), F.lower("fqdn").alias("_fqdn"), "ip_v4")
    cols = [*[c for c in msm.columns if c != "anchor_id"], "a_id", "por_nome"]
    by_name = left.join(right, F.col("_name") == F.col("_fqdn")).withColumn("por_nome", F.lit(True))
    by_ip = left.join(right, F.col("target_ip") == F.col("ip_v4")).withColumn("por_nome", F.lit(False))
    merged = by_name.select(*cols).unionByName(by_ip.select(*cols))
    return merged.groupBy(*[c for c in cols if c != "por_nome"]).agg(F.bool_or("por_nome").alias("por_nome"))


def single_owner(matched: DataFrame) -> DataFrame:
    """Keep one anchor per measurement: the only name match, else the smallest id."""
    names = F.count_if("por_nome").over(Window.partitionBy("msm_id"))
    rows = matched.withColumn("_pick", F.when(names == 1, (~F.col("por_nome")).cast("int")).otherwise(0))
    w = Window.partitionBy("msm_id").orderBy("_pick", "a_id")
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "_pick")


def mesh_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Mesh ids missing from the search result, and found ids that are not mesh."""
    missing = expected.join(found, ["a_id", "msm_id"], "left_anti").withColumn("situacao", F.lit("faltante"))
    extra = found.join(expected, ["a_id", "msm_id"], "left_anti").withColumn("situacao", F.lit("adicional"))
    cols = ["a_id", "msm_id", "situacao"]
    return missing.select(*cols).unionByName(extra.select(*cols))


def published(owned: DataFrame) -> DataFrame:
    """Measurements per anchor in id order."""
    return owned.groupBy("a_id").agg(
        F.count(F.lit(1)).alias("n_medicoes"),
        F.sort_array(F.collect_list(F.struct("msm_id", "interval"))).alias("medicoes"),
    )


# ---------------------------------------------------------------- anchors
def classify_anchors(anchors: DataFrame, mesh: DataFrame, countries: DataFrame) -> DataFrame:
    """Each anchor with its first failed requirement, or ``elegivel``."""
    place = countries.select("country", "continent", "region").dropDuplicates(["country"])
    rows = anchors.withColumn("country", F.upper(text_or_null("country"))).join(mesh, "anchor_id", "left")
    rows = rows.join(place, "country", "left")
    host = F.coalesce(text_or_null("hostname"), F.split_part(text_or_null("fqdn"), F.lit("."), F.lit(1)))
    rows = rows.withColumns({
        "coords": coordinates(F.col("lon"), F.col("lat")), "hostname": host,
        "interval_segundos": F.col("medicoes")[0]["interval"],
    })
    return rows.withColumn("motivo", first_match([
        (F.coalesce("is_disabled", F.lit(False)), "desativada"),
        (text_or_null("ip_v4").isNull(), "sem_ipv4"),
        (F.col("asn_v4").isNull(), "sem_asn_v4"),
        (F.col("medicoes").isNull(), "sem_mesh_ipv4"),
        (F.col("continent").isNull(), "pais_desconhecido"),
        (F.col("coords").isNull(), "sem_coordenadas"),
        (F.col("hostname").isNull(), "sem_hostname"),
    ], "elegivel"))


def pick_anchors(eligible: DataFrame, home: str = K.HOME_COUNTRY, seed: int = K.SEED) -> DataFrame:
    """Quota selection: one anchor per country, at most one per ASN, or two where one is too few.

    The home country's anchor is drawn first and is the origin of all distances.  The others are a largest
    assignment of countries to networks, so no country goes empty whose network could be had by an exchange.
    Of those, continent minima and the first of each distance band come before free places, which go to the
    emptiest band; Europe is cut at its ceiling, and every continent that is present gets a place.
    """
    order = [seeded_order(seed, "anchor_id"), F.col("anchor_id")]
    origin = materialise(_best(eligible.where(F.col("country") == home), ["country"], order), "origin-anchor")
    km = haversine_km(origin.select("coords").scalar(), F.col("coords"))
    placed = eligible.where(F.col("country") != home).unionByName(origin).withColumn("distancia_km", km)
    placed = materialise(placed.withColumn("faixa_distancia", distance_band(F.col("distancia_km"))), "placed-anchors")
    held = None
    for limit in (K.MAX_PER_ASN, K.MAX_PER_ASN_FALLBACK):
        held = _one_per_country(placed, origin, limit, order, held)
        one = placed.join(held.select(F.col("item").alias("anchor_id")), "anchor_id", "left_semi")
        chosen = materialise(_fill(placed, one, home, order), "chosen-anchors")
        if all(selection_criteria(chosen, home, limit).first()):
            break
    return chosen


def _best(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _one_per_country(placed: DataFrame, origin: DataFrame, limit: int, order: list[Column], start: DataFrame | None) -> DataFrame:
    """A largest assignment of countries to networks, from the one with a smaller limit if there is one.

    Among so many places, a country with as many networks as places always finds a free one, so each keeps its
    first ``TOTAL_ANCHORS`` networks per distance band: a table of a bounded number of rows.  Bands that few
    countries have are preferred.  Europe takes part with no more countries than may be chosen: where it has
    more, the assignment is made again without the others, whose networks may serve someone else.
    """
    others = placed.join(origin.select("country"), "country", "left_anti")
    few = others.groupBy(F.col("faixa_distancia").alias("_band")).agg(F.count_distinct("country").alias("_few"))
    named = _best(others, ["country", "faixa_distancia", "asn_v4"], order)
    named = _best(named, ["country", "faixa_distancia"], order, K.TOTAL_ANCHORS)
    # without a home anchor no distance is known, and all are of one band
    named = named.join(few, F.col("faixa_distancia").eqNullSafe(F.col("_band"))).drop("_band")
    named = _best(named, ["country", "asn_v4"], [F.col("_few"), *order])
    pref = F.row_number().over(Window.partitionBy("country").orderBy("_few", *order))
    options = materialise(named.select(
        F.col("country").alias("owner"), F.col("asn_v4").cast("long").alias("place"), F.col("anchor_id").cast("long").alias("item"), pref.alias("pref"), "continent",
    ), "anchor-options")
    first = origin.select(F.col("country").alias("owner"), F.col("asn_v4").cast("long").alias("place"), F.lit(1).alias("slot"), F.col("anchor_id").cast("long").alias("item"))
    held = assign(options.drop("continent"), limit, first, start)
    europe = options.where(F.col("continent") == K.EUROPE).join(held, ["owner", "item"], "left_semi").select("owner").distinct()
    if europe.count() > K.MAX_EUROPE:
        stay = europe.orderBy(F.md5("owner"), "owner").limit(K.MAX_EUROPE)
        fits = options.where(F.col("continent") != K.EUROPE).unionByName(options.join(stay, "owner", "left_semi"))
        held = assign(fits.drop("continent"), limit, first, held)
    return held


def _fill(placed: DataFrame, one: DataFrame, home: str, order: list[Column]) -> DataFrame:
    """The places: home, first of each band, continent minima, then free ones, each to the band with fewest."""
    at_home = (F.col("country") != home).cast("int")
    in_band = Window.partitionBy("faixa_distancia").orderBy(at_home, *order)
    rows = one.withColumn("_later", (F.row_number().over(in_band) > 1).cast("int"))
    in_continent = Window.partitionBy("continent").orderBy(at_home, "_later", *order)
    rows = rows.withColumn("_c", F.row_number().over(in_continent))
    quota = F.create_map(*[F.lit(x) for kv in K.CONTINENT_QUOTAS.items() for x in kv])[F.col("continent")]
    quota = F.greatest(F.coalesce(quota, F.lit(0)), F.lit(1))
    rows = rows.withColumn("_must", (F.col("country") == home) | (F.col("_later") == 0) | (F.col("_c") <= quota))
    rows = rows.where((F.col("continent") != K.EUROPE) | (F.col("_c") <= K.MAX_EUROPE))
    per_band = Window.partitionBy("faixa_distancia")
    free = Window.partitionBy("faixa_distancia", "_must").orderBy(*order)
    level = F.when(F.col("_must"), 0).otherwise(F.count_if("_must").over(per_band) + F.row_number().over(free))
    names = F.array(*[F.lit(b) for b in K.BANDS])
    rows = rows.withColumn("_level", level).withColumn("_band", F.array_position(names, F.col("faixa_distancia")))
    return rows.orderBy("_level", at_home, "_band", *order).limit(K.TOTAL_ANCHORS).select(*placed.columns)


def selection_criteria(chosen: DataFrame, home: str = K.HOME_COUNTRY, asn_limit: int = K.MAX_PER_ASN) -> DataFrame:
    """One row of pass/fail criteria for a selection."""
    per_asn = chosen.groupBy("asn_v4").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("m"))
    row = chosen.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("country").alias("paises"),
        F.count_if(F.col("country") == home).alias("casa"),
        F.count_distinct("faixa_distancia").alias("faixas"),
        F.count_if(F.col("continent") == K.EUROPE).alias("europa"),
    )
    return row.select(
        (F.col("n") == K.TOTAL_ANCHORS).alias("total_ok"), (F.col("paises") == F.col("n")).alias("pais_unico"),
        (F.col("casa") == 1).alias("um_da_casa"), (F.col("faixas") == len(K.BANDS)).alias("tres_faixas"),
        (F.col("europa") <= K.MAX_EUROPE).alias("teto_europa"),
        (F.coalesce(per_asn.scalar(), F.lit(0)) <= asn_limit).alias("asn_ok"),
    )


# ---------------------------------------------------------------- probes
def eligible_probe(target_probe: Column | None = None) -> Column:
    """Public, connected, with an IPv4 address, and not the target itself."""
    ok = F.col("is_public") & (F.col("status") == K.STATUS_CONNECTED) & F.col("address_v4").isNotNull()
    return ok if target_probe is None else ok & ~F.coalesce(F.col("probe_id") == target_probe, F.lit(False))


def probe_candidates(participants: DataFrame, probes: DataFrame, targets: DataFrame, owned: DataFrame) -> DataFrame:
    """Eligible probes per anchor with distance, band and the measurements they serve."""
    linked = participants.join(owned.select("msm_id", F.col("a_id").alias("anchor_id")), "msm_id")
    served = linked.groupBy("anchor_id", "probe_id").agg(
        F.min("msm_id").alias("measurement_id"), F.count_distinct("msm_id").alias("n_msm")
    )
    place = targets.select("anchor_id", F.col("coords").alias("_target"))
    rows = served.join(probes.where(eligible_probe()), "probe_id").join(place, "anchor_id")
    rows = rows.withColumn("coords", coordinates(F.col("lon"), F.col("lat")))
    km = F.when(F.col("coords").isNotNull(), haversine_km(F.col("_target"), F.col("coords")))
    return rows.withColumn("distancia_km", km).withColumn(
        "distance_band", distance_band(F.col("distancia_km"))
    ).drop("_target")


def pick_probes(candidates: DataFrame, seed: int = K.SEED) -> DataFrame:
    """Up to five diverse probes per anchor, chosen greedily.

    Fewer than three candidates give one (flagged), three or four are all kept.  Candidates
    alike in all scored attributes differ by their draw only, so no more than the first five
    of each such class can be chosen; that limit runs inside each task before the shuffle.
    The five rounds score this small table against one written state row per anchor and take
    the minimum with a map-side combined aggregate.  A missing country, continent or band is
    a value of its own; a missing ASN never counts as used.  ``candidates`` should be a
    written table.
    """
    draw = seeded_order(seed, "anchor_id", "probe_id")
    rows = candidates.where("coords is not null").select(
        "anchor_id", "probe_id", "asn_v4", "distance_band", "continent", "country", "is_anchor",
        "measurement_id", "distancia_km", draw.alias("_draw"),
    )
    alike = Window.partitionBy("anchor_id", "is_anchor", "asn_v4", "distance_band", "continent", "country")
    first = rows.withColumn("_r", F.row_number().over(alike.orderBy("_draw", "probe_id")))
    first = materialise(first.where(F.col("_r") <= K.MAX_PROBES).drop("_r"), "probe-classes")
    sizes = rows.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n_candidatas"))
    state = sizes.withColumn(
        "quota",
        F.when(F.col("n_candidatas") < K.MIN_PROBES, K.PROBES_WHEN_FEW)
        .when(F.col("n_candidatas") < K.MAX_PROBES, F.col("n_candidatas")).otherwise(K.MAX_PROBES),
    ).withColumns({
        "_ids": F.array().cast("array<bigint>"), "_asn": F.array().cast("array<bigint>"),
        "_band": F.array().cast("array<string>"), "_cont": F.array().cast("array<string>"),
        "_country": F.array().cast("array<string>"), "_common": F.lit(0),
    })
    state = materialise(state, "probe-state")

    def used(name, value):
        """Whether the list holds the value, a missing one included."""
        return F.exists(name, lambda x: x.eqNullSafe(F.col(value))).cast("int")

    for turn in range(K.MAX_PROBES):
        joined = first.join(state, "anchor_id").where(
            (F.col("quota") > turn) & ~F.array_contains("_ids", F.col("probe_id"))
        )
        score = F.struct(
            F.when(F.col("_common") < 1, F.col("is_anchor").cast("int")).otherwise(0).alias("s1"),
            F.coalesce(F.array_contains("_asn", F.col("asn_v4")), F.lit(False)).cast("int").alias("s2"),
            used("_band", "distance_band").alias("s3"), used("_cont", "continent").alias("s4"),
            used("_country", "country").alias("s5"),
            F.col("_draw").alias("draw"), F.col("probe_id").alias("id"), F.col("asn_v4").alias("asn"),
            F.col("distance_band").alias("band"), F.col("continent").alias("cont"),
            F.col("country").alias("country"), (~F.col("is_anchor")).cast("int").alias("common"),
        )
        best = joined.groupBy("anchor_id").agg(F.min(score).alias("b"))
        state = materialise(state.join(best, "anchor_id", "left").select(
            "anchor_id", "n_candidatas", "quota",
            *[
                F.when(F.col("b").isNull(), F.col(c)).otherwise(F.array_append(c, F.col(f"b.{f}"))).alias(c)
                for c, f in (("_ids", "id"), ("_asn", "asn"), ("_band", "band"), ("_cont", "cont"), ("_country", "country"))
            ],
            (F.col("_common") + F.coalesce("b.common", F.lit(0))).alias("_common"),
        ), "probe-state")
    picked = state.select("anchor_id", "n_candidatas", F.posexplode("_ids").alias("ordem", "probe_id"))
    kept = rows.drop("_draw").join(picked, ["anchor_id", "probe_id"])
    return kept.withColumn("poucas_origens", F.col("n_candidatas") < K.MIN_PROBES)


def validate_probes(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target the list of broken rules, empty when the choice is sound."""
    per = chosen.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("probe_id").alias("d"),
        F.max("n_candidatas").alias("c"), F.count_if(F.col("distance_band").isNull()).alias("sem_faixa"),
    )
    rows = targets.select("anchor_id").join(per, "anchor_id", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "sem_probe"), F.when(F.col("n") > K.MAX_PROBES, "probes_demais"),
        F.when((F.col("n") < K.MIN_PROBES) & (F.col("c") >= K.MIN_PROBES), "probes_de_menos"),
        F.when(F.col("d") < F.col("n"), "probe_repetida"), F.when(F.col("sem_faixa") > 0, "sem_faixa"),
    ))
    return rows.select("anchor_id", F.coalesce("n", F.lit(0)).alias("n"), F.array_join(problems, ",").alias("problemas"))


# ---------------------------------------------------------------- flow list
def flow_list(chosen: DataFrame, measurements: DataFrame) -> DataFrame:
    """One row per chosen flow; repeated ids and measurements absent upstream are flagged."""
    w = Window.partitionBy("id_fluxo").orderBy("measurement_id")
    known = measurements.select(F.col("msm_id").alias("measurement_id"), "af", "interval", "packets", F.lit(True).alias("_known"))
    rows = chosen.withColumn("id_fluxo", F.concat_ws("_", "probe_id", "anchor_id"))
    return rows.withColumn("repetido", F.row_number().over(w) > 1).join(known, "measurement_id", "left").withColumn(
        "ausente", F.col("_known").isNull()
    ).drop("_known")


def live_checklist(flows: DataFrame, probes_now: DataFrame, anchors_now: DataFrame, msm_now: DataFrame) -> DataFrame:
    """Current state of each flow's parts; ``apto`` needs every check to hold."""
    p = probes_now.select("probe_id", F.col("status").alias("_ps"), F.col("address_v4").alias("_pip"))
    a = anchors_now.select("anchor_id", F.col("is_disabled").alias("_off"), F.col("ip_v4").alias("_aip"))
    m = msm_now.select(F.col("msm_id").alias("measurement_id"), F.col("status").alias("_ms"))
    rows = flows.join(p, "probe_id", "left").join(a, "anchor_id", "left").join(m, "measurement_id", "left")
    checks = {
        "probe_conectada": F.coalesce(F.col("_ps") == K.STATUS_CONNECTED, F.lit(False)),
        "anchor_ativa": F.coalesce(~F.col("_off"), F.lit(False)),
        "mesmo_ip": F.coalesce(F.col("_aip") == F.col("anchor_ip"), F.lit(False)),
        "medicao_em_andamento": F.coalesce(F.col("_ms") == K.STATUS_ONGOING, F.lit(False)),
    }
    rows = rows.withColumns(checks)
    return rows.withColumn("apto", F.forall(F.array(*checks), lambda c: c)).drop("_ps", "_pip", "_off", "_aip", "_ms")


def local_candidates(classes: DataFrame, baseline: DataFrame, excluded: DataFrame) -> DataFrame:
    """Flows usable for live forecasts, the others with every reason they are not."""
    b = baseline.select("id_fluxo", F.col("status_baseline").alias("_s"))
    x = excluded.select("id_fluxo", F.lit(True).alias("_x")).distinct()
    rows = classes.join(b, "id_fluxo", "left").join(x, "id_fluxo", "left")
    why = F.array_compact(F.array(
        F.when(F.col("classe_fluxo") != "A+B", "classe diferente de A+B"),
        F.when(~F.col("_s").eqNullSafe(K.STATUS_VALID), "baseline não é VALIDO"),
        F.when(F.col("_x"), "fluxo excluído"),
    ))
    return rows.select("id_fluxo", "classe_fluxo", F.array_join(why, "; ").alias("motivos"), (F.size(why) == 0).alias("candidato"))


def anchor_sample(eligible: DataFrame, n: int, per_anchor: int, home: str = K.HOME_COUNTRY, seed: int = K.SEED) -> DataFrame:
    """``n - 1`` anchors in seeded order plus one of the home country, each with few measurements."""
    order = [seeded_order(seed, "anchor_id"), F.col("anchor_id")]
    drawn = eligible.orderBy(*order).limit(n - 1)
    fixed = eligible.orderBy((F.col("country") != home).cast("int"), "anchor_id").limit(1)
    both = drawn.unionByName(fixed).dropDuplicates(["anchor_id"])
    return both.select("anchor_id", "country", F.size("medicoes").alias("n_medicoes"),
                       F.slice("medicoes", 1, per_anchor).alias("medicoes"))
