"""Period tagging, first-wins deduplication, coverage and flow classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rttscope import contract as K

DEDUP_KEY = ("probe_id", "msm_id", "timestamp")


def period_of(ts: Column, periods) -> Column:
    """Name of the half-open window holding ``ts``; the few windows are job parameters."""
    tag = F
    for name, start, end in periods:
        tag = tag.when((ts >= start) & (ts < end), F.lit(name))
    return tag.otherwise(None)


def with_period(df: DataFrame, periods) -> DataFrame:
    return df.withColumn("periodo", period_of(F.col("timestamp"), periods))


def discard_reason(periods) -> Column:
    """Why a raw row is left out: type first, then window; NULL keeps the row."""
    inside = F.coalesce(period_of(F.col("timestamp"), periods) == F.col("periodo"), F.lit(False))
    return (
        F.when(~F.col("type").eqNullSafe(K.PING), K.REASON_TYPE).when(~inside, K.REASON_WINDOW)
    )


def first_wins(df: DataFrame, keys=DEDUP_KEY, order=("event_id",)) -> DataFrame:
    """Keep the first row per key in ingest order.

    ``row_number() = 1`` is pushed below the shuffle as a per-task group limit, so a key
    holding a great part of all rows is reduced before it travels.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def repeats(df: DataFrame, keys=DEDUP_KEY) -> DataFrame:
    """How many rows each repeated key would lose; counts combine before the shuffle."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .withColumn("n_descartadas", F.col("n") - 1).drop("n")
    )


def usage(
    df: DataFrame, periods, interval_s=K.INTERVAL_S, coverage_min=K.COVERAGE_MIN, min_ttl=K.MIN_SAMPLES,
    flows: DataFrame | None = None, problems: DataFrame | None = None,
) -> DataFrame:
    """Coverage of each flow in each period and whether the flow is used there.

    ``interval_s`` may be a column (an interval per measurement) or a number.  Every flow gets a row per
    period: the flows of ``flows`` (probe_id, anchor_id, id_fluxo), where given, and else those with a row.
    ``problems`` (id_fluxo, periodo, motivo) names collections that were blocked or failed: such a row counts no
    results, has no coverage and carries the reason, a blocked measurement as well as a network error.
    """
    keys = ["probe_id", "anchor_id", "id_fluxo"]
    names = [p[0] for p in periods]
    per = df.where(F.col("periodo").isin(names)).groupBy(*keys).agg(*[
        agg for p in names for agg in (
            F.count_if(F.col("periodo") == p).alias(f"_rows_{p}"),
            F.count_if((F.col("periodo") == p) & F.col("ttl").isNotNull()).alias(f"_ttl_{p}"),
        )
    ])
    if flows is not None:
        # one row per flow on either side
        per = flows.select(*keys).distinct().join(per, keys, "left").na.fill(0, [c for c in per.columns if c not in keys])
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("periodo"), F.col(f"_rows_{name}").alias("linhas"),
            F.col(f"_ttl_{name}").alias("ttl_validos"), F.lit(float(end - start)).alias("_dur"),
        ) for name, start, end in periods
    ])
    long = per.select(*keys, F.inline(rows))
    expected = F.col("_dur") / (interval_s if isinstance(interval_s, Column) else F.lit(float(interval_s)))
    long = long.withColumn("esperado", expected)
    long = long.withColumn(
        "cobertura",
        F.when(F.col("esperado") > 0, F.round(F.lit(100.0) * F.col("linhas") / F.col("esperado"), 4)),
    )
    shown = F.coalesce(F.format_string("%.2f", F.col("cobertura")), F.lit(K.REASON_COVERAGE_NO_INTERVAL))
    before, after = K.REASON_COVERAGE.split("{}")
    low = F.col("cobertura").isNull() | (F.col("cobertura") < coverage_min)
    reason = (
        F.when(F.col("linhas") == 0, K.REASON_EMPTY)
        .when(low, F.concat(F.lit(before), shown, F.lit(after)))
        .when((F.col("periodo") == K.PERIOD_A) & (F.col("ttl_validos") < min_ttl), K.REASON_FEW_TTL)
        .otherwise(K.REASON_OK)
    )
    long = long.withColumn("motivo", reason)
    if problems is not None:
        first = problems.groupBy("id_fluxo", "periodo").agg(F.min("motivo").alias("_erro"))
        long = long.join(first, ["id_fluxo", "periodo"], "left").withColumns({
            "linhas": F.when(F.col("_erro").isNull(), F.col("linhas")).otherwise(0), "ttl_validos": F.when(F.col("_erro").isNull(), F.col("ttl_validos")).otherwise(0),
            "cobertura": F.when(F.col("_erro").isNull(), F.col("cobertura")), "motivo": F.coalesce("_erro", "motivo"),
        }).drop("_erro")
    return long.withColumn("usado", F.col("motivo") == K.REASON_OK).drop("_dur")


def flow_class(used_a: Column, used_b: Column) -> Column:
    return F.when(used_a & used_b, "A+B").when(used_b, "B").when(used_a, "A").otherwise("nenhum")


def flow_classes(use: DataFrame) -> DataFrame:
    """Class of each flow from its usage rows."""
    def used(p):
        return F.coalesce(F.bool_or(F.when(F.col("periodo") == p, F.col("usado"))), F.lit(False))

    return use.groupBy("probe_id", "anchor_id", "id_fluxo").agg(
        flow_class(used(K.PERIOD_A), used(K.PERIOD_B)).alias("classe_fluxo")
    )


def used_rows(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the periods in which their flow is used."""
    joined = df.join(classes.select("probe_id", "anchor_id", "classe_fluxo"), ["probe_id", "anchor_id"])
    return joined.where(F.col("classe_fluxo").contains(F.col("periodo")))


def exclusion_ledger(discards: DataFrame, *earlier: DataFrame) -> DataFrame:
    """Sum of excluded rows per pair, measurement, flow and reason over all sources."""
    cols = ["anchor_id", "probe_id", "msm_id", "id_fluxo", "motivo", "n"]
    merged = discards.withColumn("n", F.lit(1).cast("long")).select(*cols)
    for source in earlier:
        merged = merged.unionByName(source.select(*cols))
    return merged.groupBy(*cols[:-1]).agg(F.sum("n").alias("n"))


def fetch_counters(df: DataFrame, periods, probe: Column | None = None) -> DataFrame:
    """Page-filter counters per flow: kept, other probe, out of window, family not 4."""
    inside = period_of(F.col("timestamp"), periods).isNotNull()
    own = F.lit(True) if probe is None else F.coalesce(F.col("probe_id") == probe, F.lit(False))
    return df.groupBy("id_fluxo").agg(
        F.count_if(own & inside).alias("n_mantidas"),
        F.count_if(~own).alias("n_outra_probe"),
        F.count_if(own & ~inside).alias("n_fora_da_janela"),
        F.count_if(own & inside & (F.col("af") != K.ADDRESS_FAMILY)).alias("n_af_divergente"),
    )


def high_loss(df: DataFrame, share: float = K.HIGH_LOSS_SHARE) -> DataFrame:
    """Flows that lost at least ``share`` of the packets they sent."""
    sums = df.groupBy("id_fluxo").agg(F.sum("sent").alias("enviados"), F.sum("rcvd").alias("recebidos"))
    lost = F.try_divide(F.col("enviados") - F.col("recebidos"), F.col("enviados"))
    return sums.withColumn("fracao_perda", lost).where(F.col("fracao_perda") >= share)


def enrich(rows: DataFrame, measurements: DataFrame, anchors: DataFrame, interval_s: int, flow_ip: str) -> DataFrame:
    """Packets and interval from the measurement, address from the anchor, with fallbacks."""
    m = measurements.select("msm_id", "packets", F.col("interval").alias("_interval"))
    a = anchors.select("anchor_id", F.col("ip_v4").alias("_ip"))
    dst = [F.col("dst_addr")] if "dst_addr" in rows.columns else []
    return rows.join(m, "msm_id", "left").join(a, "anchor_id", "left").withColumns({
        "interval": F.coalesce("_interval", F.lit(interval_s)),
        "anchor_ip": F.coalesce(F.col("_ip"), *dst, F.lit(flow_ip)),
    }).drop("_interval", "_ip")


def origin_address(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Newest known source address per flow, else the probe's own."""
    seen = F.max_by("probe_ip", F.when(F.col("probe_ip").isNotNull(), F.col("timestamp")))
    flows = rows.groupBy("id_fluxo", "probe_id").agg(seen.alias("_seen"))
    return flows.join(probes.select("probe_id", "address_v4"), "probe_id", "left").select(
        "id_fluxo", F.coalesce("_seen", "address_v4").alias("origem")
    )


def family_violations(flows: DataFrame, measurements: DataFrame) -> DataFrame:
    """Flows whose measurement is unknown or not IPv4; every count must be zero."""
    m = measurements.select("msm_id", "af")
    bad = ~F.col("af").eqNullSafe(K.ADDRESS_FAMILY)
    return flows.join(m, "msm_id", "left").groupBy("id_fluxo").agg(F.count_if(bad).alias("violacoes"))
