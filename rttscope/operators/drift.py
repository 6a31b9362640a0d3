"""Drift of features, predictions and performance against a reference table.

Rows are unpivoted to (keys, feature, value) and reduced to bin counts before anything is
compared, so what is joined and summarised is a few rows per feature and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions.label import psi_status, rtt_band, worst_status
from rttscope.functions.privacy import seeded_order
from rttscope.operators import metrics
from rttscope.operators.quantiles import exact_quantiles, largest_gap
from rttscope.session import materialise

HOUR, WEEK = 3600, 7 * 86400
WINDOW_HOURS = {"24h": 24, "7d": 168}


def unpivot(df: DataFrame, keys: list[str], names=K.FEATURES) -> DataFrame:
    """One row per (row, feature)."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("valor")) for n in names
    ])
    return df.select(*keys, F.inline(pairs))


# ---------------------------------------------------------------- reference
def bin_edges(long: DataFrame, keys: list[str], bins: int = K.QUANTILE_BINS) -> DataFrame:
    """Distinct quantile edges 0, 1/bins, ..., 1 per key, as a written table."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    wide = exact_quantiles(long, keys, "valor", probs)
    return materialise(wide.select(*keys, F.array_distinct(F.array(*probs)).alias("bordas")), "bin-edges")


def bin_counts(long: DataFrame, edges: DataFrame, keys: list[str], edge_keys=("feature",)) -> DataFrame:
    """Rows per (keys, feature, bin).  ``edges`` has one row per feature (and window).

    The edges are a small written table, so their join shuffles no row before it is counted, and each is a column
    of its own to compare with: a lookup in a map and a walk along an array cost many times that for each value.
    A bin is the number of inner edges not above the value.  Rows without edges are left out.
    """
    many = range(2, K.QUANTILE_BINS + 1)
    size = F.size("bordas")
    few = F.when(size > K.QUANTILE_BINS + 1, F.raise_error(F.lit("more edges than bins"))).otherwise(size < 2)
    inner = [F.when(size > i, F.get("bordas", F.lit(i - 1))).alias(f"_e{i}") for i in many]
    table = edges.select(*[F.col(k).alias(f"_k_{k}") for k in edge_keys], few.alias("_one"), *inner)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in edge_keys]
    missing = F.col("valor").isNull() | F.isnan("valor")
    place = sum((F.when(F.col(f"_e{i}") <= F.col("valor"), 1).otherwise(0) for i in many), F.lit(0))
    b = F.when(~missing, F.when(F.col("_one"), 0).otherwise(place))
    return long.join(table, same).withColumn("bin", b).groupBy(*keys, "feature", "bin").agg(
        F.count(F.lit(1)).alias("c"), F.min("valor").alias("menor"), F.max("valor").alias("maior")
    )


def _floored(counts: Column, bins: Column) -> Column:
    """Map of bin counts to an array of proportions with the zero floor applied to counts."""
    filled = F.transform(
        F.sequence(F.lit(0), bins - 1),
        lambda i: F.greatest(F.coalesce(F.try_element_at(counts, i), F.lit(0)).cast("double"), F.lit(K.PSI_FLOOR)),
    )
    total = F.aggregate(filled, F.lit(0.0), lambda a, x: a + x)
    return F.transform(filled, lambda x: x / total)


def proportions(counts: DataFrame, edges: DataFrame, keys: list[str], edge_keys=("feature",)) -> DataFrame:
    """Per (keys, feature): floored bin proportions, row count and value range."""
    # at most QUANTILE_BINS entries per group
    per = counts.groupBy(*keys, "feature").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "c")))).alias("_m"),
        F.sum("c").alias("n"), F.sum(F.when(F.col("bin").isNotNull(), F.col("c"))).alias("n_validos"),
        F.min("menor").alias("menor"), F.max("maior").alias("maior"),
    )
    rows = per.join(edges, list(edge_keys))
    bins = F.greatest(F.size("bordas") - 1, F.lit(1))
    return rows.withColumn("proporcao", _floored(F.col("_m"), bins)).drop("_m")


def reference(df: DataFrame, key: list[str], names=K.FEATURES) -> DataFrame:
    """Per-feature summary of the reference rows (train and validation only)."""
    rows = df.where(F.col("split").isin("treino", "validacao"))
    long = unpivot(rows, [], names)
    rates = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_ref"),
        F.avg((F.col("valor").isNull() | F.isnan("valor")).cast("double")).alias("taxa_nulos_ref"),
        F.avg(F.coalesce((F.col("valor") == K.SENTINEL).cast("double"), F.lit(0.0))).alias("taxa_sentinela_ref"),
    )
    edges = bin_edges(long, ["feature"])
    props = proportions(bin_counts(long, edges, []), edges, [])
    return rates.join(props.select("feature", "bordas", "proporcao"), "feature")


# ---------------------------------------------------------------- comparisons
def psi_value(seen: Column, expected: Column) -> Column:
    terms = F.zip_with(seen, expected, lambda s, e: (s - e) * F.ln(s / e))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def psi_against(counts: DataFrame, ref: DataFrame, keys: list[str], summarised: bool = True) -> DataFrame:
    """PSI per (keys, feature) of counted bins against reference proportions.

    A summarised (stored) reference gets the zero floor once more, on its proportions.
    """
    edges = ref.select("feature", "bordas")
    rows = proportions(counts, edges, keys).join(
        ref.select("feature", F.col("proporcao").alias("_ref")), "feature"
    )
    one = F.size("bordas") < 2
    same = (F.col("menor") == F.col("bordas")[0]) & (F.col("maior") == F.col("bordas")[0])
    total = F.aggregate("_ref", F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(K.PSI_FLOOR)))
    again = F.transform("_ref", lambda x: F.greatest(x, F.lit(K.PSI_FLOOR)) / total)
    expected = again if summarised else F.col("_ref")
    value = (
        F.when(F.coalesce("n_validos", F.lit(0)) == 0, None)
        .when(one, F.when(same, 0.0).otherwise(1.0))
        .when(F.size("_ref") != F.size("proporcao"), None)
        .otherwise(psi_value(F.col("proporcao"), expected))
    )
    return rows.select(*keys, "feature", "n", value.alias("psi"))


def psi_between(ref_long: DataFrame, cur_long: DataFrame, keys: list[str]) -> DataFrame:
    """PSI per (keys, feature) of two raw samples, edges from the first."""
    group = [*keys, "feature"]
    edges = bin_edges(ref_long, group)
    a = proportions(bin_counts(ref_long, edges, keys, group), edges, keys, group)
    b = proportions(bin_counts(cur_long, edges, keys, group), edges, keys, group)
    left = a.select(*group, "bordas", F.col("proporcao").alias("_p"), F.col("n_validos").alias("_na"))
    rows = left.join(b.select(*group, "proporcao", "n_validos", "menor", "maior"), group)
    same = (F.col("menor") == F.col("bordas")[0]) & (F.col("maior") == F.col("bordas")[0])
    value = (
        F.when(F.coalesce("n_validos", F.lit(0)) == 0, None)
        .when(F.size("bordas") < 2, F.when(same, 0.0).otherwise(1.0))
        .otherwise(psi_value(F.col("proporcao"), F.col("_p")))
    )
    return rows.select(*group, value.alias("psi"))


def ks(ref_long: DataFrame, cur_long: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sample KS statistic per key, with the asymptotic p-value.

    The gap comes from histograms by levels; only buckets that may hold the largest gap are put in order.
    """
    out = largest_gap(ref_long, cur_long, keys, "valor").withColumnRenamed("gap", "ks")
    lam = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("ks")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    p = F.when(F.col("ks") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return out.select(*keys, "ks", F.when(F.col("ks").isNotNull(), p).alias("ks_p"))


def chi_square(ref_counts: list[Column], cur_counts: list[Column]) -> tuple[Column, Column]:
    """Goodness of fit of three class counts; with two degrees of freedom p = exp(-x/2)."""
    def total(cols):
        out = cols[0]
        for c in cols[1:]:
            out = out + c
        return out

    tr, tc = total(ref_counts), total(cur_counts)
    stat = None
    for r, c in zip(ref_counts, cur_counts):
        expected = F.greatest(F.try_divide(r, tr) * tc, F.lit(K.PSI_FLOOR))
        term = (c - expected) * (c - expected) / expected
        stat = term if stat is None else stat + term
    stat = F.when((tr > 0) & (tc > 0), stat)
    return stat, F.exp(-stat / 2)


def js_divergence(p: list[Column], q: list[Column]) -> Column:
    """Squared base-2 Jensen-Shannon distance of two proportion rows, each first brought to sum 1."""
    def total(cols):
        out = cols[0]
        for c in cols[1:]:
            out = out + c
        return out

    sp, sq = total(p), total(q)
    pn, qn = [F.try_divide(c, sp) for c in p], [F.try_divide(c, sq) for c in q]

    def side(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    out = None
    for a, b in zip(pn, qn):
        m = (a + b) / 2
        term = (side(a, m) + side(b, m)) / 2
        out = term if out is None else out + term
    return F.when((sp > 0) & (sq > 0), F.greatest(out, F.lit(0.0)))


# ---------------------------------------------------------------- windows and blocks
def trailing(df: DataFrame, end: int, hours: int, holidays: list[str] | None = None, ts="timestamp") -> DataFrame:
    """Rows of [end - hours, end), holiday dates left out."""
    t = F.col(ts)
    rows = df.where((t >= end - hours * HOUR) & (t < end))
    if holidays:
        rows = rows.where(~F.to_date(F.timestamp_seconds(t)).cast("string").isin(list(holidays)))
    return rows


def tagged_windows(df: DataFrame, end: int, holidays: list[str] | None = None) -> DataFrame:
    """Each row once per window it is in: current or the same window a week earlier."""
    longest = 2 * WEEK // HOUR
    rows = trailing(df, end, longest, holidays)
    t = F.col("timestamp")
    marks = []
    for name, hours in WINDOW_HOURS.items():
        for role, stop in (("corrente", end), ("equivalente", end - WEEK)):
            inside = (t >= stop - hours * HOUR) & (t < stop)
            marks.append(F.when(inside, F.struct(F.lit(name).alias("janela"), F.lit(role).alias("papel"))))
    return rows.select("*", F.inline(F.array_compact(F.array(*marks))))


def enough(n: Column, status: Column, minimum: int = K.MIN_DRIFT_ROWS) -> Column:
    return F.when(n >= minimum, status).otherwise(K.DRIFT_STATUS[0])


def feature_block(windows: DataFrame, ref: DataFrame) -> DataFrame:
    """PSI, null rate and their statuses per (window, feature) of the current rows."""
    current = windows.where("papel = 'corrente'")
    long = unpivot(current, ["janela"])
    counts = bin_counts(long, ref.select("feature", "bordas"), ["janela"])
    psi = psi_against(counts, ref, ["janela"])
    nulls = counts.groupBy("janela", "feature").agg(
        (F.sum(F.when(F.col("bin").isNull(), F.col("c")).otherwise(0)) / F.sum("c")).alias("taxa_nulos")
    )
    rows = psi.join(nulls, ["janela", "feature"]).join(ref.select("feature", "taxa_nulos_ref"), "feature")
    worse = F.col("taxa_nulos") > F.coalesce("taxa_nulos_ref", F.lit(0.0)) + K.NULL_RATE_STEP
    return rows.withColumns({
        "status_psi": enough(F.col("n"), psi_status(F.col("psi"))),
        "status_qualidade": enough(F.col("n"), F.when(worse, "alerta").otherwise("estavel")),
    })


def prediction_block(windows: DataFrame, ref_props: DataFrame, col: str = "classe_prevista") -> DataFrame:
    """Class-mix divergence per window; ``ref_props`` is one row of ``prop_*`` columns."""
    cur = windows.where("papel = 'corrente'").groupBy("janela").agg(
        F.count(F.lit(1)).alias("n"), *metrics.proportions(col)
    )
    rows = cur.withColumns({f"ref_{c}": ref_props.select(f"prop_{c}").scalar() for c in K.CLASSES})
    js = js_divergence([F.col(f"ref_{c}") for c in K.CLASSES], [F.col(f"prop_{c}") for c in K.CLASSES])
    rows = rows.withColumn("js", js)
    status = (
        F.when(F.col("js") >= K.JS_ALERT, "alerta").when(F.col("js") >= K.JS_ALERT / 2, "atencao").otherwise("estavel")
    )
    return rows.withColumn("status", enough(F.col("n"), status)).drop(*[f"ref_{c}" for c in K.CLASSES])


def performance_block(windows: DataFrame, real="rotulo_real", pred="classe_prevista") -> DataFrame:
    """Macro-F1 and FALHA recall per window on labelled rows."""
    rows = windows.where((F.col("papel") == "corrente") & F.col(real).isNotNull())
    out = metrics.scores(metrics.confusion(rows, ["janela"], real, pred), "zero")
    bad = (F.col("macro_f1") < K.MACRO_F1_MIN) | (F.col("recall_falha") < K.RECALL_FAIL_MIN)
    return out.select("janela", "n", "macro_f1", "recall_falha").withColumn(
        "status", enough(F.col("n"), F.when(bad, "alerta").otherwise("estavel"))
    )


def seasonal_block(windows: DataFrame, features: DataFrame) -> DataFrame:
    """Downgrade a feature's status when last week's same window explains the shift."""
    long = unpivot(windows, ["janela", "papel"])
    now = long.where("papel = 'corrente'").drop("papel")
    before = long.where("papel = 'equivalente'").drop("papel")
    sizes = windows.groupBy("janela").agg(
        F.count_if(F.col("papel") == "corrente").alias("n_corrente"),
        F.count_if(F.col("papel") == "equivalente").alias("n_equivalente"),
    )
    seasonal = psi_between(before, now, ["janela"]).withColumnRenamed("psi", "psi_sazonal")
    rows = features.join(seasonal, ["janela", "feature"], "left").join(sizes, "janela")
    both = (F.col("n_corrente") >= K.MIN_DRIFT_ROWS) & (F.col("n_equivalente") >= K.MIN_DRIFT_ROWS)
    status = F.when(both, psi_status(F.col("psi_sazonal")))
    explained = (status == "estavel") & F.col("status_psi").isin("atencao", "alerta")
    return rows.withColumns({
        "psi_sazonal": F.when(both, F.col("psi_sazonal")), "status_sazonal": status,
        "explicado": F.coalesce(explained, F.lit(False)),
        "status_final": F.when(F.coalesce(explained, F.lit(False)), "estavel").otherwise(F.col("status_psi")),
    })


def slice_block(windows: DataFrame, ref: DataFrame, continents: DataFrame | None = None) -> DataFrame:
    """Worst feature status per window and anchor, continent or RTT band.

    Bin counts are taken once at the finest grain and rolled up by grouping sets.
    """
    rows = windows.where("papel = 'corrente'").withColumn("faixa", rtt_band("razao_rtt_p95"))
    if continents is None:
        rows = rows.withColumn("continente", F.lit(K.UNKNOWN_CONTINENT))
    else:
        rows = rows.join(continents, "anchor_id", "left").withColumn(
            "continente", F.coalesce("continente", F.lit(K.UNKNOWN_CONTINENT))
        )
    rows = rows.withColumn("anchor", F.col("anchor_id").cast("string"))
    dims = ["anchor", "continente", "faixa"]
    long = unpivot(rows, ["janela", *dims])
    fine = bin_counts(long, ref.select("feature", "bordas"), ["janela", *dims])
    base = ["janela", "feature", "bin"]
    sets = fine.groupingSets(
        [[F.col(c) for c in [*base, d]] for d in dims], *[F.col(c) for c in [*base, *dims]]
    ).agg(F.sum("c").alias("c"), F.min("menor").alias("menor"), F.max("maior").alias("maior"))
    kinds = {"anchor": "anchor", "continente": "continente", "faixa": "faixa_rtt"}
    kind = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(k)) for d, k in kinds.items()])
    counts = sets.select(
        "janela", kind.alias("tipo"), F.coalesce(*dims).alias("chave"), "feature", "bin", "c", "menor", "maior"
    )
    keys = ["janela", "tipo", "chave"]
    psi = psi_against(counts, ref, keys)
    status = psi_status(F.col("psi"))
    return psi.groupBy(*keys).agg(F.max("n").alias("n"), worst_status(status).alias("_s")).withColumn(
        "status", enough(F.col("n"), F.col("_s"))
    ).drop("_s")


def route_changes(df: DataFrame, minimum: int = K.MIN_DRIFT_ROWS, flow: str = "fluxo_id",
                  ratio_limit: float = K.ROUTE_RATIO, loss_limit: float = K.ROUTE_LOSS) -> DataFrame:
    """Flows with a high median RTT ratio and little loss: probably a new route."""
    med = exact_quantiles(unpivot(df, [flow], ("razao_rtt_p95", "perda_pct")), [flow, "feature"], "valor", {"m": 0.5})
    wide = med.groupBy(flow).agg(
        F.max(F.when(F.col("feature") == "razao_rtt_p95", F.col("m"))).alias("razao_mediana"),
        F.max(F.when(F.col("feature") == "perda_pct", F.col("m"))).alias("perda_mediana"),
    )
    sizes = df.groupBy(flow).agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.where(F.col("n") >= minimum).join(wide, flow)
    low_loss = F.col("perda_mediana").isNull() | (F.col("perda_mediana") < loss_limit)
    return rows.where((F.col("razao_mediana") > ratio_limit) & low_loss).withColumn(
        "status", F.lit("mudanca_de_rota_provavel")
    )


def report(df: DataFrame, ref: DataFrame, ref_props: DataFrame, end: int, continents=None, holidays=None) -> DataFrame:
    """All blocks as one long table (janela, bloco, chave, n, valor, status)."""
    windows = tagged_windows(df, end, holidays)
    # one row per window and feature, read by two blocks
    features = materialise(seasonal_block(windows, feature_block(windows, ref)), "drift-features")
    none = F.lit(None).cast("double")

    def rows(source, block, key, n, value, status):
        return source.select(
            "janela", F.lit(block).alias("bloco"), key.alias("chave"), n.cast("long").alias("n"),
            value.cast("double").alias("valor"), status.alias("status"),
        )

    n, status = F.col("n"), F.col("status")
    parts = [
        rows(features, "data_drift", F.col("feature"), n, F.col("psi"), F.col("status_final")),
        rows(features, "qualidade_dados", F.col("feature"), n, F.col("taxa_nulos"), F.col("status_qualidade")),
        rows(prediction_block(windows, ref_props), "predicao", F.lit("classes"), n, F.col("js"), status),
        rows(performance_block(windows), "desempenho", F.lit("macro_f1"), n, F.col("macro_f1"), status),
        rows(slice_block(windows, ref, continents), "fatia", F.concat_ws(":", "tipo", "chave"), n, none, status),
        rows(route_changes(df).withColumn("janela", F.lit("tudo")), "rota", F.col("fluxo_id"), n,
             F.col("razao_mediana"), status),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calibration(df: DataFrame, edges: DataFrame, blocks: int = 30, flows_per_block: int = 8, seed: int = K.SEED) -> DataFrame:
    """Natural PSI of random flow blocks per feature: median and p95.

    Bins are counted per flow first; a block is then a sum over its few flows.
    """
    long = unpivot(df, ["id_fluxo"])
    # a row per flow, feature and bin, read for the reference and for the blocks
    per_flow = materialise(bin_counts(long, edges, ["id_fluxo"]), "calibration-flows")
    whole = per_flow.groupBy("feature", "bin").agg(F.sum("c").alias("c"), F.min("menor").alias("menor"), F.max("maior").alias("maior"))
    ref = proportions(whole, edges, []).select("feature", "bordas", "proporcao")
    drawn = df.select("id_fluxo").distinct().select(
        "id_fluxo", F.explode(F.sequence(F.lit(1), F.lit(blocks))).alias("bloco")
    )
    w = Window.partitionBy("bloco").orderBy(seeded_order(seed, "bloco", "id_fluxo"), "id_fluxo")
    members = drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= flows_per_block).drop("_r")
    counts = per_flow.join(members, "id_fluxo").groupBy("bloco", "feature", "bin").agg(
        F.sum("c").alias("c"), F.min("menor").alias("menor"), F.max("maior").alias("maior")
    )
    # a row per block and feature, which the quantiles read several times; unwritten, each would count all rows again
    psi = materialise(psi_against(counts, ref, ["bloco"], summarised=False).where("psi is not null"), "calibration-psi")
    return exact_quantiles(psi, ["feature"], "psi", {"mediana": 0.5, "p95": 0.95}).withColumnRenamed("n", "blocos")


def calibration_advice(per_feature: DataFrame) -> DataFrame:
    """Suggested thresholds from the features' p95: their median, and twice it at least 0.25."""
    m = exact_quantiles(materialise(per_feature, "calibration"), [], "p95", {"sugestao_atencao": 0.5}).select("sugestao_atencao")
    return m.withColumn("sugestao_alerta", F.greatest(F.lit(0.25), 2 * F.col("sugestao_atencao")))
