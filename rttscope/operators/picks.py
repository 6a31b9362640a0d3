"""Deterministic picks, samples and shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions.privacy import seeded_order
from rttscope.operators.quantiles import exact_quantiles
from rttscope.operators.series import series_windows


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """Head of a total order: a top-n per task and one small merge, no global sort."""
    return df.orderBy(*order).limit(n)


def hashed_sample(df: DataFrame, n: int, key: list[str], seed: int = K.SEED) -> DataFrame:
    """``n`` rows without replacement in seeded-hash order."""
    return df.orderBy(seeded_order(seed, *key), *key).limit(n)


def covering_sample(df: DataFrame, n: int, key: list[str], seed: int = K.SEED) -> DataFrame:
    """A sample with one row of each class, one total loss, and hash-ordered fill up to ``n``.

    Ranks are limited inside each task before the shuffle, so a class holding most rows
    does not travel.
    """
    order = [seeded_order(seed, *key), *[F.col(k) for k in key]]
    total = (F.col("perda_pct") == 100) & F.col("rtt_avg").isNull() & (F.col("classe") == "FALHA")
    labelled = df.where("classe is not null").withColumn("_lost", F.coalesce(total, F.lit(False)))
    per_class = labelled.withColumn(
        "_nth", F.row_number().over(Window.partitionBy("classe").orderBy(*order))
    ).where("_nth = 1").drop("_nth")
    lost = labelled.where("_lost").orderBy(*order).limit(1)
    must = per_class.unionByName(lost).dropDuplicates(key)
    fill = labelled.orderBy(*order).limit(n)
    merged = must.withColumn("_p", F.lit(0)).unionByName(fill.withColumn("_p", F.lit(1)))
    # at most 2n + 4 rows from here on
    best = merged.groupBy(*key).agg(F.min("_p").alias("_p"), *[
        F.first(c).alias(c) for c in df.columns if c not in key
    ])
    return best.orderBy("_p", *order).limit(n).select(*df.columns)


def transition_runs(df: DataFrame, keys: list[str], length: int = 8) -> DataFrame:
    """First window of ``length`` rows in which OK, later RISCO, later FALHA occurs, per flow."""
    def exprs(w):
        frame = w.rowsBetween(0, length - 1)
        return {"_classes": F.collect_list("classe").over(frame), "_size": F.count(F.lit(1)).over(frame)}

    rows = series_windows(df, keys, ["timestamp", "msm_id"], exprs, before=0, after=length - 1)

    def step(state: Column, c: Column) -> Column:
        return (
            F.when(state == 3, 3).when((c == "FALHA") & (state == 2), 3)
            .when((c == "RISCO") & (state >= 1), 2)
            .when((c == "OK") & (state == 0), 1).otherwise(state)
        )

    reached = F.aggregate("_classes", F.lit(0), step) == 3
    hits = rows.where((F.col("_size") == length) & reached)
    return hits.groupBy(*keys).agg(F.min("timestamp").alias("inicio"), F.min("pos").alias("posicao"))


def tertiles(medians: DataFrame, col: str) -> DataFrame:
    """Two linear-quantile cut points as one row."""
    return exact_quantiles(medians, [], col, {"q1": 1 / 3, "q2": 2 / 3}).select("q1", "q2")


def with_band(medians: DataFrame, col: str) -> DataFrame:
    """Short, middle or long band of each flow's median RTT."""
    cuts = tertiles(medians, col)
    return medians.withColumns({
        "_q1": cuts.select("q1").scalar(), "_q2": cuts.select("q2").scalar(),
    }).withColumn(
        "faixa",
        F.when(F.col(col) <= F.col("_q1"), "curta").when(F.col(col) <= F.col("_q2"), "media").otherwise("longa"),
    ).drop("_q1", "_q2")


def shortlist(banded: DataFrame, col: str, preferred: Column) -> DataFrame:
    """Two shortest, two nearest the middle median, one longest; preferred rows first."""
    middle = exact_quantiles(banded.where("faixa = 'media'"), [], col, {"m": 0.5}).select("m").scalar()
    rows = banded.withColumn("_m", middle)
    sort_key = (
        F.when(F.col("faixa") == "curta", F.col(col)).when(F.col("faixa") == "media", F.abs(F.col(col) - F.col("_m")))
        .otherwise(-F.col(col))
    )
    w = Window.partitionBy("faixa").orderBy(F.when(preferred, 0).otherwise(1), sort_key, "id_fluxo")
    wanted = F.when(F.col("faixa") == "longa", 1).otherwise(2)
    return rows.withColumn("ordem", F.row_number().over(w)).where("ordem <= 2").where(
        F.col("ordem") <= wanted
    ).drop("_m")


def farthest_contrast(p95: DataFrame, chosen: str) -> DataFrame:
    """The flow whose p95 differs most from the chosen one's (ties: smallest id)."""
    own = p95.where(F.col("id_fluxo") == chosen).select("p95_rtt_A").scalar()
    rows = p95.where((F.col("id_fluxo") != chosen) & F.col("p95_rtt_A").isNotNull()).select(
        "id_fluxo", "p95_rtt_A", F.abs(F.col("p95_rtt_A") - own).alias("distancia")
    )
    return rows.orderBy(F.desc("distancia"), "id_fluxo").limit(1)


def exemplar(df: DataFrame, flow: str, own_p95: float | None, other_p95: float | None) -> DataFrame:
    """Earliest row between the two limits, else above the own one, else any with latency."""
    lat = F.col("latencia_ms")
    own, other = F.lit(own_p95).cast("double"), F.lit(other_p95).cast("double")
    rank = (
        F.when((lat > own) & (lat < other), 0).when(lat > own, 1).when(lat.isNotNull(), 2).otherwise(3)
    )
    return df.where(F.col("id_fluxo") == flow).withColumn("prioridade", rank).orderBy(
        "prioridade", "timestamp", "msm_id"
    ).limit(1)


def preferred_first(df: DataFrame, preferred: Column, valid: Column, order: list) -> DataFrame:
    """First preferred valid row, else first valid, else first."""
    rank = F.when(preferred & valid, 0).when(valid, 1).otherwise(2)
    return df.withColumn("prioridade", rank).orderBy("prioridade", *order).limit(1)
