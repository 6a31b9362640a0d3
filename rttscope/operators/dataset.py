"""From raw executions to the labelled and the final dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions.label import first_match, label_class, label_reason, split_tag
from rttscope.operators.features import fill_sentinel, series_features

PAIR = ["anchor_id", "probe_id"]


def refuse_repeated_keys(dim: DataFrame, keys: list[str]) -> DataFrame:
    """Fail the job when a dimension repeats a key, so a join stays many-to-one."""
    counted = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if counted:
        raise ValueError(f"repeated key {keys} in a table that must be unique on it")
    return dim


def processed(instants_b: DataFrame, profile: DataFrame) -> DataFrame:
    """Step-5 rows: instant metrics, TTL baseline, signed delta and change flag."""
    joined = instants_b.join(profile, PAIR, "left")
    delta = F.col("ttl") - F.col("ttl_baseline")
    return joined.withColumns({
        "delta_ttl": delta, "ttl_changed": (delta != 0).cast("int"),
    })


def labelled(rows: DataFrame) -> DataFrame:
    """Add reason and class to rows already joined with the baseline columns."""
    return rows.withColumn("motivo_rotulagem", label_reason()).withColumn("classe", label_class())


def stale_flows(rows: DataFrame, share: float = K.STALE_SHARE) -> DataFrame:
    """Flows whose period B sits above their own p99 too often: the baseline is outdated."""
    late = F.col("motivo_rotulagem") == K.REASON_P99
    return (
        rows.where(F.col("status_baseline") == K.STATUS_VALID).groupBy(*PAIR)
        .agg(F.avg(late.cast("double")).alias("fracao"), F.count(F.lit(1)).alias("n"))
        .where(F.col("fracao") >= share)
    )


def kept_series(rows: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows of flows with a valid, current baseline."""
    valid = rows.where(F.col("status_baseline") == K.STATUS_VALID)
    return valid.join(stale.select(*PAIR), PAIR, "left_anti")


def discard_reason(gap_max_s: int = K.GAP_MAX_S) -> Column:
    """Why a series row cannot be a training example, first reason in priority order."""
    return first_match([
        (F.col("classe").isNull(), K.REASON_NO_LOSS),
        (F.col("gap_s").isNull(), K.REASON_NO_NEXT),
        (F.col("alvo").isNull(), K.REASON_NEXT_UNLABELLED),
        (F.col("gap_s") > gap_max_s, K.REASON_GAP),
    ])


def candidates(series: DataFrame, gap_max_s: int = K.GAP_MAX_S) -> DataFrame:
    """Every series row with features, target and its discard reason (NULL if kept)."""
    return series_features(series).withColumn("motivo_descarte", discard_reason(gap_max_s))


def first_instant(rows: DataFrame) -> int | None:
    """Earliest kept candidate; one number, the origin of the chronological split."""
    return rows.where("motivo_descarte is null").agg(F.min("timestamp")).first()[0]


def with_split(
    rows: DataFrame, t0: int | None, train_days=K.TRAIN_DAYS, valid_days=K.VALID_DAYS,
    embargo_min=K.EMBARGO_MIN,
) -> DataFrame:
    """Tag kept candidates with their split or the embargo."""
    start = F.lit(t0).cast("long")
    return rows.where("motivo_descarte is null").withColumn(
        "split", split_tag(F.col("timestamp"), start, train_days, valid_days, embargo_min)
    )


def final(split_rows: DataFrame) -> DataFrame:
    """Metadata, 21 features and target, sentinels in place, embargo rows gone."""
    rows = split_rows.where(F.col("split") != K.REASON_EMBARGO)
    rows = rows.withColumn("classe_atual", F.col("classe"))
    return fill_sentinel(rows).select(*K.FINAL_META, *K.FEATURES, K.TARGET)


def exclusions(labelled_rows: DataFrame, stale: DataFrame, split_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows lost per flow and reason across all stages."""
    blocked = labelled_rows.join(
        stale.select(*PAIR, F.lit(True).alias("_stale")), PAIR, "left"
    ).select(
        "id_fluxo",
        F.when(F.col("status_baseline").isNull(), K.REASON_NO_BASELINE)
        .when(F.col("status_baseline") != K.STATUS_VALID, K.REASON_SHORT_BASELINE)
        .when(F.col("_stale"), K.REASON_STALE).alias("motivo"),
    )
    dropped = rows.select("id_fluxo", F.col("motivo_descarte").alias("motivo"))
    held = split_rows.where(F.col("split") == K.REASON_EMBARGO).select(
        "id_fluxo", F.lit(K.REASON_EMBARGO).alias("motivo")
    )
    merged = blocked.unionByName(dropped).unionByName(held).where("motivo is not null")
    return merged.groupBy("id_fluxo", "motivo").agg(F.count(F.lit(1)).alias("n_linhas"))


def severe_unlabelled(rows: DataFrame) -> DataFrame:
    """Rows with severe loss that got no class, per flow."""
    severe = F.col("classe").isNull() & (F.col("perda_pct") >= K.LOSS_FAIL - K.LOSS_EPS)
    return rows.where(severe).groupBy("id_fluxo").agg(F.count(F.lit(1)).alias("n"))


def zero_jitter_limit(baseline: DataFrame) -> DataFrame:
    """Flows whose jitter limit is zero, so any jitter at all is a warning."""
    return baseline.where(F.col("p95_jitter_A") == 0).select("id_fluxo").distinct()


def six_digits(col: Column) -> Column:
    """A number at six significant digits, the precision of the published final table; missing stays missing."""
    # whole numbers below a million have six digits already; text is slow, and most values are such
    whole = (F.rint(col) == col) & (F.abs(col) < 1e6)
    return F.when(whole, col.cast("double")).otherwise(F.when(col.isNotNull(), F.format_string("%.5e", col)).try_cast("double"))


def published(final_rows: DataFrame) -> DataFrame:
    """The final table at its published precision."""
    return final_rows.withColumns({
        c: six_digits(F.col(c)) for c in K.FEATURES if dict(final_rows.dtypes)[c] == "double"
    })
