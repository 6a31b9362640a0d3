"""Counting operators: quality documents, nulls, domains, fingerprints, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rttscope import contract as K


def long_metrics(df: DataFrame, stage: str, metrics: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Aggregates as rows (stage, metric, key, value), all from one pass."""
    row = df.groupBy(*(keys or [])).agg(*[m.cast("double").alias(n) for n, m in metrics.items()])
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    pairs = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics
    ])
    return row.select(F.lit(stage).alias("stage"), key.alias("key"), F.inline(pairs))


def grouped_counts(df: DataFrame, stage: str, metric: str, key: Column) -> DataFrame:
    """Rows per value of ``key`` in the long metric layout."""
    return df.groupBy(key.cast("string").alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    ).select(F.lit(stage).alias("stage"), "key", F.lit(metric).alias("metric"), "value")


def nulls_per_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL count of every column, one scan, as (column, n)."""
    names = columns or df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("coluna"), F.col(c).alias("n")) for c in names
    ])))


def domain_counts(df: DataFrame, col: str, values) -> DataFrame:
    """Rows per known value, including values that never occur."""
    row = df.agg(*[F.count_if(F.col(col) == v).alias(f"v{i}") for i, v in enumerate(values)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("valor"), F.col(f"v{i}").alias("n")) for i, v in enumerate(values)
    ])))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free fingerprint per group: the sum of a 32-bit digest of each row's text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns])
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(digest).cast("decimal(38,0)").alias("impressao")
    )


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("linhas"), F.min("timestamp").alias("inicio"), F.max("timestamp").alias("fim")
    )


def strata(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts per value of each dimension; one grouping-sets aggregate over the rows."""
    typed = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("∅")).alias(d) for d in dims])
    sets = typed.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("n")
    )
    which = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims])
    return sets.select(which.alias("dimensao"), F.coalesce(*dims).alias("valor"), "n")


def strata_summary(df: DataFrame, dims: list[str], country: str = "country") -> DataFrame:
    """Per dimension: rows, distinct values, rows of its largest value and the most countries that share a value."""
    typed = df.select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimensao"), F.col(d).cast("string").alias("valor"), F.col(country).alias("pais")) for d in dims])))
    pairs = typed.where("valor is not null").groupBy("dimensao", "valor", "pais").agg(F.count(F.lit(1)).alias("n"))
    values = pairs.groupBy("dimensao", "valor").agg(F.sum("n").alias("n"), F.count("pais").alias("paises"))
    return values.groupBy("dimensao").agg(
        F.sum("n").alias("linhas"), F.count(F.lit(1)).alias("n_valores"), F.max("n").alias("maior"), F.max("paises").alias("mais_paises"))


def constants(df: DataFrame, columns: list[str], few: int = 20) -> DataFrame:
    """Per column its distinct-value count, whether it is constant, and its values if there are few.

    Values are counted as (column, value) pairs, so a column of many values is spread over
    tasks; of such a column only the smallest and largest value are listed.
    """
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("coluna"), F.col(c).cast("string").alias("valor")) for c in columns
    ]))).where("valor is not null").groupBy("coluna", "valor").agg(F.count(F.lit(1)).alias("n"))
    # ranks are cut inside each task, so at most ``few`` + 1 values of a column travel
    nth = F.row_number().over(Window.partitionBy("coluna").orderBy("valor"))
    listed = pairs.withColumn("_nth", nth).where(F.col("_nth") <= few + 1).groupBy("coluna").agg(F.sort_array(F.collect_list("valor")).alias("valores"))
    rows = pairs.groupBy("coluna").agg(
        F.count(F.lit(1)).alias("n_valores"), F.min("valor").alias("primeiro"), F.max("valor").alias("ultimo"),
    ).withColumn("divergente", F.col("n_valores") > 1)
    return rows.join(listed, "coluna").withColumn("valores", F.when(F.col("n_valores") <= few, F.col("valores")))


def losses_outside_set(df: DataFrame, examples: int | None = None, eps: float = K.LOSS_EPS) -> DataFrame:
    """Rows whose loss percent is not one a three-packet ping can give."""
    distance = F.array_min(F.array(*[F.abs(F.col("perda_pct") - v) for v in K.EXPECTED_LOSSES]))
    bad = df.where(distance > eps)
    if examples is None:
        return bad
    return bad.orderBy("timestamp", "id_fluxo").limit(examples)
