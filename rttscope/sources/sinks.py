"""Writers: CSV with contract rendering, partitioned Parquet, JSON lines, retention."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.operators.dataset import six_digits


def cell(col: str, type_: str) -> Column:
    """Text of one CSV cell: true/false, JSON for nested values, decimals without trailing zeros."""
    c = F.col(col)
    if type_ == "boolean":
        return F.when(c, "true").when(~c, "false")
    if type_ in ("double", "float"):
        text = F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
        shown = F.when(text.isin("", "-"), "0").otherwise(text)
        return F.when(c.isNotNull() & ~F.isnan(c), shown)
    if type_.startswith(("array", "map", "struct")):
        return F.to_json(c)
    return c.cast("string")


def rendered(df: DataFrame, columns=None) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(*[cell(c, types[c]).alias(c) for c in (columns or df.columns)])


def write_csv(df: DataFrame, path: str, columns=None) -> None:
    """Fixed column order, header, blanks for missing values."""
    rendered(df, columns).write.mode("overwrite").option("header", True).option("nullValue", "").option(
        "emptyValue", "").option("escape", '"').csv(path)


def write_final(df: DataFrame, path: str) -> None:
    """The final table at full precision, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def short_text(col: str) -> Column:
    """Six significant digits without trailing zeros; an exponent below 0.0001 and from a million on."""
    x = six_digits(F.col(col))
    plain = F.regexp_replace(x.cast("decimal(20,10)").cast("string"), r"\.?0+$", "")
    power = F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e")
    fixed = F.abs(x).between(0.0001, 999_999.5)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x == 0, "0").when(fixed, plain).otherwise(power))


def write_final_csv(df: DataFrame, path: str) -> None:
    """The final table as text at six significant digits."""
    doubles = [c for c, t in df.dtypes if t == "double" and c in K.FEATURES]
    write_csv(df.withColumns({c: short_text(c) for c in doubles}), path)


def with_day(df: DataFrame, ts: str = "ts_previsao") -> DataFrame:
    return df.withColumn("data", F.substring(ts, 1, 10))


def write_predictions(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Replace the dates present in ``df``, leaving the others; files are sized by date.

    The rebalance hint lets the planner split a busy date into as many tasks as its size asks for
    and join small dates; files end at ``rows_per_file``.
    """
    spread = with_day(df).hint("rebalance", "data")
    spread.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("partitionOverwriteMode", "dynamic").partitionBy("data").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_json(df: DataFrame, path: str, start: str | None = None, end: str | None = None) -> None:
    """Stored predictions of a date range as JSON lines in contract field order."""
    rows = df
    if start:
        rows = rows.where(F.col("data").cast("string") >= start)
    if end:
        rows = rows.where(F.col("data").cast("string") <= end)
    rows.select(*K.LOG_FIELDS).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_events(df: DataFrame, path: str, day: Column) -> None:
    """Operational events, one folder per day."""
    df.withColumn("dia", day).write.mode("append").partitionBy("dia").parquet(path)


def append_alerts(df: DataFrame, path: str) -> None:
    df.withColumn("data", F.substring("ts", 1, 10)).write.mode("append").partitionBy("data").parquet(path)


def expired_days(df: DataFrame, today: date, keep_days: int = K.RETENTION_DAYS, col: str = "data") -> DataFrame:
    """Dates older than the retention with their row counts; nothing is removed."""
    limit = (today - timedelta(days=keep_days)).isoformat()
    return df.where(F.col(col).cast("string") < limit).groupBy(F.col(col).cast("string").alias(col)).agg(
        F.count(F.lit(1)).alias("n")
    )


def rewrite_kept(spark: SparkSession, source: str, target: str, today: date, keep_days: int = K.RETENTION_DAYS,
                 col: str = "data", dry_run: bool = True) -> DataFrame:
    """Retention by rewriting the kept dates to ``target``; returns what would be left out."""
    rows = spark.read.parquet(source)
    gone = expired_days(rows, today, keep_days, col)
    if not dry_run:
        limit = (today - timedelta(days=keep_days)).isoformat()
        rows.where(F.col(col).cast("string") >= limit).write.mode("overwrite").partitionBy(col).parquet(target)
    return gone
