"""Registry of runnable queries and, where SQL can express them, their check text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rttscope.plans.oracle import sql
from rttscope.plans.stages import Stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_STAGES: dict[tuple, Stages] = {}


def folder_key(spark: SparkSession, sf_dir: str) -> tuple:
    """The application and the files of a folder: name, size and time, so changed files are read anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    held = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)
    return (spark.sparkContext.applicationId, sf_dir, *held)


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    """The stage tables of one input folder, written once per application and state of the folder."""
    key = folder_key(spark, sf_dir)
    if key not in _STAGES:
        _STAGES[key] = Stages.of(spark, sf_dir)
    return _STAGES[key]


def register(name: str, check: str | None = None, extra: dict[str, str] | None = None):
    """Register a query function; ``check`` is the SQL body run against the stage CTEs."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if check is not None:
            ORACLE[name] = sql(check, extra)
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals, so summation order does not show."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])
