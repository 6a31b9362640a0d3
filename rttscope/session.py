"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_DIRS: dict[str, str] = {}
_SCOPES = threading.local()


def session(app: str = "rttscope", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library relies on (UTC, AQE, skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a folder of its own; a
    cluster without it is refused, since executors could not read a driver-local path.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="rttscope-")
    return _LOCAL_DIRS[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A path for one run's written table, never used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder once and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    for made in getattr(_SCOPES, "open", []):
        made.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever file system its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote; one that is not there is fine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialise` writes inside go when the block ends.

    For blocks that write their result elsewhere; nothing that is read later may be made inside.
    """
    made: list[str] = []
    _SCOPES.open = [*getattr(_SCOPES, "open", []), made]
    try:
        yield
    finally:
        _SCOPES.open = [x for x in _SCOPES.open if x is not made]
        for path in made:
            remove(spark, path)
