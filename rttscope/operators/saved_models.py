"""A stored model as an artefact: its digest, and scoring again what a log recorded with it."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rttscope.operators import models
from rttscope.sources.readers import ContractError

PREFIX = "sha256:"
KINDS = {"arvore_decisao": DecisionTreeClassificationModel, "random_forest": RandomForestClassificationModel}


def digest(spark: SparkSession, path: str) -> str:
    """``sha256:`` and the hash over the model's files: each file is hashed where it is read, then their hashes in name order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    each = files.where(~name.contains("/_")).select(F.concat_ws(":", name, F.sha2("content", 256)).alias("line"))
    lines = F.sort_array(F.collect_list("line"))  # a model is a handful of files
    return each.agg(F.concat(F.lit(PREFIX), F.sha2(F.array_join(lines, "\n"), 256))).first()[0]


def save(model, spark: SparkSession, path: str) -> str:
    """Write a fitted tree or forest; returns the digest that its log rows carry."""
    model.write().save(path)
    return digest(spark, path)


def rescored(spark: SparkSession, path: str, family: str, recorded: DataFrame, rows: DataFrame) -> DataFrame:
    """The classes that the stored model gives ``rows`` now.

    Refused if a recorded row carries another digest than the files have: then another model wrote it.
    """
    here = digest(spark, path)
    other = recorded.where(~F.col("modelo_hash").eqNullSafe(F.lit(here))).select("modelo_hash").limit(1).collect()
    if other:
        raise ContractError(f"recorded with model {other[0][0]}, stored is {here}")
    return models.predicted(KINDS[family].load(path), models.vectors(rows)).withColumnRenamed("previsto", "classe_prevista")
