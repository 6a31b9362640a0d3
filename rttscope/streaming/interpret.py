"""Column functions shared by batch and live rows."""

from pyspark.sql import DataFrame

from rttscope.functions.parse import instant_metrics
from rttscope.operators.dataset import labelled, processed


def interpret(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Raw rows to labelled rows: instant metrics, baseline join, rule."""
    return labelled(processed(instant_metrics(rows).drop("_rtts", "_rtt_mean"), profile))
