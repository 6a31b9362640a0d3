"""Text and JSON parsing of raw ping results, and the instant metrics of one execution.

All expressions stay in the JVM.  Missing is always NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# VARIANT type names that count as numbers; quoted numbers and booleans do not.
_NUMERIC = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def number(col) -> Column:
    """Text to double; blanks, booleans and NaN are missing."""
    c = F.col(col) if isinstance(col, str) else col
    value = c.try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def whole(col) -> Column:
    """Text to long, only when it is digits after an optional minus."""
    c = F.trim((F.col(col) if isinstance(col, str) else col).cast("string"))
    return F.when(c.rlike(r"^-?[0-9]+$"), c.try_cast("bigint"))


def text_or_null(col) -> Column:
    """Trimmed text; blank is missing."""
    c = F.trim((F.col(col) if isinstance(col, str) else col).cast("string"))
    return F.when(c != "", c)


def packets(col: str) -> Column:
    """The elements of the ``result`` JSON text; malformed or non-array text has none."""
    return F.coalesce(
        F.try_variant_get(F.try_parse_json(F.col(col)), "$", "array<variant>"),
        F.array().cast("array<variant>"),
    )


def packet_rtts(col: str) -> Column:
    """Numeric ``rtt`` values of the packets, other elements skipped."""
    rtts = F.transform(packets(col), lambda e: F.try_variant_get(e, "$.rtt", "variant"))
    numeric = F.filter(rtts, lambda r: r.isNotNull() & F.schema_of_variant(r).rlike(_NUMERIC))
    return F.transform(numeric, lambda r: F.try_variant_get(r, "$", "double"))


def has_timeout(col: str) -> Column:
    """True when any packet carries the timeout key, whatever its value."""
    return F.exists(packets(col), lambda e: F.try_variant_get(e, "$.x", "variant").isNotNull())


def slugs(col: str) -> Column:
    """Tag names from a JSON array of ``{slug}`` objects or plain strings."""
    named = F.transform(
        packets(col),
        lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))
        .otherwise(F.try_variant_get(e, "$.slug", "string")),
    )
    return F.array_compact(named)


def mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def population_std(values: Column, centre: Column | None = None) -> Column:
    """Two-pass population deviation to nine decimals; one value gives 0, none gives NULL.

    A ``centre`` given as a column (:func:`mean_of` the values) is not worked out again for every value.
    Rounding makes equal packet patterns give equal deviations, as exact summation would,
    so strict comparisons against a percentile of the same values do not hang on noise.
    """
    centre = mean_of(values) if centre is None else centre
    spread = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre))
    return F.when(F.size(values) > 0, F.round(F.sqrt(spread / F.size(values)), 9))


def loss_percent(sent: Column, received: Column) -> Column:
    return F.when(sent > 0, (sent - received) / sent * 100)


def instant_metrics(df: DataFrame) -> DataFrame:
    """Add RTT, loss, jitter and latency of each execution from the raw columns.

    Recorded min/max/avg win over the packet values; a negative recorded value is the
    source's "nothing came back" mark and counts as not recorded.
    """
    parsed = df.withColumn("_rtts", packet_rtts("result"))
    lost = F.coalesce(F.col("rcvd") == 0, F.lit(False))
    rtts = F.col("_rtts")

    def recorded(name: str, fallback: Column) -> Column:
        kept = F.when(F.col(name) >= 0, F.col(name))
        return F.when(~lost, F.coalesce(kept, fallback))

    return (
        parsed.withColumn("_rtt_mean", mean_of(rtts))
        .withColumns({
            "rtt_min": recorded("min", F.array_min(rtts)),
            "rtt_max": recorded("max", F.array_max(rtts)),
            "rtt_avg": recorded("avg", F.col("_rtt_mean")),
            "perda_pct": loss_percent(F.col("sent"), F.col("rcvd")),
            "jitter_ms": F.when(~lost, population_std(rtts, F.col("_rtt_mean"))),
        })
        .withColumn("latencia_ms", F.col("rtt_avg"))
    )


def flow_id(probe="probe_id", anchor="anchor_id") -> Column:
    return F.concat_ws("_", F.col(probe).cast("string"), F.col(anchor).cast("string"))


def unix_from_iso(col) -> Column:
    """ISO-8601 text to Unix seconds; text without an offset is read as UTC."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_seconds(F.try_to_timestamp(c))


def iso_from_unix(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
