"""Readers: CSV, JSON documents and logs, Parquet partitions, and their contract checks."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rttscope import contract as K
from rttscope import schemas
from rttscope.functions.label import first_match
from rttscope.functions.parse import number, whole


class ContractError(ValueError):
    """Input that does not follow the data contract."""


# ---------------------------------------------------------------- CSV
def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text CSV with a header that must equal the schema; a different header fails the read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option(
        "mode", "FAILFAST").option("escape", '"').csv(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The raw table with typed values; blanks are missing."""
    text = read_csv(spark, path, schemas.RAW_TEXT)
    ints = ("anchor_id", "probe_id", "msm_id", "ttl", "dup", "rcvd", "sent", "timestamp", "packets", "interval")
    return text.withColumns({**{c: whole(c) for c in ints}, **{c: number(c) for c in ("min", "max", "avg")}})


def require_columns(df: DataFrame, columns, origin: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{origin}: missing columns {', '.join(missing)}")
    return df


def compare_names(given, expected) -> dict[str, list[str]]:
    """Feature-list difference both ways."""
    return {"faltam": sorted(set(expected) - set(given)), "sobram": sorted(set(given) - set(expected))}


def name_differences(df: DataFrame, names: Column, expected=K.FEATURES) -> DataFrame:
    """Rows whose list of names lacks an expected one or has another: (columns of ``df``, nome, lado)."""
    want = F.array(*[F.lit(n) for n in expected])
    told = lambda values, side: F.transform(values, lambda n: F.struct(n.alias("nome"), F.lit(side).alias("lado")))
    both = F.concat(told(F.array_except(want, names), "falta"), told(F.array_except(names, want), "sobra"))
    return df.select(*df.columns, F.inline(both))


def model_input(df: DataFrame, names=K.FEATURES) -> DataFrame:
    """Only the named features, in order; forbidden or absent columns are refused."""
    banned = sorted(set(names) & set(K.FORBIDDEN_COLUMNS))
    if banned:
        raise ContractError(f"columns not allowed as features: {', '.join(banned)}")
    return require_columns(df, names, "model input").select(*names)


def read_splits(spark: SparkSession, path: str, splits) -> DataFrame:
    """Only the asked splits of the stored final table; others are pruned by directory."""
    unknown = sorted(set(splits) - set(K.SPLITS))
    if unknown:
        raise ContractError(f"unknown split: {', '.join(unknown)}")
    return spark.read.parquet(path).where(F.col("split").isin(*splits))


def replay(df: DataFrame, flow: str, period: tuple[int, int], backfill_h: int, newest: int | None = None) -> DataFrame:
    """Stored rows of one flow in the period's last hours, newer than what is already known."""
    start = max(period[0], period[1] - backfill_h * 3600)
    t = F.col("timestamp")
    rows = df.where((F.col("id_fluxo") == flow) & (t >= start) & (t < period[1]))
    return rows if newest is None else rows.where(t > newest)


# ---------------------------------------------------------------- JSON
def read_result_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of ping results per file; the file, or else its folder, is named after the measurement."""
    rows = spark.read.schema(schemas.API_RESULT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)(?:\.json|/part-[^/]*)$", 1).try_cast("bigint")
    return rows.withColumn("msm_arquivo", name)


def unwrap_body(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Result lists from API bodies (bare list or ``{results}``); other shapes come back apart."""
    body = F.try_parse_json(F.col(col))
    items = F.coalesce(
        F.try_variant_get(body, "$", "array<variant>"), F.try_variant_get(body, "$.results", "array<variant>")
    )
    parsed = df.withColumn("_items", items)
    good = parsed.where("_items is not null").withColumn("item", F.explode("_items")).drop("_items")
    bad = parsed.where("_items is null").drop("_items").withColumn("motivo", F.lit("corpo inesperado"))
    return good, bad


def status_name(col: str) -> Column:
    """Name of a status given as an object or as plain text."""
    v = F.try_parse_json(F.col(col))
    return F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$", "string"), F.col(col))


def narrow_measurement(df: DataFrame, col: str) -> DataFrame:
    """The contract fields of measurement objects held as JSON text."""
    v = F.try_parse_json(F.col(col))

    def get(path, type_):
        return F.try_variant_get(v, path, type_)

    return df.select(
        get("$.id", "bigint").alias("id"), get("$.interval", "bigint").alias("interval"),
        get("$.is_public", "boolean").alias("is_public"), get("$.packets", "bigint").alias("packets"),
        get("$.target", "string").alias("target"), get("$.target_ip", "string").alias("target_ip"),
        get("$.type", "string").alias("type"), get("$.af", "bigint").alias("af"),
        F.coalesce(get("$.status.name", "string"), F.when(
            F.schema_of_variant(get("$.status", "variant")) == "STRING", get("$.status", "string"))).alias("status"),
    )


def narrow_anchor(df: DataFrame, col: str) -> DataFrame:
    """The contract fields of anchor objects held as JSON text; a geometry gives longitude and latitude."""
    v = F.try_parse_json(F.col(col))

    def get(path, type_):
        return F.try_variant_get(v, path, type_)

    return df.select(
        get("$.id", "bigint").alias("id"), get("$.fqdn", "string").alias("fqdn"), get("$.hostname", "string").alias("hostname"),
        get("$.ip_v4", "string").alias("ip_v4"), get("$.as_v4", "bigint").alias("asn_v4"), F.upper(F.trim(get("$.country", "string"))).alias("country"),
        get("$.geometry.coordinates[0]", "double").alias("lon"), get("$.geometry.coordinates[1]", "double").alias("lat"),
        F.coalesce(get("$.is_disabled", "boolean"), F.lit(False)).alias("is_disabled"),
    )


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of JSON lines, each row with the file it came from."""
    return spark.read.schema(schema).json(path).withColumn("arquivo", F.col("_metadata.file_name"))


def read_predictions(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored predictions of a date range; the dates prune directories."""
    rows = spark.read.parquet(path)
    day = F.col("data").cast("string")
    if start:
        rows = rows.where(day >= start)
    if end:
        rows = rows.where(day <= end)
    return rows


def parse_maps(df: DataFrame, columns=("features", "proba")) -> DataFrame:
    """Maps stored as JSON text become native maps."""
    return df.withColumns({c: F.from_json(c, "map<string,double>") for c in columns})


def anchor_continents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """anchor → continent from anchors documents, one per line or one per file."""
    schema = T.StructType([T.StructField("anchors", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("continent", T.StringType())])))])
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return doc.select(F.inline("anchors")).select(F.col("id").alias("anchor_id"), F.col("continent").alias("continente"))


# ---------------------------------------------------------------- windows
def _instant(text: str, zone_required: bool = False) -> int:
    raw = str(text).strip()
    if raw.replace(".", "", 1).isdigit() and float(raw) > 10**9:
        return int(float(raw))
    parsed = datetime.fromisoformat(raw.replace("Z", "+00:00"))
    if parsed.tzinfo is None:
        if zone_required:
            raise ContractError(f"instant without offset: {text}")
        parsed = parsed.replace(tzinfo=timezone.utc)
    return int(parsed.timestamp())


def collection_window(start: str | None = None, end: str | None = None, now: str | None = None, hours: int = 24):
    """Explicit pair of instants, or the last whole hours before ``now``."""
    if (start is None) != (end is None):
        raise ContractError("give both ends of the window or none")
    if start is None:
        current = _instant(now) if now else int(datetime.now(timezone.utc).timestamp())
        stop = current // 3600 * 3600
        return stop - hours * 3600, stop
    first, stop = _instant(start), _instant(end)
    if stop <= first:
        raise ContractError("the window must end after it starts")
    return first, stop


def checked_periods(rows: DataFrame, keys: tuple[str, ...] = (), zone_required: bool = False) -> DataFrame:
    """Period rows (nome, inicio, fim as text) with their instants and the reason against each, if any.

    ``keys`` name the document a row belongs to.  An instant is a number of seconds or ISO text, UTC where it
    has no offset.  A window may not begin before an earlier one of its document has ended.  A document without one of
    the periods A and B gets a row for it.
    """
    def instant(c: str) -> Column:
        text = F.trim(c)
        seconds = F.when(text.rlike(r"^[0-9]+([.][0-9]*)?$"), text.try_cast("double"))
        return F.when(seconds > 1e9, F.floor(seconds)).otherwise(F.unix_seconds(F.try_to_timestamp(text))).cast("long")

    has_zone = lambda c: F.trim(c).rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2}|^[0-9.]+)$")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    parsed = rows.select(*keys, "nome", F.col("inicio").alias("_inicio"), F.col("fim").alias("_fim"), instant("inicio").alias("inicio"), instant("fim").alias("fim"))
    parsed = parsed.withColumn("motivo", first_match([
        (blank("_inicio") | blank("_fim"), "limite ausente"),
        (F.lit(zone_required) & ~(has_zone("_inicio") & has_zone("_fim")), "instante sem fuso"),
        (F.col("inicio").isNull() | F.col("fim").isNull(), "instante invalido"),
        (F.col("fim") <= F.col("inicio"), "invertido"),
    ]))
    # windows of one document are a handful
    earlier = Window.partitionBy(*keys).orderBy("inicio", "fim", "nome").rowsBetween(Window.unboundedPreceding, -1)
    overlap = F.max(F.when(F.col("motivo").isNull(), F.col("fim"))).over(earlier) > F.col("inicio")
    told = parsed.withColumn("motivo", F.coalesce("motivo", F.when(overlap, "sobreposto"))).select(*keys, "nome", "inicio", "fim", "motivo")
    # each row stands for its own period; a document lacks those that none of its rows names
    names = told.groupBy(*keys).agg(F.collect_set(F.when(F.col("nome").isin(K.PERIOD_A, K.PERIOD_B), F.col("nome"))).alias("_names"))
    lacking = names.select(*keys, F.explode(F.array_except(F.array(F.lit(K.PERIOD_A), F.lit(K.PERIOD_B)), "_names")).alias("nome"))
    return told.unionByName(lacking.withColumn("motivo", F.lit("periodo ausente")), allowMissingColumns=True)


def period_windows(rows: DataFrame, zone_required: bool = False) -> tuple[tuple[str, int, int], ...]:
    """The windows of one document in time order; any that is refused stops the reading."""
    found = checked_periods(rows, (), zone_required).orderBy("inicio").collect()  # the periods of one document
    wrong = [f"{r.nome}: {r.motivo}" for r in found if r.motivo]
    if wrong:
        raise ContractError("; ".join(wrong))
    return tuple((r.nome, r.inicio, r.fim) for r in found)


def period_dimension(spark: SparkSession, path: str, zone_required: bool = False):
    """Period windows from the metadata document: every one is checked."""
    schema = T.StructType([T.StructField("periodos", T.ArrayType(T.StructType([
        T.StructField(c, T.StringType()) for c in ("nome", "inicio", "fim")])))])
    return period_windows(spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("periodos")), zone_required)
