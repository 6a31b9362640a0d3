"""Raw pings and their dimensions derived from the star-schema test tables.

``events`` becomes one ping execution per row; anchors, probes and measurements come from
``supplier``, ``customer``, ``nation`` and ``region`` by integer arithmetic on their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rttscope import contract as K

# Period windows of the derived pings (half-open, Unix seconds).
A_START, B_START, B_END = 1704067200, 1705363200, 1706659200
PERIODS = ((K.PERIOD_A, A_START, B_START), (K.PERIOD_B, B_START, B_END))
# Parameters suited to the derived series, which is sparser than a real 240 s schedule.
INTERVAL_S = 28_800
GAP_S = 21_600
TRAIN_DAYS, VALID_DAYS = 10, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(col: str) -> str:
    return f"concat(cast({col} div 100 as string), '.', lpad(cast({col} % 100 as string), 2, '0'))"


def _packet(nth: int, col: str) -> str:
    return (
        f"case when rcvd >= {nth} then concat('{{\"rtt\":', {_cents(col)}, '}}') "
        "else '{\"x\":\"*\"}' end"
    )


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw ping execution per event, narrow and unshuffled."""
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_id % 7 as j",
        "unix_seconds(cast(ts as timestamp)) as timestamp",
        "cast(round(value * 100) as bigint) + 500 as c0",
        "3 - case when event_type = 'error' then event_id % 4 else 0 end as rcvd",
    ).withColumns({"c1": F.expr("c0 + j * 25"), "c2": F.expr("c0 + j * 50")})
    base = base.withColumns({
        "cmax": F.expr("case rcvd when 3 then c2 when 2 then c1 else c0 end"),
        "csum": F.expr("case rcvd when 3 then c0 + c1 + c2 when 2 then c0 + c1 else c0 end"),
    })

    def stat(value: str) -> str:
        return (
            "case when rcvd = 0 then cast(-1 as double) "
            f"when event_id % 11 = 0 then null else {value} end"
        )

    return base.selectExpr(
        "event_id", "user_id % 5 as probe_id", "user_id % 2 as anchor_id",
        "concat(cast(user_id % 5 as string), '_', cast(user_id % 2 as string)) as id_fluxo",
        "1000 + user_id % 10 as msm_id", "timestamp", "3L as sent", "rcvd",
        "case when rcvd = 0 then null when event_id % 50 = 0 then 120 else 54 + event_id % 3 end as ttl",
        f"concat('[', {_packet(1, 'c0')}, ',', {_packet(2, 'c1')}, ',', {_packet(3, 'c2')}, ']') as result",
        f"{stat('cast(c0 as double) / 100')} as min",
        f"{stat('cast(cmax as double) / 100')} as max",
        f"{stat('round(cast(csum as double) / (100 * rcvd), 6)')} as avg",
        "case when event_id % 97 = 0 then 'traceroute' else 'ping' end as type",
        "case when event_id % 101 = 0 then 6 else 4 end as af",
    )


# fixed values: country code given to each nation key, in key order
ISO = "DZ,BR,CN,FR,IR,EG,AR,IN,DE,IQ,ET,CA,ID,RO,JO,KE,PE,JP,RU,SA,MA,US,VN,GB,OM"
COUNTRY = f"split_part('{ISO}', ',', cast(n_nationkey as int) + 1)"
# Which continent name of the contract a nation belongs to.
CONTINENT = (
    f"case when r_name = 'AFRICA' then 'África' when r_name = 'EUROPE' then 'Europa' "
    f"when r_name = 'AMERICA' and {COUNTRY} in ('AR', 'BR', 'PE') then 'América do Sul' "
    "when r_name = 'AMERICA' then 'América do Norte' else 'Ásia' end"
)


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country dimension: code, continent, region.  At most one row per nation."""
    return table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")
    ).selectExpr(
        "n_nationkey", f"{COUNTRY} as country", f"{CONTINENT} as continent",
        "r_name as region",
    )


ANCHOR_COLUMNS = {
    "anchor_id": "s_suppkey",
    "fqdn": "concat('host', cast(s_suppkey as {str}), '.', lower(country), '.example')",
    "hostname": "case when s_suppkey % 4 = 0 then concat('host', cast(s_suppkey as {str})) else '  ' end",
    "ip_v4": "case when s_suppkey % 13 = 0 then null else concat('10.', cast(s_suppkey {div} 250 % 250 as {str}), "
    "'.', cast(s_suppkey % 250 as {str}), '.1') end",
    "country": "country",
    "asn_v4": "case when s_suppkey % 16 = 0 then null else 64500 + s_suppkey % 40 end",
    "lon": "case when s_suppkey % 17 = 0 then null else cast(s_suppkey * 37 % 360 - 180 as double) end",
    "lat": "case when s_suppkey % 17 = 0 then null else cast(s_suppkey * 53 % 180 - 90 as double) end",
    "is_disabled": "s_suppkey % 19 = 0",
}
MEASUREMENT_COLUMNS = {
    "msm_id": "anchor_id * 10 + k",
    "anchor_id": "anchor_id",
    "target": "case when k = 0 then upper(fqdn) else ip_v4 end",
    "target_ip": "case when k = 0 then null else ip_v4 end",
    "type": "case when k = 2 and anchor_id % 3 = 0 then 'traceroute' else 'ping' end",
    "af": "case when anchor_id % 7 = 0 and k = 1 then 6 else 4 end",
    "is_public": "not (anchor_id % 11 = 0 and k = 2)",
    "status": "case when anchor_id % 5 = 0 and k = 2 then 'Stopped' else 'Ongoing' end",
    "interval": "case when anchor_id % 29 = 28 then null else 240 + 60 * k end",
    "packets": "3",
    "is_mesh": "k < 2",
    "target_url": "concat('https://example.org/anchors/', cast(anchor_id as {str}), '/')",
}
PROBE_COLUMNS = {
    "probe_id": "c_custkey",
    "country": "country",
    "continent": "continent",
    "asn_v4": "case when c_custkey % 12 = 0 then null else 65000 + c_custkey % 60 end",
    "lon": "case when c_custkey % 31 = 0 then null else cast(c_custkey * 41 % 360 - 180 as double) end",
    "lat": "case when c_custkey % 31 = 0 then null else cast(c_custkey * 59 % 180 - 90 as double) end",
    "status": "case when c_custkey % 9 = 0 then 'Disconnected' else 'Connected' end",
    "is_public": "c_custkey % 14 <> 0",
    "is_anchor": "c_custkey % 6 = 0",
    "address_v4": "case when c_custkey % 25 = 0 then null else concat('172.', cast(16 + c_custkey {div} 60000 as {str}), "
    "'.', cast(c_custkey {div} 250 % 240 as {str}), '.', cast(c_custkey % 250 as {str})) end",
    "tags": "concat('[{{\"slug\":\"seg-', lower(c_mktsegment), '\"}},\"home\",7]')",
}


def _projection(columns: dict[str, str]) -> list[str]:
    return [f"{e.format(str='string', div='div')} as {n}" for n, e in columns.items()]


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate anchor per supplier; some lack coordinates, an ASN or an address."""
    s = table(spark, sf_dir, "supplier").join(
        countries(spark, sf_dir), F.expr("s_nationkey = n_nationkey")
    )
    return s.selectExpr(*_projection(ANCHOR_COLUMNS))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three measurements per anchor, some of an unsuited kind."""
    a = anchors(spark, sf_dir).selectExpr("anchor_id", "fqdn", "ip_v4", "explode(sequence(0, 2)) as k")
    return a.selectExpr(*_projection(MEASUREMENT_COLUMNS))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probe per customer."""
    c = table(spark, sf_dir, "customer").join(
        countries(spark, sf_dir), F.expr("c_nationkey = n_nationkey")
    )
    return c.selectExpr(*_projection(PROBE_COLUMNS))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which probes take part in which measurement: 1 to 4 anchors per probe, by arithmetic."""
    total = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as probe_id")
    linked = c.selectExpr("probe_id", "explode(sequence(0, cast(probe_id % 4 as int))) as i")
    anchor = (F.col("probe_id") * 7 + F.col("i") * 13) % total
    return linked.select(
        (anchor * 10 + F.col("probe_id") % 2).alias("msm_id"), "probe_id"
    ).dropDuplicates()
