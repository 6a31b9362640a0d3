"""URL rules by hash-prefix lookup of host-suffix and path-prefix expressions.

Each distinct (host, path) is expanded into every host suffix at a label border joined to every path
prefix that ends in ``/``.  The first four bytes of the expressions' SHA-256 meet the rules' in
an equi-join; full digests, the rest of the rule's path and precedence are confirmed after it.

Rules have columns host, path, verdict.  A rule fits its host and all subdomains if the url's path
starts with the rule's path.  The longest rule (host and path together) wins; among equally long ones
the longer host, then the smaller text; a rule given with both verdicts blocks.

Defined results: a null url, or one without ``://``, has empty host and path; a url that no rule
fits gets ``default`` and a null rule; repeated rows stay, each with its verdict; rules with a null or
empty host, path or verdict are ignored; empty tables give empty results or defaults.  Further
columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as literal text: host lower-cased in A-Z, path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def suffixes(host: str, most: str) -> Column:
    """Suffixes of ``host`` at label borders, of at most ``most`` labels."""
    n = f"size(split({host}, '[.]'))"
    return F.expr(f"transform(sequence(1, least({n}, {most})), k -> substring_index({host}, '.', -k))")


def prefixes(path: str, most: str) -> Column:
    """Prefixes of ``path`` that end in ``/``, of at most ``most`` slashes."""
    n = f"(size(split({path}, '/')) - 1)"
    return F.expr(f"if({n} < 1, cast(array() as array<string>), transform(sequence(1, greatest(1, least({n}, {most}))), k -> concat(substring_index({path}, '/', k), '/')))")


def prepared(rules: DataFrame) -> DataFrame:
    """One row per rule with its lookup key: the host and the path up to its last ``/``."""
    kept = rules.where("host > '' and startswith(path, '/') and verdict > ''").select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    once = kept.groupBy("rule_host", "rule_path").agg(F.when(F.max((F.col("verdict") == "block").cast("int")) == 1, "block").otherwise(F.min("verdict")).alias("rule_verdict"))
    key = F.concat("rule_host", F.lit(" "), F.regexp_extract("rule_path", r"(?s)\A(.*/)", 1))
    return once.withColumn("rule_digest", F.sha2(key, 256)).withColumn("short", F.conv(F.substring("rule_digest", 1, 8), 16, 10).cast("long"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``."""
    table = prepared(rules)
    # no rule needs a longer suffix or prefix than the rules themselves have
    shape = table.agg(F.max(F.size(F.split("rule_host", "[.]"))).alias("labels"), F.max(F.size(F.split("rule_path", "/")) - 1).alias("slashes")).first()
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    distinct = urls.select("host", "path").distinct()
    tried = distinct.withColumn("suffix", F.explode(suffixes("host", str(shape.labels or 1)))).withColumn("prefix", F.explode(prefixes("path", str(shape.slashes or 1))))
    tried = tried.withColumn("digest", F.sha2(F.concat("suffix", F.lit(" "), "prefix"), 256)).withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    fits = tried.join(table, "short").where("digest = rule_digest and suffix = rule_host and startswith(path, rule_path)")
    rule = F.concat("rule_host", "rule_path")
    # the order of struct fields is the precedence; min over inverted lengths keeps the smaller text
    best = fits.groupBy("host", "path").agg(F.min(F.struct(-F.length(rule), -F.length("rule_host"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
