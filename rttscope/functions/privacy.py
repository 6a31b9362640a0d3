"""Pseudonyms and stable ids."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pseudonym(col: str, salt: str | None) -> Column:
    """Salted SHA-256 of a value; without a salt the value is blanked, never passed through."""
    if not salt:
        return F.lit(None).cast("string")
    text = F.col(col).cast("string")
    return F.when(text.isNotNull(), F.sha2(F.concat(F.lit(salt), F.lit(":"), text), 256))


def pseudonymise(df: DataFrame, columns: list[str], salt: str | None) -> DataFrame:
    """Replace each identifying column by ``<column>_hash``; says so when no salt was given."""
    named = [c for c in columns if c in df.columns]
    out = df.withColumns({f"{c}_hash": pseudonym(c, salt) for c in named}).drop(*named)
    return out if salt else out.withColumn("privacidade", F.lit("identificador omitido; sal ausente"))


def alert_id(rule: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", rule, key), 256), 1, 16)


def seeded_order(seed: int, *cols) -> Column:
    """A repeatable pseudo-random ordering key, the same in any engine with MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
