"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space: the separators of words, as a Java / Python character class.
WORD_SEP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null text gives null."""
    return F.filter(F.split(text, WORD_SEP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row: a bound variable
    is not copied into its uses when projections merge or filters move down."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    escaped = "".join(f"\\x{ord(c):02x}" for c in chars)
    return F.length(text) - F.length(F.regexp_replace(text, f"[{escaped}]+", ""))


def order_hash(*cols: Column) -> Column:
    """60-bit order key from md5, the same number in DuckDB:
    ``('0x' || substr(md5(..), 1, 15))::BIGINT``."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def join_by_group(left: DataFrame, groups: DataFrame, keys: list[str], salt_on: Column,
                  max_rows: int = 10_000, salts: int = 32) -> DataFrame:
    """Left join of rows with a table of one row per group, nulls in the keys equal.

    The group table is counted: up to ``max_rows`` rows it is broadcast, beyond
    that each of its rows is repeated for every salt and the rows of a hot group
    are dealt over the salts by ``salt_on``."""
    groups = groups.withColumnsRenamed({k: f"__g_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__g_{k}"))
    gone = [f"__g_{k}" for k in keys]
    if groups.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(groups), same, "left").drop(*gone)
    salted = groups.withColumn("__g_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("__salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    return left.join(salted, same & (F.col("__salt") == F.col("__g_salt")), "left").drop("__salt", "__g_salt", *gone)
