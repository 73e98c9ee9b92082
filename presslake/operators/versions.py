"""Redelivered rows: exact removal of copies before an expanding step.

Expanding operators (explode) must emit a set. Removing copies of the *input*
rows is far cheaper than removing copies of the expanded rows, and is exact
unless one key arrives with several different contents. That is checked first
on hashes; only then is the expanded result made distinct as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def has_conflicts(df: DataFrame, keys: list[str], content: list[str]) -> bool:
    """Does any key occur with two different contents?

    Two hash aggregates of fixed width per key, combined before the shuffle, so
    a key that holds a third of the rows costs one row per task. Hash equality of
    different contents (probability 2**-64 a pair) is covered by a second seed.
    """
    h = F.xxhash64(*[F.col(c) for c in content], *[F.col(c).isNull() for c in content])
    g = F.hash(*[F.col(c) for c in content], F.lit(17))
    found = (
        df.select(*keys, h.alias("_h"), g.alias("_g"))
        .groupBy(*keys)
        .agg(F.min("_h").alias("a"), F.max("_h").alias("b"), F.min("_g").alias("c"), F.max("_g").alias("d"))
        .filter("a <> b OR c <> d")
    )
    return not found.isEmpty()


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows over ``columns`` only, combined before the shuffle."""
    return df.select(*columns).distinct()
