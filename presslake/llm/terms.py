"""How distinctive a term is for its record.

Probabilistic relevance weighting: a term's weight is its inverse document
frequency times a term frequency that saturates (k1) and is normalised by the
record's length against the average (b). ``k1=None`` is the limit without
saturation, where the weight grows with the plain count.

Document frequencies cover all records. Terms that sit in a large share of the
records would make hot join keys; there are provably few of them (at most
HEAVY), so they are joined by broadcast and only the rest is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.session import StagedTable

#: A term is heavy if it holds more than 1/HEAVY of all (record, term) rows; so there are fewer than HEAVY such terms.
HEAVY = 512
WORD = r"[\p{L}\p{N}]{2,}"


def terms_of(columns: list[str]) -> Column:
    """The terms of a record: longest runs of two or more Unicode letters or digits, lower-cased. NULL is empty."""
    text = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def term_weights(df: DataFrame, key: str, columns: list[str], k1: float | None = 1.2, b: float = 0.75, idf: str = "probabilistic") -> DataFrame:
    """(key, term, tf, df, weight) for every term of every record; one row per (record, term).

    ``df`` must hold one row per key; rows with a NULL key are left out.
    idf ``probabilistic``: ln(1 + (n - df + 0.5) / (df + 0.5)); ``smooth``:
    ln((1 + n) / (1 + df)) + 1. Records without terms give no row but count in
    n and in the average length. Empty tables give no row.
    """
    records = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), terms_of(columns).alias("t"))
    counted = StagedTable(
        records.select("k", F.size("t").alias("len"), F.explode_outer("t").alias("term")).groupBy("k", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"))
    )
    occurring = counted.read().filter("term IS NOT NULL")
    sizes = counted.read().groupBy("k").agg(F.max("len").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), F.lit(1)).first()
    n, average = sizes.n, float(sizes.avg or 1.0)
    rows = occurring.count()
    frequencies = StagedTable(occurring.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    is_heavy = F.col("df") * HEAVY > rows
    heavy, light = frequencies.read().filter(is_heavy), frequencies.read().filter(~is_heavy)
    heavy_terms = [r.term for r in heavy.select("term").collect()]  # fewer than HEAVY
    common = F.col("term").isin(heavy_terms) if heavy_terms else F.lit(False)
    joined = occurring.filter(common).join(F.broadcast(heavy), "term").unionByName(occurring.filter(~common).join(light, "term"))
    d = F.col("df").cast("double")
    rarity = F.log(F.lit(1.0 + n) / (1.0 + d)) + 1.0 if idf == "smooth" else F.log(1.0 + (F.lit(float(n)) - d + 0.5) / (d + 0.5))
    tf = F.col("tf").cast("double")
    if k1 is None:
        saturated = tf
    else:
        saturated = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("len") / average))
    return joined.select(F.col("k").alias(key), "term", "tf", "df", (saturated * rarity).alias("weight"))


def top_terms(weights: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` terms of greatest weight per record; equal weights go to the smaller term in code point order."""
    order = Window.partitionBy(key).orderBy(F.desc("weight"), F.asc("term"))
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def first_versions(df: DataFrame, key: str, split: str, row_number: str, columns: list[str]) -> DataFrame:
    """One row per key: split ``train`` before ``dev`` before others, then the lowest row number, then the smallest content."""
    rank = F.when(F.col(split) == "train", 0).when(F.col(split) == "dev", 1).otherwise(2)
    order = Window.partitionBy(key).orderBy(rank, F.col(row_number).asc_nulls_last(), *[F.col(c) for c in columns])
    lean = df.filter(F.col(key).isNotNull()).select(key, split, row_number, *columns)
    return lean.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(key, *columns)
