"""The feed's data model as DataFrames: articles, impressions in order, partitions, candidates, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def articles(news: DataFrame) -> DataFrame:
    """One row per news_id: split train before dev, then the lowest row number. NULL texts become ''."""
    rank = F.when(F.col("source_split") == "train", 0).when(F.col("source_split") == "dev", 1).otherwise(2)
    texts = ["category", "subcategory", "title", "abstract"]
    order = Window.partitionBy("news_id").orderBy(rank, "source_row_number", *texts)
    lean = news.filter("news_id <> ''").select("news_id", "source_split", "source_row_number", *texts)
    first = lean.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    return first.select("news_id", *[F.coalesce(c, F.lit("")).alias(c) for c in texts])


def impressions(behaviors: DataFrame) -> DataFrame:
    """One row per impression with a timestamp (``ts_us``), from its earliest delivery; NULL arrays become empty."""
    order = Window.partitionBy("impression_id").orderBy("ingested_at", "source_split", "source_row_number")
    kept = behaviors.filter("impression_id IS NOT NULL AND timestamp IS NOT NULL").withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    empty = "array<struct<position:int,news_id:string,clicked:tinyint>>"
    return kept.select(
        "impression_id",
        F.coalesce("user_id", F.lit("")).alias("user_id"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("ts_us"),
        "source_split",
        "source_row_number",
        F.coalesce("history", F.array().cast("array<string>")).alias("history"),
        F.coalesce("impressions", F.array().cast(empty)).alias("candidates"),
    )


def ordinals(rows: DataFrame) -> DataFrame:
    """``rows`` with their 1-based place in (ts_us, source_row_number, impression_id) order.

    Ranks are taken within hours and shifted by the running total of earlier
    hours, so that no task sorts more than an hour; the totals are bounded by
    the calendar.
    """
    hour = F.expr(f"(ts_us - pmod(ts_us, {HOUR_US}L)) div {HOUR_US}L")
    keyed = rows.withColumn("_hour", hour)
    totals = keyed.groupBy("_hour").agg(F.count(F.lit(1)).alias("_c"))
    totals = totals.select("_hour", (F.sum("_c").over(Window.orderBy("_hour")) - F.col("_c")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_hour").orderBy("ts_us", "source_row_number", "impression_id"))
    return keyed.withColumn("_own", own).join(totals, "_hour").withColumn("ordinal", F.col("_own") + F.col("_before")).drop("_hour", "_own", "_before")


def partitioned(rows: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Chronological split into train, validation and test by ordinal; bounds are computed as Python numbers from one count."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("shares must lie between 0 and 1 and leave a rest")
    n = rows.count()
    a, b = int(n * train), int(n * (train + validation))
    part = F.when(F.col("ordinal") <= a, "train").when(F.col("ordinal") <= b, "validation").otherwise("test")
    return ordinals(rows).withColumn("part", part)


def officially_partitioned(rows: DataFrame, train: float = 0.8) -> DataFrame:
    """The delivered split: the first share of ``train`` in time order is train, its rest validation, and all of ``dev`` is test.

    At least one row stays on either side of the bound; rows of other source splits are left out.
    """
    if not 0 < train < 1:
        raise ValueError("the share must lie between 0 and 1")
    delivered = rows.filter("source_split IN ('train', 'dev')")
    counts = {r.source_split: r["count"] for r in delivered.groupBy("source_split").count().collect()}
    n = counts.get("train", 0)
    if n < 2 or not counts.get("dev"):
        raise ValueError("the split needs two train rows and one dev row")
    bound = min(max(int(n * train), 1), n - 1)
    own = ordinals(delivered.filter("source_split = 'train'")).withColumn("part", F.when(F.col("ordinal") <= bound, "train").otherwise("validation"))
    return own.unionByName(ordinals(delivered.filter("source_split = 'dev'")).withColumn("part", F.lit("test")))


def integrity(rows: DataFrame, delivered: DataFrame) -> dict[str, int]:
    """Violations of a split: raises if any partition is empty, or impressions or source rows are shared, or partitions overlap in time order.

    ``rows`` hold part, ordinal and the source keys, ``delivered`` the table they
    come from. Returned are counts that are reported only: impressions that were
    delivered several times, and users that several partitions share.
    """
    parts = {r.part: r for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")).collect()}
    order = ("train", "validation", "test")
    broken = [f"{p} is empty" for p in order if p not in parts]
    broken += [f"{b} begins before {a} ends" for a, b in zip(order, order[1:]) if a in parts and b in parts and parts[b].lo < parts[a].hi]
    shared = lambda *keys: rows.groupBy(*keys).agg(F.count_distinct("part").alias("n")).filter("n > 1").count()
    for name, keys in (("impressions", ("impression_id",)), ("source rows", ("source_split", "source_row_number"))):
        if n := shared(*keys):
            broken.append(f"{n} {name} are in several partitions")
    if broken:
        raise ValueError("; ".join(broken))
    users = rows.filter("user_id <> ''").groupBy("user_id").agg(F.count_distinct("part").alias("n")).filter("n > 1").count()
    repeated = delivered.filter("impression_id IS NOT NULL").groupBy("impression_id").count().filter("count > 1").count()
    return {"shared_users": users, "repeated_impressions": repeated}


def candidates(rows: DataFrame, carry: tuple[str, ...] = ("part", "user_id", "ts_us", "ordinal")) -> DataFrame:
    """One row per candidate: impression_id, carried columns, position, news_id, label (NULL: unlabeled)."""
    return rows.select("impression_id", *carry, F.inline("candidates").alias("position", "news_id", "label"))


def history(rows: DataFrame, carry: tuple[str, ...] = ("part",)) -> DataFrame:
    """One row per history entry with its place; order and duplicates are kept."""
    return rows.select("impression_id", *carry, F.posexplode("history").alias("place", "news_id"))
