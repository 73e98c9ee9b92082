"""Audits, slices, drift and request-log summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history_bucket(size: Column) -> Column:
    return F.when(size == 0, "0").when(size <= 5, "1-5").when(size <= 20, "6-20").otherwise("21+")


def candidate_bucket(size: Column) -> Column:
    return F.when(size <= 10, "1-10").when(size <= 50, "11-50").otherwise("51+")


def shown(value: Column, missing: str = "<missing>") -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", missing).otherwise(value)


def news_audit(news: DataFrame) -> DataFrame:
    """Rows, articles, repeated ids and missing texts of the delivered news, in one row."""
    per_id = news.filter("news_id IS NOT NULL").groupBy("news_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.coalesce("title", F.lit("")) == "", 1)).alias("t"),
        F.count(F.when(F.coalesce("abstract", F.lit("")) == "", 1)).alias("a"),
    )
    return per_id.agg(
        F.sum("n").alias("total_rows"),
        F.count(F.lit(1)).alias("unique_news"),
        F.sum(F.col("n") - 1).alias("duplicate_news"),
        F.sum("t").alias("missing_titles"),
        F.sum("a").alias("missing_abstracts"),
    )


def behavior_audit(rows: DataFrame) -> DataFrame:
    """Per source split: impressions, users, history and candidate sizes, labels and click-through rate."""
    labels = F.col("candidates")
    clicked = F.size(F.filter(labels, lambda c: c.clicked == 1))
    plain = F.size(F.filter(labels, lambda c: c.clicked == 0))
    unlabeled = F.size(F.filter(labels, lambda c: c.clicked.isNull()))
    lean = rows.select(
        "source_split", "impression_id", "user_id", F.size("history").alias("h"), F.size("candidates").alias("c"), clicked.alias("p"), plain.alias("m"), unlabeled.alias("u")
    )
    return lean.groupBy("source_split").agg(
        F.count(F.lit(1)).alias("n_impressions"),
        F.count_distinct(F.when(F.col("user_id") != "", F.col("user_id"))).alias("n_users"),
        F.count(F.when(F.col("h") == 0, 1)).alias("empty_histories"),
        F.round(F.avg("h"), 4).alias("mean_history"),
        F.median("h").alias("median_history"),
        F.round(F.avg("c"), 4).alias("mean_candidates"),
        F.median("c").alias("median_candidates"),
        F.sum("p").alias("clicked"),
        F.sum("m").alias("not_clicked"),
        F.sum("u").alias("unlabeled"),
        F.round(F.sum("p") / F.sum(F.col("p") + F.col("m")), 6).alias("click_through_rate"),
    )


def slices(per_impression: DataFrame, metrics: list[str]) -> DataFrame:
    """Macro metrics overall and by each slice column, in one pass with GROUPING SETS.

    ``per_impression`` holds history_slice, candidate_slice and category_slice.
    """
    columns = ["history_slice", "candidate_slice", "category_slice"]
    per_impression.createOrReplaceTempView("_presslake_slices")
    sets = ", ".join(["()"] + [f"({c})" for c in columns])
    family = "CASE grouping_id(" + ", ".join(columns) + ") WHEN 7 THEN 'overall' WHEN 3 THEN 'history' WHEN 5 THEN 'candidates' ELSE 'category' END"
    values = ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics)
    return per_impression.sparkSession.sql(
        f"SELECT {family} AS family, coalesce({', '.join(columns)}, 'all') AS slice, count(*) AS n_impressions, "
        f"count(mrr) AS n_evaluated, {values} FROM _presslake_slices GROUP BY GROUPING SETS ({sets})"
    )


def distribution(df: DataFrame, key: Column, weight: Column | None = None) -> DataFrame:
    """(key, share): relative frequencies."""
    counts = df.groupBy(key.alias("key")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("key", (F.col("n") / F.col("t")).alias("share"))  # a single row


def jensen_shannon(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row ``jsd`` (base 2) of two (key, share) distributions; missing keys have share 0."""
    both = first.select("key", F.col("share").alias("p")).join(second.select("key", F.col("share").alias("q")), "key", "full_outer").fillna(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return both.agg(F.round(F.coalesce(F.sum(part(F.col("p")) + part(F.col("q"))) / 2, F.lit(0.0)), 9).alias("jsd"))


def chronology_violations(rows: DataFrame, block: int = 100_000) -> DataFrame:
    """(source_split, n_violations): rows earlier than the row before them in their source split.

    Rows are compared in blocks of row numbers, so that no task sorts a split; the last time of the
    block before, empty ones skipped, is carried over by a table of one row per block.
    """
    keyed = rows.select("source_split", "source_row_number", "ts_us", F.expr(f"source_row_number div {block}").alias("_b"))
    order = Window.partitionBy("source_split", "_b").orderBy("source_row_number", "ts_us")
    edges = keyed.groupBy("source_split", "_b").agg(F.max(F.struct("source_row_number", "ts_us")).ts_us.alias("_last"))
    edges = edges.withColumn("_carried", F.lag("_last").over(Window.partitionBy("source_split").orderBy("_b"))).drop("_last")
    own = keyed.withColumn("_p", F.lag("ts_us").over(order)).alias("own")
    same = F.col("own.source_split").eqNullSafe(F.col("edges.source_split")) & F.col("own._b").eqNullSafe(F.col("edges._b"))
    both = own.join(edges.alias("edges"), same)
    late = both.filter(F.coalesce("_p", "_carried") > F.col("ts_us"))
    return late.groupBy(F.col("own.source_split").alias("source_split")).agg(F.count(F.lit(1)).alias("n_violations"))
