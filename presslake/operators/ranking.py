"""Scorers of logged candidates and impression-grouped ranking metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Discounts 1/log2(rank+1) of the first ten ranks, as Python computes them.
DISCOUNTS = [1.0 / math.log2(r + 1) for r in range(1, 11)]
IDEAL = [sum(DISCOUNTS[:k]) for k in range(11)]


def _from_table(values: list[float], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def ranked(scored: DataFrame) -> DataFrame:
    """Adds ``rank``: score descending, then position."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("impression_id").orderBy(F.desc("score"), "position")).cast("bigint"))


def by_original_order(cand: DataFrame) -> DataFrame:
    return cand.withColumn("score", -F.col("position").cast("double"))


def clicks(cand: DataFrame) -> DataFrame:
    """Clicks per article: (news_id, clicks)."""
    return cand.filter("label = 1").groupBy("news_id").agg(F.count(F.lit(1)).alias("clicks"))


def by_popularity(cand: DataFrame, fit: DataFrame, fallback: float = 0.0) -> DataFrame:
    """Score: the fit partition's clicks on the article, else ``fallback``."""
    stats = clicks(fit).select("news_id", F.col("clicks").cast("double").alias("score"))
    return cand.join(stats, "news_id", "left").withColumn("score", F.coalesce("score", F.lit(fallback)))


def decayed_clicks(fit: DataFrame, half_life_hours: float) -> DataFrame:
    """Clicks weighted by 0.5^(age / half-life), age counted from the fit's last impression; rounded so that sums don't depend on order."""
    last = fit.agg(F.max("ts_us")).first()[0] or 0
    age = F.greatest((F.lit(last) - F.col("ts_us")) / 3.6e9, F.lit(0.0))
    weight = F.pow(F.lit(0.5), age / half_life_hours)
    return fit.filter("label = 1").groupBy("news_id").agg(F.round(F.sum(weight), 9).alias("decayed"))


def by_decayed_popularity(cand: DataFrame, fit: DataFrame, half_life_hours: float, fallback: float = 0.0) -> DataFrame:
    stats = decayed_clicks(fit, half_life_hours).select("news_id", F.col("decayed").alias("score"))
    return cand.join(stats, "news_id", "left").withColumn("score", F.coalesce("score", F.lit(fallback)))


def history_counts(hist: DataFrame, articles: DataFrame, column: str) -> DataFrame:
    """(impression_id, column, n): known history entries per value; duplicates count."""
    return hist.join(articles.select("news_id", column), "news_id").groupBy("impression_id", column).agg(F.count(F.lit(1)).alias("n"))


def by_category_affinity(cand: DataFrame, hist: DataFrame, articles: DataFrame, category_weight: float = 1.0, subcategory_weight: float = 0.5) -> DataFrame:
    """Weighted number of history entries in the candidate's category and subcategory; 0 without known history. '' equals ''."""
    own = cand.join(articles.select("news_id", "category", "subcategory"), "news_id", "left")
    c = history_counts(hist, articles, "category").withColumnRenamed("n", "_c")
    s = history_counts(hist, articles, "subcategory").withColumnRenamed("n", "_s")
    joined = own.join(c, ["impression_id", "category"], "left").join(s, ["impression_id", "subcategory"], "left")
    score = category_weight * F.coalesce("_c", F.lit(0)) + subcategory_weight * F.coalesce("_s", F.lit(0))
    return joined.withColumn("score", score.cast("double")).drop("_c", "_s")


#: An impression is heavy if it holds more than 1/HEAVY of all rows; there are fewer than HEAVY of them. Score bands of a heavy one.
HEAVY, BANDS = 512, 64


def _ranks(scored: DataFrame) -> DataFrame:
    """``scored`` with rank (score descending, then position), n rows of the impression, and of its tied block the rows and the first rank.

    A heavy impression is ranked in bands of its score, shifted by the rows of
    the bands above, so that no task sorts it whole; equal scores share a band.
    """
    total = scored.count()
    heavy = [r.impression_id for r in scored.groupBy("impression_id").count().filter(F.col("count") * HEAVY > max(total, HEAVY * 1000)).select("impression_id").collect()]

    def within(df: DataFrame, *band: str) -> DataFrame:
        out = df.withColumn("rank", F.row_number().over(Window.partitionBy("impression_id", *band).orderBy(F.desc("score"), "position")).cast("bigint"))
        tie = Window.partitionBy("impression_id", *band, "score")
        return out.withColumns({"ties": F.count(F.lit(1)).over(tie), "first": F.min("rank").over(tie), "n": F.count(F.lit(1)).over(Window.partitionBy("impression_id", *band))})

    if not heavy:
        return within(scored)
    is_heavy = F.coalesce(F.col("impression_id").isin(heavy), F.lit(False))
    hot = scored.filter(is_heavy)
    edges = sorted({e for e in hot.filter("score IS NOT NULL AND NOT isnan(score)").agg(F.percentile_approx("score", [k / BANDS for k in range(1, BANDS)], 10_000).alias("e")).first().e or []}, reverse=True)
    band = F.lit(len(edges))
    for k, e in reversed(list(enumerate(edges))):
        band = F.when(F.col("score") >= e, k).otherwise(band)  # NaN is above all, as in the order
    banded = hot.withColumn("_band", F.when(F.col("score").isNull(), len(edges) + 1).otherwise(band))
    sizes = banded.groupBy("impression_id", "_band").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("impression_id")  # of a few bands
    sizes = sizes.select("impression_id", "_band", F.coalesce(F.sum("_c").over(whole.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"), F.sum("_c").over(whole).alias("_n"))
    own = within(banded, "_band").join(F.broadcast(sizes), ["impression_id", "_band"])  # fewer than HEAVY x (BANDS + 2) rows
    shifted = own.withColumns({"rank": F.col("rank") + F.col("_above"), "first": F.col("first") + F.col("_above"), "n": F.col("_n")}).drop("_band", "_above", "_n")
    return within(scored.filter(~is_heavy)).unionByName(shifted)


def impression_metrics(scored: DataFrame, carry: tuple[str, ...] = ("part",)) -> DataFrame:
    """One row per impression: skipped (reason or NULL), the metrics, and auc (NULL with one class).

    Ranks are exact; the AUC is the rank-sum form with ties at half.
    """
    r = _ranks(scored)
    # Ascending average rank of a tied block that begins at descending rank ``first``.
    ascending = F.col("n") - F.col("first") - (F.col("ties") - 1) / 2.0 + 1.0
    positive = F.col("label") == 1
    top = lambda k: F.sum(F.when(positive & (F.col("rank") <= k), 1).otherwise(0))
    gain = lambda k: F.sum(F.when(positive & (F.col("rank") <= k), _from_table(DISCOUNTS, (F.col("rank") - 1).cast("int"))).otherwise(0.0))
    g = r.groupBy("impression_id", *carry).agg(
        F.max(F.col("label").isNull()).alias("unlabeled"),
        F.max(F.col("score").isNull()).alias("missing"),
        F.max(F.isnan("score") | (F.abs("score") == float("inf"))).alias("infinite"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(positive, 1).otherwise(0)).alias("p"),
        F.min(F.when(positive, F.col("rank"))).alias("best"),
        F.sum(F.when(positive, ascending)).alias("ranks"),
        top(5).alias("t5"),
        top(10).alias("t10"),
        gain(5).alias("g5"),
        gain(10).alias("g10"),
    )
    reason = F.when(F.col("unlabeled"), "unlabeled_impression").when(F.col("missing"), "missing_score").when(F.col("infinite"), "non_finite_score")
    p, n = F.col("p"), F.col("n")
    ndcg = lambda g, k: F.when(p > 0, F.col(g) / _from_table(IDEAL, F.least(p, F.lit(k)).cast("int"))).otherwise(0.0)
    valid = lambda c: F.when(F.col("skipped").isNull(), c)
    out = g.withColumn("skipped", reason)
    return out.select(
        "impression_id",
        *carry,
        "skipped",
        valid(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"),
        valid(ndcg("g5", 5)).alias("ndcg_5"),
        valid(ndcg("g10", 10)).alias("ndcg_10"),
        valid(F.when(p > 0, F.col("t5") / p).otherwise(0.0)).alias("recall_5"),
        valid(F.when(p > 0, F.col("t10") / p).otherwise(0.0)).alias("recall_10"),
        valid((F.col("t5") > 0).cast("double")).alias("hit_rate_5"),
        valid((F.col("t10") > 0).cast("double")).alias("hit_rate_10"),
        valid(F.when((p > 0) & (p < n), (F.col("ranks") - p * (p + 1) / 2.0) / (p * (n - p)))).alias("auc"),
    )


METRICS = ["mrr", "ndcg_5", "ndcg_10", "recall_5", "recall_10", "hit_rate_5", "hit_rate_10", "auc"]


def macro_metrics(per_impression: DataFrame, by: tuple[str, ...] = ("part",)) -> DataFrame:
    """Macro means over the evaluated impressions, with counts of what was skipped."""
    return per_impression.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_impressions"),
        F.count(F.when(F.col("skipped").isNull(), 1)).alias("n_evaluated"),
        F.count(F.when(F.col("skipped") == "unlabeled_impression", 1)).alias("n_unlabeled"),
        F.count("auc").alias("n_auc"),
        *[F.round(F.avg(m), 6).alias(m) for m in METRICS],
    )
