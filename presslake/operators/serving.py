"""Ranking of requests in batch: validation, scoring against the served catalog, and the request log it yields.

A request is a history and a list of candidates. Requests are a DataFrame, so
the same operators serve a file of them or the micro-batches of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.operators import monitoring, ranking

MOST_IDS = 1_000
POLICIES = ("category_affinity", "original_order")


def validated(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests with trimmed ids, rejected requests with ``reason``) of (request_id, history, candidates).

    A request has one to 1 000 candidates and at most 1 000 history ids, none
    of them blank. NULL arrays count as empty.
    """
    ids = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x))
    clean = requests.select("request_id", ids(F.col("history")).alias("history"), ids(F.col("candidates")).alias("candidates"))
    blank = lambda c: F.exists(c, lambda x: x.isNull() | (x == ""))
    reason = (
        F.when(F.size("candidates") == 0, "no_candidates")
        .when((F.size("candidates") > MOST_IDS) | (F.size("history") > MOST_IDS), "too_many_ids")
        .when(blank("candidates") | blank("history"), "blank_id")
    )
    marked = clean.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").select("request_id", "reason")


def ranked(requests: DataFrame, catalog: DataFrame, policy: str = "category_affinity") -> DataFrame:
    """(request_id, news_id, original_position, rank, score): known candidates by score, then by their place in the request.

    ``catalog`` holds news_id, category and subcategory, each id once.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy {policy} can't be served")
    cand = requests.select(F.col("request_id").alias("impression_id"), F.posexplode("candidates").alias("position", "news_id")).join(catalog.select("news_id"), "news_id", "left_semi")
    if policy == "original_order":
        scored = ranking.by_original_order(cand)
    else:
        read = requests.select(F.col("request_id").alias("impression_id"), F.explode("history").alias("news_id"))
        scored = ranking.by_category_affinity(cand, read, catalog)
    place = F.row_number().over(Window.partitionBy("impression_id").orderBy(F.desc("score"), "position"))
    return scored.select(F.col("impression_id").alias("request_id"), "news_id", F.col("position").cast("bigint").alias("original_position"), place.cast("bigint").alias("rank"), "score")


def request_log(requests: DataFrame, catalog: DataFrame, ranked_rows: DataFrame) -> DataFrame:
    """One log row per request: sizes, missing and unknown ids, known history, and the categories of its ten best.

    The known history is its length less the *distinct* unknown ids, so a
    repeated unknown id counts as known, as the service reports it.
    """
    has = catalog.select("news_id", F.lit(True).alias("known"))

    def lost(column: str, name: str) -> DataFrame:
        each = requests.select("request_id", F.explode(column).alias("news_id")).join(has, "news_id", "left")
        gone = F.when(F.col("known").isNull(), F.col("news_id"))
        return each.groupBy("request_id").agg(F.count(gone).alias(f"{name}_count"), F.count_distinct(gone).alias(f"{name}_ids"))

    top = ranked_rows.filter("rank <= 10").join(catalog.select("news_id", monitoring.shown(F.col("category")).alias("category")), "news_id")
    counts = top.groupBy("request_id", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("request_id")
    counts = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("top_ranked_category_counts"))
    number = ranked_rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("ranked_candidate_count"))
    out = requests.select("request_id", F.size("history").cast("bigint").alias("history_id_count"), F.size("candidates").cast("bigint").alias("candidate_id_count"))
    for more in (lost("candidates", "missing_candidate"), lost("history", "unknown_history"), number, counts):
        out = out.join(more, "request_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select(
        "request_id", "history_id_count", "candidate_id_count", zero("ranked_candidate_count").alias("ranked_candidate_count"),
        zero("missing_candidate_count").alias("missing_candidate_count"), zero("unknown_history_ids").alias("unknown_history_count"),
        (F.col("history_id_count") - zero("unknown_history_ids")).alias("known_history_count"), (F.col("history_id_count") == 0).alias("empty_history"),
        F.lit("success").alias("status"), "top_ranked_category_counts",
    )


def _rate(part: str, whole: Column) -> Column:
    return F.round(F.sum(part) / F.nullif(whole, F.lit(0)), 9)


def log_summary(log: DataFrame) -> DataFrame:
    """Counts, rates and sizes of a request log, in one row."""
    size = F.col("candidate_id_count").cast("double")
    return log.agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(F.col("status") == "success").alias("successful_requests"),
        F.count_if(F.col("status") == "failed").alias("failed_requests"),
        F.coalesce(F.sum("missing_candidate_count"), F.lit(0)).alias("missing_candidates"),
        _rate("missing_candidate_count", F.sum("candidate_id_count")).alias("missing_candidate_rate"),
        F.coalesce(F.sum("unknown_history_count"), F.lit(0)).alias("unknown_history"),
        _rate("unknown_history_count", F.sum("history_id_count")).alias("unknown_history_rate"),
        F.count_if("empty_history").alias("empty_history"),
        F.round(F.avg(F.col("empty_history").cast("double")), 9).alias("empty_history_rate"),
        F.min(size).alias("min_candidates"),
        F.round(F.avg(size), 6).alias("mean_candidates"),
        F.round(F.percentile(size, F.lit(0.5)), 6).alias("p50_candidates"),
        F.round(F.percentile(size, F.lit(0.95)), 6).alias("p95_candidates"),
        F.max(size).alias("max_candidates"),
    )


def log_categories(log: DataFrame) -> DataFrame:
    """(category, n, share) over the ten best of all requests: the maps of the log summed."""
    each = log.select(F.explode("top_ranked_category_counts").alias("category", "n")).groupBy("category").agg(F.sum("n").alias("n"))
    total = each.agg(F.sum("n").alias("t"))
    return each.crossJoin(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))  # a single row


def log_drift(log: DataFrame, reference: DataFrame) -> DataFrame:
    """Two Jensen-Shannon divergences and two absolute differences of rates between a log and a reference log, in one row."""
    history = lambda df: monitoring.distribution(df, monitoring.history_bucket(F.col("history_id_count")))
    candidates = lambda df: monitoring.distribution(df, monitoring.candidate_bucket(F.col("candidate_id_count")))
    rates = lambda df, tag: df.agg(
        F.avg(F.col("empty_history").cast("double")).alias(f"e{tag}"), (F.sum("missing_candidate_count") / F.sum("candidate_id_count")).alias(f"m{tag}")
    )
    one = monitoring.jensen_shannon(history(reference), history(log)).withColumnRenamed("jsd", "history_length_jsd")
    two = monitoring.jensen_shannon(candidates(reference), candidates(log)).withColumnRenamed("jsd", "candidate_count_jsd")
    out = one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(rates(log, 1))).crossJoin(F.broadcast(rates(reference, 0)))  # single rows
    gap = lambda k: F.round(F.abs(F.coalesce(f"{k}1", F.lit(0.0)) - F.coalesce(f"{k}0", F.lit(0.0))), 9)
    return out.select(F.round("history_length_jsd", 6).alias("history_length_jsd"), F.round("candidate_count_jsd", 6).alias("candidate_count_jsd"), gap("e").alias("empty_history_rate_difference"), gap("m").alias("missing_candidate_rate_difference"))
