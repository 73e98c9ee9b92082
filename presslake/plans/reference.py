"""Queries of the feed-evaluation operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslake.operators import dense, features, feed, monitoring, projection, ranking, selection, text
from presslake.session import StagedTable, cut, release
from presslake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


class _Views:
    """The views most queries start from; all lazy. The split rows are read by several branches of a query and kept between them."""

    def __init__(self, spark: SparkSession, d: str):
        self.articles = feed.articles(table(spark, d, "news"))
        self.rows = feed.partitioned(feed.impressions(table(spark, d, "behaviors"))).persist(StorageLevel.MEMORY_AND_DISK)

    def stage(self) -> _Views:
        """The split rows written once, for queries of many steps: they take no executor's memory, and the shuffle files behind them go."""
        if not self.__dict__.get("staged"):
            self.rows.unpersist()
            self.rows, self.staged = StagedTable(self.rows).read(), True
            release(self.rows.sparkSession)
        return self

    def candidates(self, *parts: str) -> DataFrame:
        return feed.candidates(self.rows.filter(F.col("part").isin(*parts)) if parts else self.rows)

    def history(self, *parts: str) -> DataFrame:
        return feed.history(self.rows.filter(F.col("part").isin(*parts)) if parts else self.rows)


_LATEST: dict[tuple[str, str], _Views] = {}


def _Feed(spark: SparkSession, d: str) -> _Views:  # noqa: N802
    """The views of a folder; those of another folder or session are released, so that a session keeps one split at most."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LATEST:
        for old in _LATEST.values():
            try:
                old.rows.unpersist()
            except Exception:  # noqa: BLE001  the session of the old views has ended
                pass
        _LATEST.clear()
        _LATEST[key] = _Views(spark, d)
    elif not _LATEST[key].__dict__.get("staged") and not _LATEST[key].rows.storageLevel.useMemory:  # the caller cleared the cache
        _LATEST[key].rows.persist(StorageLevel.MEMORY_AND_DISK)
    return _LATEST[key]


# --- audit, split, integrity ---


@query
def audit_news(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.news_audit(table(spark, d, "news"))


@query
def audit_categories(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "news").select(monitoring.shown(F.col("category"), "(missing)").alias("category"))
    return news.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def audit_subcategories(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "news").select(monitoring.shown(F.col("subcategory"), "(missing)").alias("subcategory"))
    return news.groupBy("subcategory").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def audit_splits(spark: SparkSession, d: str) -> DataFrame:
    """Delivered rows by table and source split, and of behaviors those without a timestamp."""
    rows = lambda name, late: table(spark, d, name).groupBy("source_split").agg(F.lit(name).alias("delivery"), F.count(F.lit(1)).alias("n_rows"), late.alias("n_invalid_timestamps"))
    return rows("news", F.lit(0).cast("bigint")).unionByName(rows("behaviors", F.count_if(F.col("timestamp").isNull())))


@query
def audit_missing_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without an article: entries, ids, and the first twenty ids in order."""
    rows = feed.impressions(table(spark, d, "behaviors"))
    lost = feed.candidates(rows, ()).join(feed.articles(table(spark, d, "news")).select("news_id"), "news_id", "left_anti").groupBy("news_id").count()
    first = lost.select("news_id").orderBy("news_id").limit(20).agg(F.array_join(F.array_sort(F.collect_list("news_id")), " ").alias("samples"))
    total = lost.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_entries"), F.count(F.lit(1)).alias("n_ids"))
    return total.crossJoin(F.broadcast(first))  # single rows


@query
def audit_behaviors(spark: SparkSession, d: str) -> DataFrame:
    return monitoring.behavior_audit(feed.impressions(table(spark, d, "behaviors")))


@query
def dedupe_news(spark: SparkSession, d: str) -> DataFrame:
    return feed.articles(table(spark, d, "news"))


@query
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return _Feed(spark, d).rows.select("impression_id", F.col("ordinal").cast("bigint").alias("ordinal"), "part")


@query
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    labels = lambda v: F.sum(F.size(F.filter("candidates", lambda c: c.clicked.eqNullSafe(F.lit(v)))))
    return _Feed(spark, d).rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        labels(1).alias("clicked"),
        labels(0).alias("not_clicked"),
        labels(None).alias("unlabeled"),
    )


@query
def split_official(spark: SparkSession, d: str) -> DataFrame:
    """The delivered split: four fifths of the train delivery in time order are train, the rest validation, dev is test."""
    rows = feed.officially_partitioned(feed.impressions(table(spark, d, "behaviors")))
    return rows.select("impression_id", F.col("ordinal").cast("bigint").alias("ordinal"), "part")


@query
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    """Counts that are reported of a valid split; an invalid one raises."""
    f = _Feed(spark, d)
    counts = feed.integrity(f.rows, table(spark, d, "behaviors"))
    return spark.createDataFrame(sorted(counts.items()), "violation string, n bigint")


@query
def integrity_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Users that several partitions share, per pair, and impressions that were delivered under several source splits."""
    rows = _Feed(spark, d).rows
    users = rows.filter("user_id <> ''").select("part", "user_id").distinct()
    pairs = users.alias("a").join(users.alias("b"), "user_id").filter("a.part < b.part").groupBy(F.col("a.part").alias("first"), F.col("b.part").alias("second"))
    delivered = table(spark, d, "behaviors").filter("impression_id IS NOT NULL").groupBy("impression_id").agg(F.count_distinct("source_split").alias("n"))
    repeated = delivered.filter("n > 1").agg(F.count(F.lit(1)).alias("shared_impressions"))
    return pairs.agg(F.count(F.lit(1)).alias("shared_users")).crossJoin(F.broadcast(repeated))  # a single row


@query
def chronology_violations(spark: SparkSession, d: str) -> DataFrame:
    """Impressions delivered out of time order within their source split."""
    return monitoring.chronology_violations(feed.impressions(table(spark, d, "behaviors")))


@query
def position_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose candidate positions are negative, repeated or unsorted, or whose labels aren't 0, 1 or NULL."""
    positions = F.transform("candidates", lambda c: c.position)
    rows = feed.impressions(table(spark, d, "behaviors")).withColumn("p", positions)
    return rows.agg(
        F.count(F.when(F.exists("p", lambda x: x < 0), 1)).alias("negative"),
        F.count(F.when(F.size(F.array_distinct("p")) < F.size("p"), 1)).alias("repeated"),
        F.count(F.when(F.array_sort("p") != F.col("p"), 1)).alias("unsorted"),
        F.count(F.when(F.exists("candidates", lambda c: ~F.coalesce(c.clicked.isin(0, 1), F.lit(True))), 1)).alias("bad_labels"),
    )


@query
def missing_references(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and history entries without an article, as counts of entries and of ids."""
    f = _Feed(spark, d)
    sides = f.candidates().select(F.lit("candidate").alias("side"), "news_id").unionByName(f.history().select(F.lit("history").alias("side"), "news_id"))
    lost = sides.join(f.articles.select("news_id"), "news_id", "left_anti")
    return lost.groupBy("side").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("news_id").alias("n_ids"))


@query
def candidates_explode(spark: SparkSession, d: str) -> DataFrame:
    f = _Feed(spark, d)
    out = f.candidates().join(f.articles, "news_id")
    return out.select(
        "part", "impression_id", "user_id", "ts_us", F.col("position").cast("bigint").alias("candidate_position"), F.col("news_id").alias("candidate_news_id"),
        F.col("label").cast("bigint").alias("click_label"), F.col("category").alias("candidate_category"), F.col("subcategory").alias("candidate_subcategory"), F.col("title").alias("candidate_title"),
    )


@query
def history_known(spark: SparkSession, d: str) -> DataFrame:
    """Known and unknown history entries per impression."""
    f = _Feed(spark, d)
    known = f.articles.select("news_id", F.lit(1).alias("k"))
    return f.history().join(known, "news_id", "left").groupBy("impression_id").agg(F.count("k").alias("n_known"), F.count(F.when(F.col("k").isNull(), 1)).alias("n_unknown"))


@query
def retrieval_queries(spark: SparkSession, d: str) -> DataFrame:
    """Clicked targets and the last ten history entries of every impression, order and duplicates kept."""
    rows = feed.impressions(table(spark, d, "behaviors"))
    targets = F.transform(F.filter("candidates", lambda c: c.clicked == 1), lambda c: c.news_id)
    recent = F.expr("slice(history, greatest(size(history) - 10, 0) + 1, 10)")
    return rows.select("impression_id", F.array_join(targets, " ").alias("targets"), F.array_join(recent, " ").alias("recent_history"), F.array_join(F.array_distinct(recent), " ").alias("distinct_history"))


# --- baselines and metrics ---


def _scored(spark: SparkSession, d: str, name: str, fit: tuple[str, ...], on: tuple[str, ...], half_life: float = 24.0) -> DataFrame:
    f = _Feed(spark, d)
    cand = f.candidates(*on)
    if name == "original_order":
        return ranking.by_original_order(cand)
    if name == "global_popularity":
        return ranking.by_popularity(cand, f.candidates(*fit))
    if name == "time_decayed":
        return ranking.by_decayed_popularity(cand, f.candidates(*fit), half_life)
    if name == "category_affinity":
        return ranking.by_category_affinity(cand, f.history(*on), f.articles)
    if name == "tfidf_similarity":
        return _tfidf_scored(f, cand, fit, on)
    raise ValueError(f"unknown baseline {name}")


def _observed(f: _Views, fit: tuple[str, ...]) -> DataFrame:
    """The distinct article ids that the fitting partitions show or read, computed once per split: ids only, read by several branches of a query."""
    kept = f.__dict__.setdefault("observed", {})
    if fit not in kept:
        kept[fit] = cut(f.candidates(*fit).select("news_id").unionByName(f.history(*fit).select("news_id")).distinct())
    return kept[fit]


def _tfidf_scored(f: _Views, cand: DataFrame, fit: tuple[str, ...], on: tuple[str, ...]) -> DataFrame:
    """Cosine of the mean history vector and the candidate; 0 for articles the fit hasn't seen."""
    observed = _observed(f, fit)
    weights = text.tfidf(f.articles, observed).join(observed, "news_id", "left_semi")
    known = f.articles.join(observed, "news_id", "left_semi")
    score = text.history_similarity(f.rows.filter(F.col("part").isin(*on)), weights, known)
    return cand.join(score, ["impression_id", "news_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


BASELINES = ("original_order", "global_popularity", "time_decayed", "category_affinity", "tfidf_similarity")


def _register_baseline(name: str) -> None:
    def rank(spark: SparkSession, d: str) -> DataFrame:
        scored = ranking.ranked(_scored(spark, d, name, ("train",), ("validation",)))
        return scored.select("impression_id", F.col("position").cast("bigint").alias("position"), "news_id", F.col("label").cast("bigint").alias("label"), F.round("score", 6).alias("score"), "rank")

    def metrics(spark: SparkSession, d: str) -> DataFrame:
        """Fitted on train and evaluated on validation; refitted on both and evaluated once on test."""
        validation = _scored(spark, d, name, ("train",), ("validation",))
        test = _scored(spark, d, name, ("train", "validation"), ("test",))
        columns = ["impression_id", "part", "position", "label", "score"]
        return ranking.macro_metrics(ranking.impression_metrics(validation.select(*columns).unionByName(test.select(*columns))))

    QUERIES[f"rank_{name}"], QUERIES[f"metrics_{name}"] = rank, metrics


for _name in BASELINES:
    _register_baseline(_name)


@query
def impression_metrics(spark: SparkSession, d: str) -> DataFrame:
    per = ranking.impression_metrics(_scored(spark, d, "category_affinity", ("train",), ("validation",)))
    return per.select("impression_id", "skipped", *[F.round(m, 6).alias(m) for m in ranking.METRICS])


#: Half-lives of the decayed popularity in hours.
HALF_LIVES = (6.0, 24.0, 72.0)


def _baseline_runs(spark: SparkSession, d: str) -> DataFrame:
    """Validation metrics of every baseline: (name, half_life, ndcg_10, mrr, auc). Of the half-lives, the chosen one stands for its baseline."""

    def run(name: str, half_life: float | None = None) -> DataFrame:
        scored = _scored(spark, d, name, ("train",), ("validation",), *([half_life] if half_life else []))
        per = ranking.macro_metrics(ranking.impression_metrics(scored))
        return per.select(F.lit(name).alias("name"), F.lit(half_life).cast("double").alias("half_life"), "ndcg_10", "mrr", "auc")

    decayed = reduce(DataFrame.unionByName, [run("time_decayed", h) for h in HALF_LIVES])
    others = [run(name) for name in BASELINES if name != "time_decayed"]
    return reduce(DataFrame.unionByName, [*others, selection.HALF_LIFE.choose(decayed)])


@query
def select_half_life(spark: SparkSession, d: str) -> DataFrame:
    """Validation metrics of three half-lives, the chosen one first: ndcg, then mrr, then the smaller half-life."""
    out = None
    for h in HALF_LIVES:
        per = ranking.macro_metrics(ranking.impression_metrics(_scored(spark, d, "time_decayed", ("train",), ("validation",), h)))
        row = per.select(F.lit(h).alias("half_life"), "ndcg_10", "mrr")
        out = row if out is None else out.unionByName(row)
    order = Window.orderBy(F.desc("ndcg_10"), F.desc("mrr"), "half_life")  # three rows
    return out.withColumn("place", F.row_number().over(order).cast("bigint"))


@query
def select_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The strongest baseline on validation (ties to the smaller name) and the reported one (ties to the larger)."""
    out = _baseline_runs(spark, d).drop("half_life")
    strongest = selection.STRONGEST_BASELINE.choose(out).withColumn("selector", F.lit("strongest"))
    return strongest.unionByName(selection.REPORTED_BASELINE.choose(out).withColumn("selector", F.lit("reported")))


@query
def target_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Per partition: impressions without a click, and clicked targets with and without an article."""
    f = _Feed(spark, d)
    targets = f.candidates().filter("label = 1").join(f.articles.select("news_id", F.lit(1).alias("k")), "news_id", "left")
    per = targets.groupBy("impression_id").agg(F.count("k").alias("known"), F.count(F.lit(1)).alias("n"))
    return f.rows.join(per, "impression_id", "left").groupBy("part").agg(
        F.count(F.when(F.col("n").isNull(), 1)).alias("n_without_click"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("n_known_targets"),
        F.coalesce(F.sum(F.col("n") - F.col("known")), F.lit(0)).alias("n_missing_targets"),
    )


@query
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories among the ten best ranked candidates of each validation impression."""
    scored = ranking.ranked(_scored(spark, d, "category_affinity", ("train",), ("validation",))).filter("rank <= 10")
    return scored.groupBy("impression_id", monitoring.shown(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query
def prediction_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Full-outer comparison of scored_candidates with the logged candidates by (impression, position)."""
    logged = feed.impressions(table(spark, d, "behaviors")).select("impression_id", F.inline("candidates").alias("position", "news_id", "label"))
    scored = table(spark, d, "scored_candidates").filter("impression_id IS NOT NULL").select("impression_id", F.col("candidate_position").alias("position"), F.col("candidate_news_id").alias("s_news"), "score").distinct()
    both = logged.join(scored, ["impression_id", "position"], "full_outer")
    kind = F.when(F.col("news_id").isNull(), "unexpected").when(F.col("s_news").isNull(), "missing").when(F.col("news_id") != F.col("s_news"), "different").otherwise("equal")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def scored_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the delivered scores, each (impression, position) once."""
    cols = [F.col("candidate_position").alias("position"), F.col("click_label").alias("label"), "score"]
    rows = table(spark, d, "scored_candidates").filter("impression_id IS NOT NULL").select("impression_id", *cols).distinct()
    return ranking.macro_metrics(ranking.impression_metrics(rows.withColumn("part", F.lit("all"))))


@query
def score_ties(spark: SparkSession, d: str) -> DataFrame:
    """Impressions with tied category-affinity scores and the mean concentration of their ten best in one category."""
    r = ranking.ranked(_scored(spark, d, "category_affinity", ("train",), ("validation",)))
    ties = r.groupBy("impression_id").agg((F.count("score") > F.count_distinct("score")).cast("double").alias("tied"))
    top = r.filter("rank <= 10").groupBy("impression_id", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("impression_id").agg((F.max("n") / F.sum("n")).alias("share"))
    return ties.join(top, "impression_id").agg(F.count(F.lit(1)).alias("n_impressions"), F.round(F.avg("tied"), 6).alias("tie_fraction"), F.round(F.avg("share"), 6).alias("top10_concentration"))


# --- text, profiles, retrieval ---


def _content(spark: SparkSession, d: str) -> tuple[_Views, DataFrame]:
    f = _Feed(spark, d)
    return f, text.tfidf(f.articles, _observed(f, ("train",)))


@query
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d)[1].select("news_id", "term", text.rounded(F.col("weight"), 6).alias("weight"))


def _recent(rows: DataFrame) -> DataFrame:
    """Impressions with their last ten history entries."""
    return rows.withColumn("history", F.expr("slice(history, greatest(size(history) - 10, 0) + 1, 10)"))


@query
def profile_mean(spark: SparkSession, d: str) -> DataFrame:
    f, weights = _content(spark, d)
    out = text.mean_profiles(feed.history(_recent(f.rows)), weights, f.articles)
    return out.select("impression_id", "term", text.rounded(F.col("weight"), 6).alias("weight"))


@query
def profile_recency(spark: SparkSession, d: str) -> DataFrame:
    f, weights = _content(spark, d)
    out = text.recency_profiles(feed.history(_recent(f.rows)), weights, f.articles, 0.8)
    return out.select("impression_id", "term", text.rounded(F.col("weight"), 6).alias("weight"))


@query
def availability_first_seen(spark: SparkSession, d: str) -> DataFrame:
    f = _Feed(spark, d)
    shown = f.candidates().groupBy("news_id").agg(F.min("ts_us").alias("first_candidate_us"))
    read = feed.history(f.rows, ("ts_us",)).groupBy("news_id").agg(F.min("ts_us").alias("first_history_us"))
    return shown.join(read, "news_id", "full_outer")


@query
def retrieve_popular(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most clicked articles: clicks, then the earlier first sight, then the id."""
    f = _Feed(spark, d)
    stats = ranking.clicks(f.candidates("train")).join(text.first_seen(f.candidates()), "news_id", "left").join(f.articles.select("news_id"), "news_id", "left_semi")
    best = stats.orderBy(F.desc("clicks"), F.asc_nulls_last("first_us"), "news_id").limit(20)
    order = Window.orderBy(F.desc("clicks"), F.asc_nulls_last("first_us"), "news_id")  # twenty rows
    return best.select("news_id", "clicks", F.row_number().over(order).cast("bigint").alias("rank"))


# --- dense vectors ---


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, d, "embeddings").select("vec_id", "embedding")
    return base.filter("vec_id % 20 = 0"), base


@query
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    out = dense.normalised(table(spark, d, "embeddings"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return out.select("vec_id", F.round(norm, 6).alias("norm"), "is_zero", F.size("embedding").cast("bigint").alias("dimensions"))


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    asked, base = _vectors(spark, d)
    return dense.top_k(asked, base, 10).select("query_id", "vec_id", F.round("score", 4).alias("score"))


def _agreements(spark: SparkSession, d: str) -> DataFrame:
    asked, base = _vectors(spark, d)
    model, assigned = dense.cells(base, 16)
    return dense.agreements(dense.top_k(asked, base, 100), dense.top_k_in_cells(asked, assigned, model, 100, 12))


@query
def ann_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the inverted file (16 cells, 12 visited) with the exact search, per query, at all cutoffs."""
    return _agreements(spark, d)


@query
def ann_agreement_mean(spark: SparkSession, d: str) -> DataFrame:
    return dense.mean_agreement(_agreements(spark, d))


# --- features and models ---


@query
def prior_clicks(spark: SparkSession, d: str) -> DataFrame:
    out = features.click_state(_Feed(spark, d).candidates(), 24.0)
    return out.select("impression_id", F.col("position").cast("bigint").alias("position"), "news_id", "prior_clicks")


@query
def prior_decayed_clicks(spark: SparkSession, d: str) -> DataFrame:
    out = features.click_state(_Feed(spark, d).candidates(), 24.0)
    return out.select("impression_id", F.col("position").cast("bigint").alias("position"), "news_id", F.round("prior_decayed", 6).alias("prior_decayed"))


def _features(spark: SparkSession, d: str, part: str | tuple[str, ...] = "train", fit: tuple[str, ...] = ("train",)) -> DataFrame:
    """Features of the rows of ``part``: of the fitting partitions in their order, of others in evaluation mode, which knows all clicks of the fit and none of its own."""
    if not set(fit) <= {"train", "validation"}:
        raise ValueError("features must not be fitted on test")
    f = _Feed(spark, d)
    parts = (part,) if isinstance(part, str) else part
    rows = f.stage().rows.filter(F.col("part").isin(*parts))
    observed = _observed(f, fit)
    vectors = StagedTable(text.vectors(f.articles, observed)[0].join(observed, "news_id", "left_semi")).read()
    release(spark)
    cand = features.with_history(rows, vectors, f.articles, observed)
    known = None if set(parts) <= set(fit) else f.candidates(*fit)
    return features.feature_table(cand, rows, f.articles, observed, fit=known)


def _staged_features(*how) -> DataFrame:
    """The features written once, for the several passes of a fit."""
    return StagedTable(_features(*how)).read()


@query
def ltr_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d)


@query
def ltr_features_validation(spark: SparkSession, d: str) -> DataFrame:
    """Features in evaluation mode: they know all clicks of train and none of validation."""
    return _features(spark, d, "validation")


#: The rankers of the grid by name: kind and parameters.
RANKERS = {
    "logistic_regression_C-0.1": ("logistic", {"c": 0.1}),
    "logistic_regression_C-1.0": ("logistic", {"c": 1.0}),
    "gradient_boosting_learning_rate-0.05_leaves-16": ("boosted", {"learning_rate": 0.05}),
    "gradient_boosting_learning_rate-0.1_leaves-16": ("boosted", {"learning_rate": 0.1}),
}


def _ranked_metrics(name: str, fit: DataFrame, on: DataFrame, part: str) -> DataFrame:
    """Metrics of a ranker of the grid, fitted on one feature table and evaluated on another."""
    kind, how = RANKERS[name]
    scored = features.predicted(features.fit_ranker(fit, kind, **how), on)
    rows = scored.select("impression_id", "position", F.when(F.col("label") >= 0, F.col("label")).alias("label"), F.round("score", 9).alias("score"), F.lit(part).alias("part"))
    return ranking.macro_metrics(ranking.impression_metrics(rows))


@query
def ltr_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the logistic ranker on validation."""
    return _ranked_metrics("logistic_regression_C-1.0", _staged_features(spark, d), _features(spark, d, "validation"), "validation")


@query
def ltr_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the boosted trees on validation."""
    return _ranked_metrics("gradient_boosting_learning_rate-0.1_leaves-16", _staged_features(spark, d), _features(spark, d, "validation"), "validation")


@query
def ltr_grid(spark: SparkSession, d: str) -> DataFrame:
    """Validation metrics of all rankers of the grid, the chosen one first."""
    fit, on = _staged_features(spark, d), _staged_features(spark, d, "validation")
    runs = [_ranked_metrics(name, fit, on, "validation").withColumn("name", F.lit(name)) for name in RANKERS]
    return selection.RANKER.placed(reduce(DataFrame.unionByName, runs).drop("part"))


@query
def ltr_selected(spark: SparkSession, d: str) -> DataFrame:
    """The ranker chosen on validation, refitted on train and validation and evaluated once on test; its lift over the strongest baseline on validation."""
    best = ltr_grid(spark, d).filter("place = 1").first()
    baseline = select_baseline(spark, d).filter("selector = 'strongest'").first()
    both = ("train", "validation")
    out = _ranked_metrics(best.name, _staged_features(spark, d, both, both), _features(spark, d, "test", both), "test")
    lift = selection.relative_lift(best.ndcg_10, baseline.ndcg_10)
    return out.withColumns({"name": F.lit(best.name), "baseline": F.lit(baseline.name), "validation_lift": F.lit(round(lift, 6))})


@query
def ltr_baselines(spark: SparkSession, d: str) -> DataFrame:
    """The five baselines recomputed from the feature columns of validation."""
    table_ = _staged_features(spark, d, "validation")
    scores = {
        "original_order": -F.col("position").cast("double"),
        "global_popularity": F.col("global_click_count"),
        "time_decayed": F.col("time_decayed_click_count"),
        "category_affinity": F.col("category_history_count") + 0.5 * F.col("subcategory_history_count"),
        "tfidf_similarity": F.col("tfidf_history_similarity"),
    }
    label = F.when(F.col("label") >= 0, F.col("label")).alias("label")
    runs = [table_.select(F.concat_ws(":", F.lit(n), "impression_id").alias("impression_id"), "position", label, c.alias("score"), F.lit(n).alias("part")) for n, c in scores.items()]
    return ranking.macro_metrics(ranking.impression_metrics(reduce(DataFrame.unionByName, runs))).withColumnRenamed("part", "name")


@query
def ltr_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Standardised coefficients of the logistic ranker, largest first."""
    model = features.fit_ranker(_staged_features(spark, d)).stages[-1]
    rows = sorted(zip(features.FEATURES, (float(c) for c in model.coefficients)), key=lambda x: (-abs(x[1]), x[0]))
    return spark.createDataFrame([(k + 1, f, round(c, 6)) for k, (f, c) in enumerate(rows)], "place bigint, feature string, coefficient double")


# --- monitoring ---


@query
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    f = _Feed(spark, d)
    scored = ranking.by_category_affinity(f.candidates("validation"), f.history("validation"), f.articles)
    per = ranking.impression_metrics(scored)
    top = ranking.ranked(scored).filter("rank = 1").select("impression_id", monitoring.shown(F.col("category")).alias("category_slice"))
    sizes = f.rows.select("impression_id", monitoring.history_bucket(F.size("history")).alias("history_slice"), monitoring.candidate_bucket(F.size("candidates")).alias("candidate_slice"))
    return monitoring.slices(per.join(top, "impression_id").join(sizes, "impression_id"), ["mrr", "ndcg_10", "auc"])


def _profile(f: _Views, part: str) -> dict[str, DataFrame]:
    rows = f.rows.filter(F.col("part") == part)
    shown = feed.candidates(rows).join(f.articles, "news_id")
    return {
        "history_length": monitoring.distribution(rows, monitoring.history_bucket(F.size("history"))),
        "candidate_count": monitoring.distribution(rows, monitoring.candidate_bucket(F.size("candidates"))),
        "category": monitoring.distribution(shown, monitoring.shown(F.col("category"))),
    }


@query
def profile_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, shares in _profile(_Feed(spark, d), "validation").items():
        rows = shares.select(F.lit(name).alias("profile"), "key", F.round("share", 9).alias("share"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def jsd_drift(spark: SparkSession, d: str) -> DataFrame:
    f = _Feed(spark, d)
    a, b = _profile(f, "train"), _profile(f, "test")
    out = None
    for name in a:
        row = monitoring.jensen_shannon(a[name], b[name]).select(F.lit(name).alias("profile"), F.round("jsd", 6).alias("jsd"))
        out = row if out is None else out.unionByName(row)
    return out


@query
def profile_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of impressions without history and of candidates without a category, per partition."""
    f = _Feed(spark, d)
    empty = f.rows.groupBy("part").agg(F.round(F.avg((F.size("history") == 0).cast("double")), 9).alias("empty_history_rate"))
    shown = f.candidates().join(f.articles, "news_id", "left").groupBy("part")
    return empty.join(shown.agg(F.round(F.avg((F.coalesce("category", F.lit("")) == "").cast("double")), 9).alias("missing_category_rate")), "part")


@query
def request_log_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and latencies by outcome; percentiles interpolated (p50, p95) and by nearest rank (n95)."""
    events = table(spark, d, "events").select(F.col("event_type").alias("outcome"), "value")
    return events.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.round(F.min("value"), 6).alias("min_ms"),
        F.round(F.avg("value"), 6).alias("mean_ms"),
        F.round(F.expr("percentile(value, 0.5)"), 6).alias("p50_ms"),
        F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95_ms"),
        F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("n95_ms"),
        F.round(F.max("value"), 6).alias("max_ms"),
    )


@query
def request_windows(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming telemetry: events per hour and type."""
    events = table(spark, d, "events").select(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("us"), "event_type", "value")
    hour = F.expr("us - pmod(us, 3600000000L)")
    return events.groupBy(hour.alias("window_start_us"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total_value"))
