"""Queries of batch serving and its log: the impressions of validation and test are taken as requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.operators import monitoring, ranking, serving
from presslake.plans.reference import _Feed, _Views
from presslake.plans.reference_sql import _CB, _HB, _SHOWN, FEED, _metrics, _scored
from presslake.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _requests(f: _Views, part: str) -> DataFrame:
    rows = f.rows.filter(F.col("part") == part)
    return rows.select(F.col("impression_id").alias("request_id"), "history", F.transform("candidates", lambda c: c.news_id).alias("candidates"))


def _log(f: _Views, part: str) -> DataFrame:
    good, _ = serving.validated(_requests(f, part))
    return cut(serving.request_log(good, f.articles, serving.ranked(good, f.articles)))


@query
def serve_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The ranked candidates of every valid request."""
    f = _Feed(spark, d)
    return serving.ranked(serving.validated(_requests(f, "test"))[0], f.articles)


@query
def serve_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Requests that are refused, with the reason."""
    return serving.validated(_requests(_Feed(spark, d), "test"))[1]


@query
def serve_log(spark: SparkSession, d: str) -> DataFrame:
    return _log(_Feed(spark, d), "test").drop("top_ranked_category_counts")


@query
def serve_log_summary(spark: SparkSession, d: str) -> DataFrame:
    return serving.log_summary(_log(_Feed(spark, d), "test"))


@query
def serve_log_categories(spark: SparkSession, d: str) -> DataFrame:
    return serving.log_categories(_log(_Feed(spark, d), "test"))


@query
def serve_log_drift(spark: SparkSession, d: str) -> DataFrame:
    """The log of test against that of validation."""
    f = _Feed(spark, d)
    return serving.log_drift(_log(f, "test"), _log(f, "validation"))


@query
def profile_drift(spark: SparkSession, d: str) -> DataFrame:
    """Input profiles of train and test compared: three divergences and two absolute differences of rates, in one row."""
    f = _Feed(spark, d)
    part = lambda p: f.rows.filter(F.col("part") == p)
    shown = lambda p: f.candidates(p).join(f.articles, "news_id")
    ways = {
        "history_length": lambda p: monitoring.distribution(part(p), monitoring.history_bucket(F.size("history"))),
        "candidate_count": lambda p: monitoring.distribution(part(p), monitoring.candidate_bucket(F.size("candidates"))),
        "category": lambda p: monitoring.distribution(shown(p), monitoring.shown(F.col("category"))),
    }
    out = None
    for name, way in ways.items():
        one = monitoring.jensen_shannon(way("train"), way("test")).select(F.round("jsd", 6).alias(f"{name}_jsd"))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # single rows
    empty = f.rows.agg(*[F.avg(F.when(F.col("part") == p, (F.size("history") == 0).cast("double"))).alias(p) for p in ("train", "test")])
    missing = f.candidates("train", "test").join(f.articles.select("news_id", F.lit(True).alias("k")), "news_id", "left")
    missing = missing.agg(*[F.avg(F.when(F.col("part") == p, F.col("k").isNull().cast("double"))).alias(p) for p in ("train", "test")])
    gap = lambda df, name: df.select(F.round(F.abs(F.col("train") - F.col("test")), 9).alias(name))
    return out.crossJoin(F.broadcast(gap(empty, "empty_history_rate_difference"))).crossJoin(F.broadcast(gap(missing, "missing_candidate_rate_difference")))


@query
def slice_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the candidates of validation with a category, a subcategory, and without an article."""
    f = _Feed(spark, d)
    own = f.candidates("validation").join(f.articles.select("news_id", "category", "subcategory", F.lit(True).alias("k")), "news_id", "left")
    named = lambda c: F.round(F.avg((F.coalesce(c, F.lit("")) != "").cast("double")), 9)
    return own.agg(
        F.count(F.lit(1)).alias("candidate_count"), named(F.col("category")).alias("known_category_fraction"), named(F.col("subcategory")).alias("known_subcategory_fraction"),
        F.round(F.avg(F.col("k").isNull().cast("double")), 9).alias("missing_candidate_fraction"),
    )


@query
def slice_empty_history(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of category affinity on validation by empty and non-empty history."""
    f = _Feed(spark, d)
    scored = ranking.by_category_affinity(f.candidates("validation"), f.history("validation"), f.articles)
    sizes = f.rows.select("impression_id", F.when(F.size("history") == 0, "empty").otherwise("non_empty").alias("slice"))
    per = ranking.impression_metrics(scored).join(sizes, "impression_id")
    return per.groupBy("slice").agg(F.count(F.lit(1)).alias("n_impressions"), F.count("mrr").alias("n_evaluated"), *[F.round(F.avg(m), 6).alias(m) for m in ("mrr", "ndcg_10", "auc")])


def _rank_sql(part: str) -> str:
    return _scored("category_affinity", "'train'", f"'{part}'", "v") + ", r AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, position) AS rank FROM s_v JOIN (SELECT news_id FROM art) USING (news_id))"


_VALID = ", rq AS (SELECT impression_id AS request_id, part, history, list_transform(impressions, lambda c: c.news_id) AS candidates FROM split WHERE len(impressions) BETWEEN 1 AND 1000 AND len(history) <= 1000)"
_LOG = (
    _VALID
    + """, mc AS (SELECT request_id, count(*) AS n FROM (SELECT request_id, unnest(candidates) AS news_id FROM rq) WHERE news_id NOT IN (SELECT news_id FROM art) GROUP BY 1),
uh AS (SELECT request_id, count(DISTINCT news_id) AS n FROM (SELECT request_id, unnest(history) AS news_id FROM rq) WHERE news_id NOT IN (SELECT news_id FROM art) GROUP BY 1),
lg AS (SELECT request_id, part, len(history) AS history_id_count, len(candidates) AS candidate_id_count, coalesce(mc.n, 0) AS missing_candidate_count, coalesce(uh.n, 0) AS unknown_history_count
  FROM rq LEFT JOIN mc USING (request_id) LEFT JOIN uh USING (request_id))"""
)
ORACLES["serve_ranked"] = FEED + _rank_sql("test") + " SELECT impression_id AS request_id, news_id, CAST(row_number() OVER (PARTITION BY impression_id ORDER BY position) - 1 AS BIGINT) AS original_position, rank, score FROM r"
ORACLES["serve_rejected"] = FEED + " SELECT impression_id AS request_id, CASE WHEN len(impressions) = 0 THEN 'no_candidates' ELSE 'too_many_ids' END AS reason FROM split WHERE part = 'test' AND (len(impressions) = 0 OR len(impressions) > 1000 OR len(history) > 1000)"
ORACLES["serve_log"] = (
    FEED
    + _LOG
    + " SELECT request_id, history_id_count, candidate_id_count, candidate_id_count - missing_candidate_count AS ranked_candidate_count, missing_candidate_count, unknown_history_count, history_id_count - unknown_history_count AS known_history_count, history_id_count = 0 AS empty_history, 'success' AS status FROM lg WHERE part = 'test'"
)
ORACLES["serve_log_summary"] = (
    FEED
    + _LOG
    + """ SELECT count(*) AS request_count, count(*) AS successful_requests, CAST(0 AS BIGINT) AS failed_requests, CAST(sum(missing_candidate_count) AS BIGINT) AS missing_candidates,
  round(sum(missing_candidate_count)::DOUBLE / sum(candidate_id_count), 9) AS missing_candidate_rate, CAST(sum(unknown_history_count) AS BIGINT) AS unknown_history,
  round(sum(unknown_history_count)::DOUBLE / sum(history_id_count), 9) AS unknown_history_rate, count(*) FILTER (WHERE history_id_count = 0) AS empty_history,
  round(avg(CASE WHEN history_id_count = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS empty_history_rate, min(candidate_id_count)::DOUBLE AS min_candidates, round(avg(candidate_id_count), 6) AS mean_candidates,
  round(quantile_cont(candidate_id_count, 0.5)::DOUBLE, 6) AS p50_candidates, round(quantile_cont(candidate_id_count, 0.95)::DOUBLE, 6) AS p95_candidates, max(candidate_id_count)::DOUBLE AS max_candidates FROM lg WHERE part = 'test'"""
)
ORACLES["serve_log_categories"] = FEED + _rank_sql("test") + f", c AS (SELECT {_SHOWN.format(c='category', m='<missing>')} AS category, count(*) AS n FROM r WHERE rank <= 10 GROUP BY 1) SELECT category, n, round(n::DOUBLE / sum(n) OVER (), 9) AS share FROM c"
_PAIR = """, {t}d AS (SELECT part, key, n::DOUBLE / sum(n) OVER (PARTITION BY part) AS share FROM ({source})),
{t} AS (SELECT round(round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 9), 6) AS jsd
  FROM (SELECT coalesce(a.share, 0) AS p, coalesce(b.share, 0) AS q FROM (SELECT * FROM {t}d WHERE part = '{a}') a FULL JOIN (SELECT * FROM {t}d WHERE part = '{b}') b USING (key)))"""
_SIZES = "SELECT part, {bucket} AS key, count(*) AS n FROM {rows} GROUP BY 1, 2"
ORACLES["serve_log_drift"] = (
    FEED
    + _LOG
    + _PAIR.format(t="h", a="validation", b="test", source=_SIZES.format(bucket=_HB, rows="rq"))
    + _PAIR.format(t="k", a="validation", b="test", source=_SIZES.format(bucket=_CB.replace("impressions", "candidates"), rows="rq"))
    + """, x AS (SELECT part, avg(CASE WHEN history_id_count = 0 THEN 1.0::DOUBLE ELSE 0 END) AS e, sum(missing_candidate_count)::DOUBLE / sum(candidate_id_count) AS m FROM lg GROUP BY 1)
SELECT h.jsd AS history_length_jsd, k.jsd AS candidate_count_jsd, round(abs(t.e - v.e), 9) AS empty_history_rate_difference, round(abs(t.m - v.m), 9) AS missing_candidate_rate_difference
  FROM h CROSS JOIN k CROSS JOIN (SELECT * FROM x WHERE part = 'test') t CROSS JOIN (SELECT * FROM x WHERE part = 'validation') v"""
)
ORACLES["profile_drift"] = (
    FEED
    + _PAIR.format(t="h", a="train", b="test", source=_SIZES.format(bucket=_HB, rows="split"))
    + _PAIR.format(t="k", a="train", b="test", source=_SIZES.format(bucket=_CB, rows="split"))
    + _PAIR.format(t="g", a="train", b="test", source=_SIZES.format(bucket=_SHOWN.format(c="category", m="<missing>"), rows="cand JOIN art USING (news_id)"))
    + """, e AS (SELECT part, avg(CASE WHEN len(history) = 0 THEN 1.0::DOUBLE ELSE 0 END) AS e FROM split GROUP BY 1),
m AS (SELECT part, avg(CASE WHEN art.news_id IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS m FROM cand LEFT JOIN art ON art.news_id = cand.news_id GROUP BY 1)
SELECT h.jsd AS history_length_jsd, k.jsd AS candidate_count_jsd, g.jsd AS category_jsd, round(abs(a.e - b.e), 9) AS empty_history_rate_difference, round(abs(c.m - d.m), 9) AS missing_candidate_rate_difference
  FROM h CROSS JOIN k CROSS JOIN g CROSS JOIN (SELECT * FROM e WHERE part = 'train') a CROSS JOIN (SELECT * FROM e WHERE part = 'test') b CROSS JOIN (SELECT * FROM m WHERE part = 'train') c CROSS JOIN (SELECT * FROM m WHERE part = 'test') d"""
)
ORACLES["slice_coverage"] = (
    FEED
    + """SELECT count(*) AS candidate_count, round(avg(CASE WHEN category <> '' THEN 1.0::DOUBLE ELSE 0 END), 9) AS known_category_fraction, round(avg(CASE WHEN subcategory <> '' THEN 1.0::DOUBLE ELSE 0 END), 9) AS known_subcategory_fraction,
  round(avg(CASE WHEN art.news_id IS NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS missing_candidate_fraction FROM cand LEFT JOIN art ON art.news_id = cand.news_id WHERE part = 'validation'"""
)
ORACLES["slice_empty_history"] = (
    FEED
    + _scored("category_affinity", "'train'", "'validation'", "v")
    + _metrics("SELECT * FROM s_v")
    + """ SELECT CASE WHEN len(history) = 0 THEN 'empty' ELSE 'non_empty' END AS slice, count(*) AS n_impressions, count(mrr) AS n_evaluated, round(avg(mrr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(auc), 6) AS auc
  FROM per JOIN split USING (impression_id) GROUP BY 1"""
)
