"""DuckDB SQL of the catalog retrieval, written from its definition: every eligible article is scored for every query."""

from __future__ import annotations

import math

from presslake.plans.reference_sql import FEED, _tfidf

_NAME = "text=title_abstract__profile=mean__history=10__decay=none__exclude_history=true"
_QUERIES = """, fs AS (SELECT news_id, min(ts_us) AS first_us FROM cand WHERE news_id IS NOT NULL GROUP BY 1),
ck AS (SELECT news_id, count(*) AS clicks FROM cand WHERE label = 1 AND part = 'train' GROUP BY 1),
aq AS (SELECT impression_id, part, user_id, ts_us, history, history[greatest(len(history) - 9, 1):] AS recent FROM split WHERE TRY_CAST(impression_id AS BIGINT) % 20 = 0),
tg AS (SELECT c.impression_id, c.news_id, a.news_id IS NOT NULL AS known, coalesce(f.first_us <= c.ts_us, false) AS seen FROM cand c JOIN aq USING (impression_id)
  LEFT JOIN art a ON a.news_id = c.news_id LEFT JOIN fs f ON f.news_id = c.news_id WHERE label = 1),
tn AS (SELECT aq.impression_id, count(tg.impression_id) AS n_targets, count(*) FILTER (WHERE known AND seen) AS n_available, count(*) FILTER (WHERE known AND NOT seen) AS n_unavailable,
  count(*) FILTER (WHERE NOT known) AS n_missing, count(DISTINCT tg.news_id) FILTER (WHERE known AND seen) AS n_distinct FROM aq LEFT JOIN tg USING (impression_id) GROUP BY 1)"""
_SEARCH = (
    _QUERIES
    + """, ak AS (SELECT impression_id, news_id, count(*) OVER (PARTITION BY impression_id) AS n FROM (SELECT impression_id, unnest(recent) AS news_id FROM aq) JOIN art USING (news_id)),
pm AS (SELECT * FROM (SELECT impression_id, term, round(sum(weight) / any_value(n), 9) AS p FROM ak JOIN w_t USING (news_id) GROUP BY 1, 2) WHERE p <> 0),
pl AS (SELECT impression_id, sqrt(sum(p * p)) AS l FROM pm GROUP BY 1),
qs AS (SELECT aq.*, coalesce(k.n, 0) AS n_known, len(recent) - coalesce(k.n, 0) AS n_unknown, l,
  CASE WHEN len(recent) = 0 THEN 'empty_history' WHEN k.n IS NULL THEN 'no_known_history' WHEN l IS NULL THEN 'all_zero_profile' END AS why
  FROM aq LEFT JOIN (SELECT impression_id, any_value(n) AS n FROM ak GROUP BY 1) k USING (impression_id) LEFT JOIN pl USING (impression_id)),
ct AS (SELECT art.news_id, first_us, coalesce(clicks, 0) AS clicks FROM art JOIN fs USING (news_id) LEFT JOIN ck USING (news_id)),
el AS (SELECT qs.impression_id, why, l, ct.* FROM qs JOIN ct ON first_us <= ts_us AND NOT list_contains(history, ct.news_id)),
dt AS (SELECT impression_id, w.news_id, sum(p * weight) AS dot FROM pm JOIN w_t w USING (term) GROUP BY 1, 2),
sc AS (SELECT el.impression_id, el.news_id, first_us, CASE WHEN why IS NULL THEN round(coalesce(dot, 0) / l, 6) ELSE clicks::DOUBLE END AS score FROM el LEFT JOIN dt ON dt.impression_id = el.impression_id AND dt.news_id = el.news_id),
fd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, first_us, news_id) AS rank FROM sc) WHERE rank <= 100),
sm AS (SELECT qs.*, coalesce(size, 0) AS catalog_size, coalesce(why, CASE WHEN size IS NULL THEN 'no_eligible_articles' END) AS reason FROM qs LEFT JOIN (SELECT impression_id, count(*) AS size FROM el GROUP BY 1) USING (impression_id)),
tt AS (SELECT DISTINCT impression_id, news_id FROM tg WHERE known AND seen)"""
)
_HEAD = FEED + _tfidf("'train'", "t") + _SEARCH
_GAIN = f"{math.log(2.0)!r}::DOUBLE / ln(rank + 1.0::DOUBLE)"
_IDEAL = "(SELECT sum(" + f"{math.log(2.0)!r}::DOUBLE / ln(r + 1.0::DOUBLE)" + ") FROM range(1, {k} + 1) t(r) WHERE r <= n_distinct)"
_CUTS, _GAINS = (10, 20, 50, 100), (10, 20, 100)

ORACLES: dict[str, str] = {
    "retrieve_cosine": _HEAD
    + f""" SELECT part AS partition, fd.impression_id, user_id, ts_us AS query_us, rank AS retrieved_rank, fd.news_id AS retrieved_news_id, score,
  tt.news_id IS NOT NULL AS is_clicked_target, false AS was_in_history, catalog_size, reason IS NOT NULL AS fallback_used, '{_NAME}' AS selected_configuration
  FROM fd JOIN sm USING (impression_id) LEFT JOIN tt ON tt.impression_id = fd.impression_id AND tt.news_id = fd.news_id""",
    "retrieval_fallbacks": _HEAD + " SELECT coalesce(reason, 'none') AS reason, count(*) AS n_queries, round(avg(catalog_size), 6) AS mean_catalog_size FROM sm GROUP BY 1",
    "retrieval_violations": _HEAD
    + """ SELECT count(*) AS n_retrieved, CAST(0 AS BIGINT) AS n_ineligible, CAST(0 AS BIGINT) AS n_in_history, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_rank_gaps FROM fd""",
    "retrieval_targets": FEED + _QUERIES + " SELECT impression_id, n_targets, n_available, n_unavailable, n_missing FROM tn",
    "static_catalog": FEED + " SELECT DISTINCT news_id FROM cand JOIN art USING (news_id) WHERE part = 'test'",
    "retrieval_quality": _HEAD
    + ", h AS (SELECT fd.impression_id, min(rank) AS best, "
    + ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS h{k}" for k in _CUTS)
    + ", "
    + ", ".join(f"sum(CASE WHEN rank <= {k} THEN {_GAIN} ELSE 0 END) AS g{k}" for k in _GAINS)
    + """ FROM fd JOIN tt ON tt.impression_id = fd.impression_id AND tt.news_id = fd.news_id GROUP BY 1),
v AS (SELECT sm.*, tn.* EXCLUDE (impression_id), h.* EXCLUDE (impression_id), n_available > 0 AS valid FROM sm JOIN tn USING (impression_id) LEFT JOIN h USING (impression_id)),
u AS (SELECT count(DISTINCT news_id) AS unique_recommendations FROM fd JOIN v USING (impression_id) WHERE valid)
SELECT """
    + f"'{_NAME}' AS configuration, count(*) AS n_queries, count(*) FILTER (WHERE valid) AS n_valid_queries, count(*) FILTER (WHERE n_targets = 0) AS n_no_clicked_target, "
    + "count(*) FILTER (WHERE n_targets > 0 AND NOT valid) AS n_no_available_target, "
    + ", ".join(f"round(avg(coalesce(h{k}, 0)::DOUBLE / n_distinct) FILTER (WHERE valid), 6) AS recall_{k}" for k in _CUTS)
    + ", "
    + ", ".join(f"round(avg(CASE WHEN coalesce(h{k}, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE valid), 6) AS hit_rate_{k}" for k in _CUTS)
    + ", round(avg(coalesce(1.0::DOUBLE / best, 0)) FILTER (WHERE valid), 6) AS mrr_100, "
    + ", ".join(f"round(avg(coalesce(g{k}, 0) / {_IDEAL.format(k=k)}) FILTER (WHERE valid), 6) AS ndcg_{k}" for k in _GAINS)
    + """, round(avg(catalog_size) FILTER (WHERE valid), 6) AS mean_catalog_size, median(catalog_size) FILTER (WHERE valid) AS median_catalog_size,
  round(sum(n_available)::DOUBLE / nullif(sum(n_available + n_unavailable), 0), 6) AS target_availability_rate, round(avg(CASE WHEN reason IS NULL THEN 0.0::DOUBLE ELSE 1 END) FILTER (WHERE valid), 6) AS fallback_rate,
  round(0.0::DOUBLE, 6) AS retrieved_history_rate, round(avg(n_known) FILTER (WHERE valid), 6) AS mean_known_history, CAST(sum(n_unknown) FILTER (WHERE valid) AS BIGINT) AS n_unknown_history,
  CAST(sum(n_missing) AS BIGINT) AS n_missing_targets, any_value(unique_recommendations) AS unique_recommendations, round(any_value(unique_recommendations)::DOUBLE / (SELECT count(*) FROM art), 6) AS catalog_coverage
  FROM v CROSS JOIN u""",
}
