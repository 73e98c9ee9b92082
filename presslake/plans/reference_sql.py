"""DuckDB SQL of the feed-evaluation queries."""

from __future__ import annotations

import math

_DISCOUNT = "CASE rank " + " ".join(f"WHEN {r} THEN {1.0 / math.log2(r + 1)!r}::DOUBLE" for r in range(1, 11)) + " ELSE 0::DOUBLE END"
_IDEAL = [sum(1.0 / math.log2(r + 1) for r in range(1, k + 1)) for k in range(11)]


def _ideal(k: int) -> str:
    return f"CASE least(p, {k}) " + " ".join(f"WHEN {i} THEN {_IDEAL[i]!r}::DOUBLE" for i in range(1, k + 1)) + " END"


def feed(train: str = "0.7", validation: str = "0.15") -> str:
    return f"""
WITH art AS (SELECT news_id, coalesce(category, '') AS category, coalesce(subcategory, '') AS subcategory, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract
  FROM (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY CASE source_split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END, source_row_number) AS rn FROM news WHERE news_id <> '') WHERE rn = 1),
imp AS (SELECT impression_id, coalesce(user_id, '') AS user_id, epoch_us(timestamp) AS ts_us, source_split, source_row_number, coalesce(history, []) AS history, coalesce(impressions, []) AS impressions
  FROM (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY ingested_at, source_split, source_row_number) AS rn FROM behaviors WHERE impression_id IS NOT NULL AND timestamp IS NOT NULL) WHERE rn = 1),
bounds AS (SELECT CAST(floor(count(*) * {train}::DOUBLE) AS BIGINT) AS a, CAST(floor(count(*) * ({train}::DOUBLE + {validation}::DOUBLE)) AS BIGINT) AS b FROM imp),
o AS (SELECT *, row_number() OVER (ORDER BY ts_us, source_row_number, impression_id) AS ordinal FROM imp),
split AS (SELECT o.*, CASE WHEN ordinal <= a THEN 'train' WHEN ordinal <= b THEN 'validation' ELSE 'test' END AS part FROM o CROSS JOIN bounds),
cand AS (SELECT impression_id, part, user_id, ts_us, ordinal, c.position AS position, c.news_id AS news_id, c.clicked AS label FROM (SELECT *, unnest(impressions) AS c FROM split)),
hist AS (SELECT impression_id, part, ts_us, unnest(history) AS news_id, generate_subscripts(history, 1) - 1 AS place FROM split)
"""


FEED = feed()


def _scored(name: str, fit: str, on: str, tag: str, half_life: float = 24.0) -> str:
    """CTE ``s_tag``: impression_id, part, position, news_id, label, score of a baseline."""
    fitted, own = f"(SELECT * FROM cand WHERE part IN ({fit}))", f"(SELECT * FROM cand WHERE part IN ({on}))"
    columns = "c.impression_id, c.part, c.position, c.news_id, c.label"
    if name == "original_order":
        return f", s_{tag} AS (SELECT {columns}, CAST(-c.position AS DOUBLE) AS score FROM {own} c)"
    if name == "global_popularity":
        return f", s_{tag} AS (SELECT {columns}, CAST(coalesce(k.n, 0) AS DOUBLE) AS score FROM {own} c LEFT JOIN (SELECT news_id, count(*) AS n FROM {fitted} WHERE label = 1 GROUP BY 1) k USING (news_id))"
    if name == "time_decayed":
        return f""", k_{tag} AS (SELECT news_id, round(sum(pow(0.5::DOUBLE, greatest((m.t - ts_us) / 3.6e9, 0) / {half_life}::DOUBLE)), 9) AS w FROM {fitted} CROSS JOIN (SELECT max(ts_us) AS t FROM {fitted}) m WHERE label = 1 GROUP BY 1),
s_{tag} AS (SELECT {columns}, coalesce(k.w, 0.0::DOUBLE) AS score FROM {own} c LEFT JOIN k_{tag} k USING (news_id))"""
    if name == "category_affinity":
        h = f"(SELECT h.impression_id, a.category, a.subcategory FROM hist h JOIN art a USING (news_id) WHERE h.part IN ({on}))"
        return f""", hc_{tag} AS (SELECT impression_id, category, count(*) AS n FROM {h} GROUP BY 1, 2), hs_{tag} AS (SELECT impression_id, subcategory, count(*) AS n FROM {h} GROUP BY 1, 2),
s_{tag} AS (SELECT {columns}, a.category, CAST(coalesce(hc.n, 0) + 0.5 * coalesce(hs.n, 0) AS DOUBLE) AS score FROM {own} c LEFT JOIN art a USING (news_id)
  LEFT JOIN hc_{tag} hc ON hc.impression_id = c.impression_id AND hc.category = a.category LEFT JOIN hs_{tag} hs ON hs.impression_id = c.impression_id AND hs.subcategory = a.subcategory)"""
    return (
        _tfidf(fit, tag)
        + f""", k_{tag} AS (SELECT h.impression_id, h.news_id FROM hist h JOIN ob_{tag} USING (news_id) JOIN art USING (news_id) WHERE h.part IN ({on})),
kn_{tag} AS (SELECT impression_id, count(*) AS n FROM k_{tag} GROUP BY 1),
pr_{tag} AS (SELECT k.impression_id, w.term, round(sum(w.weight) / any_value(kn.n), 9) AS p FROM k_{tag} k JOIN kn_{tag} kn USING (impression_id) JOIN w_{tag} w USING (news_id) GROUP BY 1, 2),
l_{tag} AS (SELECT impression_id, sqrt(sum(p * p)) AS l FROM pr_{tag} GROUP BY 1),
d_{tag} AS (SELECT c.impression_id, c.news_id, round(sum(pr.p * w.weight) / any_value(l.l), 6) AS score FROM (SELECT DISTINCT impression_id, news_id FROM {own}) c JOIN ob_{tag} USING (news_id)
  JOIN w_{tag} w USING (news_id) JOIN pr_{tag} pr ON pr.impression_id = c.impression_id AND pr.term = w.term JOIN l_{tag} l ON l.impression_id = c.impression_id GROUP BY 1, 2),
s_{tag} AS (SELECT {columns}, coalesce(d.score, 0.0::DOUBLE) AS score FROM {own} c LEFT JOIN d_{tag} d ON d.impression_id = c.impression_id AND d.news_id = c.news_id)"""
    )


def _tfidf(fit: str, tag: str) -> str:
    text = "concat_ws(' ', nullif(trim(title), ''), nullif(trim(abstract), ''))"
    return f""", ob_{tag} AS (SELECT DISTINCT news_id FROM (SELECT news_id FROM cand WHERE part IN ({fit}) UNION ALL SELECT news_id FROM hist WHERE part IN ({fit}))),
tf_{tag} AS (SELECT news_id, term, count(*) AS tf FROM (SELECT news_id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM art) GROUP BY 1, 2),
n_{tag} AS (SELECT count(*) AS n FROM art JOIN ob_{tag} USING (news_id) WHERE {text} <> ''),
df_{tag} AS (SELECT term, count(*) AS df FROM tf_{tag} JOIN ob_{tag} USING (news_id) GROUP BY 1),
raw_{tag} AS (SELECT news_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf_{tag} JOIN df_{tag} USING (term) CROSS JOIN n_{tag}),
w_{tag} AS (SELECT news_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY news_id)), 9) AS weight FROM raw_{tag})"""


def _metrics(source: str, part: str = "part") -> str:
    """CTEs ``per`` (one row per impression) and ``macro``."""
    return f""", rk AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, position) AS rank FROM ({source})),
rk2 AS (SELECT *, count(*) OVER (PARTITION BY impression_id) AS cnt, count(*) OVER (PARTITION BY impression_id, score) AS ties, min(rank) OVER (PARTITION BY impression_id, score) AS fst FROM rk),
g AS (SELECT impression_id, {part} AS part, bool_or(label IS NULL) AS unlabeled, bool_or(score IS NULL) AS missing, bool_or(NOT isfinite(score)) AS infinite, count(*) AS n,
  count(*) FILTER (WHERE label = 1) AS p, min(rank) FILTER (WHERE label = 1) AS best, sum(cnt - fst - (ties - 1) / 2.0::DOUBLE + 1.0::DOUBLE) FILTER (WHERE label = 1) AS ranks,
  count(*) FILTER (WHERE label = 1 AND rank <= 5) AS t5, count(*) FILTER (WHERE label = 1 AND rank <= 10) AS t10,
  sum(CASE WHEN label = 1 AND rank <= 5 THEN {_DISCOUNT} ELSE 0 END) AS g5, sum(CASE WHEN label = 1 AND rank <= 10 THEN {_DISCOUNT} ELSE 0 END) AS g10 FROM rk2 GROUP BY 1, 2),
per0 AS (SELECT *, CASE WHEN unlabeled THEN 'unlabeled_impression' WHEN missing THEN 'missing_score' WHEN infinite THEN 'non_finite_score' END AS skipped FROM g),
per AS (SELECT impression_id, part, skipped,
  CASE WHEN skipped IS NULL THEN coalesce(1.0::DOUBLE / best, 0::DOUBLE) END AS mrr,
  CASE WHEN skipped IS NULL THEN CASE WHEN p > 0 THEN g5 / ({_ideal(5)}) ELSE 0::DOUBLE END END AS ndcg_5,
  CASE WHEN skipped IS NULL THEN CASE WHEN p > 0 THEN g10 / ({_ideal(10)}) ELSE 0::DOUBLE END END AS ndcg_10,
  CASE WHEN skipped IS NULL THEN CASE WHEN p > 0 THEN t5::DOUBLE / p ELSE 0::DOUBLE END END AS recall_5,
  CASE WHEN skipped IS NULL THEN CASE WHEN p > 0 THEN t10::DOUBLE / p ELSE 0::DOUBLE END END AS recall_10,
  CASE WHEN skipped IS NULL THEN CAST(t5 > 0 AS DOUBLE) END AS hit_rate_5, CASE WHEN skipped IS NULL THEN CAST(t10 > 0 AS DOUBLE) END AS hit_rate_10,
  CASE WHEN skipped IS NULL AND p > 0 AND p < n THEN (ranks - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)) END AS auc FROM per0)"""


_NAMES = ["mrr", "ndcg_5", "ndcg_10", "recall_5", "recall_10", "hit_rate_5", "hit_rate_10", "auc"]
_MACRO = (
    " SELECT part, count(*) AS n_impressions, count(*) FILTER (WHERE skipped IS NULL) AS n_evaluated, count(*) FILTER (WHERE skipped = 'unlabeled_impression') AS n_unlabeled, count(auc) AS n_auc, "
    + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _NAMES)
    + " FROM per GROUP BY 1"
)
_TRAIN, _BOTH, _VAL, _TEST = "'train'", "'train', 'validation'", "'validation'", "'test'"
_SHOWN = "CASE WHEN coalesce({c}, '') = '' THEN '{m}' ELSE {c} END"
_HB = "CASE WHEN len(history) = 0 THEN '0' WHEN len(history) <= 5 THEN '1-5' WHEN len(history) <= 20 THEN '6-20' ELSE '21+' END"
_CB = "CASE WHEN len(impressions) <= 10 THEN '1-10' WHEN len(impressions) <= 50 THEN '11-50' ELSE '51+' END"

ORACLES: dict[str, str] = {
    "audit_news": """SELECT CAST(count(*) AS BIGINT) AS total_rows, count(DISTINCT news_id) AS unique_news, count(*) - count(DISTINCT news_id) AS duplicate_news,
  count(*) FILTER (WHERE coalesce(title, '') = '') AS missing_titles, count(*) FILTER (WHERE coalesce(abstract, '') = '') AS missing_abstracts FROM news WHERE news_id IS NOT NULL""",
    "audit_categories": f"SELECT {_SHOWN.format(c='category', m='(missing)')} AS category, count(*) AS n_rows FROM news GROUP BY 1",
    "audit_subcategories": f"SELECT {_SHOWN.format(c='subcategory', m='(missing)')} AS subcategory, count(*) AS n_rows FROM news GROUP BY 1",
    "audit_splits": """SELECT source_split, 'news' AS delivery, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_invalid_timestamps FROM news GROUP BY 1
  UNION ALL SELECT source_split, 'behaviors', count(*), count(*) FILTER (WHERE timestamp IS NULL) FROM behaviors GROUP BY 1""",
    "audit_missing_candidates": FEED
    + """, l AS (SELECT news_id FROM cand WHERE news_id NOT IN (SELECT news_id FROM art)), u AS (SELECT DISTINCT news_id FROM l ORDER BY 1 LIMIT 20)
SELECT (SELECT count(*) FROM l) AS n_entries, (SELECT count(DISTINCT news_id) FROM l) AS n_ids, coalesce((SELECT string_agg(news_id, ' ' ORDER BY news_id) FROM u), '') AS samples""",
    "audit_behaviors": FEED
    + """SELECT source_split, count(*) AS n_impressions, count(DISTINCT nullif(user_id, '')) AS n_users, count(*) FILTER (WHERE len(history) = 0) AS empty_histories,
  round(avg(len(history)), 4) AS mean_history, median(len(history)) AS median_history, round(avg(len(impressions)), 4) AS mean_candidates, median(len(impressions)) AS median_candidates,
  CAST(sum(len(list_filter(impressions, lambda c: c.clicked = 1))) AS BIGINT) AS clicked, CAST(sum(len(list_filter(impressions, lambda c: c.clicked = 0))) AS BIGINT) AS not_clicked,
  CAST(sum(len(list_filter(impressions, lambda c: c.clicked IS NULL))) AS BIGINT) AS unlabeled,
  round(sum(len(list_filter(impressions, lambda c: c.clicked = 1)))::DOUBLE / sum(len(list_filter(impressions, lambda c: c.clicked IS NOT NULL))), 6) AS click_through_rate FROM imp GROUP BY 1""",
    "dedupe_news": FEED + "SELECT * FROM art",
    "split_assign": FEED + "SELECT impression_id, ordinal, part FROM split",
    "split_summary": FEED
    + """SELECT part, count(*) AS n_rows, min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(sum(len(list_filter(impressions, lambda c: c.clicked = 1))) AS BIGINT) AS clicked,
  CAST(sum(len(list_filter(impressions, lambda c: c.clicked = 0))) AS BIGINT) AS not_clicked, CAST(sum(len(list_filter(impressions, lambda c: c.clicked IS NULL))) AS BIGINT) AS unlabeled FROM split GROUP BY 1""",
    "split_official": FEED
    + """, n AS (SELECT greatest(least(CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT), count(*) - 1), 1) AS b FROM imp WHERE source_split = 'train'),
r AS (SELECT impression_id, source_split, row_number() OVER (PARTITION BY source_split ORDER BY ts_us, source_row_number, impression_id) AS ordinal FROM imp WHERE source_split IN ('train', 'dev'))
SELECT impression_id, ordinal, CASE WHEN source_split = 'dev' THEN 'test' WHEN ordinal <= b THEN 'train' ELSE 'validation' END AS part FROM r CROSS JOIN n""",
    "integrity_checks": FEED
    + """SELECT 'repeated_impressions' AS violation, (SELECT count(*) FROM (SELECT impression_id FROM behaviors WHERE impression_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS n
  UNION ALL SELECT 'shared_users', (SELECT count(*) FROM (SELECT user_id FROM split WHERE user_id <> '' GROUP BY 1 HAVING count(DISTINCT part) > 1))""",
    "integrity_overlaps": FEED
    + """, u AS (SELECT DISTINCT part, user_id FROM split WHERE user_id <> '') SELECT a.part AS first, b.part AS second, count(*) AS shared_users,
  (SELECT count(*) FROM (SELECT impression_id FROM behaviors WHERE impression_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_split) > 1)) AS shared_impressions FROM u a JOIN u b ON a.user_id = b.user_id AND a.part < b.part GROUP BY 1, 2""",
    "chronology_violations": FEED
    + "SELECT source_split, count(*) AS n_violations FROM (SELECT source_split, ts_us, lag(ts_us) OVER (PARTITION BY source_split ORDER BY source_row_number, ts_us) AS p FROM imp) WHERE p > ts_us GROUP BY 1",
    "position_violations": FEED
    + """, x AS (SELECT list_transform(impressions, lambda c: c.position) AS p, impressions FROM imp) SELECT count(*) FILTER (WHERE len(list_filter(p, lambda v: v < 0)) > 0) AS negative,
  count(*) FILTER (WHERE len(list_distinct(p)) < len(p)) AS repeated, count(*) FILTER (WHERE list_sort(p) <> p) AS unsorted,
  count(*) FILTER (WHERE len(list_filter(impressions, lambda c: c.clicked NOT IN (0, 1))) > 0) AS bad_labels FROM x""",
    "missing_references": FEED
    + """SELECT side, count(*) AS n_entries, count(DISTINCT news_id) AS n_ids FROM (SELECT 'candidate' AS side, news_id FROM cand UNION ALL SELECT 'history', news_id FROM hist)
  WHERE news_id NOT IN (SELECT news_id FROM art) GROUP BY 1""",
    "candidates_explode": FEED
    + """SELECT part, impression_id, user_id, ts_us, CAST(position AS BIGINT) AS candidate_position, news_id AS candidate_news_id, CAST(label AS BIGINT) AS click_label,
  category AS candidate_category, subcategory AS candidate_subcategory, title AS candidate_title FROM cand JOIN art USING (news_id)""",
    "history_known": FEED
    + "SELECT impression_id, count(a.news_id) AS n_known, count(*) - count(a.news_id) AS n_unknown FROM hist h LEFT JOIN art a USING (news_id) GROUP BY 1",
    "retrieval_queries": FEED
    + """, q AS (SELECT impression_id, list_transform(list_filter(impressions, lambda c: c.clicked = 1), lambda c: c.news_id) AS t, history[greatest(len(history) - 9, 1):] AS r FROM imp)
SELECT impression_id, coalesce(array_to_string(t, ' '), '') AS targets, coalesce(array_to_string(r, ' '), '') AS recent_history,
  coalesce(array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ' '), '') AS distinct_history FROM q""",
    "impression_metrics": FEED
    + _scored("category_affinity", _TRAIN, _VAL, "v")
    + _metrics("SELECT * FROM s_v")
    + " SELECT impression_id, skipped, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in _NAMES)
    + " FROM per",
    "prediction_integrity": FEED
    + """, l AS (SELECT impression_id, position, news_id FROM cand), s AS (SELECT DISTINCT impression_id, candidate_position AS position, candidate_news_id AS s_news, score FROM scored_candidates WHERE impression_id IS NOT NULL)
SELECT CASE WHEN news_id IS NULL THEN 'unexpected' WHEN s_news IS NULL THEN 'missing' WHEN news_id <> s_news THEN 'different' ELSE 'equal' END AS kind, count(*) AS n_rows
  FROM l FULL JOIN s ON l.impression_id = s.impression_id AND l.position = s.position GROUP BY 1""",
    "scored_metrics": "WITH z AS (SELECT DISTINCT impression_id, candidate_position AS position, click_label AS label, score FROM scored_candidates WHERE impression_id IS NOT NULL)"
    + _metrics("SELECT *, 'all' AS part FROM z")
    + _MACRO,
    "score_ties": FEED
    + _scored("category_affinity", _TRAIN, _VAL, "v")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, position) AS rank FROM s_v),
t AS (SELECT impression_id, CAST(count(score) > count(DISTINCT score) AS DOUBLE) AS tied FROM r GROUP BY 1),
c AS (SELECT impression_id, max(n)::DOUBLE / sum(n) AS share FROM (SELECT impression_id, category, count(*) AS n FROM r WHERE rank <= 10 GROUP BY 1, 2) GROUP BY 1)
SELECT count(*) AS n_impressions, round(avg(tied), 6) AS tie_fraction, round(avg(share), 6) AS top10_concentration FROM t JOIN c USING (impression_id)""",
    "availability_first_seen": FEED
    + """SELECT coalesce(a.news_id, b.news_id) AS news_id, first_candidate_us, first_history_us FROM (SELECT news_id, min(ts_us) AS first_candidate_us FROM cand GROUP BY 1) a
  FULL JOIN (SELECT news_id, min(ts_us) AS first_history_us FROM hist GROUP BY 1) b ON a.news_id = b.news_id""",
    "tfidf_weights": FEED + _tfidf(_TRAIN, "t") + " SELECT news_id, term, round(weight, 6) AS weight FROM w_t",
    "retrieve_popular": FEED
    + """, k AS (SELECT news_id, count(*) AS clicks FROM cand WHERE part = 'train' AND label = 1 GROUP BY 1), f AS (SELECT news_id, min(ts_us) AS first_us FROM cand GROUP BY 1)
SELECT news_id, clicks, rank FROM (SELECT news_id, clicks, row_number() OVER (ORDER BY clicks DESC, first_us NULLS LAST, news_id) AS rank FROM k LEFT JOIN f USING (news_id) JOIN art USING (news_id)) WHERE rank <= 20""",
    "vector_norms": "SELECT vec_id, round(CASE WHEN n <= 1e-12 THEN 0 ELSE 1 END::DOUBLE, 6) AS norm, n <= 1e-12 AS is_zero, len(embedding) AS dimensions FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)",
    "dense_topk": """SELECT query_id, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (
  SELECT q.vec_id AS query_id, b.vec_id AS vec_id, round(list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0)) WHERE r <= 10""",
    "prior_clicks": FEED
    + """SELECT impression_id, CAST(position AS BIGINT) AS position, news_id, CAST(coalesce(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY news_id ORDER BY ordinal RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_clicks FROM cand""",
    "prior_decayed_clicks": FEED
    + """, k AS (SELECT news_id, ordinal, ts_us FROM cand WHERE label = 1)
SELECT c.impression_id, CAST(c.position AS BIGINT) AS position, c.news_id, round(round(coalesce((SELECT sum(pow(0.5::DOUBLE, (c.ts_us - k.ts_us) / 3.6e9 / 24.0::DOUBLE)) FROM k WHERE k.news_id = c.news_id AND k.ordinal < c.ordinal), 0::DOUBLE), 9), 6) AS prior_decayed FROM cand c""",
    "slice_metrics": FEED
    + _scored("category_affinity", _TRAIN, _VAL, "v")
    + _metrics("SELECT * FROM s_v")
    + f""", top AS (SELECT impression_id, {_SHOWN.format(c="category", m="<missing>")} AS cs FROM rk WHERE rank = 1),
j AS (SELECT per.*, cs, {_HB} AS hs, {_CB} AS ks FROM per JOIN top USING (impression_id) JOIN split s USING (impression_id)),
u AS (SELECT 'overall' AS family, 'all' AS slice, * FROM j UNION ALL SELECT 'history', hs, * FROM j UNION ALL SELECT 'candidates', ks, * FROM j UNION ALL SELECT 'category', cs, * FROM j)
SELECT family, slice, count(*) AS n_impressions, count(mrr) AS n_evaluated, round(avg(mrr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(auc), 6) AS auc FROM u GROUP BY 1, 2""",
    "request_log_summary": """SELECT event_type AS outcome, count(*) AS n_requests, round(min(value), 6) AS min_ms, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
  round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_disc(value, 0.95), 6) AS n95_ms, round(max(value), 6) AS max_ms FROM events GROUP BY 1""",
    "request_windows": "SELECT us - us % 3600000000 AS window_start_us, event_type, count(*) AS n_events, round(sum(value), 4) AS total_value FROM (SELECT epoch_us(ts) AS us, event_type, value FROM events) GROUP BY 1, 2",
}

for _name in ("original_order", "global_popularity", "time_decayed", "category_affinity", "tfidf_similarity"):
    ORACLES[f"rank_{_name}"] = (
        FEED
        + _scored(_name, _TRAIN, _VAL, "v")
        + " SELECT impression_id, CAST(position AS BIGINT) AS position, news_id, CAST(label AS BIGINT) AS label, round(score, 6) AS score, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, position) AS rank FROM s_v"
    )
    ORACLES[f"metrics_{_name}"] = (
        FEED
        + _scored(_name, _TRAIN, _VAL, "v")
        + _scored(_name, _BOTH, _TEST, "t")
        + _metrics("SELECT impression_id, part, position, label, score FROM s_v UNION ALL SELECT impression_id, part, position, label, score FROM s_t")
        + _MACRO
    )

_HALF = FEED
_halves = []
for _k, _h in enumerate((6.0, 24.0, 72.0)):
    _HALF += _scored("time_decayed", _TRAIN, _VAL, f"h{_k}", _h)
    _halves.append(f"SELECT '{_h}:' || impression_id AS impression_id, '{_h}' AS part, position, label, score FROM s_h{_k}")
ORACLES["select_half_life"] = (
    _HALF
    + _metrics(" UNION ALL ".join(_halves))
    + ", m AS (SELECT part::DOUBLE AS half_life, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(mrr), 6) AS mrr FROM per GROUP BY 1) SELECT *, row_number() OVER (ORDER BY ndcg_10 DESC, mrr DESC, half_life) AS place FROM m"
)

_RECENT = """, aq AS (SELECT impression_id, history[greatest(len(history) - 9, 1):] AS h FROM split),
ah AS (SELECT impression_id, unnest(h) AS news_id, generate_subscripts(h, 1) AS place FROM aq),
ak AS (SELECT impression_id, news_id, place, count(*) OVER (PARTITION BY impression_id) AS n, row_number() OVER (PARTITION BY impression_id ORDER BY place DESC) - 1 AS after FROM ah JOIN art USING (news_id))"""
_MEAN = ", pm AS (SELECT impression_id, term, round(sum(weight) / any_value(n), 9) AS weight FROM ak JOIN w_t USING (news_id) GROUP BY 1, 2)"
ORACLES["profile_mean"] = FEED + _tfidf(_TRAIN, "t") + _RECENT + _MEAN + " SELECT impression_id, term, round(weight, 6) AS weight FROM pm"
ORACLES["profile_recency"] = (
    FEED
    + _tfidf(_TRAIN, "t")
    + _RECENT
    + """, tt AS (SELECT impression_id, sum(pow(0.8::DOUBLE, after)) AS t FROM ak GROUP BY 1)
SELECT impression_id, term, round(round(sum(pow(0.8::DOUBLE, after) * weight) / any_value(t), 9), 6) AS weight FROM ak JOIN tt USING (impression_id) JOIN w_t USING (news_id) GROUP BY 1, 2"""
)
_DIST = f""", dp AS (SELECT part, 'history_length' AS profile, {_HB} AS key, count(*) AS n FROM split GROUP BY 1, 2, 3 UNION ALL SELECT part, 'candidate_count', {_CB}, count(*) FROM split GROUP BY 1, 2, 3
  UNION ALL SELECT part, 'category', {_SHOWN.format(c="category", m="<missing>")}, count(*) FROM cand JOIN art USING (news_id) GROUP BY 1, 2, 3),
ds AS (SELECT part, profile, key, n::DOUBLE / sum(n) OVER (PARTITION BY part, profile) AS share FROM dp)"""
ORACLES["profile_distribution"] = FEED + _DIST + " SELECT profile, key, round(share, 9) AS share FROM ds WHERE part = 'validation'"
ORACLES["jsd_drift"] = (
    FEED
    + _DIST
    + """, pq AS (SELECT coalesce(a.profile, b.profile) AS profile, coalesce(a.share, 0) AS p, coalesce(b.share, 0) AS q FROM (SELECT * FROM ds WHERE part = 'train') a
  FULL JOIN (SELECT * FROM ds WHERE part = 'test') b ON a.profile = b.profile AND a.key = b.key)
SELECT profile, round(round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 9), 6) AS jsd FROM pq GROUP BY 1"""
)



def _feature_sql(part: str) -> str:
    """All features; of train as before each impression, else with the clicks of all of train."""
    before = part == "train"
    clicks = (
        """pc AS (SELECT impression_id, position, coalesce(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY news_id ORDER BY ordinal RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM tr),
pd AS (SELECT c.impression_id, c.position, coalesce((SELECT sum(pow(0.5::DOUBLE, (c.ts_us - ck.ts_us) / 3.6e9 / 24.0::DOUBLE)) FROM ck WHERE ck.news_id = c.news_id AND ck.ordinal < c.ordinal), 0::DOUBLE) AS d FROM tr c)"""
        if before
        else """tot AS (SELECT news_id, count(*) AS g, sum(pow(0.5::DOUBLE, greatest((m.t - ts_us) / 3.6e9, 0) / 24.0::DOUBLE)) AS d FROM ck CROSS JOIN (SELECT max(ts_us) AS t FROM cand WHERE part = 'train') m GROUP BY 1),
pc AS (SELECT impression_id, position, coalesce(g, 0) AS g FROM tr LEFT JOIN tot USING (news_id)), pd AS (SELECT impression_id, position, coalesce(d, 0::DOUBLE) AS d FROM tr LEFT JOIN tot USING (news_id))"""
    )
    return (
        FEED
        + _scored("tfidf_similarity", _TRAIN, f"'{part}'", "f")
        + f""", tr AS (SELECT * FROM cand WHERE part = '{part}'), ht AS (SELECT * FROM hist WHERE part = '{part}'),
ob AS (SELECT DISTINCT news_id FROM (SELECT news_id FROM cand WHERE part = 'train' UNION ALL SELECT news_id FROM hist WHERE part = 'train')), fa AS (SELECT art.* FROM art JOIN ob USING (news_id)),
ck AS (SELECT news_id, ordinal, ts_us FROM cand WHERE part = 'train' AND label = 1),
{clicks},
hk AS (SELECT ht.impression_id, a.category, a.subcategory FROM ht JOIN art a USING (news_id)),
h1 AS (SELECT impression_id, category, count(*) AS n FROM hk GROUP BY 1, 2), h2 AS (SELECT impression_id, subcategory, count(*) AS n FROM hk GROUP BY 1, 2), h3 AS (SELECT impression_id, count(*) AS n FROM hk GROUP BY 1),
f1 AS (SELECT category, count(*) AS n FROM fa GROUP BY 1), f2 AS (SELECT subcategory, count(*) AS n FROM fa GROUP BY 1), sn AS (SELECT DISTINCT impression_id, news_id FROM ht)
SELECT c.impression_id, CAST(c.position AS BIGINT) AS position, c.news_id, CAST(coalesce(c.label, -1) AS BIGINT) AS label, 1.0::DOUBLE / (c.position + 1.0::DOUBLE) AS reciprocal_position, pc.g::DOUBLE AS global_click_count,
  round(round(pd.d, 9), 6) AS time_decayed_click_count, coalesce(h1.n, 0)::DOUBLE AS category_history_count, coalesce(h2.n, 0)::DOUBLE AS subcategory_history_count, s_f.score AS tfidf_history_similarity,
  coalesce(f1.n, 0)::DOUBLE AS category_article_frequency, coalesce(f2.n, 0)::DOUBLE AS subcategory_article_frequency, len(s.history)::DOUBLE AS history_length, coalesce(h3.n, 0)::DOUBLE AS known_history_count,
  CAST(len(s.history) = 0 AS DOUBLE) AS empty_history, CAST(sn.news_id IS NOT NULL AS DOUBLE) AS candidate_seen_in_history, CAST(trim(a.abstract) <> '' AS DOUBLE) AS has_abstract,
  length(a.title)::DOUBLE AS title_length, length(a.abstract)::DOUBLE AS abstract_length
FROM tr c JOIN art a ON a.news_id = c.news_id JOIN split s ON s.impression_id = c.impression_id JOIN pc ON pc.impression_id = c.impression_id AND pc.position = c.position
  JOIN pd ON pd.impression_id = c.impression_id AND pd.position = c.position JOIN s_f ON s_f.impression_id = c.impression_id AND s_f.position = c.position
  LEFT JOIN h1 ON h1.impression_id = c.impression_id AND h1.category = a.category
  LEFT JOIN h2 ON h2.impression_id = c.impression_id AND h2.subcategory = a.subcategory LEFT JOIN h3 ON h3.impression_id = c.impression_id LEFT JOIN f1 ON f1.category = a.category
  LEFT JOIN f2 ON f2.subcategory = a.subcategory LEFT JOIN sn ON sn.impression_id = c.impression_id AND sn.news_id = c.news_id"""
    )


ORACLES["ltr_features"] = _feature_sql("train")
ORACLES["ltr_features_validation"] = _feature_sql("validation")

ORACLES["target_diagnostics"] = (
    FEED
    + """, t AS (SELECT c.impression_id, count(a.news_id) AS known, count(*) AS n FROM cand c LEFT JOIN art a USING (news_id) WHERE label = 1 GROUP BY 1)
SELECT part, count(*) FILTER (WHERE n IS NULL) AS n_without_click, CAST(coalesce(sum(known), 0) AS BIGINT) AS n_known_targets, CAST(coalesce(sum(n - known), 0) AS BIGINT) AS n_missing_targets
  FROM split LEFT JOIN t USING (impression_id) GROUP BY 1"""
)
ORACLES["top_categories"] = (
    FEED
    + _scored("category_affinity", _TRAIN, _VAL, "v")
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, position) AS rank FROM s_v)
SELECT impression_id, {_SHOWN.format(c="category", m="<missing>")} AS category, count(*) AS n FROM r WHERE rank <= 10 GROUP BY 1, 2"""
)
ORACLES["profile_rates"] = (
    FEED
    + """, e AS (SELECT part, round(avg(CAST(len(history) = 0 AS DOUBLE)), 9) AS empty_history_rate FROM split GROUP BY 1),
m AS (SELECT part, round(avg(CAST(coalesce(category, '') = '' AS DOUBLE)), 9) AS missing_category_rate FROM cand LEFT JOIN art USING (news_id) GROUP BY 1)
SELECT * FROM e JOIN m USING (part)"""
)
_names = ("original_order", "global_popularity", "category_affinity", "tfidf_similarity")
_runs = FEED
for _n in _names:
    _runs += _scored(_n, _TRAIN, _VAL, f"b_{_n}")
for _k, _h in enumerate((6.0, 24.0, 72.0)):
    _runs += _scored("time_decayed", _TRAIN, _VAL, f"b_h{_k}", _h)
_parts = [f"SELECT '{_n}:' || impression_id AS impression_id, '{_n}' AS part, position, label, score FROM s_b_{_n}" for _n in _names]
_parts += [f"SELECT 'h{_k}:' || impression_id AS impression_id, 'time_decayed{_k}' AS part, position, label, score FROM s_b_h{_k}" for _k in range(3)]
_runs += _metrics(" UNION ALL ".join(_parts))
_runs += """, m0 AS (SELECT part, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(mrr), 6) AS mrr, round(avg(auc), 6) AS auc FROM per GROUP BY 1),
m AS (SELECT part AS name, ndcg_10, mrr, auc FROM m0 WHERE part NOT LIKE 'time_decayed%' UNION ALL
  (SELECT 'time_decayed', ndcg_10, mrr, auc FROM m0 WHERE part LIKE 'time_decayed%' ORDER BY ndcg_10 DESC, mrr DESC, part LIMIT 1))"""
ORACLES["select_baseline"] = (
    _runs
    + " (SELECT *, 'strongest' AS selector FROM m ORDER BY ndcg_10 DESC, mrr DESC, auc DESC, name LIMIT 1) UNION ALL (SELECT *, 'reported' AS selector FROM m ORDER BY ndcg_10 DESC, mrr DESC, name DESC LIMIT 1)"
)
_five = FEED
for _n in (*_names, "time_decayed"):
    _five += _scored(_n, _TRAIN, _VAL, f"b_{_n}")
_score = {"time_decayed": "round(score, 6)"}
_five += _metrics(" UNION ALL ".join(f"SELECT '{_n}:' || impression_id AS impression_id, '{_n}' AS part, position, label, {_score.get(_n, 'score')} AS score FROM s_b_{_n} JOIN (SELECT news_id FROM art) USING (news_id)" for _n in (*_names, "time_decayed")))
ORACLES["ltr_baselines"] = _five + _MACRO.replace(" SELECT part,", " SELECT part AS name,")
