"""DuckDB SQL of the language-model queries that SQL can express."""

from __future__ import annotations

_BASKETS = """
WITH rec AS (SELECT impression_id AS r, list_concat(coalesce(history, []), coalesce(list_transform(list_filter(impressions, lambda c: c.clicked = 1), lambda c: c.news_id), [])) AS items
             FROM behaviors WHERE impression_id IS NOT NULL),
n AS (SELECT count(DISTINCT r) AS n FROM rec),
item AS (SELECT DISTINCT r, x FROM (SELECT r, unnest(items) AS x FROM rec) WHERE x IS NOT NULL),
c AS (SELECT x, count(*) AS c FROM item GROUP BY x),
p AS (SELECT a.x AS a, b.x AS b, count(*) AS ab FROM item a JOIN item b ON a.r = b.r AND a.x < b.x GROUP BY 1, 2 HAVING count(*) >= 5),
kept AS (SELECT p.a, p.b, n.n, ca.c AS ca, cb.c AS cb, p.ab FROM p JOIN c ca ON ca.x = p.a JOIN c cb ON cb.x = p.b CROSS JOIN n
         WHERE p.ab * n.n >= 20 * ca.c * cb.c)
"""

_TERMS = r"""
WITH art AS (SELECT * FROM (SELECT news_id, title, abstract, category, row_number() OVER (PARTITION BY news_id
               ORDER BY CASE source_split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END, source_row_number) AS r FROM news WHERE news_id IS NOT NULL) WHERE r = 1),
tok AS (SELECT news_id, list_transform(regexp_extract_all(concat_ws(chr(10), coalesce(title, ''), coalesce(abstract, ''), coalesce(category, '')), '[\p{L}\p{N}]{2,}'), lambda x: lower(x)) AS t FROM art),
st AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM tok),
tf AS (SELECT news_id, term, any_value(len) AS len, count(*) AS tf FROM (SELECT news_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
"""

ORACLES = {
    "p3_found": """
SELECT impression_id, CAST(candidate_position AS BIGINT) AS candidate_position FROM (
  SELECT impression_id, candidate_position, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, candidate_position) AS r
  FROM (SELECT impression_id, candidate_position, max(score + 0.0) AS score FROM scored_candidates
        WHERE impression_id IS NOT NULL AND candidate_position IS NOT NULL AND isfinite(score) GROUP BY 1, 2)) WHERE r <= 3""",
    "p5_found": _BASKETS + "SELECT a AS news_a, b AS news_b FROM kept",
    "p5_scores": _BASKETS
    + """SELECT a AS item_a, b AS item_b, n AS n_records, ca AS count_a, cb AS count_b, ab AS n_both,
  round(CAST(ab AS DOUBLE) * n / (CAST(ca AS DOUBLE) * cb), 6) AS lift,
  round(CASE WHEN ab < ca THEN CAST(n - cb AS DOUBLE) * ca / (CAST(n AS DOUBLE) * (ca - ab)) END, 6) AS conviction FROM kept""",
    "p6_found": _TERMS
    + """SELECT news_id, term FROM (SELECT news_id, term, row_number() OVER (PARTITION BY news_id ORDER BY tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) DESC, term) AS r
  FROM tf JOIN df USING (term) CROSS JOIN st) WHERE r <= 3""",
    "p6_relevance": _TERMS
    + """SELECT news_id, term, tf, df, round(CAST(tf AS DOUBLE) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg)) * ln(1.0 + (n - df + 0.5) / (df + 0.5)), 6) AS weight
  FROM tf JOIN df USING (term) CROSS JOIN st""",
}
