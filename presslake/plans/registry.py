"""All queries outside the language-model subpackage, with their SQL."""

from __future__ import annotations

from presslake.plans import general, reference, reference_sql, retrieval, retrieval_sql, serving

QUERIES = {**general.QUERIES, **reference.QUERIES, **retrieval.QUERIES, **serving.QUERIES}
ORACLES = {**general.ORACLES, **reference_sql.ORACLES, **retrieval_sql.ORACLES, **serving.ORACLES}
