"""Queries of the general record-processing problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.operators import nested, packed, rows
from presslake.operators.sessions import sessions
from presslake.sources.tables import table

KEYS = ["source_split", "source_row_number"]
PACKED_FIELDS = ["history_raw", "impressions"]
ENTITY_FIELDS = ["title_entities", "abstract_entities"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The values by the fields' grammar: only quotes protect, so no dictionary can change a row and none is gathered."""
    return packed.split_packed(table(spark, d, "behavior_exports"), "export_id", PACKED_FIELDS)


def p1_protected(spark: SparkSession, d: str) -> DataFrame:
    """As p1_found, but values that are quoted in any field stay whole where they stand without quotes; here the dictionary decides."""
    exports = table(spark, d, "behavior_exports")
    return packed.split_packed(exports, "export_id", PACKED_FIELDS, packed.harvest(exports, PACKED_FIELDS, bare=True))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    flat = nested.flatten_entities(table(spark, d, "news"), ENTITY_FIELDS, KEYS)
    mentions = flat.filter("kind = 'mention' OR n_mentions = 0").select("nested_field", *KEYS, "item_path", "item_key", "mention_pos", "surface")
    candidates = nested.flatten_candidates(table(spark, d, "behaviors"), "impressions", KEYS)
    candidates = candidates.select(
        F.lit("impressions").alias("nested_field"), *KEYS, "item_path", "item_key", F.lit(-1).cast("bigint").alias("mention_pos"), F.lit("").alias("surface")
    )
    return mentions.unionByName(candidates)


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """The supertype of all entities: one row per entity with its variant, subtype, parent link and own columns."""
    flat = nested.flatten_entities(table(spark, d, "news"), ENTITY_FIELDS, KEYS)
    return flat.filter("kind = 'entity'").drop("kind", "mention_pos", "surface", "offsets")


def p2_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The supertype of all mentions, linked to its entity by source row, field and item_path."""
    flat = nested.flatten_entities(table(spark, d, "news"), ENTITY_FIELDS, KEYS)
    return flat.filter("kind = 'mention'").select("nested_field", *KEYS, "item_path", "subtype", "mention_pos", "surface", "offsets")


#: The columns of the typed entity tables: what their shape always lacks is left out.
_LINKS = ["nested_field", *KEYS, "variant", "item_path", "parent_path", "depth"]
_OWN = ["label", "type", "confidence", "aliases", "n_mentions"]


def _entity_table(prefix: str):
    def typed(spark: SparkSession, d: str) -> DataFrame:
        flat = nested.flatten_entities(table(spark, d, "news"), ENTITY_FIELDS, KEYS)
        key = {"current": [F.col("item_key").alias("entity_id")], "legacy": [F.col("item_key").alias("id")], "unkeyed": []}[prefix]
        return flat.filter(F.col("kind") == "entity").filter(F.col("subtype").startswith(prefix)).select(*_LINKS, *key, *_OWN, "n_members")

    return typed


def p2_located_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with places in the text: one row per mention with its offsets."""
    return p2_mentions(spark, d).filter("subtype = 'located'").drop("subtype")


def p2_plain_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions without places."""
    return p2_mentions(spark, d).filter("subtype = 'plain'").drop("subtype", "offsets")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "behaviors"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return rows.failures(table(spark, d, "raw_news"), rows.NEWS, KEYS).unionByName(
        rows.failures(table(spark, d, "raw_behaviors"), rows.BEHAVIORS, KEYS)
    )


def p7_broken_fields(spark: SparkSession, d: str) -> DataFrame:
    """The failing lines with the first field that is broken."""
    return rows.failures(table(spark, d, "raw_news"), rows.NEWS, KEYS, broken_field=True).unionByName(
        rows.failures(table(spark, d, "raw_behaviors"), rows.BEHAVIORS, KEYS, broken_field=True)
    )


def p7_typed_news(spark: SparkSession, d: str) -> DataFrame:
    return rows.typed_news(table(spark, d, "raw_news"), KEYS)


def p7_typed_behaviors(spark: SparkSession, d: str) -> DataFrame:
    return rows.typed_behaviors(table(spark, d, "raw_behaviors"), KEYS)


QUERIES = {f.__name__: f for f in (p1_found, p1_protected, p2_found, p2_entities, p2_mentions, p4_found, p7_found, p7_broken_fields, p7_typed_news, p7_typed_behaviors)}
QUERIES |= {f"p2_{prefix}_entities": _entity_table(prefix) for prefix in ("current", "legacy", "unkeyed")}
QUERIES |= {f.__name__: f for f in (p2_located_mentions, p2_plain_mentions)}
ORACLES: dict[str, str] = {
    "p4_found": """WITH e AS (SELECT impression_id, min(struct_pack(t := epoch_us(timestamp), u := user_id)) AS v FROM behaviors
  WHERE impression_id IS NOT NULL AND user_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1),
g AS (SELECT v.u AS user_id, v.t AS t, CASE WHEN v.t - lag(v.t) OVER (PARTITION BY v.u ORDER BY v.t) <= 1800000000 THEN 0 ELSE 1 END AS starts FROM e),
s AS (SELECT user_id, t, sum(starts) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(t) AS session_start_us, max(t) AS session_end_us, count(*) AS n_events FROM s GROUP BY user_id, k""",
}
