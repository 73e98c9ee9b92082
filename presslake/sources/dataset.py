"""The prepared dataset: written from delivered feeds, loaded with validation, and its serving catalog and reports."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.operators import feed
from presslake.sources.files import FeedError, missing_files

PARTS = ("train", "validation", "test")
NEWS = ("source_split", "source_row_number", "news_id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities")
BEHAVIORS = ("source_split", "source_row_number", "source_row_hash", "impression_id", "user_id", "timestamp", "history", "impressions")
CATALOG = ("news_id", "category", "subcategory")
METADATA = "split_metadata.json"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any Hadoop file system; an existing one is replaced."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """A report with sorted keys and two blanks of indent."""
    write_text(spark, path, json.dumps(document, indent=2, sort_keys=True, default=str) + "\n")


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON object; FeedError if the file holds anything else."""
    try:
        document = json.loads(read_text(spark, path))
    except ValueError as error:
        raise FeedError(f"{path}: {error}") from error
    if not isinstance(document, dict):
        raise FeedError(f"{path}: no JSON object")
    return document


def write_table(df: DataFrame, path: str) -> None:
    """A few rows as one CSV file with a header (sweeps, latencies)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(title: str, rows: list[dict]) -> str:
    """A report table; columns in the order of the first row."""
    if not rows:
        return f"# {title}\n\nno rows\n"
    columns = list(rows[0])
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(columns), line("---" for _ in columns), *[line(r[c] for c in columns) for r in rows], ""])


def prepare(spark: SparkSession, news: DataFrame, rows: DataFrame, behaviors: DataFrame, folder: str, protocol: str) -> dict:
    """Writes news once per id, the three partitions of ``rows`` (with part) and the metadata; returns the metadata.

    Raises, before anything is written, if the split breaks its integrity or a
    candidate has no article.
    """
    counts = feed.integrity(rows, behaviors)
    kept = first_news(news)
    lost = feed.candidates(rows, ()).join(kept.select("news_id"), "news_id", "left_anti").count()
    if lost:
        raise FeedError(f"{lost} candidates have no article")
    kept.select(*NEWS).write.mode("overwrite").parquet(f"{folder}/news.parquet")
    own = rows.select(
        "part", "source_split", "source_row_number", "source_row_hash", "impression_id", "user_id", F.timestamp_micros("ts_us").alias("timestamp"), "history",
        F.transform("candidates", lambda c, i: F.struct(i.cast("int").alias("position"), c.news_id.alias("news_id"), c.clicked.cast("tinyint").alias("clicked"))).alias("impressions"),
    )
    for part in PARTS:
        own.filter(F.col("part") == part).select(*BEHAVIORS).write.mode("overwrite").parquet(f"{folder}/{part}_behaviors.parquet")
    sizes = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}
    metadata = {"protocol": protocol, "rows": sizes, **counts}
    write_json(spark, f"{folder}/{METADATA}", metadata)
    return metadata


def first_news(news: DataFrame) -> DataFrame:
    """All columns of the first delivery of every article; NULL texts become ''."""
    first = feed.articles(news).select("news_id")
    rank = F.when(F.col("source_split") == "train", 0).when(F.col("source_split") == "dev", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), "source_row_number", *[F.coalesce(c, F.lit("")).alias(c) for c in NEWS if c not in ("source_row_number", "news_id")]))
    return news.join(first, "news_id", "left_semi").groupBy("news_id").agg(best.alias("b")).select("news_id", "b.*").drop("r")


@dataclass(frozen=True)
class Dataset:
    """Validated views of a prepared dataset; ``behaviors`` has the column part."""

    news: DataFrame
    behaviors: DataFrame
    metadata: dict
    #: History entries without an article, per part.
    unknown_history: dict[str, int]


def _require_columns(df: DataFrame, names: tuple[str, ...], path: str) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise FeedError(f"{path}: missing columns {', '.join(missing)}")


def _violations(df: DataFrame, checks: dict[str, Column], path: str) -> None:
    """Raises for the first named condition that holds for any row; all are counted in one pass."""
    found = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()]).first().asDict()
    for name, n in found.items():
        if n:
            raise FeedError(f"{path}: {n} rows with {name.replace('_', ' ')}")


def load_dataset(spark: SparkSession, folder: str, limit: int | None = None) -> Dataset:
    """The prepared dataset, checked: files, columns, ids, positions, labels, and an article for every candidate.

    ``limit`` keeps the first impressions of every partition in the order of time, row number and id.
    """
    if limit is not None and limit <= 0:
        raise ValueError("the limit must be positive")
    files = ["news.parquet", *[f"{p}_behaviors.parquet" for p in PARTS], METADATA]
    if missing := missing_files(spark, folder, files):
        raise FeedError(f"{folder}: missing {', '.join(missing)}")
    news = spark.read.parquet(f"{folder}/news.parquet")
    _require_columns(news, ("news_id", "category", "subcategory", "title", "abstract"), "news.parquet")
    _violations(news, {"an_empty_news_id": F.trim("news_id") == ""}, "news.parquet")
    if news.groupBy("news_id").count().filter("count > 1").limit(1).count():
        raise FeedError("news.parquet: news_id is repeated")
    news = news.select("news_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("category", "subcategory", "title", "abstract")])
    parts = []
    for part in PARTS:
        path = f"{part}_behaviors.parquet"
        rows = spark.read.parquet(f"{folder}/{path}")
        _require_columns(rows, BEHAVIORS, path)
        places = F.transform("impressions", lambda c: c.position)
        checks = {
            "an_empty_impression_id": F.trim("impression_id") == "",
            "no_timestamp": F.col("timestamp").isNull(),
            "an_empty_candidate_id": F.exists("impressions", lambda c: c.news_id.isNull() | (F.trim(c.news_id) == "")),
            "a_negative_position": F.exists("impressions", lambda c: c.position.isNull() | (c.position < 0)),
            "positions_out_of_order": (F.size(F.array_distinct(places)) < F.size(places)) | (F.array_sort(places) != places),
            "a_label_that_is_none": F.exists("impressions", lambda c: ~F.coalesce(c.clicked.isin(0, 1), F.lit(True))),
            "an_empty_history_id": F.exists("history", lambda h: h.isNull() | (F.trim(h) == "")),
        }
        _violations(rows, checks, path)
        if rows.groupBy("impression_id").count().filter("count > 1").limit(1).count():
            raise FeedError(f"{path}: impression_id is repeated")
        if limit is not None:
            rows = rows.orderBy("timestamp", "source_row_number", "impression_id").limit(limit)
        parts.append(rows.select(*BEHAVIORS).withColumn("part", F.lit(part)))
    behaviors = parts[0].unionByName(parts[1]).unionByName(parts[2])
    known = news.select("news_id")
    lost = behaviors.select(F.explode(F.transform("impressions", lambda c: c.news_id)).alias("news_id")).join(known, "news_id", "left_anti").count()
    if lost:
        raise FeedError(f"{lost} candidates have no article")
    unknown = behaviors.select("part", F.explode("history").alias("news_id")).join(known, "news_id", "left_anti").groupBy("part").count()
    counts = {p: 0 for p in PARTS} | {r.part: r["count"] for r in unknown.collect()}
    return Dataset(news, behaviors, read_json(spark, f"{folder}/{METADATA}"), counts)


def load_catalog(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The serving catalog ``name`` inside ``folder``: three columns, each id once; a name that leaves the folder is refused."""
    if name.startswith("/") or ":" in name or ".." in name.split("/"):
        raise FeedError(f"{name} leaves the folder")
    df = spark.read.parquet(f"{folder}/{name}")
    _require_columns(df, CATALOG, name)
    if df.groupBy("news_id").count().filter("count > 1 OR news_id IS NULL").limit(1).count():
        raise FeedError(f"{name}: news_id is repeated or NULL")
    return df.select(*CATALOG)


def save_vectors(articles: DataFrame, folder: str, source: str) -> dict:
    """Saves (news_id, embedding) with a fingerprint of size, dimension and content."""
    articles.select("news_id", "embedding").write.mode("overwrite").parquet(f"{folder}/vectors.parquet")
    spark = articles.sparkSession
    fingerprint = _fingerprint(spark.read.parquet(f"{folder}/vectors.parquet")) | {"source": source}
    write_json(spark, f"{folder}/index.json", fingerprint)
    return fingerprint


def load_vectors(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Saved vectors; raises if they or their source aren't those of the fingerprint."""
    df = spark.read.parquet(f"{folder}/vectors.parquet")
    kept = read_json(spark, f"{folder}/index.json")
    if kept != _fingerprint(df) | {"source": source}:
        raise FeedError(f"{folder}: the vectors don't fit their fingerprint")
    return df


def _fingerprint(df: DataFrame) -> dict:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"), F.bit_xor(F.xxhash64("news_id", "embedding")).alias("h")).first()
    if r.n and r.lo != r.hi:
        raise FeedError("vectors of several dimensions")
    return {"rows": r.n, "dimension": r.lo or 0, "content": str(r.h)}
