"""File sources: tab-separated feeds, request logs, layouts; and the sinks of derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presslake.operators.rows import parsed_timestamp, trimmed

NEWS_COLUMNS = ("news_id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities")
BEHAVIOR_COLUMNS = ("impression_id", "user_id", "timestamp", "history", "impressions")
REQUEST_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("selected_policy", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in ("history_id_count", "candidate_id_count", "ranked_candidate_count", "missing_candidate_count", "unknown_history_count")],
        T.StructField("empty_history", T.BooleanType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("top_ranked_category_counts", T.MapType(T.StringType(), T.LongType())),
    ]
)


class FeedError(ValueError):
    """A file or row that breaks the declared format."""


def missing_files(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """The names that don't exist under a folder of any Hadoop file system."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for n in names if not fs.exists(jvm.org.apache.hadoop.fs.Path(root, n))]


#: Files of a delivery under each protocol.
LAYOUTS = {
    "official": ("train/news.tsv", "train/behaviors.tsv", "dev/news.tsv", "dev/behaviors.tsv"),
    "train_only": ("train/news.tsv", "train/behaviors.tsv"),
}


def require_layout(spark: SparkSession, folder: str, protocol: str) -> list[str]:
    """The paths of a delivery; FeedError names what is missing."""
    if protocol not in LAYOUTS:
        raise ValueError(f"unknown protocol {protocol}")
    if missing := missing_files(spark, folder, list(LAYOUTS[protocol])):
        raise FeedError(f"{folder}: missing {', '.join(missing)}")
    return [f"{folder.rstrip('/')}/{n}" for n in LAYOUTS[protocol]]


def numbered_lines(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(source_split, source_row_number, line): 1-based line numbers in file order.

    A line's number is its place in its file block plus the lines of the blocks
    before it. Places come from ids that grow along a block, so nothing is sorted
    but one row per block, and no line leaves the JVM.
    """
    block = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select(F.col("value").alias("line"), *[F.col(c) for c in block], F.monotonically_increasing_id().alias("_id"))
    sizes = lines.groupBy("file_path", "file_block_start").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first"))
    order = Window.orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    offsets = sizes.select("file_path", "file_block_start", "_first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_before"))
    number = F.col("_id") - F.col("_first") + F.col("_before") + 1
    return lines.join(offsets, ["file_path", "file_block_start"]).select(F.lit(split).alias("source_split"), number.cast("bigint").alias("source_row_number"), "line")


def feed_timestamp(text: Column) -> Column:
    """The instant of a feed's timestamp: the strict forms, and ISO dates alone, without seconds, or with further forms of zones. Without a zone it is UTC."""
    iso = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}")
    return F.coalesce(parsed_timestamp(text), F.when(iso, text.try_cast("timestamp")))


def read_news(lines: DataFrame) -> DataFrame:
    """Typed news rows of unquoted lines; ``error`` names what is wrong (columns, id) or is NULL."""
    parts = F.split("line", "\t", -1)
    named = lines.withColumn("_p", parts).withColumn("_ok", F.size("_p") == len(NEWS_COLUMNS))
    out = named.select("source_split", "source_row_number", "_ok", *[F.when(F.col("_ok"), trimmed(F.get("_p", i))).alias(c) for i, c in enumerate(NEWS_COLUMNS)])
    error = F.when(~F.col("_ok"), "columns").when(F.col("news_id") == "", "id")
    return out.withColumn("error", error).drop("_ok")


def candidate_token(token: Column) -> Column:
    """(news_id, clicked, malformed) of a token ``ID``, ``ID-0`` or ``ID-1``; the label follows the last hyphen."""
    labeled = token.rlike(r"^(?s:.+)-[01]\z")
    plain = ~token.contains("-")
    news_id = F.when(labeled, F.regexp_extract(token, r"^((?s:.+))-[01]\z", 1)).when(plain, token)
    return F.struct(news_id.alias("news_id"), F.when(labeled, F.substring(token, -1, 1).cast("tinyint")).alias("clicked"), (~labeled & ~plain).alias("malformed"))


def read_behaviors(lines: DataFrame) -> DataFrame:
    """Typed behavior rows of unquoted lines, with the line's SHA-256, the number of malformed tokens, and ``error``."""
    tokens = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")
    named = lines.withColumn("_p", F.split("line", "\t", -1)).withColumn("_ok", F.size("_p") == len(BEHAVIOR_COLUMNS))
    named = named.select("*", *[F.when(F.col("_ok"), trimmed(F.get("_p", i))).alias(c) for i, c in enumerate(BEHAVIOR_COLUMNS)])
    parsed = named.withColumns({"ts": feed_timestamp(F.col("timestamp")), "_t": F.transform(tokens(F.col("impressions")), candidate_token)})
    good = F.filter("_t", lambda c: ~c.malformed)
    error = F.when(~F.col("_ok"), "columns").when((F.col("impression_id") == "") | (F.col("user_id") == ""), "id").when(F.col("ts").isNull(), "timestamp")
    return parsed.select(
        "source_split",
        "source_row_number",
        F.sha2("line", 256).alias("source_row_hash"),
        "impression_id",
        "user_id",
        F.col("ts").alias("timestamp"),
        tokens(F.col("history")).alias("history"),
        F.transform(good, lambda c, i: F.struct(i.cast("int").alias("position"), c.news_id.alias("news_id"), c.clicked.alias("clicked"))).alias("impressions"),
        F.size(F.filter("_t", lambda c: c.malformed)).alias("malformed_tokens"),
        error.alias("error"),
    )


def require_valid(rows: DataFrame) -> DataFrame:
    """Strict mode: raises on the first broken row by split and number, or the first with a malformed token, else the rows without ``error``."""
    if "malformed_tokens" in rows.columns:
        rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("malformed_tokens") > 0, "impressions")))
    bad = rows.filter("error IS NOT NULL").orderBy("source_split", "source_row_number").limit(1).collect()
    if bad:
        raise FeedError(f"{bad[0].source_split} line {bad[0].source_row_number}: {bad[0].error}")
    return rows.drop("error")


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """Request-log lines with their number; broken ones and those without the required fields have their text in ``broken``, blank ones are skipped."""
    lines = numbered_lines(spark, path, "").filter(F.trim("line") != "")
    parsed = lines.withColumn("_r", F.from_json("line", T.StructType([*REQUEST_LOG.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    required = F.col("_r._bad").isNotNull() | F.col("_r.request_id").isNull() | F.coalesce(F.col("_r.latency_ms") < 0, F.lit(False))
    return parsed.select(F.col("source_row_number").alias("line_number"), *[F.col(f"_r.{f.name}") for f in REQUEST_LOG.fields], F.when(required, F.col("line")).alias("broken"))


def write_candidates(rows: DataFrame, path: str, partition_by: str = "part") -> None:
    """Candidate, prediction or retrieval rows as Parquet, one folder per partition value."""
    rows.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def write_catalog(articles: DataFrame, path: str) -> None:
    """The serving catalogue: three columns, sorted by id within files."""
    articles.select("news_id", "category", "subcategory").repartitionByRange("news_id").sortWithinPartitions("news_id").write.mode("overwrite").parquet(path)
