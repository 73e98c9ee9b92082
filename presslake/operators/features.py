"""Leakage-free learning-to-rank features: strict-prior click state and the full feature table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslake.operators import ranking, text
from presslake.session import spread


#: Impressions whose rows of one article are sorted by one task at most, half-lives of a time bucket, and buckets that are looked back.
CHUNK, BUCKET_HALF_LIVES, BUCKETS_BACK = 50_000, 20, 4


def click_state(cand: DataFrame, half_life_hours: float) -> DataFrame:
    """``cand`` with ``prior_clicks`` and ``prior_decayed``: the clicks on the article in impressions before this one, in ordinal order.

    The decayed sum weighs a click by 0.5^(hours since / half-life). The
    impression itself is left out, also when it shows the article twice;
    earlier impressions of the same time count.

    Clicks are combined per (article, time bucket, chunk of ordinals). Inside a
    chunk a running sum is taken of clicks scaled to the bucket's start, so that
    it decays by one factor; earlier chunks of the bucket and the buckets before
    come as totals. Clicks of more than ``BUCKETS_BACK`` buckets before weigh
    less than 2^-80 and can't show in the nine places kept. Work grows with the
    rows, and no task sorts more of an article than a chunk.
    """
    span = int(BUCKET_HALF_LIVES * half_life_hours * 3_600_000_000)
    rows = cand.withColumns({"_b": F.expr(f"(ts_us - pmod(ts_us, {span}L)) div {span}L"), "_c": F.expr(f"ordinal div {CHUNK}")})
    scaled = F.pow(F.lit(2.0), (F.col("ts_us") - F.col("_b") * F.lit(span)) / 3.6e9 / half_life_hours)
    clicked = F.when(F.col("label") == 1, 1).otherwise(0)
    rows = rows.withColumns({"_n": clicked, "_w": clicked * scaled, "_f": scaled})
    chunks = rows.filter("_n > 0").groupBy("news_id", "_b", "_c").agg(F.sum("_n").alias("n"), F.sum("_w").alias("w"))
    # Every (article, bucket, chunk) with candidates needs the totals before it, whether it has clicks or not.
    places = rows.select("news_id", "_b", "_c").distinct().join(chunks, ["news_id", "_b", "_c"], "left").fillna(0, ["n", "w"])
    in_bucket = Window.partitionBy("news_id", "_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumns({"n_before": F.coalesce(F.sum("n").over(in_bucket), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(in_bucket), F.lit(0.0))})
    buckets = places.groupBy("news_id", "_b").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    order = Window.partitionBy("news_id").orderBy("_b")
    back = [F.coalesce(F.sum("w").over(order.rangeBetween(-k, -k)), F.lit(0.0)) * 2.0 ** (-BUCKET_HALF_LIVES * k) for k in range(1, BUCKETS_BACK + 1)]
    earlier = buckets.select("news_id", "_b", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_earlier"), sum(back, F.lit(0.0)).alias("w_earlier"))
    totals = places.join(earlier, ["news_id", "_b"]).select("news_id", "_b", "_c", (F.col("n_before") + F.col("n_earlier")).alias("_n0"), (F.col("w_before") + F.col("w_earlier")).alias("_w0"))
    own = Window.partitionBy("news_id", "_b", "_c").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({"_n1": F.coalesce(F.sum("_n").over(own), F.lit(0)), "_w1": F.coalesce(F.sum("_w").over(own), F.lit(0.0))}).join(totals, ["news_id", "_b", "_c"])
    out = out.withColumns({"prior_clicks": (F.col("_n0") + F.col("_n1")).cast("bigint"), "prior_decayed": F.round((F.col("_w0") + F.col("_w1")) / F.col("_f"), 9)})
    return out.drop("_b", "_c", "_n", "_w", "_f", "_n0", "_w0", "_n1", "_w1")


def prior_clicks(cand: DataFrame) -> DataFrame:
    """``cand`` with ``prior_clicks`` alone."""
    return click_state(cand, 24.0).drop("prior_decayed")


def prior_decayed_clicks(cand: DataFrame, half_life_hours: float) -> DataFrame:
    """``cand`` with ``prior_decayed``; ``prior_clicks`` of ``cand`` stay if it has them."""
    return click_state(cand.drop("prior_clicks"), half_life_hours) if "prior_clicks" in cand.columns else click_state(cand, half_life_hours).drop("prior_clicks")


def fitted_clicks(cand: DataFrame, fit: DataFrame, half_life_hours: float) -> DataFrame:
    """``cand`` with all clicks of the fitting partitions on the article, counted and decayed to their last impression."""
    counts = ranking.clicks(fit).withColumnRenamed("clicks", "prior_clicks")
    decayed = ranking.decayed_clicks(fit, half_life_hours).withColumnRenamed("decayed", "prior_decayed")
    return cand.join(counts, "news_id", "left").join(decayed, "news_id", "left").fillna({"prior_clicks": 0, "prior_decayed": 0.0})


#: Impressions of one block, and those whose similarities are computed at a time.
IMPRESSION_BLOCK, SIMILAR = 100_000, 500
#: What comes from the reader's history and the article itself.
OF_HISTORY = ["tfidf_history_similarity", "category_history", "subcategory_history", "length", "known", "seen"]
OF_ARTICLE = ["category_frequency", "subcategory_frequency", "has_abstract", "title_length", "abstract_length"]


def _described(articles: DataFrame, observed: DataFrame) -> DataFrame:
    """(news_id, category, subcategory) and OF_ARTICLE; frequencies are those among the observed articles."""
    fitted = articles.join(observed, "news_id", "left_semi")
    out = articles.select("news_id", "category", "subcategory", (F.trim("abstract") != "").cast("double").alias("has_abstract"), F.length("title").cast("double").alias("title_length"), F.length("abstract").cast("double").alias("abstract_length"))
    for column in ("category", "subcategory"):
        out = out.join(fitted.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias(f"{column}_frequency")), column, "left")
    return out.fillna(0.0, ["category_frequency", "subcategory_frequency"]).select("news_id", "category", "subcategory", *OF_ARTICLE)


def _counted(at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each of ``at`` is among ``of``."""
    keys, counts = np.unique(of, return_counts=True)
    if not len(keys):
        return np.zeros(len(at))
    place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[place] == at, counts[place], 0).astype(float)


def _similar(h_imp: np.ndarray, h_art: np.ndarray, c_imp: np.ndarray, c_art: np.ndarray, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Cosines of candidates and the mean vectors of histories; impressions are numbered from 0 to n."""

    def postings(art: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = starts[art + 1] - starts[art]
        return np.arange(size.sum()) + np.repeat(starts[art] - np.cumsum(size) + size, size), size

    span = int(terms.max(initial=0)) + 1
    at, size = postings(h_art)
    own, place = np.unique(np.repeat(h_imp, size) * span + terms[at], return_inverse=True)
    of = own // span
    known = np.bincount(h_imp, minlength=n)
    profile = text.whole(np.bincount(place, weights[at], minlength=len(own)) / np.maximum(known, 1)[of], text.PLACES)
    norm = np.sqrt(np.bincount(of, profile * profile, minlength=n))
    at, size = postings(c_art)
    who = np.repeat(np.arange(len(c_art)), size)
    key = c_imp[who] * span + terms[at]
    place = np.searchsorted(own, key)
    met = place < len(own)
    met[met] = own[place[met]] == key[met]
    dots = np.bincount(who[met], profile[place[met]] * weights[at[met]], minlength=len(c_art))
    length = norm[c_imp]
    return np.where(length > 0, text.whole(dots / np.where(length > 0, length, 1.0), 6), 0.0)


def _block_features(key, rows: pa.Table, arts: pa.Table) -> pa.Table:
    """Candidates with an article of a block of impressions, with OF_HISTORY and OF_ARTICLE."""
    n = len(rows)
    ids = pa.concat_arrays(arts.column("news_id").chunks) if len(arts) else pa.array([], pa.string())
    code = lambda c: pc.fill_null(pc.index_in(c, value_set=ids), -1).to_numpy().astype(np.int64)
    sizes, terms = text.flat(arts.column("terms"))
    weights, starts = text.as_weights(text.flat(arts.column("weights"))[1]), np.concatenate([[0], np.cumsum(sizes)])
    fitted = arts.column("fitted").to_numpy()
    whole = lambda c: pa.concat_arrays(rows.column(c).chunks) if n else pa.array([], rows.schema.field(c).type)
    lists = {c: whole(c) for c in ("history", "candidates")}
    length = pc.list_value_length(lists["history"]).to_numpy(zero_copy_only=False).astype(np.int64)
    h_imp, h_art = np.repeat(np.arange(n), length), code(lists["history"].flatten())
    h_imp, h_art = h_imp[h_art >= 0], h_art[h_art >= 0]
    shown = lists["candidates"].flatten()
    c_imp, c_art = np.repeat(np.arange(n), pc.list_value_length(lists["candidates"]).to_numpy(zero_copy_only=False).astype(np.int64)), code(pc.struct_field(shown, "news_id"))
    kept = np.flatnonzero(c_art >= 0)
    c_imp, c_art, shown = c_imp[kept], c_art[kept], shown.take(pa.array(kept))
    out = {"length": length[c_imp].astype(float), "known": np.bincount(h_imp, minlength=n)[c_imp].astype(float), "seen": (_counted(c_imp * (len(ids) + 1) + c_art, h_imp * (len(ids) + 1) + h_art) > 0).astype(float)}
    for column in ("category", "subcategory"):
        named = pc.dictionary_encode(arts.column(column)).combine_chunks()
        named = named if isinstance(named, pa.Array) else named.chunk(0) if named.num_chunks else None
        kind = named.indices.to_numpy().astype(np.int64) if named is not None else np.array([], np.int64)
        many = int(kind.max(initial=0)) + 1
        out[f"{column}_history"] = _counted(c_imp * many + kind[c_art], h_imp * many + kind[h_art])
    score = np.zeros(len(c_imp))
    use_h, use_c = fitted[h_art], fitted[c_art]
    for low in range(0, n, SIMILAR):
        h, c = slice(*np.searchsorted(h_imp, [low, low + SIMILAR])), slice(*np.searchsorted(c_imp, [low, low + SIMILAR]))
        hu, cu = np.flatnonzero(use_h[h]) + h.start, np.flatnonzero(use_c[c]) + c.start
        score[cu] = _similar(h_imp[hu] - low, h_art[hu], c_imp[cu] - low, c_art[cu], starts, terms, weights, SIMILAR)
    at, art = pa.array(c_imp), pa.array(c_art)
    return pa.table({
        **{c: rows.column(c).take(at) for c in ("impression_id", "ts_us", "ordinal")}, "position": pc.struct_field(shown, "position"), "news_id": ids.take(art), "label": pc.struct_field(shown, "clicked"),
        "tfidf_history_similarity": score, **{c: out[c] for c in OF_HISTORY[1:]}, **{c: arts.column(c).take(art) for c in OF_ARTICLE},
    })


def with_history(rows: DataFrame, vectors: DataFrame, articles: DataFrame, observed: DataFrame) -> DataFrame:
    """The candidates with an article: impression_id, ts_us, ordinal, position, news_id, label, OF_HISTORY and OF_ARTICLE.

    ``vectors`` are those of the observed articles. Blocks of impressions meet
    the articles they show or name, each once, in cogrouped maps; candidates
    leave them as finished rows, so that no join has candidates on a side.
    """
    spark = rows.sparkSession
    n = rows.count()
    blocks = max(1, -(-n // IMPRESSION_BLOCK), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1_000)))
    keys = F.array(*[F.lit(key).cast("bigint") for key in spread(spark, blocks)])
    own = rows.select(F.get(keys, F.pmod(F.xxhash64("impression_id"), F.lit(blocks)).cast("int")).alias("g"), "impression_id", "ts_us", "ordinal", "history", "candidates")
    named = F.array_union("history", F.transform("candidates", lambda c: c.news_id))
    wanted = own.select("g", named.alias("ids")).repartition("g").select("g", F.explode("ids").alias("news_id")).distinct()
    none = F.array().cast("array<int>")
    described = _described(articles, observed).join(vectors.withColumn("fitted", F.lit(True)), "news_id", "left").withColumns({"fitted": F.col("fitted").isNotNull(), "terms": F.coalesce("terms", none), "weights": F.coalesce("weights", none)})
    schema = "impression_id string, ts_us bigint, ordinal bigint, position int, news_id string, label tinyint, " + ", ".join(f"{c} double" for c in OF_HISTORY + OF_ARTICLE)
    return own.withColumn("ordinal", F.col("ordinal").cast("bigint")).groupBy("g").cogroup(wanted.join(described, "news_id").withColumnRenamed("g", "b").groupBy("b")).applyInArrow(_block_features, schema)


def _joined(cand: DataFrame, rows: DataFrame, articles: DataFrame, observed: DataFrame) -> DataFrame:
    """``cand`` with OF_HISTORY and OF_ARTICLE by joins, for candidates that come with a similarity of their own."""
    hist = rows.select("impression_id", F.explode("history").alias("news_id"))
    known = hist.join(articles.select("news_id"), "news_id", "left_semi").groupBy("impression_id").agg(F.count(F.lit(1)).alias("known"))
    seen = hist.distinct().withColumn("seen", F.lit(1))
    out = cand.join(_described(articles, observed), "news_id")
    for column in ("category", "subcategory"):
        out = out.join(ranking.history_counts(hist, articles, column).withColumnRenamed("n", f"{column}_history"), ["impression_id", column], "left")
    return out.join(known, "impression_id", "left").join(seen, ["impression_id", "news_id"], "left").join(rows.select("impression_id", F.size("history").alias("length")), "impression_id")


def feature_table(cand: DataFrame, rows: DataFrame, articles: DataFrame, observed: DataFrame, half_life_hours: float = 24.0, fit: DataFrame | None = None) -> DataFrame:
    """All features of every candidate; ``cand`` brings the text similarity, ``tfidf_history_similarity``.

    ``observed`` holds the distinct article ids of the fitting partitions, ``fit``
    their candidates: with it the clicks are all of theirs (evaluation), without
    it those before each impression among ``cand`` itself (training).
    """
    cand = cand if set(OF_HISTORY + OF_ARTICLE) <= set(cand.columns) else _joined(cand, rows, articles, observed)
    out = click_state(cand, half_life_hours) if fit is None else fitted_clicks(cand, fit, half_life_hours)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return out.select(
        "impression_id",
        F.col("position").cast("bigint").alias("position"),
        "news_id",
        F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"),
        (1.0 / (F.col("position") + 1.0)).alias("reciprocal_position"),
        number("prior_clicks").alias("global_click_count"),
        F.round("prior_decayed", 6).alias("time_decayed_click_count"),
        number("category_history").alias("category_history_count"),
        number("subcategory_history").alias("subcategory_history_count"),
        number("tfidf_history_similarity").alias("tfidf_history_similarity"),
        number("category_frequency").alias("category_article_frequency"),
        number("subcategory_frequency").alias("subcategory_article_frequency"),
        number("length").alias("history_length"),
        number("known").alias("known_history_count"),
        (F.col("length") == 0).cast("double").alias("empty_history"),
        number("seen").alias("candidate_seen_in_history"),
        "has_abstract",
        "title_length",
        "abstract_length",
    )


FEATURES = [
    "position", "reciprocal_position", "global_click_count", "time_decayed_click_count", "category_history_count", "subcategory_history_count",
    "tfidf_history_similarity", "category_article_frequency", "subcategory_article_frequency", "history_length", "known_history_count", "empty_history",
    "candidate_seen_in_history", "has_abstract", "title_length", "abstract_length",
]


def fit_ranker(features: DataFrame, kind: str = "logistic", c: float = 1.0, learning_rate: float = 0.1):
    """A pointwise ranker on the labeled rows: standardised logistic regression with inverse penalty ``c``, or 50 boosted trees of at most 16 leaves, classes balanced by weight."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    labeled = features.filter("label >= 0")  # read by the counts and by the fit
    counts = {r.label: r["count"] for r in labeled.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError("both classes are needed")
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="raw")
    if kind == "logistic":
        stages = [
            assemble,
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1.0 / (c * n), maxIter=300),
        ]
    else:
        stages = [assemble, GBTClassifier(featuresCol="raw", labelCol="y", weightCol="w", maxIter=50, maxDepth=4, stepSize=learning_rate, minInstancesPerNode=10, seed=42)]
    return Pipeline(stages=stages).fit(labeled.withColumns({"w": weight, "y": F.col("label").cast("double")}))


def predicted(model, features: DataFrame) -> DataFrame:
    """``features`` with ``score``, the probability of a click."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(features).withColumn("score", F.get(vector_to_array("probability"), 1))
