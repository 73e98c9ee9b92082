"""TF-IDF weights, reader profiles and content retrieval as joins over a long (news_id, term, weight) table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.session import numbered

TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Weights are rounded to this many places before they are ranked, so that sums don't depend on the order of additions.
PLACES = 9


def rounded(value: Column, places: int) -> Column:
    """Non-negative numbers rounded as a scaled number is, halves up, so that a half in decimals doesn't hang on how a double is printed."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def whole(values: np.ndarray, places: int) -> np.ndarray:
    """Non-negative numbers rounded as ``rounded`` does."""
    scale = float(10**places)
    return np.floor(values * scale + 0.5) / scale


def article_text(*parts: str) -> Column:
    """Trimmed, non-blank parts joined by a blank."""
    return F.concat_ws(" ", *[F.nullif(F.trim(F.col(p)), F.lit("")) for p in parts])


def tfidf(articles: DataFrame, fit_ids: DataFrame, parts: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """(news_id, term, weight): raw counts times ln((1+n)/(1+df))+1, L2-normalised per article.

    Document frequencies come from the articles in ``fit_ids`` with any text;
    all articles are weighted, with the terms the fit knows.
    """
    tokens = F.regexp_extract_all(F.lower(article_text(*parts)), F.lit(TOKEN), F.lit(0))
    tf = articles.select("news_id", F.explode(tokens).alias("term")).groupBy("news_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    fit = articles.join(fit_ids, "news_id", "left_semi").filter(article_text(*parts) != "")
    n = fit.count()
    df = tf.join(fit_ids, "news_id", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, "term").withColumn("w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("news_id")))
    return raw.select("news_id", "term", rounded(F.col("w") / norm, PLACES).alias("weight"))


#: Vocabularies of at most so many terms are broadcast, as they grow far more slowly than the texts.
BROADCAST_TERMS = 1_000_000


def vectors(articles: DataFrame, fit_ids: DataFrame, parts: tuple[str, ...] = ("title", "abstract")) -> tuple[DataFrame, DataFrame]:
    """The weights of ``tfidf`` as one row per article, also of those without any: (news_id, terms, weights); and the vocabulary (term, code).

    Terms are numbers, weights whole multiples of 10^-PLACES, which take half the
    space of text and doubles. Tokens never leave their article's partition.
    """
    tokens = F.regexp_extract_all(F.lower(article_text(*parts)), F.lit(TOKEN), F.lit(0))
    fit = articles.join(fit_ids, "news_id", "left_semi").filter(article_text(*parts) != "")
    n = fit.count()
    vocabulary = numbered(fit.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy("term"), "code")
    known = F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_TERMS else vocabulary
    each = articles.select("news_id", F.explode(tokens).alias("term")).join(known, "term")
    raw = each.groupBy("news_id", "code", "df").agg(F.count(F.lit(1)).alias("tf"))
    raw = raw.select("news_id", "code", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)).alias("w"))
    lists = raw.groupBy("news_id").agg(F.array_sort(F.collect_list(F.struct("code", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.w * x.w))
    parts_of = lambda x: F.floor(x.w / F.col("norm") * float(10**PLACES) + 0.5).cast("int")
    coded = lists.withColumn("norm", norm).select("news_id", F.transform("v", lambda x: x.code).alias("terms"), F.transform("v", parts_of).alias("weights"))
    none = F.array().cast("array<int>")
    out = articles.select("news_id").join(coded, "news_id", "left").select("news_id", *[F.coalesce(c, none).alias(c) for c in ("terms", "weights")])
    return out, vocabulary.select("term", "code")


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lists of a column (NULL: 0) and their values in one array; whole numbers of weights stay whole."""
    one = column.combine_chunks()
    one = one if isinstance(one, pa.Array) else pa.concat_arrays(one.chunks) if one.num_chunks else pa.array([], column.type)
    return pc.fill_null(pc.list_value_length(one), 0).to_numpy(zero_copy_only=False).astype(np.int64), one.flatten().to_numpy(zero_copy_only=False)


def as_weights(values: np.ndarray) -> np.ndarray:
    """Weights as doubles; whole numbers are multiples of 10^-PLACES."""
    return values / float(10**PLACES) if values.dtype.kind == "i" else values.astype(np.float64)


def mean_profiles(hist: DataFrame, weights: DataFrame, known: DataFrame) -> DataFrame:
    """(impression_id, term, weight): the mean vector of the known history entries; duplicates count."""
    entries = hist.join(known.select("news_id"), "news_id", "left_semi")
    size = entries.groupBy("impression_id").agg(F.count(F.lit(1)).alias("_n"))
    sums = entries.groupBy("impression_id", "news_id").agg(F.count(F.lit(1)).alias("_m")).join(weights, "news_id")
    sums = sums.groupBy("impression_id", "term").agg(F.sum(F.col("_m") * F.col("weight")).alias("_s"))
    return sums.join(size, "impression_id").select("impression_id", "term", rounded(F.col("_s") / F.col("_n"), PLACES).alias("weight"))


def recency_profiles(hist: DataFrame, weights: DataFrame, known: DataFrame, decay: float) -> DataFrame:
    """As ``mean_profiles``, with weight decay^(entries after it) over the known entries, normalised to sum 1."""
    entries = hist.join(known.select("news_id"), "news_id", "left_semi")
    after = F.row_number().over(Window.partitionBy("impression_id").orderBy(F.desc("place"))) - 1
    entries = entries.withColumn("_d", F.pow(F.lit(decay), after))
    total = entries.groupBy("impression_id").agg(F.sum("_d").alias("_t"))
    sums = entries.join(weights, "news_id").groupBy("impression_id", "term").agg(F.sum(F.col("_d") * F.col("weight")).alias("_s"))
    return sums.join(total, "impression_id").select("impression_id", "term", rounded(F.col("_s") / F.col("_t"), PLACES).alias("weight"))


#: Impressions whose histories and candidates are scored by one task at a time.
IMPRESSION_BLOCK = 500


def _similarities(block: pa.Table) -> pa.Table:
    """Cosines of candidates and mean histories of a block of impressions; entries of history have side 0, candidates side 1."""
    block = block.combine_chunks()
    column = lambda name: block.column(name).chunk(0) if block.column(name).num_chunks else pa.array([], block.schema.field(name).type)
    named = column("impression_id").dictionary_encode()
    imp, names = named.indices.to_numpy(), named.dictionary
    side, often = column("side").to_numpy(), column("m").to_numpy().astype(float)
    sizes = pc.list_value_length(column("terms")).to_numpy()
    row = np.repeat(np.arange(len(imp)), sizes)
    term = column("terms").flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    weight = column("weights").flatten().to_numpy()
    key = imp[row].astype(np.int64) * (int(term.max(initial=0)) + 1) + term
    read = side[row] == 0
    known = np.bincount(imp[side == 0], often[side == 0], minlength=len(names))
    own, at = np.unique(key[read], return_inverse=True)
    of = np.zeros(len(own), np.int64)
    of[at] = imp[row[read]]
    profile = whole(np.bincount(at, often[row[read]] * weight[read], minlength=len(own)) / known[of], PLACES) if len(own) else np.array([], float)
    norm = np.sqrt(np.bincount(of, profile * profile, minlength=len(names)))
    asked = np.flatnonzero(~read)
    place = np.searchsorted(own, key[asked])
    met = place < len(own)
    met[met] = own[place[met]] == key[asked][met]
    dots = np.bincount(row[asked[met]], profile[place[met]] * weight[asked[met]], minlength=len(imp))
    length = norm[imp]
    score = np.where(length > 0, whole(dots / np.where(length > 0, length, 1.0), 6), 0.0)
    out = side == 1
    kept = block.filter(pa.array(out))
    return pa.table({"impression_id": kept.column("impression_id"), "news_id": kept.column("news_id"), "score": score[out]})


def history_similarity(rows: DataFrame, weights: DataFrame, known: DataFrame) -> DataFrame:
    """(impression_id, news_id, score): the cosine of each known candidate and the mean vector of the known history entries, which count as often as they are there.

    ``rows`` hold impression_id, history and candidates. Every article's vector
    is one row; it meets the entries by id, and entries are gathered in blocks of
    impressions, where dot products are taken. No term is a join key.
    """
    pairs = F.array_sort(F.collect_list(F.struct("term", "weight")))
    vector = known.select("news_id").join(weights.groupBy("news_id").agg(pairs.alias("v")), "news_id", "left")
    empty = F.array().cast("array<struct<term:string,weight:double>>")
    vector = vector.withColumn("v", F.coalesce("v", empty)).select("news_id", F.transform("v", lambda x: x.term).alias("terms"), F.transform("v", lambda x: x.weight).alias("weights"))
    read = rows.select("impression_id", F.lit(0).alias("side"), F.explode("history").alias("news_id")).groupBy("impression_id", "side", "news_id").agg(F.count(F.lit(1)).alias("m"))
    shown = rows.select("impression_id", F.lit(1).alias("side"), F.explode(F.array_distinct(F.transform("candidates", lambda c: c.news_id))).alias("news_id"), F.lit(1).cast("bigint").alias("m"))
    entries = read.unionByName(shown).join(vector, "news_id")
    blocks = max(1, -(-rows.count() // IMPRESSION_BLOCK))
    keyed = entries.withColumn("_b", F.pmod(F.xxhash64("impression_id"), F.lit(blocks)))
    return keyed.groupBy("_b").applyInArrow(_similarities, "impression_id string, news_id string, score double")


def first_seen(cand: DataFrame) -> DataFrame:
    """(news_id, first_us): the first impression that shows an article."""
    return cand.groupBy("news_id").agg(F.min("ts_us").alias("first_us"))
