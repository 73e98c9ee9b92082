"""Dense article vectors from TF-IDF by truncated singular value decomposition, and dense reader profiles.

Subspace iteration over blocks of articles: the basis is a table of one k-vector
per term. A pass brings every block the vectors of its own terms, multiplies its
rows with them and their transpose with the result, and adds up one k-vector per
term and block. Only the k x k matrix of inner products reaches the driver, from
which the factors that make the basis orthonormal follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.operators import text
from presslake.session import StagedTable, cut, numbered, release, spread

PASSES = 5
#: Articles of a block, and postings that are multiplied at a time.
BLOCK, POSTINGS = 40_000, 200_000


def dense_articles(weights: DataFrame, fit_ids: DataFrame, dimensions: int) -> DataFrame:
    """``dense_vectors`` of long (news_id, term, weight)."""
    terms = numbered(weights.select("term").distinct().orderBy("term"), "code")
    pairs = F.array_sort(F.collect_list(F.struct("code", "weight")))
    lists = weights.join(terms, "term").groupBy("news_id").agg(pairs.alias("v"))
    return dense_vectors(lists.select("news_id", F.transform("v", lambda x: x.code).alias("terms"), F.transform("v", lambda x: x.weight).alias("weights")), terms, fit_ids, dimensions)


def dense_vectors(vectors: DataFrame, vocabulary: DataFrame, fit_ids: DataFrame, dimensions: int) -> DataFrame:
    """(news_id, embedding): every article's (news_id, terms, weights) times the leading right singular vectors of the fit rows, unit length.

    The iteration begins with hashes of the vocabulary's (term, code) terms, so that it doesn't depend on the codes.

    Dimensions are capped to the shape. Articles without a known term get the zero vector.
    """
    spark = vectors.sparkSession
    fit = _Blocks(vectors.join(fit_ids, "news_id", "left_semi").filter("size(terms) > 0"))
    terms = vocabulary.join(fit.terms.read().select(F.col("term").alias("code")), "code", "left_semi")
    k = max(1, min(dimensions, terms.count(), fit.rows.read().count()))
    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.xxhash64("term", i), F.lit(1_000_003)) / 500_001.0 - 1.0)
    basis = _orthonormal(terms.withColumn("v", start).select(F.col("code").alias("term"), "v"), "term", k)
    for _ in range(PASSES):
        sums = fit.times(basis, _transposed(k), "term int, v array<double>").groupBy("term").agg(*[F.sum(F.get("v", i)).alias(f"s{i}") for i in range(k)])
        basis = _orthonormal(sums.select("term", F.array(*[f"s{i}" for i in range(k)]).alias("v")), "term", k)
        release(spark)
    every = _Blocks(vectors)
    out = StagedTable(every.times(basis, _projected(k), "news_id string, embedding array<double>")).read()
    release(spark)
    return out


class _Blocks:
    """Articles in blocks, and the terms of each block."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        whole = StagedTable(vectors.select("news_id", "terms", "weights")).read()
        n = whole.count()
        blocks = max(1, -(-n // BLOCK), min(spark.sparkContext.defaultParallelism, -(-n // 500)))
        keys = F.array(*[F.lit(key).cast("bigint") for key in spread(spark, blocks)])
        self.rows = StagedTable(whole.withColumn("g", F.get(keys, F.pmod(F.xxhash64("news_id"), F.lit(blocks)).cast("int"))))
        self.terms = StagedTable(self.rows.read().select("g", F.explode("terms").alias("term")).distinct())

    def times(self, basis: DataFrame, product, schema: str) -> DataFrame:
        """``product`` of every block's rows and the vectors of its terms."""
        own = self.terms.read().join(basis, "term")
        return self.rows.read().groupBy("g").cogroup(own.groupBy("g")).applyInArrow(product, schema)


def _multiplied(rows: pa.Table, basis: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' products with the basis; the terms of the basis; row, place in the basis and weight of every posting that has one."""
    codes = basis.column("term").to_numpy()
    order = np.argsort(codes)
    codes, v = codes[order], _vectors(pa.concat_arrays(basis.column("v").chunks), k)[order] if len(basis) else np.zeros((0, k))
    sizes, terms = text.flat(rows.column("terms"))
    row, weight = np.repeat(np.arange(len(sizes)), sizes), text.as_weights(text.flat(rows.column("weights"))[1])
    at = np.searchsorted(codes, terms)
    met = at < len(codes)
    met[met] = codes[at[met]] == terms[met]
    row, at, weight = row[met], at[met], weight[met]
    return _segmented(row, at, weight, v, len(rows)), codes, row, at, weight


def _segmented(to: np.ndarray, source: np.ndarray, weight: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Sums of weight times v[source] by ``to``, which is in order."""
    out = np.zeros((n, v.shape[1]))
    for begin in range(0, len(to), POSTINGS):
        here = slice(begin, begin + POSTINGS)
        own = to[here]
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[edge]] += np.add.reduceat(v[source[here]] * weight[here, None], edge, axis=0)
    return out


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _transposed(k: int):
    def product(key, rows: pa.Table, basis: pa.Table) -> pa.Table:
        by_article, codes, row, at, weight = _multiplied(rows, basis, k)
        order = np.argsort(at, kind="stable")
        return pa.table({"term": pa.array(codes.astype(np.int32)), "v": _lists(_segmented(at[order], row[order], weight[order], by_article, len(codes)))})

    return product


def _projected(k: int):
    def product(key, rows: pa.Table, basis: pa.Table) -> pa.Table:
        made = _multiplied(rows, basis, k)[0]
        norm = np.sqrt((made**2).sum(axis=1))[:, None]
        return pa.table({"news_id": rows.column("news_id"), "embedding": _lists(np.where(norm > 1e-12, made / np.where(norm > 1e-12, norm, 1.0), 0.0))})

    return product


def _vectors(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _orthonormal(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``rows`` (key, v) times the k x k matrix that makes the columns orthonormal; columns beyond the rank become zero."""
    rows = cut(rows)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            m = _vectors(batch.column(0), k)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["i", "x"])

    cells = rows.select("v").mapInArrow(inner, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()  # k x k rows
    gram = np.zeros(k * k)
    gram[cells["i"].to_numpy()] = cells["x"].to_numpy()
    values, directions = np.linalg.eigh(gram.reshape(k, k))
    scale = np.where(values > max(values.max(initial=0.0), 1e-300) * 1e-14, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    factor = directions * scale

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _vectors(batch.column(1), k) @ factor
            offsets = pa.array(np.arange(0, m.size + 1, k), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], names=[key, "v"])

    return cut(rows.select(key, "v").mapInArrow(times, f"{key} int, v array<double>"))


def dense_profiles(hist: DataFrame, articles: DataFrame) -> DataFrame:
    """(impression_id, embedding): the unit-length mean vector of the known history entries; duplicates count."""
    sums = hist.join(articles, "news_id").select("impression_id", F.posexplode("embedding").alias("d", "x")).groupBy("impression_id", "d").agg(F.avg("x").alias("x"))
    mean = sums.groupBy("impression_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s.x).alias("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return mean.withColumn("_n", norm).filter("_n > 1e-12").select("impression_id", F.transform("embedding", lambda x: x / F.col("_n")).alias("embedding"))
