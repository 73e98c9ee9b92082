"""Dense vectors: normalisation, exact top-K by inner product, and an inverted-file approximation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.operators import text
from presslake.session import StagedTable, spread


def normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vector`` scaled to unit length; norms up to 1e-12 become zero vectors, flagged in ``is_zero``."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    out = df.withColumn("_n", norm)
    scaled = F.transform(vector, lambda x: F.when(F.col("_n") > 1e-12, x.cast("double") / F.col("_n")).otherwise(0.0))
    return out.withColumns({vector: scaled, "is_zero": F.col("_n") <= 1e-12}).drop("_n")


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


#: Products that one group holds at a time (32 MB), for blocks of queries and base.
CELLS = 4_000_000


def _best_of_block(k: int, places: int):
    """The ``k`` best of a block of the base for each query of a block."""

    def best(key, q: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(q) or not len(b):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()))})
        b = b.sort_by("vec_id")  # ties go to the smaller id
        ids, own = q.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        dots = np.round(_matrix(q.column("embedding").combine_chunks()) @ _matrix(b.column("embedding").combine_chunks()).T, places)
        dots[ids[:, None] == own[None, :]] = -np.inf
        kept = np.isfinite(dots)
        if len(own) > k:
            least = np.partition(dots, -k, axis=1)[:, -k][:, None]
            above, tied = dots > least, (dots == least) & kept
            kept &= above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        row, column = np.nonzero(kept)
        return pa.table({"query_id": ids[row], "vec_id": own[column], "score": dots[row, column]})

    return best


def top_k(queries: DataFrame, base: DataFrame, k: int, places: int = 6, block: int = 2_000) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` most similar vectors of every query, itself excluded; ties to the smaller id.

    ``queries`` and ``base`` hold (vec_id, embedding) of unit length. The
    queries are a stated set. Blocks of ``block`` queries meet blocks of the base
    in cogrouped maps of at most CELLS products, which keep k rows per query; the
    driver sees only the two row counts.
    """
    wide = max(1, CELLS // block)
    n_q, n_b = max(1, -(-queries.count() // block)), max(1, -(-base.count() // wide))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = queries.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", mine(n_q).alias("qb"), every(n_b).alias("bb"))
    b = base.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", mine(n_b).alias("bb"), every(n_q).alias("qb"))
    found = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(_best_of_block(k, places), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def cells(base: DataFrame, n_cells: int, sample: int = 50_000, seed: int = 42):
    """An inverted file: centroids by k-means on at most ``sample`` rows; every row is assigned to its cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = base.select("vec_id", "embedding", array_to_vector("embedding").alias("features"))
    n = points.count()
    fitting = points if n <= sample else points.sample(sample / n, seed)
    model = KMeans(k=n_cells, seed=seed, maxIter=15, featuresCol="features", predictionCol="cell").fit(fitting)
    return model, model.transform(points).select("vec_id", "embedding", "cell")


#: A cell is spread over so many tasks, as one may hold a large share of the vectors.
SALTS = 8


def pairs_in_cells(queries: DataFrame, assigned: DataFrame, model, probes: int, places: int = 6) -> DataFrame:
    """(query_id, vec_id, score): every query with the vectors of the ``probes`` cells whose centres are nearest."""
    centres = np.array(model.clusterCenters())

    @F.pandas_udf("array<int>")
    def nearest(v):
        import pandas as pd

        m = np.stack(v.to_numpy())
        d = (m**2).sum(axis=1)[:, None] - 2 * m @ centres.T + (centres**2).sum(axis=1)[None, :]
        return pd.Series(np.argsort(d, axis=1, kind="stable")[:, :probes].tolist())

    visits = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode(nearest("embedding")).alias("cell"))
    visits = visits.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = assigned.withColumn("_z", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return visits.join(salted, ["cell", "_z"]).select("query_id", "vec_id", F.round(dot, places).alias("score"))


def top_k_in_cells(queries: DataFrame, assigned: DataFrame, model, k: int, probes: int, places: int = 6) -> DataFrame:
    """Approximate ``top_k``: each query visits the ``probes`` cells whose centres are nearest."""
    pairs = pairs_in_cells(queries, assigned, model, probes, places).filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


#: Vectors of a base that one task holds beside its queries; a larger base is searched by pairs. Queries of a task at most.
BASE_BLOCK, QUERY_BLOCK = 400_000, 20_000


def eligible_search_in_cells(queries: DataFrame, asked: DataFrame, assigned: DataFrame, model, first_seen: DataFrame, k: int, ways: list[tuple[int, int]], places: int = 6) -> DataFrame:
    """``eligible_search`` of the queries in the cells they visit, for every (probes, oversampling) of ``ways`` at once.

    One row per query and way: (query_id, probes, oversampling, ids, scores) and
    the diagnostics; ``ids`` in the order of ranks. Blocks of queries meet the
    whole base in cogrouped maps, which count places instead of sorting; pairs
    never leave them.
    """
    base = StagedTable(assigned.join(first_seen.select(F.col("news_id").alias("vec_id"), "first_us"), "vec_id", "left"))
    q = StagedTable(queries.select(F.col("vec_id").alias("query_id"), "embedding").join(asked.select(F.col("impression_id").alias("query_id"), "ts_us", "history"), "query_id"))
    if base.read().count() > BASE_BLOCK:
        return _by_pairs(q.read(), asked, assigned, model, first_seen, k, ways, places)
    n, spark = q.read().count(), queries.sparkSession
    blocks = max(1, -(-n // QUERY_BLOCK), min(spark.sparkContext.defaultParallelism, -(-n // 100)))
    keys = F.array(*[F.lit(key).cast("bigint") for key in spread(spark, blocks)])
    left = q.read().withColumn("g", F.get(keys, F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
    right = base.read().withColumn("g", F.explode(keys))
    counts = ", ".join(f"{c} bigint" for c in COSTS)
    found = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_eligible_of_block(np.array(model.clusterCenters()), k, ways, places), f"query_id string, probes int, oversampling int, ids array<string>, scores array<double>, {counts}")
    return found.withColumns(_FLAGS(k))


COSTS = ["search_calls", "requested", "examined", "rejected_unavailable", "rejected_history", "n_found", "n_eligible"]


def _FLAGS(k: int) -> dict[str, Column]:  # noqa: N802
    return {"unfilled": (F.col("n_found") < k) & (F.col("n_found") < F.col("n_eligible")), "oversampled": F.col("requested") > k}


def _by_pairs(q: DataFrame, asked: DataFrame, assigned: DataFrame, model, first_seen: DataFrame, k: int, ways: list[tuple[int, int]], places: int) -> DataFrame:
    out = []
    for probes, oversampling in ways:
        pairs = pairs_in_cells(q.withColumnRenamed("query_id", "vec_id"), assigned, model, probes, places)
        found, costs = eligible_search(pairs, asked, first_seen, k, oversampling)
        lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("z"))
        none = F.array()
        lists = lists.select("query_id", F.transform("z", lambda x: x.vec_id).alias("ids"), F.transform("z", lambda x: x.score).alias("scores"))
        row = costs.join(lists, "query_id", "left").withColumns({"probes": F.lit(probes), "oversampling": F.lit(oversampling), "ids": F.coalesce("ids", none.cast("array<string>")), "scores": F.coalesce("scores", none.cast("array<double>"))})
        out.append(row.select("query_id", "probes", "oversampling", "ids", "scores", *COSTS, "unfilled", "oversampled"))
    return reduce(DataFrame.unionByName, out)


def _eligible_of_block(centres: np.ndarray, k: int, ways: list[tuple[int, int]], places: int):
    """The search of a block of queries; scores are whole numbers of 10^-places."""

    def first_of(scores: np.ndarray, depth: int) -> np.ndarray:
        """Which belong to the first ``depth`` by score, then by place."""
        if depth >= len(scores):
            return np.ones(len(scores), bool)
        least = np.partition(scores, len(scores) - depth)[len(scores) - depth]
        inside = scores > least
        tied = np.flatnonzero(scores == least)
        inside[tied[: depth - np.count_nonzero(inside)]] = True
        return inside

    def search(key, q: pa.Table, b: pa.Table) -> pa.Table:
        rows: dict[str, list] = {c: [] for c in ["query", "probes", "oversampling", *COSTS]}
        which, score = [], []
        b = b.sort_by("vec_id")  # ties go to the smaller id
        ids = pa.concat_arrays(b.column("vec_id").chunks) if len(b) else pa.array([], pa.string())
        if len(q) and len(b):
            m, cell = _matrix(pa.concat_arrays(b.column("embedding").chunks)), b.column("cell").to_numpy()
            first = pc.fill_null(b.column("first_us"), np.iinfo(np.int64).max).to_numpy()
            v = _matrix(pa.concat_arrays(q.column("embedding").chunks))
            distance = (v**2).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres**2).sum(axis=1)[None, :]
            turn = np.argsort(np.argsort(distance, axis=1, kind="stable"), axis=1, kind="stable")  # when a query visits a cell
            ts, (sizes, names) = q.column("ts_us").to_numpy(), text.flat(q.column("history"))
            of = np.concatenate([[0], np.cumsum(sizes)])
            read_at = pc.fill_null(pc.index_in(pa.array(names, pa.string()), value_set=ids), -1).to_numpy()
            wide = max(1, CELLS // len(b))
            for at in range(0, len(v), wide):
                keys = np.rint(v[at : at + wide] @ m.T * 10.0**places).astype(np.int32)
                for i in range(at, min(at + wide, len(v))):
                    late = first > ts[i]
                    read = np.zeros(len(b), bool)
                    own = read_at[of[i] : of[i + 1]]
                    read[own[own >= 0]] = True
                    read &= ~late
                    fits = ~(late | read)
                    visited = turn[i][cell]
                    for probes in dict.fromkeys(p for p, _ in ways):
                        seen = np.flatnonzero(visited < probes)
                        if not len(seen):
                            continue
                        own, late_, read_, fits_ = keys[i - at][seen], late[seen], read[seen], fits[seen]
                        good = np.flatnonzero(fits_)
                        best = good[first_of(own[good], k)]
                        best = best[np.lexsort((best, -own[best]))]
                        n = len(seen)
                        needed = n if len(best) < k else int(np.count_nonzero(own > own[best[-1]]) + np.count_nonzero(own[: best[-1] + 1] == own[best[-1]]))
                        for oversampling in (o for p, o in ways if p == probes):
                            depth, calls = min(n, k * max(1, oversampling)), 1
                            while depth < needed:
                                depth, calls = depth * 2, calls + 1
                            depth = min(n, depth)
                            inside = first_of(own, depth)
                            row = (i, probes, oversampling, calls, depth, depth, np.count_nonzero(late_ & inside), np.count_nonzero(read_ & inside), len(best), len(good))
                            for c, x in zip(rows, row):
                                rows[c].append(x)
                            which.append(seen[best])
                            score.append(own[best] / 10.0**places)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in which])]).astype(np.int32))
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.array([], kind)
        return pa.table({
            "query_id": q.column("query_id").take(pa.array(rows["query"], pa.int64())), "probes": pa.array(rows["probes"], pa.int32()), "oversampling": pa.array(rows["oversampling"], pa.int32()),
            "ids": pa.ListArray.from_arrays(offsets, ids.take(pa.array(flat(which, np.int64)))), "scores": pa.ListArray.from_arrays(offsets, pa.array(flat(score, np.float64))), **{c: pa.array(rows[c], pa.int64()) for c in COSTS},
        })

    return search


def eligible_search(pairs: DataFrame, asked: DataFrame, first_seen: DataFrame, k: int, oversampling: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best eligible of scored pairs, as an index that can't filter finds them, and what it cost.

    The index is asked for ``k * oversampling`` results, in the order of score and
    id, of which those that weren't shown yet at the query's time or are in the
    reader's history are dropped; while fewer than ``k`` are left the depth is
    doubled. The depth a query ends with follows from the place of its k-th
    eligible result, so that all queries are searched at once.

    Found: (query_id, rank, vec_id, score); diagnostics per query: calls,
    requested and examined results, what was rejected and why, and whether less
    than k were found although more were eligible.
    """
    more = pairs.join(first_seen.select(F.col("news_id").alias("vec_id"), "first_us"), "vec_id", "left").join(asked.select(F.col("impression_id").alias("query_id"), "ts_us", "history"), "query_id")
    late = F.coalesce(F.col("first_us") > F.col("ts_us"), F.lit(True))
    read = F.array_contains("history", F.col("vec_id"))
    own = Window.partitionBy("query_id")
    order = own.orderBy(F.desc("score"), "vec_id")
    raw = more.select("query_id", "vec_id", "score", late.alias("late"), (~late & read).alias("read"), F.row_number().over(order).alias("place"))
    raw = raw.withColumn("fits", (~F.col("late") & ~F.col("read")).cast("int"))
    raw = raw.withColumn("rank", F.sum("fits").over(own.orderBy("place")))
    last = F.min(F.when((F.col("fits") == 1) & (F.col("rank") == k), F.col("place"))).over(own)
    raw = raw.withColumns({"n": F.count(F.lit(1)).over(own), "eligible": F.sum("fits").over(own), "needed": F.coalesce(last, F.count(F.lit(1)).over(own))})
    start = F.least(F.col("n"), F.lit(k * max(1, oversampling)))
    doublings = F.greatest(F.ceil(F.log2(F.col("needed") / start)), F.lit(0))
    raw = raw.withColumns({"calls": (doublings + 1).cast("bigint"), "depth": F.least(F.col("n"), (start * F.pow(F.lit(2), doublings)).cast("bigint"))})
    found = raw.filter("fits = 1 AND place <= depth").filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "score")
    inside = F.col("place") <= F.col("depth")
    count = lambda c: F.count_if(inside & c)
    costs = raw.groupBy("query_id").agg(
        F.max("calls").alias("search_calls"),
        F.max("depth").alias("requested"),
        count(F.lit(True)).alias("examined"),
        count(F.col("late")).alias("rejected_unavailable"),
        count(F.col("read")).alias("rejected_history"),
        F.least(count(F.col("fits") == 1), F.lit(k)).alias("n_found"),
        F.max("eligible").cast("bigint").alias("n_eligible"),
    )
    return found, costs.withColumns(_FLAGS(k))


def _displacement(common: Column, a: Column, b: Column) -> Column:
    """How far the common ids lie apart in two arrays, in all."""
    return F.aggregate(common, F.lit(0.0), lambda s, x: s + F.abs(F.array_position(a, x) - F.array_position(b, x)))


def agreements(exact: DataFrame, approximate: DataFrame, cutoffs: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """Per query, of (query_id, rank, vec_id): overlap, set recall, Jaccard and mean displacement of common results at every cutoff, and equality of the lists."""
    longest = max(cutoffs)
    lists = lambda df, name: df.filter(F.col("rank") <= longest).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x.vec_id).alias(name))
    both = lists(exact, "a").join(lists(approximate, "b"), "query_id", "left").withColumn("b", F.coalesce("b", F.filter("a", lambda x: F.lit(False))))
    out = [
        F.get("a", 0).eqNullSafe(F.get("b", 0)).cast("double").alias("top1_agreement"),
        (F.col("a") == F.col("b")).cast("double").alias("ordered_list_agreement"),
        (F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size("a"), F.size("b")) - 1), lambda i: ~F.get("a", i).eqNullSafe(F.get("b", i))), 0) + 1).cast("bigint").alias("first_differing_rank"),
    ]
    for c in cutoffs:
        a, b = F.slice("a", 1, c), F.slice("b", 1, c)
        common = F.array_intersect(a, b)
        moved = _displacement(common, a, b)
        out += [
            F.size(common).cast("bigint").alias(f"overlap_{c}"),
            F.round(F.size(common) / F.size(a), 6).alias(f"set_recall_{c}"),
            F.round(F.size(common) / F.size(F.array_union(a, b)), 6).alias(f"jaccard_{c}"),
            F.round(moved / F.nullif(F.size(common), F.lit(0)), 6).alias(f"mean_displacement_{c}"),
        ]
    return both.select("query_id", *out)


def mean_agreement(per_query: DataFrame) -> DataFrame:
    """The means of all agreement columns, NULLs left out, in one row."""
    columns = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in columns])


def agreement(exact: DataFrame, approximate: DataFrame, cutoff: int) -> DataFrame:
    """Per query: overlap, set recall, Jaccard, equal first result and first differing rank at a cutoff."""
    lists = lambda df, name: df.filter(F.col("rank") <= cutoff).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias(name))
    both = lists(exact, "a").join(lists(approximate, "b"), "query_id", "left")
    a = F.transform("a", lambda x: x.vec_id)
    b = F.coalesce(F.transform("b", lambda x: x.vec_id), F.array().cast("array<bigint>"))
    both = both.select("query_id", a.alias("a"), b.alias("b"))
    overlap = F.size(F.array_intersect("a", "b"))
    longest = F.greatest(F.size("a"), F.size("b"))
    differing = F.filter(F.sequence(F.lit(0), longest - 1), lambda i: ~F.get("a", i).eqNullSafe(F.get("b", i)))
    return both.select(
        "query_id",
        overlap.cast("bigint").alias("overlap"),
        F.round(overlap / F.size("a"), 6).alias("set_recall"),
        F.round(overlap / F.size(F.array_union("a", "b")), 6).alias("jaccard"),
        F.coalesce(F.get("a", 0).eqNullSafe(F.get("b", 0)), F.lit(False)).alias("same_first"),
        (F.get(differing, 0) + 1).cast("bigint").alias("first_differing_rank"),
    )
