"""Retrieval from the whole catalog under as-of eligibility: exact cosine with popularity as the fallback.

An article is eligible for a query if it has metadata and was shown as a
candidate no later than the query's time; articles of the reader's history are
left out. All eligible articles are ranked, also those that share no term with
the profile, by score, then by the time they were first shown, then by id. A
query without a usable profile is ranked by clicks instead.

The queries are a stated set. They meet the catalog in blocks: every pair of a
query block and an article block is one group of a cogrouped map, which holds
``CELLS`` scores at a time. Scores are bounded first: the terms of many articles
by a matrix product in single precision, the others by their postings; whoever
can be among the k best within the error of that is scored again in double
precision. k articles are returned per query. Nothing is collected or broadcast
but the vocabulary, and what a group holds doesn't grow with either side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.operators import feed, text
from presslake.session import StagedTable, release, spread

#: Queries and articles that meet in one group at most, scores that it holds at a time, and impressions whose profiles are made at a time.
QUERY_BLOCK, ARTICLE_BLOCK, CELLS, PROFILE_BLOCK = 20_000, 120_000, 4_000_000, 2_000
#: Articles of a group that are indexed at a time.
INDEX = 25_000
#: Terms of more than 1/COMMON of a block's articles are scored by a matrix product, at most MOST_COMMON of them.
COMMON, MOST_COMMON = 40, 384
#: Scores are rounded to this many places before they are ranked.
PLACES = 6
RECALL_CUTOFFS, NDCG_CUTOFFS = (10, 20, 50, 100), (10, 20, 100)


def availability(rows: DataFrame) -> DataFrame:
    """(news_id, first_us): when an article was first shown, over the impressions of all partitions."""
    return feed.candidates(rows, ("ts_us",)).filter("news_id IS NOT NULL").groupBy("news_id").agg(F.min("ts_us").alias("first_us"))


def static_catalog(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """(news_id): articles with metadata that the given impressions show, whenever they do."""
    return feed.candidates(rows, ()).select("news_id").distinct().join(articles.select("news_id"), "news_id", "left_semi")


def queries(rows: DataFrame, articles: DataFrame, first_seen: DataFrame) -> DataFrame:
    """One row per impression: history, its clicked targets by their state, and the time asked.

    targets (with repeats), available (in news and eligible at the time; repeats
    kept), n_unavailable, n_missing (without metadata).
    """
    target = feed.candidates(rows, ("ts_us",)).filter("label = 1").select("impression_id", "ts_us", "position", "news_id")
    known = target.join(articles.select("news_id", F.lit(True).alias("known")), "news_id", "left").join(first_seen, "news_id", "left")
    available = F.col("known").isNotNull() & (F.col("first_us") <= F.col("ts_us"))
    states = known.groupBy("impression_id").agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.array_sort(F.collect_list(F.when(available, F.struct("position", "news_id")))).alias("_a"),
        F.count_if(F.col("known").isNotNull() & ~F.coalesce(available, F.lit(False))).alias("n_unavailable"),
        F.count_if(F.col("known").isNull()).alias("n_missing"),
    )
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    out = rows.select("impression_id", "part", "user_id", "ts_us", "history").join(states, "impression_id", "left")
    return out.select(
        "impression_id", "part", "user_id", "ts_us", "history", count("n_targets"),
        F.coalesce(F.transform("_a", lambda x: x.news_id), F.array().cast("array<string>")).alias("available"), count("n_unavailable"), count("n_missing"),
    )


def _ways(size: np.ndarray, configurations: list[tuple[int | None, float | None]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every configuration (history length, decay) the entries it takes of histories of the given sizes, and the first configuration that takes the same with the same shares."""
    taken = [size if n is None else np.minimum(size, max(n, 1)) for n, _ in configurations]
    owner = []
    for j, (_, decay) in enumerate(configurations):
        own = np.full(len(size), j)
        for i in range(j - 1, -1, -1):
            same = (taken[i] == taken[j]) & ((taken[j] <= 1) | (configurations[i][1] == decay))
            own = np.where(same, i, own)
        owner.append(own)
    return taken, owner


def _profiles_of_block(configurations: list[tuple[int | None, float | None]]):
    """Profiles of a block of impressions, whose history entries come as rows with the vectors of those that are known."""

    def profile(block: pa.Table) -> pa.Table:
        block = block.sort_by([("impression_id", "ascending"), ("place", "ascending")])
        ids = block.column("impression_id").combine_chunks()
        ids = (ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)).dictionary_encode()
        imp, n_imp = ids.indices.to_numpy(), len(ids.dictionary)
        place = pc.fill_null(block.column("place"), -1).to_numpy()
        known = pc.is_valid(block.column("terms")).to_numpy() & (place >= 0)
        size = np.zeros(n_imp, np.int64)
        size[imp] = block.column("size").to_numpy()
        lengths, term = text.flat(block.column("terms"))
        weight = text.as_weights(text.flat(block.column("weights"))[1])
        entry = np.repeat(np.arange(len(imp)), lengths)
        span = int(term.max(initial=0)) + 1
        keys, at = np.unique(imp[entry].astype(np.int64) * span + term, return_inverse=True)
        of, code = keys // span, (keys % span).astype(np.int32)
        seen = np.bincount(imp, known, minlength=n_imp)
        after = seen[imp] - np.cumsum(known) + np.concatenate([[0], np.cumsum(seen)])[:-1][imp]  # known entries after one
        taken, owner = _ways(size, configurations)
        out = []
        for j, (_, decay) in enumerate(configurations):
            mine = owner[j] == j
            if not mine.any():
                continue
            used = known & mine[imp] & (place >= size[imp] - taken[j][imp])
            share = np.where(used, 1.0 if decay is None else float(decay) ** after, 0.0)
            n_known, total = np.bincount(imp, used, minlength=n_imp).astype(np.int64), np.bincount(imp, share, minlength=n_imp)
            sums = np.bincount(at, share[entry] * weight, minlength=len(keys)) / np.where(total > 0, total, 1.0)[of]
            value = np.sign(sums) * np.floor(np.abs(sums) * 10.0**text.PLACES + 0.5)  # in whole multiples of 10^-PLACES
            kept = np.flatnonzero(value)
            counts = np.bincount(of[kept], minlength=n_imp)
            who = np.flatnonzero(mine)
            offsets = np.concatenate([[0], np.cumsum(counts[who])]).astype(np.int32)
            kept = kept[mine[of[kept]]]
            ways = [[c for c in range(len(configurations)) if owner[c][i] == j] for i in who]
            reason = np.where(size[who] == 0, "empty_history", np.where(n_known[who] == 0, "no_known_history", np.where(counts[who] == 0, "all_zero_profile", "")))
            out.append(pa.table({
                "impression_id": ids.dictionary.take(pa.array(who)), "ways": pa.array(ways, pa.list_(pa.int32())),
                "terms": pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[kept])), "weights": pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[kept].astype(np.int32))),
                "n_known": n_known[who], "n_unknown": taken[j][who] - n_known[who], "reason": pc.if_else(pa.array(reason != ""), pa.array(reason, pa.string()), pa.scalar(None, pa.string())),
            }))
        return pa.concat_tables(out)

    return profile


def profiles(asked: DataFrame, vectors: DataFrame, configurations: list[tuple[int | None, float | None]]) -> DataFrame:
    """A profile of every query under every (history length, decay): (impression_id, ways, terms, weights, n_known, n_unknown, reason).

    The last ``length`` history entries (all for None), each as often as it is
    there; known are those in ``vectors``. Without ``decay`` the mean of their
    vectors, with it the mean weighted by decay^(known entries after it).
    Configurations that take the same entries with the same shares have one row;
    ``ways`` are their places in the list. ``reason`` is why there is no profile:
    empty_history, no_known_history or all_zero_profile; else NULL.
    """
    entries = asked.select("impression_id", F.size("history").cast("bigint").alias("size"), F.posexplode_outer("history").alias("place", "news_id"))
    entries = entries.join(vectors, "news_id", "left").select("impression_id", "size", "place", "terms", "weights")
    blocks = max(1, -(-asked.count() // PROFILE_BLOCK))
    schema = "impression_id string, ways array<int>, terms array<int>, weights array<int>, n_known bigint, n_unknown bigint, reason string"
    return entries.groupBy(F.pmod(F.xxhash64("impression_id"), F.lit(blocks)).alias("_b")).applyInArrow(_profiles_of_block(configurations), schema)


class _Index:
    """Articles in the order of ties, with their terms both ways round."""

    def __init__(self, a: pa.Table):
        self.first, self.n = a.column("first_us").to_numpy(), len(a)
        clicks = a.column("clicks").to_numpy()
        self.clicks, self.by_clicks = clicks, np.argsort(-clicks, kind="stable")
        self.sizes, self.terms = text.flat(a.column("terms"))
        self.weights = text.as_weights(text.flat(a.column("weights"))[1])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.signed = bool((self.weights < 0).any())
        span = int(self.terms.max(initial=0)) + 1
        df = np.bincount(self.terms, minlength=span)
        common = np.flatnonzero(df * COMMON > self.n)
        common = common[np.argsort(-df[common], kind="stable")[:MOST_COMMON]]
        self.place = np.full(span, -1, np.int64)  # row of the matrix, -1: by postings, -2: in no article
        self.place[df == 0] = -2
        self.place[common] = np.arange(len(common))
        own = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)
        row = self.place[self.terms]
        dense = row >= 0
        self.matrix = np.zeros((len(common), self.n), np.float32)
        self.matrix[row[dense], own[dense]] = self.weights[dense]
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.articles, self.values = own[rare].astype(np.int64), self.weights[rare].astype(np.float32)
        self.begin = np.searchsorted(self.terms[rare], np.arange(span + 1))

    def bounded(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Scores of n queries, whose terms are given, in single precision."""
        place = np.where(term < len(self.place), self.place[np.minimum(term, len(self.place) - 1)], -2)
        q = np.zeros((n, len(self.matrix)), np.float32)
        dense, rare = place >= 0, np.flatnonzero(place == -1)
        q[row[dense], place[dense]] = weight[dense]
        scores = q @ self.matrix
        flat_scores = scores.reshape(-1)
        for part in np.array_split(rare, max(1, len(rare) // 1_024)):
            begin, size = self.begin[term[part]], self.begin[term[part] + 1] - self.begin[term[part]]
            at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            np.add.at(flat_scores, self.articles[at] + np.repeat(row[part] * self.n, size), self.values[at] * np.repeat(weight[part].astype(np.float32), size))
        return scores

    def exact(self, which: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Products of the given articles' vectors and a query that has a place for every term."""
        size = self.sizes[which]
        at = np.arange(size.sum()) + np.repeat(self.starts[which] - np.cumsum(size) + size, size)
        return np.bincount(np.repeat(np.arange(len(which)), size), self.weights[at] * query[self.terms[at]], minlength=len(which))


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.sign(scores) * np.floor(np.abs(scores) * 10.0**PLACES + 0.5) / 10.0**PLACES


def _clicked(index: _Index, n: int, read: np.ndarray, k: int) -> np.ndarray:
    """The k most clicked of the first n articles but ``read``."""
    found, at = np.array([], np.int64), 0
    while len(found) < k and at < index.n:
        step = index.by_clicks[at : at + 16 * k]
        found = np.concatenate([found, step[(step < n) & ~np.isin(step, read)]])
        at += len(step)
    return found[:k]


def _best(index: _Index, scores: np.ndarray, n: int, k: int, error: float, least: float) -> np.ndarray:
    """Who can be among the k best of the first n articles, by scores with at most that error; those that are left out hold -inf. ``least`` is the k-th best of earlier articles."""
    step = max(1, n // max(16 * k, 4_096))
    some = scores[:n:step]
    if len(some) > k:  # the k-th best of a part is not above the k-th best of all
        least = max(least, np.partition(some, len(some) - k)[len(some) - k])
    margin = 2 * error + 10.0**-PLACES  # scores that are rounded to the same place are tied
    maybe = np.flatnonzero(scores[:n] >= least - margin) if least - margin > 0 or index.signed else np.flatnonzero(scores[:n] > 0)
    if len(maybe) > k:
        own = scores[maybe]
        least = max(least, np.partition(own, len(own) - k)[len(own) - k])
        maybe = maybe[own >= least - margin]
    if least - margin <= 0 and not index.signed:  # with the first of those that share no term
        none = np.flatnonzero(scores[:n] == 0)[:k]
        maybe = np.union1d(maybe, none)
    return maybe[np.isfinite(scores[maybe])]


def _block(k: int, exclude_history: bool):
    """The k best of a block of articles for each of a block of queries."""

    def search(key, q: pa.Table, a: pa.Table) -> pa.Table:
        a = a.sort_by([("first_us", "ascending"), ("news_id", "ascending")])
        ids = pa.concat_arrays(a.column("news_id").chunks) if len(a) else pa.array([], pa.string())
        first, n_q = a.column("first_us").to_numpy(), len(q)
        until = np.searchsorted(first, q.column("ts_us").to_numpy(), "right") if n_q else np.array([], np.int64)
        sizes, terms = text.flat(q.column("terms"))
        weights = text.as_weights(text.flat(q.column("weights"))[1])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        row = np.repeat(np.arange(n_q), sizes)
        norm = np.sqrt(np.bincount(row, weights * weights, minlength=n_q))
        norm = np.where(norm > 0, norm, 1.0)
        history_sizes, read_ids = text.flat(q.column("history"))
        read_at = pc.fill_null(pc.index_in(pa.array(read_ids, pa.string()), value_set=ids), -1).to_numpy()
        read_starts = np.concatenate([[0], np.cumsum(history_sizes)])
        by_clicks = pc.is_valid(q.column("reason")).to_numpy() if n_q else np.array([], bool)
        reads = [np.unique(x[(x >= 0) & (x < n)]) for n, x in zip(until, (read_at[read_starts[i] : read_starts[i + 1]] for i in range(n_q)))]
        aways = reads if exclude_history else [x[:0] for x in reads]
        found, score = [np.array([], np.int64)] * n_q, [np.array([])] * n_q
        for low in range(0, len(a), INDEX):
            index = _Index(a.slice(low, INDEX))
            query = np.zeros(max(int(index.terms.max(initial=0)), int(terms.max(initial=0))) + 1)
            wide = max(1, CELLS // index.n)
            for at in range(0, n_q, wide):
                end = min(at + wide, n_q)
                if not (until[at:end] > low).any():
                    continue
                mine = slice(starts[at], starts[end])
                bound = index.bounded(row[mine] - at, terms[mine], weights[mine] / norm[row[mine]], end - at)
                for i in range(at, end):
                    n = min(int(until[i]) - low, index.n)
                    if n <= 0:
                        continue
                    away = aways[i][(aways[i] >= low) & (aways[i] < low + n)] - low
                    if by_clicks[i]:
                        which = _clicked(index, n, away, k)
                        own = index.clicks[which]
                    else:
                        scores = bound[i - at]
                        scores[away] = -np.inf
                        which = _best(index, scores, n, k, (sizes[i] + 4) * 2.0**-23, score[i][-1] if len(score[i]) == k else -np.inf)
                        span = slice(starts[i], starts[i + 1])
                        query[terms[span]] = weights[span]
                        own = _rounded(index.exact(which, query) / norm[i])
                        query[terms[span]] = 0.0
                    which, own = np.concatenate([found[i], which + low]), np.concatenate([score[i], own])
                    order = np.lexsort((which, -own))[:k]
                    found[i], score[i] = which[order], own[order]
        eligible = until - np.array([len(x) for x in aways], np.int64)
        seen = [np.isin(x, read) for x, read in zip(found, reads)]
        which = np.concatenate(found) if found else np.array([], np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
        lists = lambda values: pa.ListArray.from_arrays(offsets, values)
        flat_of = lambda parts, kind: np.concatenate(parts) if parts else np.array([], kind)
        return pa.table({
            **{c: q.column(c) for c in ("impression_id", "ways", "n_known", "n_unknown", "reason")}, "n_eligible": eligible, "ids": lists(ids.take(pa.array(which))),
            "scores": lists(pa.array(flat_of(score, float).astype(np.float64))), "first": lists(pa.array(first[which] if len(first) else np.array([], np.int64))), "seen": lists(pa.array(flat_of(seen, bool).astype(bool))),
        })

    return search


def listed(
    names: list[str], asked: DataFrame, profile: DataFrame, vectors: DataFrame, first_seen: DataFrame, clicks: DataFrame, k: int, exclude_history: bool = True
) -> DataFrame:
    """The ``k`` best eligible articles of every query and profile: (impression_id, configurations, n_known, n_unknown, catalog_size, fallback_reason, ids, scores, seen), the lists in the order of ranks.

    ``profile`` has the names' places in ``ways``; ``configurations`` are those names.
    """
    catalog = StagedTable(vectors.join(first_seen, "news_id").join(clicks, "news_id", "left").select("news_id", "first_us", F.coalesce("clicks", F.lit(0)).cast("double").alias("clicks"), "terms", "weights"))
    rows = StagedTable(asked.select("impression_id", "ts_us", "history").join(profile, "impression_id"))
    spark = asked.sparkSession
    release(spark)
    n_q, n_a = rows.read().count(), catalog.read().count()
    a_blocks = max(1, -(-n_a // ARTICLE_BLOCK))
    q_blocks = max(1, -(-n_q // QUERY_BLOCK), min(-(-n_q // 200), -(-2 * spark.sparkContext.defaultParallelism // a_blocks)))
    keys = F.array(*[F.lit(key).cast("bigint") for key in spread(spark, q_blocks * a_blocks)])
    mine = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = F.get(keys, F.col("qb") * a_blocks + F.col("ab")).alias("g")
    q = rows.read().withColumn("qb", mine(q_blocks, "impression_id", "ways")).withColumn("ab", every(a_blocks)).select(group, "impression_id", "ways", "ts_us", "history", "terms", "weights", "n_known", "n_unknown", "reason")
    a = catalog.read().withColumn("ab", mine(a_blocks, "news_id")).withColumn("qb", every(q_blocks)).select(group, "news_id", "first_us", "clicks", "terms", "weights")
    schema = "impression_id string, ways array<int>, n_known bigint, n_unknown bigint, reason string, n_eligible bigint, ids array<string>, scores array<double>, first array<bigint>, seen array<boolean>"
    found = q.groupBy("g").cogroup(a.groupBy("g")).applyInArrow(_block(k, exclude_history), schema)
    if a_blocks > 1:
        zipped = F.arrays_zip(F.transform("scores", lambda x: -x).alias("s"), "first", "ids", "seen")
        merged = found.select("impression_id", "ways", "n_known", "n_unknown", "reason", "n_eligible", zipped.alias("z")).groupBy("impression_id", "ways").agg(
            F.first("n_known").alias("n_known"), F.first("n_unknown").alias("n_unknown"), F.first("reason").alias("reason"), F.sum("n_eligible").alias("n_eligible"), F.slice(F.array_sort(F.flatten(F.collect_list("z"))), 1, k).alias("z")
        )
        found = merged.select("impression_id", "ways", "n_known", "n_unknown", "reason", "n_eligible", F.transform("z", lambda x: x.ids).alias("ids"), F.transform("z", lambda x: 0.0 - x.s).alias("scores"), F.transform("z", lambda x: x.seen).alias("seen"))
    reason = F.coalesce("reason", F.when(F.col("n_eligible") == 0, "no_eligible_articles"))
    named = F.transform("ways", lambda w: F.get(F.array(*[F.lit(n) for n in names]), w))
    return StagedTable(found.select("impression_id", "ways", "n_known", "n_unknown", F.col("n_eligible").alias("catalog_size"), reason.alias("fallback_reason"), "ids", "scores", "seen")).read().withColumn("configurations", named)


def ranks_of(lists: DataFrame) -> DataFrame:
    """(configuration, impression_id, retrieved_rank, retrieved_news_id, score, was_in_history)."""
    each = lists.select(F.explode("configurations").alias("configuration"), "impression_id", F.posexplode(F.arrays_zip("ids", "scores", "seen")).alias("at", "x"))
    return each.select("configuration", "impression_id", (F.col("at") + 1).cast("bigint").alias("retrieved_rank"), F.col("x.ids").alias("retrieved_news_id"), F.col("x.scores").alias("score"), F.col("x.seen").alias("was_in_history"))


def summary_of(lists: DataFrame) -> DataFrame:
    """(configuration, impression_id, catalog_size, n_known, n_unknown, fallback_used, fallback_reason)."""
    return lists.select(F.explode("configurations").alias("configuration"), "impression_id", "catalog_size", "n_known", "n_unknown", F.col("fallback_reason").isNotNull().alias("fallback_used"), "fallback_reason")


def violations(found: DataFrame, asked: DataFrame, articles: DataFrame, first_seen: DataFrame) -> DataFrame:
    """What a valid result has none of, in one row: repeated, ineligible and already read articles, and ranks that aren't 1, 2, 3, ..."""
    per = found.groupBy("configuration", "impression_id").agg(
        (F.count(F.lit(1)) - F.count_distinct("retrieved_news_id")).alias("repeated"), ((F.max("retrieved_rank") != F.count(F.lit(1))) | (F.min("retrieved_rank") != 1)).alias("gap")
    )
    first = articles.select("news_id").join(first_seen, "news_id").select(F.col("news_id").alias("retrieved_news_id"), "first_us")
    each = found.join(first, "retrieved_news_id", "left").join(asked.select("impression_id", "ts_us", "history"), "impression_id", "left")
    bad = each.agg(
        F.count(F.lit(1)).alias("n_retrieved"),
        F.count_if(F.coalesce(F.col("first_us") > F.col("ts_us"), F.lit(True))).alias("n_ineligible"),
        F.count_if(F.array_contains("history", F.col("retrieved_news_id"))).alias("n_in_history"),
    )
    wrong = per.agg(F.coalesce(F.sum("repeated"), F.lit(0)).alias("n_repeated"), F.count_if("gap").alias("n_rank_gaps"))
    return bad.crossJoin(F.broadcast(wrong))  # single rows


def _gain(rank: Column) -> Column:
    return F.lit(math.log(2.0)) / F.log(rank + 1.0)


def metrics(found: DataFrame, summary: DataFrame, asked: DataFrame, n_catalog: int) -> DataFrame:
    """``list_metrics`` of results that come as rows (see ``ranks_of`` and ``summary_of``)."""
    ranked = F.array_sort(F.collect_list(F.struct("retrieved_rank", "retrieved_news_id", "was_in_history")))
    per = found.groupBy("configuration", "impression_id").agg(ranked.alias("z"))
    field = lambda c: F.transform("z", lambda x: x[c])
    lists = summary.join(per, ["configuration", "impression_id"], "left").select(
        F.array("configuration").alias("configurations"), "impression_id", "n_known", "n_unknown", "catalog_size", "fallback_reason",
        *[F.coalesce(field(c), F.array().cast(f"array<{kind}>")).alias(name) for name, c, kind in (("ids", "retrieved_news_id", "string"), ("seen", "was_in_history", "boolean"))],
    )
    return list_metrics(lists, asked, n_catalog)


def list_metrics(lists: DataFrame, asked: DataFrame, n_catalog: int) -> DataFrame:
    """One row per configuration: macro means over the queries with an available target, and counts over all queries.

    A target that an impression lists twice counts once in the metrics and
    twice in the availability rate, as delivered. NDCG has binary gains.
    """
    ideal = [0.0]
    for r in range(1, max(NDCG_CUTOFFS) + 1):
        ideal.append(ideal[-1] + math.log(2.0) / math.log(r + 1.0))
    targets = asked.select("impression_id", F.array_distinct("available").alias("t"), F.size("available").cast("bigint").alias("n_available"), "n_targets", "n_unavailable", "n_missing")
    each = lists.join(targets, "impression_id").withColumn("valid", F.size("t") > 0)
    place = F.sort_array(F.filter(F.transform("t", lambda x: F.array_position("ids", x)), lambda r: r > 0))
    each = each.withColumn("hits", F.when(F.col("valid"), place))
    within = lambda c: F.filter("hits", lambda r: r <= c)
    q = each.select(
        F.explode("configurations").alias("configuration"), "t", "valid", "n_available", "n_targets", "n_unavailable", "n_missing", "n_known", "n_unknown", "catalog_size", F.col("fallback_reason").isNotNull().alias("fallback_used"),
        F.when(F.col("valid"), F.size("ids").cast("bigint")).alias("n_retrieved"), F.when(F.col("valid"), F.size(F.filter("seen", lambda x: x)).cast("bigint")).alias("n_read"), F.get(within(100), 0).alias("best"),
        *[F.when(F.col("valid"), F.size(within(c))).alias(f"h{c}") for c in RECALL_CUTOFFS], *[F.aggregate(within(c), F.lit(0.0), lambda s, r: s + _gain(r)).alias(f"g{c}") for c in NDCG_CUTOFFS],
    )
    n = F.size("t")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    mean = lambda c: F.round(F.avg(F.when(F.col("valid"), c)), 6)
    best_of = lambda c: F.get(F.array(*[F.lit(x) for x in ideal[: c + 1]]), F.least(n, F.lit(c)))
    valid_sum = lambda c: F.sum(F.when(F.col("valid"), c).otherwise(0))
    out = q.groupBy("configuration").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if("valid").alias("n_valid_queries"),
        F.count_if(F.col("n_targets") == 0).alias("n_no_clicked_target"),
        F.count_if((F.col("n_targets") > 0) & ~F.col("valid")).alias("n_no_available_target"),
        *[mean(count(f"h{c}") / n).alias(f"recall_{c}") for c in RECALL_CUTOFFS],
        *[mean((count(f"h{c}") > 0).cast("double")).alias(f"hit_rate_{c}") for c in RECALL_CUTOFFS],
        mean(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr_100"),
        *[mean(F.coalesce(f"g{c}", F.lit(0.0)) / best_of(c)).alias(f"ndcg_{c}") for c in NDCG_CUTOFFS],
        mean(F.col("catalog_size")).alias("mean_catalog_size"),
        F.median(F.when(F.col("valid"), F.col("catalog_size"))).alias("median_catalog_size"),
        F.round(F.sum("n_available") / F.nullif(F.sum(F.col("n_available") + F.col("n_unavailable")), F.lit(0)), 6).alias("target_availability_rate"),
        mean(F.col("fallback_used").cast("double")).alias("fallback_rate"),
        F.round(valid_sum(count("n_read")) / F.nullif(valid_sum(count("n_retrieved")), F.lit(0)), 6).alias("retrieved_history_rate"),
        mean(F.col("n_known")).alias("mean_known_history"),
        valid_sum(F.col("n_unknown")).alias("n_unknown_history"),
        F.sum("n_missing").alias("n_missing_targets"),
    )
    shown = each.filter("valid").select(F.explode("configurations").alias("configuration"), "ids").select("configuration", F.explode("ids").alias("news_id")).distinct()
    unique = shown.groupBy("configuration").agg(F.count(F.lit(1)).alias("unique_recommendations"))
    out = out.join(unique, "configuration", "left").withColumn("unique_recommendations", count("unique_recommendations").cast("bigint"))
    return out.withColumn("catalog_coverage", F.round(F.col("unique_recommendations") / F.lit(float(n_catalog)), 6))
