import itertools
import math
import random

import numpy as np
import pytest

from presslake.llm import pairs, terms, topn


def plain_top(rows, n):
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s) and math.isfinite(s):
            best[g, i] = max(best.get((g, i), -math.inf), s)
    out = []
    for g in {g for g, _ in best}:
        out += [(g, i) for _, i in sorted((-s, i) for (h, i), s in best.items() if h == g)[:n]]
    return sorted(out)


def top(spark, rows, n=3):
    schema = "g string, i int, s double, r int, band int, have int"
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    return sorted((r.g, r.i) for r in topn.top_n(df, "g", "s", "i", n).collect())


def test_top_n_ties_dirt_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", k, 0.5) for k in range(9, -1, -1)] + [("a", 3, 0.5)] * 4 + [("b", 1, nan), ("b", 2, inf), ("b", 3, None), ("b", None, 1.0), (None, 1, 1.0), ("c", 2, 0.0), ("c", 1, -0.0), ("c", 7, -5.0), ("c", 8, -6.0)]
    rows += [("d", 5, 0.1), ("d", 5, 0.9), ("d", 6, 0.4)]
    assert top(spark, rows) == plain_top(rows, 3) == [("a", 0), ("a", 1), ("a", 2), ("c", 1), ("c", 2), ("c", 7), ("d", 5), ("d", 6)]


def test_top_n_hot_group_and_empty(spark):
    rng = random.Random(3)
    rows = [("hot", k, rng.choice([0.1, 0.2, 0.9, rng.random()])) for k in range(3000)] + [(f"g{k % 400}", k, rng.randint(0, 4) / 4) for k in range(4000)]
    assert top(spark, rows, 5) == plain_top(rows, 5)
    assert top(spark, []) == []


BASKETS = "r string, a array<string>, b array<string>, w int, x string"


def test_pairs_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = []
    for k in range(300):
        items = [f"i{min(int(rng.expovariate(0.08)), 60)}" for _ in range(rng.randint(0, 6))]
        rows.append((f"r{k}", [*items, "hot", None], ["hot"] if k % 2 else None, 1, "x"))
    rows += rows[:50] + [("empty", None, None, 1, "x"), (None, ["i1", "i2"], None, 1, "x"), ("two", ["i1"], None, 1, "x"), ("two", ["i2"], None, 1, "x")]
    got = {(r.item_a, r.item_b): (r.n_both, r.lift) for r in pairs.pair_scores(spark.createDataFrame(rows, BASKETS), "r", [F.col("a"), F.col("b")], 2, 3).collect()}
    records = {}
    for r, a, b, *_ in rows:
        if r is not None:
            records.setdefault(r, set()).update(x for x in (a or []) + (b or []) if x)
    n, single, both = len(records), {}, {}
    for items in records.values():
        for x in items:
            single[x] = single.get(x, 0) + 1
        for p in itertools.combinations(sorted(items), 2):
            both[p] = both.get(p, 0) + 1
    want = {p: c for p, c in both.items() if c >= 2 and c * n >= 3 * single[p[0]] * single[p[1]]}
    assert {p: c for p, (c, _) in got.items()} == want and want
    for (a, b), (c, lift) in got.items():
        assert lift == pytest.approx(c * n / single[a] / single[b])


def test_pairs_of_nothing(spark):
    from pyspark.sql import functions as F

    assert pairs.pair_scores(spark.createDataFrame([], BASKETS), "r", [F.col("a")], 1, 1).count() == 0


NEWS = "news_id string, source_split string, source_row_number bigint, title string, abstract string, category string, k string, t string, term string"


def test_terms(spark):
    texts = ["title", "abstract", "category"]
    rows = [("A", "dev", 1, "old text", None, "x1"), ("A", "train", 9, "The été, the ÉTÉ 12 a", None, "cat"), ("A", "train", 10, "later", "", ""), ("B", "train", 2, "the dog", "", "cat"), ("C", "train", 3, None, None, None), (None, "train", 4, "lost", "", ""), ("B", "train", 2, "the dog", "", "cat")]
    df = spark.createDataFrame([(*r, "q", "r", "s") for r in rows], NEWS)
    articles = terms.first_versions(df, "news_id", "source_split", "source_row_number", texts)
    w = {(r.news_id, r.term): r for r in terms.term_weights(articles, "news_id", texts, k1=None, idf="smooth").collect()}
    assert {k: r.tf for k, r in w.items()} == {("A", "the"): 2, ("A", "été"): 2, ("A", "12"): 1, ("A", "cat"): 1, ("B", "the"): 1, ("B", "dog"): 1, ("B", "cat"): 1}
    assert w["A", "été"].weight == pytest.approx(2 * (math.log(4 / 2) + 1)) and w["B", "cat"].weight == pytest.approx(math.log(4 / 3) + 1)
    best = terms.top_terms(terms.term_weights(articles, "news_id", texts, k1=None, idf="smooth"), "news_id", 2)
    assert sorted((r.news_id, r.term) for r in best.collect()) == [("A", "the"), ("A", "été"), ("B", "cat"), ("B", "dog")]
    okapi = {(r.news_id, r.term): r.weight for r in terms.term_weights(articles, "news_id", texts).collect()}
    length = 1.2 * (0.25 + 0.75 * 6 / 3)
    assert okapi["A", "été"] == pytest.approx(2 * 2.2 / (2 + length) * math.log(1 + 2.5 / 1.5))
    assert terms.term_weights(articles.limit(0), "news_id", texts).count() == 0


def test_top_n_reads_only_what_open_groups_need(spark):
    rows = [(f"g{g}", i, float(1000 - i)) for g in range(20) for i in range(100)] + [("late", 7, -5.0), ("late", 8, -6.0), ("hot", 1, 999.0)] + [("hot", i, 999.0) for i in range(2, 3000)]
    df = spark.createDataFrame(rows, "g string, i int, s double")
    read = []
    got = topn.top_n(df, "g", "s", "i", 3, (0.3, 0.7, 0.9), rows_read=read)
    want = {(f"g{g}", i, float(1000 - i)) for g in range(20) for i in range(3)} | {("late", 7, -5.0), ("late", 8, -6.0)} | {("hot", i, 999.0) for i in (1, 2, 3)}
    rows_ = [tuple(r) for r in got.collect()]
    assert set(rows_) == want and len(rows_) == len(want)
    # The g groups lack one item after the first band and fill in the second; the third has rows of full groups only; of the last the late group's two rows are taken.
    assert read == [(0, 3039), (1, 480), (3, 2)]


def test_top_n_carries_open_groups_over_bands(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{int(g)}", int(i), float(np.round(s, 1))) for g, i, s in zip(rng.integers(0, 60, 1500), rng.integers(0, 12, 1500), rng.normal(size=1500))]
    df = spark.createDataFrame(rows, "g string, i int, s double")
    best = {}
    for g, i, s in rows:
        best[g, i] = max(s, best.get((g, i), s))
    want = set()
    for g in {g for g, _ in best}:
        want |= {(g, i, s) for s, i in sorted(((s, i) for (h, i), s in best.items() if h == g), key=lambda x: (-x[0], x[1]))[:5]}
    for most in (100_000, 0):
        topn.MOST_BROADCAST, kept = most, topn.MOST_BROADCAST
        got = [tuple(r) for r in topn.top_n(df, "g", "s", "i", 5, (0.2, 0.4, 0.6, 0.8)).collect()]
        topn.MOST_BROADCAST = kept
        assert set(got) == {(g, i, s + 0.0) for g, i, s in want} and len(got) == len(want)


def test_large_baskets_are_cut_into_chunks(spark):
    """A basket above the limit gives the same pairs, each once, whatever the chunks; rare items leave before."""
    rng = random.Random(5)
    big = [f"i{k:03d}" for k in range(60)]
    rows = [(r, big) for r in range(3)] + [(10 + r, rng.sample(big, 8) + [f"rare{r}"]) for r in range(40)] + [(100 + r, []) for r in range(60)]
    df = spark.createDataFrame(rows, "r int, items array<string>")
    got = {}
    for large, chunk, share in ((2_000, 500, 1.0), (20, 7, 0.0)):
        kept = pairs.LARGE, pairs.CHUNK, pairs.RARE_SHARE
        pairs.LARGE, pairs.CHUNK, pairs.RARE_SHARE = large, chunk, share
        got[large] = sorted((x.item_a, x.item_b, x.n_both) for x in pairs.pair_scores(df, "r", [df["items"]], 3, 1).collect())
        pairs.LARGE, pairs.CHUNK, pairs.RARE_SHARE = kept
    counts = {}
    for _, items in rows:
        for pair in itertools.combinations(sorted(set(items)), 2):
            counts[pair] = counts.get(pair, 0) + 1
    single = {x: sum(x in i for _, i in rows) for x in big}
    want = sorted((a, b, n) for (a, b), n in counts.items() if n >= 3 and n * len(rows) >= single[a] * single[b])
    assert got[2_000] == got[20] == want and len(want) > 500
