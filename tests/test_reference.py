"""Hand-computed values of the feed-evaluation operators."""

import math
from datetime import UTC, datetime

import pytest

from presslake.operators import dense, feed, features, monitoring, ranking, text
from presslake.sources import files

HOUR = 3_600_000_000


def scored(spark, rows):
    return spark.createDataFrame(rows, "impression_id string, part string, position int, label int, score double")


def metrics(spark, rows):
    return {r.impression_id: r for r in ranking.impression_metrics(scored(spark, rows)).collect()}


def test_metric_values(spark):
    m = metrics(spark, [("a", "p", 0, 1, 0.2), ("a", "p", 1, 0, 0.9), ("a", "p", 2, 1, 0.1)])["a"]
    assert m.mrr == 0.5 and m.recall_5 == 1 and m.auc == 0
    assert m.ndcg_5 == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))


def test_ties_and_skips(spark):
    nan = float("nan")
    rows = [("t", "p", 0, 0, 1.0), ("t", "p", 1, 1, 1.0), ("u", "p", 0, None, 1.0), ("n", "p", 0, 1, nan), ("m", "p", 0, 1, None), ("o", "p", 0, 0, 1.0)]
    m = metrics(spark, rows)
    assert m["t"].mrr == 0.5 and m["t"].auc == 0.5
    assert [m[k].skipped for k in "unmo"] == ["unlabeled_impression", "non_finite_score", "missing_score", None]
    assert m["o"].auc is None and m["o"].mrr == 0 and m["o"].ndcg_10 == 0
    total = ranking.macro_metrics(ranking.impression_metrics(scored(spark, rows))).first()
    assert (total.n_impressions, total.n_evaluated, total.n_unlabeled, total.n_auc) == (5, 2, 1, 1)


def cand(spark, rows):
    return spark.createDataFrame(rows, "impression_id string, ordinal bigint, ts_us bigint, position int, news_id string, label int")


def test_decay_and_popularity(spark):
    fit = cand(spark, [("1", 1, 0, 0, "A", 1), ("2", 2, 24 * HOUR, 0, "B", 1), ("2", 2, 24 * HOUR, 1, "C", 0)])
    assert {r.news_id: r.decayed for r in ranking.decayed_clicks(fit, 24.0).collect()} == {"A": 0.5, "B": 1.0}
    got = {r.news_id: r.score for r in ranking.by_popularity(fit, fit).collect()}
    assert got == {"A": 1.0, "B": 1.0, "C": 0.0}


def test_prior_clicks_never_see_the_present(spark):
    def state(first_label):
        c = cand(spark, [("1", 1, 0, 0, "A", first_label), ("1", 1, 0, 1, "A", 1), ("2", 2, 0, 0, "A", 1), ("3", 3, 24 * HOUR, 0, "A", 0), ("4", 4, 9000 * HOUR, 0, "A", 0)])
        out = features.prior_decayed_clicks(features.prior_clicks(c), 24.0)
        return {(r.impression_id, r.position): (r.prior_clicks, r.prior_decayed) for r in out.collect()}

    clicked, unclicked = state(1), state(0)
    assert clicked["1", 0] == clicked["1", 1] == unclicked["1", 0] == (0, 0.0)
    assert clicked["2", 0] == (2, 2.0) and unclicked["2", 0] == (1, 1.0)
    assert clicked["3", 0] == (3, 1.5) and clicked["4", 0] == (3, 0.0)


def behaviors(spark, n):
    at = datetime(2020, 1, 1, tzinfo=UTC)
    schema = "impression_id string, user_id string, timestamp timestamp, source_split string, source_row_number bigint, history array<string>, impressions array<struct<position:int,news_id:string,clicked:tinyint>>, ingested_at timestamp"
    return spark.createDataFrame([(str(k), "U", at, "train", k, ["N1", "N2"], [(0, "N1", 1), (1, "N2", 0)], at) for k in range(n)], schema)


def test_tied_times_split_by_row_number(spark):
    parts = {int(r.impression_id): r.part for r in feed.partitioned(feed.impressions(behaviors(spark, 20))).collect()}
    assert [list(parts.values()).count(p) for p in ("train", "validation", "test")] == [14, 3, 3]
    assert all(parts[k] == "train" for k in range(14)) and parts[19] == "test"
    with pytest.raises(ValueError):
        feed.partitioned(feed.impressions(behaviors(spark, 3)), 0.9, 0.2)


def test_category_affinity_counts_repeats(spark):
    articles = spark.createDataFrame([("N1", "s", "f"), ("N2", "s", ""), ("N3", "", "")], "news_id string, category string, subcategory string")
    hist = spark.createDataFrame([("1", 0, "N1"), ("1", 1, "N1"), ("1", 2, "N2"), ("1", 3, "gone")], "impression_id string, place int, news_id string")
    c = cand(spark, [("1", 1, 0, 0, "N1", 1), ("1", 1, 0, 1, "N2", 0), ("1", 1, 0, 2, "N3", 0), ("2", 2, 0, 0, "N1", 0)])
    got = {(r.impression_id, r.news_id): r.score for r in ranking.by_category_affinity(c, hist, articles).collect()}
    assert got == {("1", "N1"): 4.0, ("1", "N2"): 3.5, ("1", "N3"): 0.5, ("2", "N1"): 0.0}


def test_smooth_idf(spark):
    articles = spark.createDataFrame([("A", "x été", ""), ("B", "x x", ""), ("C", "", "")], "news_id string, title string, abstract string")
    w = {(r.news_id, r.term): r.weight for r in text.tfidf(articles.replace("x été", "xx été").replace("x x", "xx xx"), articles.select("news_id")).collect()}
    idf = math.log(3 / 2) + 1
    assert w["A", "été"] == pytest.approx(idf / math.hypot(1, idf), abs=1e-8) and w["B", "xx"] == 1.0


def shares(spark, d):
    return spark.createDataFrame(list(d.items()) or [], "key string, share double")


def test_drift_bounds(spark):
    jsd = lambda a, b: monitoring.jensen_shannon(shares(spark, a), shares(spark, b)).first().jsd
    assert jsd({"a": 0.5, "b": 0.5}, {"a": 0.5, "b": 0.5}) == 0
    assert jsd({"a": 1.0}, {"b": 1.0}) == 1
    assert jsd({}, {}) == 0
    assert jsd({"a": 0.9, "b": 0.1}, {"b": 1.0}) == jsd({"b": 1.0}, {"a": 0.9, "b": 0.1})


def test_exact_search_is_independent_of_blocks(spark):
    rows = [(k, [math.cos(k), math.sin(k)]) for k in range(60)]
    base = dense.normalised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    few = base.filter("vec_id % 20 = 0")
    a = sorted(map(tuple, dense.top_k(few, base, 5).collect()))
    assert a == sorted(map(tuple, dense.top_k(few, base.repartition(7), 5, block=1).collect()))
    best = {q: v for q, v, s, r in a if r == 1}
    for q in (0, 20, 40):
        assert best[q] == min((k for k in range(60) if k != q), key=lambda k: (-round(math.cos(q - k), 6), k))
    same = dense.agreement(dense.top_k(few, base, 5), dense.top_k(few, base, 5), 5).first()
    assert same.jaccard == 1 and same.first_differing_rank is None and same.same_first


def test_zero_vectors(spark):
    out = dense.normalised(spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id bigint, embedding array<double>")).orderBy("vec_id").collect()
    assert out[0].is_zero and list(out[0].embedding) == [0, 0] and list(out[1].embedding) == pytest.approx([0.6, 0.8])


def test_feed_files(spark, tmp_path):
    (tmp_path / "news.tsv").write_text('N1\tnews\tlocal\t "Local" one \tAbstract\tu\t[]\t[]\nN2\ta\tb\n\t\t\t\t\t\t\t\n')
    lines = files.numbered_lines(spark, str(tmp_path / "news.tsv"), "train")
    rows = files.read_news(lines).orderBy("source_row_number").collect()
    assert [(r.source_row_number, r.error) for r in rows] == [(1, None), (2, "columns"), (3, "id")] and rows[0].title == '"Local" one'
    with pytest.raises(files.FeedError, match="line 2: columns"):
        files.require_valid(files.read_news(lines))
    (tmp_path / "behaviors.tsv").write_text("1\tU1\t11/15/2019 8:00:00 AM\t\tN1-1 N2 A-B-0 BROKEN-x -1 A-\n2\tU1\tnot-a-date\tN1  N2\t\n")
    a, b = files.read_behaviors(files.numbered_lines(spark, str(tmp_path / "behaviors.tsv"), "train")).orderBy("source_row_number").collect()
    assert [tuple(c) for c in a.impressions] == [(0, "N1", 1), (1, "N2", None), (2, "A-B", 0)] and a.malformed_tokens == 3 and a.history == []
    assert a.timestamp == datetime(2019, 11, 15, 8) and b.error == "timestamp" and b.history == ["N1", "N2"]
    assert files.missing_files(spark, str(tmp_path), ["news.tsv", "other.tsv"]) == ["other.tsv"]


def test_request_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"request_id": "r", "latency_ms": 2.5, "top_ranked_category_counts": {"a": 2}}\n\nnot json\n')
    rows = files.read_request_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert sorted((r.request_id, r.broken) for r in rows if r.request_id) == [("r", None)] and [r.broken for r in rows if r.broken] == ["not json"]


def test_streaming_equals_batch(spark, tmp_path):
    from presslake.streaming import telemetry

    rows = [(datetime(2020, 1, 1, h % 5), "a" if h % 2 else "b", float(h)) for h in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = telemetry.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "kind", "value", late="10 hours")
    q = stream.writeStream.format("memory").queryName("telemetry_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("telemetry_test").collect()))
    assert got == sorted(map(tuple, telemetry.windowed(df, "ts", "kind", "value").collect())) and sum(r[2] for r in got) == 40


def test_projection_spans_the_leading_singular_vectors(spark):
    import numpy as np

    from presslake.operators import projection

    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3)) @ np.diag([9.0, 4.0, 2.0]) @ rng.normal(size=(3, 12)) + 0.01 * rng.normal(size=(40, 12))
    rows = [(f"N{i}", f"t{j}", float(x[i, j])) for i in range(40) for j in range(12)] + [("N99", "unknown", 1.0)]
    weights = spark.createDataFrame(rows, "news_id string, term string, weight double")
    fit = spark.createDataFrame([(f"N{i}",) for i in range(40)], "news_id string")
    got = {r.news_id: np.array(r.embedding) for r in projection.dense_articles(weights, fit, 3).collect()}
    right = np.linalg.svd(x)[2][:3]
    want = x @ right.T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    own = np.array([got[f"N{i}"] for i in range(40)])
    assert np.allclose(own @ own.T, want @ want.T, atol=1e-3) and not got["N99"].any()


def test_evaluation_features_know_the_clicks_of_the_fit(spark):
    from pyspark.sql import functions as F

    articles = spark.createDataFrame([("A", "s", "f", "title", "text"), ("B", "s", "f", "title", " ")], "news_id string, category string, subcategory string, title string, abstract string")
    fit = cand(spark, [("1", 1, 0, 0, "A", 1), ("2", 2, 24 * HOUR, 0, "A", 1), ("2", 2, 24 * HOUR, 1, "B", 0)])
    own = cand(spark, [("3", 3, 30 * HOUR, 0, "A", 1), ("3", 3, 30 * HOUR, 1, "B", 1), ("4", 4, 40 * HOUR, 0, "B", 0)]).withColumn("tfidf_history_similarity", F.lit(0.25))
    rows = spark.createDataFrame([("3", ["A"]), ("4", [])], "impression_id string, history array<string>")
    table = lambda **x: {(r.impression_id, r.news_id): (r.global_click_count, r.time_decayed_click_count) for r in features.feature_table(own, rows, articles, articles.select("news_id"), **x).collect()}
    assert table(fit=fit) == {("3", "A"): (2.0, 1.5), ("3", "B"): (0.0, 0.0), ("4", "B"): (0.0, 0.0)}
    assert table()["4", "B"][0] == 1.0 and table()["3", "A"] == (0.0, 0.0)
    assert [r.tfidf_history_similarity for r in features.feature_table(own, rows, articles, articles.select("news_id"), fit=fit).collect()] == [0.25] * 3


def test_rankers_use_all_features(spark):
    rows = [tuple(float((k * 7 + i) % 5) for i in range(len(features.FEATURES))) + (k % 2,) for k in range(40)]
    model = features.fit_ranker(spark.createDataFrame(rows, [*features.FEATURES, "label"]), "boosted")
    assert model.stages[-1].getNumTrees == 50 and len(features.FEATURES) == model.stages[-1].numFeatures == 16


def test_all_baselines_and_half_lives_run(spark, monkeypatch):
    from presslake.plans import reference

    asked = []

    def scored_stub(spark, d, name, fit, on, half_life=24.0):
        asked.append((name, half_life))
        good = name == "time_decayed" and half_life == 72.0
        return scored(spark, [("a", "p", 0, 0, 0.0 if good else 1.0), ("a", "p", 1, 1, 0.5)])

    monkeypatch.setattr(reference, "_scored", scored_stub)
    got = {r.selector: r.name for r in reference.select_baseline(spark, "").collect()}
    assert got == {"strongest": "time_decayed", "reported": "time_decayed"}
    assert {n for n, _ in asked} == set(reference.BASELINES) and {h for n, h in asked if n == "time_decayed"} == {6.0, 24.0, 72.0}


def test_chronology_counts_across_blocks(spark):
    times = [5, 6, 7, 3, 4, 9, 2, 8]  # earlier than the row before: the fourth and the seventh
    rows = [(split, k * step, t) for split, step in (("train", 1), ("dev", 10)) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "source_split string, source_row_number bigint, ts_us bigint")
    for block in (1, 2, 3, 100):
        assert {r.source_split: r.n_violations for r in monitoring.chronology_violations(df, block).collect()} == {"train": 2, "dev": 2}


def test_every_impression_with_known_history_has_a_profile(spark, tmp_path):
    from presslake.plans import reference

    rows = behaviors(spark, 30).replace({"7": "seven"}, subset=["impression_id"])
    rows.write.parquet(str(tmp_path / "behaviors.parquet"))
    news = [("N1", "train", 1, "s", "f", "fair opens", ""), ("N2", "train", 2, "s", "f", "council meets", "")]
    spark.createDataFrame(news, "news_id string, source_split string, source_row_number bigint, category string, subcategory string, title string, abstract string").write.parquet(str(tmp_path / "news.parquet"))
    want = {str(k) for k in range(30) if k != 7} | {"seven"}
    for profile in (reference.profile_mean, reference.profile_recency):
        assert {r.impression_id for r in profile(spark, str(tmp_path)).select("impression_id").distinct().collect()} == want


NEWS_FIXTURE = [
    ("N1", "train", 1, "news", "local", "Local one", "Abstract one"), ("N2", "train", 2, "sports", "football", "Football two", "Abstract two"), ("N3", "train", 3, "finance", "markets", "Markets three", "Abstract three"),
    ("N4", "train", 4, "tech", "ai", "AI four", "Abstract four"), ("N2", "dev", 1, "sports", "football", "Football two duplicate", "Abstract two"), ("N5", "dev", 2, "health", "wellness", "Wellness five", "Abstract five"),
]
BEHAVIORS_FIXTURE = [
    ("1", "U1", 15, 8, "train", 1, "", "N1-1 N2-0"), ("2", "U2", 15, 9, "train", 2, "N1", "N2-1 N3-0"), ("3", "U1", 15, 10, "train", 3, "N1 N2", "N3-0 N4-1"), ("4", "U3", 15, 11, "train", 4, "N2", "N4-0"),
    ("5", "U4", 15, 12, "train", 5, "N1 N3", "N2-1"), ("6", "U5", 16, 8, "dev", 1, "N1 N2", "N5 N2"), ("7", "U6", 16, 9, "dev", 2, "N3", "N1-0 N5-1"),
]


def fixture(spark, tmp_path):
    """The small feed of two deliveries, under its delivered split."""
    from presslake.plans.reference import _Feed

    spark.createDataFrame(NEWS_FIXTURE, "news_id string, source_split string, source_row_number bigint, category string, subcategory string, title string, abstract string").write.parquet(str(tmp_path / "news.parquet"))
    rows = []
    for i, u, day, hour, split, n, history, tokens in BEHAVIORS_FIXTURE:
        own = [(k, t[:2], int(t[3]) if len(t) > 2 else None) for k, t in enumerate(tokens.split())]
        rows.append((i, u, datetime(2019, 11, day, hour, tzinfo=UTC), split, n, history.split(), own, datetime(2019, 11, 17, tzinfo=UTC)))
    schema = "impression_id string, user_id string, timestamp timestamp, source_split string, source_row_number bigint, history array<string>, impressions array<struct<position:int,news_id:string,clicked:tinyint>>, ingested_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "behaviors.parquet"))
    f = _Feed(spark, str(tmp_path))
    f.rows = feed.officially_partitioned(feed.impressions(spark.read.parquet(str(tmp_path / "behaviors.parquet"))))
    return f


def test_official_split_and_integrity(spark, tmp_path):
    f = fixture(spark, tmp_path)
    delivered = spark.read.parquet(str(tmp_path / "behaviors.parquet"))
    assert {r.part: r["count"] for r in f.rows.groupBy("part").count().collect()} == {"train": 4, "validation": 1, "test": 2}
    assert feed.integrity(f.rows, delivered.unionAll(delivered.limit(1))) == {"shared_users": 0, "repeated_impressions": 1}
    moved = f.rows.unionByName(f.rows.filter("part = 'test'").replace("test", "train", subset=["part"]))
    with pytest.raises(ValueError, match="impressions are in several partitions"):
        feed.integrity(moved, delivered)
    with pytest.raises(ValueError, match="validation is empty"):
        feed.integrity(f.rows.filter("part <> 'validation'"), delivered)
    with pytest.raises(ValueError):
        feed.officially_partitioned(feed.impressions(delivered.filter("source_split = 'train'")))


@pytest.mark.parametrize("blocks", [(1_000, 4_000), (1, 2)])
def test_golden_retrieval_order(spark, tmp_path, monkeypatch, blocks):
    """Chosen on validation among the mean and the decay of one half, refitted, and run on test."""
    from presslake.operators import retrieval, selection
    from presslake.plans import retrieval as plans

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(retrieval, "ARTICLE_BLOCK", blocks[1])
    f = fixture(spark, tmp_path)
    grid = plans.grid(("title",), (10,), (None, 0.5))
    runs = plans.evaluate(plans.Catalog(f, ("train",)), f.rows.filter("part = 'validation'"), grid, 20).withColumnRenamed("configuration", "name")
    chosen = selection.EXACT_RETRIEVAL.choose(runs).first().name
    assert chosen == max(grid)  # both find the target, so the larger name wins
    order = {}
    for part, fit in (("validation", ("train",)), ("test", ("train", "validation"))):
        found, _, asked = (catalog := plans.Catalog(f, fit)).search(f.rows.filter(f"part = '{part}'"), {chosen: grid[chosen]}, 20)
        for r in found.orderBy("impression_id", "retrieved_rank").collect():
            order.setdefault(r.impression_id, []).append(r.retrieved_news_id)
        wrong = retrieval.violations(found, asked, catalog.articles, catalog.first_seen).first().asDict()
        assert wrong.pop("n_retrieved") == {"validation": 2, "test": 7}[part] and not any(wrong.values())
    assert order == {"5": ["N2", "N4"], "6": ["N3", "N4", "N5"], "7": ["N1", "N2", "N4", "N5"]}


def test_eligibility_fallbacks_and_targets(spark, tmp_path):
    from presslake.operators import retrieval
    from presslake.plans import retrieval as plans

    f = fixture(spark, tmp_path)
    found, summary, asked = (catalog := plans.Catalog(f, ("train",))).search(f.rows, plans.grid(("title",), (10,), (None,)), 20)
    reasons = {r.impression_id: (r.fallback_reason, r.catalog_size) for r in summary.collect()}
    # At 8:00 only the first two articles were shown; the first reader has no history and gets them by clicks. Equal times are eligible.
    assert reasons["1"] == ("empty_history", 2) and reasons["2"] == (None, 2) and reasons["5"] == (None, 2)
    assert [r.retrieved_news_id for r in found.filter("impression_id = '1'").orderBy("retrieved_rank").collect()] == ["N1", "N2"]
    targets = {r.impression_id: (r.n_targets, list(r.available), r.n_unavailable, r.n_missing) for r in asked.collect()}
    assert targets["5"] == (1, ["N2"], 0, 0) and targets["6"] == (0, [], 0, 0)
    m = retrieval.metrics(found, summary, asked, 5).first()
    assert (m.n_queries, m.n_valid_queries, m.n_no_clicked_target, m.n_no_available_target) == (7, 5, 2, 0) and m.retrieved_history_rate == 0
    # The first, second, third, fifth and seventh reader find their target at rank 1, 1, 2, 1 and 4 at the latest.
    ranks = {r.impression_id: r.retrieved_rank for r in found.join(asked, "impression_id").filter("array_contains(available, retrieved_news_id)").collect()}
    assert m.mrr_100 == pytest.approx(sum(1 / r for r in ranks.values()) / 5, abs=1e-6) and m.recall_20 == 1.0
    assert m.ndcg_10 == pytest.approx(sum(1 / math.log2(r + 1) for r in ranks.values()) / 5, abs=1e-6)
    with_history, _, _ = catalog.search(f.rows.filter("impression_id = '5'"), plans.grid(("title",), (10,), (None,)), 20)
    assert with_history.count() == 2


def test_click_state_over_chunks_and_buckets(spark, monkeypatch):
    """Against a plain sum over all earlier clicks, with small chunks, many buckets, ties in time and repeated articles."""
    import random

    rng = random.Random(1)
    at, rows = 0, []
    for o in range(300):
        at += rng.choice([0, 0, HOUR, 7 * HOUR, 300 * HOUR])
        rows += [(str(o), o + 1, at, p, rng.choice("AAAB"), rng.choice([0, 1, None])) for p in range(rng.randint(1, 4))]
    for chunk in (7, 50_000):
        monkeypatch.setattr(features, "CHUNK", chunk)
        got = {(r.impression_id, r.position): (r.prior_clicks, r.prior_decayed) for r in features.click_state(cand(spark, rows), 24.0).collect()}
        assert len(got) == len(rows)
        for i, o, t, p, n, _ in rows:
            before = [u for _, q, u, _, m, label in rows if m == n and q < o and label == 1]
            assert got[i, p][0] == len(before) and got[i, p][1] == pytest.approx(sum(0.5 ** ((t - u) / HOUR / 24) for u in before), abs=2e-9)


def test_heavy_impressions_are_ranked_in_bands(spark, monkeypatch):
    import random

    rng = random.Random(2)
    rows = [("hot", "p", k, rng.choice([0, 1]), rng.choice([rng.random(), 0.5, 0.25])) for k in range(3000)]
    rows += [(f"i{k % 40}", "p", k, rng.choice([0, 1]), rng.random()) for k in range(400)] + [("hot", "p", 3000 + k, 0, x) for k, x in enumerate([float("inf"), -1.0])]
    plain = sorted(map(tuple, ranking._ranks(scored(spark, rows)).collect()))
    monkeypatch.setattr(ranking, "HEAVY", 3)
    banded = ranking._ranks(scored(spark, rows))
    assert sorted(map(tuple, banded.select(*ranking._ranks(scored(spark, rows[:5])).columns).collect())) == plain


def test_serving_in_batch(spark):
    from presslake.operators import serving

    catalog = spark.createDataFrame([("N1", "s", "f"), ("N2", "s", "g"), ("N3", "", "")], "news_id string, category string, subcategory string")
    rows = [
        ("a", ["N1", " N1 ", "X", "X"], ["N2", "N1", "gone", "N3", "gone"]), ("b", [], ["N3", "N2"]), ("c", None, None), ("d", ["N1"], ["N1", " "]), ("e", ["N1"], ["N1"] * 1001), ("f", ["N1"] * 1001, ["N1"]),
    ]
    good, bad = serving.validated(spark.createDataFrame(rows, "request_id string, history array<string>, candidates array<string>"))
    assert {r.request_id: r.reason for r in bad.collect()} == {"c": "no_candidates", "d": "blank_id", "e": "too_many_ids", "f": "too_many_ids"}
    ranked = serving.ranked(good, catalog)
    got = {(r.request_id, r.rank): (r.news_id, r.original_position, r.score) for r in ranked.collect()}
    assert got == {("a", 1): ("N1", 1, 3.0), ("a", 2): ("N2", 0, 2.0), ("a", 3): ("N3", 3, 0.0), ("b", 1): ("N3", 0, 0.0), ("b", 2): ("N2", 1, 0.0)}
    assert [r.news_id for r in serving.ranked(good, catalog, "original_order").filter("request_id = 'a'").orderBy("rank").collect()] == ["N2", "N1", "N3"]
    log = {r.request_id: r for r in serving.request_log(good, catalog, ranked).collect()}
    # A repeated unknown id counts once as unknown, so that its repetition counts as known.
    assert (log["a"].unknown_history_count, log["a"].known_history_count, log["a"].missing_candidate_count, log["a"].ranked_candidate_count) == (1, 3, 2, 3)
    assert log["a"].top_ranked_category_counts == {"s": 2, "<missing>": 1} and log["b"].empty_history
    total = serving.log_summary(serving.request_log(good, catalog, ranked)).first()
    assert (total.request_count, total.missing_candidates, total.unknown_history, total.p50_candidates) == (2, 2, 1, 3.5) and total.missing_candidate_rate == pytest.approx(2 / 7, abs=1e-9)
    with pytest.raises(ValueError):
        serving.ranked(good, catalog, "boosted")


def test_eligible_search_doubles_its_depth(spark):
    pairs = [("q", f"N{k:02d}", 1.0 - k / 100) for k in range(16)] + [("r", "N00", 0.5)]
    asked = spark.createDataFrame([("q", 10, ["N09", "N11"]), ("r", 10, [])], "impression_id string, ts_us bigint, history array<string>")
    # Only the last eight are shown by then, and two of them were read.
    first = spark.createDataFrame([(f"N{k:02d}", 10 if k >= 8 else 11) for k in range(16)], "news_id string, first_us bigint")
    found, costs = dense.eligible_search(spark.createDataFrame(pairs, "query_id string, vec_id string, score double"), asked, first, 2, 2)
    assert [(r.query_id, r.rank, r.vec_id) for r in found.orderBy("query_id", "rank").collect()] == [("q", 1, "N08"), ("q", 2, "N10")]
    c = {r.query_id: r for r in costs.collect()}
    # Asked for 4, 8 and 16 results; the second eligible one is the eleventh.
    assert (c["q"].search_calls, c["q"].requested, c["q"].examined, c["q"].rejected_unavailable, c["q"].rejected_history) == (3, 16, 16, 8, 2)
    assert not c["q"].unfilled and c["q"].oversampled and (c["r"].search_calls, c["r"].n_found, c["r"].unfilled) == (1, 0, False)


def test_agreements_at_cutoffs(spark):
    lists = lambda ids: spark.createDataFrame([("q", k + 1, i) for k, i in enumerate(ids)], "query_id string, rank bigint, vec_id string")
    r = dense.agreements(lists("abcd"), lists("acbx"), (2, 4)).first()
    assert (r.top1_agreement, r.ordered_list_agreement, r.first_differing_rank, r.overlap_2, r.overlap_4) == (1.0, 0.0, 2, 1, 3)
    assert (r.set_recall_4, r.jaccard_4, r.mean_displacement_4, r.mean_displacement_2) == (0.75, 0.6, pytest.approx(2 / 3, abs=1e-6), 0.0)
    none = dense.agreements(lists("ab"), lists("cd"), (2,)).first()
    assert none.overlap_2 == 0 and none.mean_displacement_2 is None and dense.mean_agreement(dense.agreements(lists("ab"), lists("ab"), (2,))).first().jaccard_2 == 1.0


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("".join(f"a{k}\n" for k in range(5000)))
    (tmp_path / "in" / "b.tsv").write_text("".join(f"b{k}\n" for k in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.numbered_lines(spark, str(tmp_path / "in"), "train").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"a{k}" for k in range(5000)] + [f"b{k}" for k in range(20000)]
    assert [r.line for r in sorted(rows, key=lambda r: r.source_row_number)] == want and len({r.source_row_number for r in rows}) == len(want)


def test_feed_timestamps_and_strict_tokens(spark, tmp_path):
    times = ["2019-11-15", "2019-11-15 08:00", "2019-11-15T08:00:00+02:00", "11/15/2019 8:00:00 AM", "2019-11-15T08:00:00.5Z", "15 Nov", "2019-13-01", ""]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, s string").select("k", files.feed_timestamp(F_col("s")).alias("t")).orderBy("k").collect()]
    assert [None if t is None else (t.hour, t.minute, t.microsecond) for t in got] == [(0, 0, 0), (8, 0, 0), (6, 0, 0), (8, 0, 0), (8, 0, 500000), None, None, None]
    (tmp_path / "behaviors.tsv").write_text("1\tU1\t11/15/2019 8:00:00 AM\t\tN1-1\n2\tU1\t11/15/2019 8:00:00 AM\t\tBROKEN-x\n")
    rows = files.read_behaviors(files.numbered_lines(spark, str(tmp_path / "behaviors.tsv"), "train"))
    with pytest.raises(files.FeedError, match="line 2: impressions"):
        files.require_valid(rows)
    with pytest.raises(files.FeedError, match="dev/news.tsv"):
        files.require_layout(spark, str(tmp_path), "official")


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_dataset_round_trip_and_validation(spark, tmp_path):
    from pyspark.sql import functions as F

    from presslake.sources import dataset

    f = fixture(spark, tmp_path)
    delivered = spark.read.parquet(str(tmp_path / "behaviors.parquet"))
    news = spark.read.parquet(str(tmp_path / "news.parquet"))
    for c in dataset.NEWS:
        news = news if c in news.columns else news.withColumn(c, F.lit(""))
    rows = f.rows.withColumn("source_row_hash", F.lit("x"))
    out = str(tmp_path / "prepared")
    metadata = dataset.prepare(spark, news, rows, delivered, out, "official")
    assert metadata["rows"] == {"train": 4, "validation": 1, "test": 2}
    loaded = dataset.load_dataset(spark, out)
    assert loaded.metadata == metadata and loaded.news.count() == 5 and loaded.unknown_history == {"train": 0, "validation": 0, "test": 0}
    assert {r.title for r in loaded.news.filter("news_id = 'N2'").collect()} == {"Football two"}
    assert dataset.load_dataset(spark, out, limit=1).behaviors.groupBy("part").count().filter("count <> 1").count() == 0
    with pytest.raises(files.FeedError, match="have no article"):
        dataset.prepare(spark, news.filter("news_id <> 'N5'"), rows, delivered, str(tmp_path / "other"), "official")
    bad = loaded.behaviors.filter("part = 'test'").drop("part").withColumn("impressions", F.transform("impressions", lambda c: F.struct(F.lit(0).alias("position"), c.news_id.alias("news_id"), c.clicked.alias("clicked"))))
    bad.write.mode("overwrite").parquet(str(tmp_path / "bad.parquet"))
    spark.read.parquet(str(tmp_path / "bad.parquet")).write.mode("overwrite").parquet(f"{out}/test_behaviors.parquet")
    with pytest.raises(files.FeedError, match="positions out of order"):
        dataset.load_dataset(spark, out)
    files.write_catalog(loaded.news, f"{out}/catalog.parquet")
    assert dataset.load_catalog(spark, out, "catalog.parquet").columns == ["news_id", "category", "subcategory"]
    with pytest.raises(files.FeedError, match="leaves the folder"):
        dataset.load_catalog(spark, out, "../catalog.parquet")
    vectors = spark.createDataFrame([("N1", [1.0, 0.0]), ("N2", [0.0, 1.0])], "news_id string, embedding array<double>")
    dataset.save_vectors(vectors, str(tmp_path / "index"), "tfidf")
    assert dataset.load_vectors(spark, str(tmp_path / "index"), "tfidf").count() == 2
    with pytest.raises(files.FeedError):
        dataset.load_vectors(spark, str(tmp_path / "index"), "other")
    assert "| 1 | x |" in dataset.markdown("Runs", [{"place": 1, "name": "x"}])


def test_lost_references_are_counted(spark, tmp_path):
    """Ids without an article in a candidate list and in histories, on planted rows."""
    from presslake.plans import reference

    fixture(spark, tmp_path)
    planted = tmp_path / "planted"
    rows = spark.read.parquet(str(tmp_path / "behaviors.parquet"))
    spark.read.parquet(str(tmp_path / "news.parquet")).filter("news_id NOT IN ('N1', 'N5')").write.parquet(str(planted / "news.parquet"))
    rows.write.parquet(str(planted / "behaviors.parquet"))
    got = {r.side: (r.n_entries, r.n_ids) for r in reference.missing_references(spark, str(planted)).collect()}
    assert got == {"candidate": (4, 2), "history": (4, 1)}
    lost = reference.audit_missing_candidates(spark, str(planted)).first()
    assert (lost.n_entries, lost.n_ids, lost.samples) == (4, 2, "N1 N5")
    with pytest.raises(ValueError, match="not be fitted on test"):
        reference._features(spark, str(planted), "test", ("train", "test"))


def test_streams_append_and_count(spark, tmp_path):
    from presslake.streaming import telemetry

    df = spark.createDataFrame([("N1", 1), ("N1", 0), ("N2", 1), ("N1", 1)], "news_id string, clicked int")
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = telemetry.running_clicks(read()).writeStream.format("memory").queryName("clicks_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.news_id: r.clicks for r in spark.table("clicks_test").collect()} == {"N1": 2, "N2": 1}
    q = telemetry.append_log(read(), str(tmp_path / "log"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def searched(spark, monkeypatch, blocks, signed=False, k=5):
    """A search of random queries and the same by brute force: {query: [(article, score)]} and sizes of the catalog."""
    import numpy as np

    from presslake.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(retrieval, "ARTICLE_BLOCK", blocks[1])
    monkeypatch.setattr(retrieval, "INDEX", 17)
    rng = np.random.default_rng(3)
    weights = {f"N{i:03d}": {int(t): round(float(w), 2) for t, w in zip(rng.choice(60, 6, replace=False) ** 2 // 60, rng.random(6) - 0.5 * signed)} for i in range(150)}
    weights["N007"], weights["N008"] = {}, dict(weights["N009"])  # no term; equal vectors
    first = {n: int(rng.integers(0, 50)) for n in weights if n != "N011"}
    clicks = {"N003": 4, "N004": 4, "N100": 9}
    asked = {f"q{i}": (int(rng.integers(0, 60)), [f"N{int(x):03d}" for x in rng.integers(0, 150, 3)] if i % 4 else []) for i in range(30)}
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    vectors = table([(n, list(sorted(w)), [w[t] for t in sorted(w)]) for n, w in weights.items()], "news_id string, terms array<int>, weights array<double>")
    queries = table([(q, t, h) for q, (t, h) in asked.items()], "impression_id string, ts_us bigint, history array<string>")
    profile = retrieval.profiles(queries, vectors, [(10, None), (25, 0.5)])
    lists = retrieval.listed(["a", "b"], queries, profile, vectors, table(list(first.items()), "news_id string, first_us bigint"), table(list(clicks.items()), "news_id string, clicks bigint"), k)
    want, sizes = {}, {}
    for q, (ts, h) in asked.items():
        catalog = [n for n in first if first[n] <= ts and n not in h]
        sizes[q] = len(catalog)
        for name, decay in (("a", 1.0), ("b", 0.5)):
            share = [decay ** (len(h) - 1 - i) for i in range(len(h))]
            p = {}
            for n, s in zip(h, share):
                for t, w in weights[n].items():
                    p[t] = p.get(t, 0.0) + s * w / sum(share)
            p = {t: round(w, 9) for t, w in p.items() if round(w, 9)}
            norm = math.sqrt(sum(w * w for w in p.values()))
            score = {n: sum(p[t] * w for t, w in weights[n].items() if t in p) / norm if p else float(clicks.get(n, 0)) for n in catalog}
            want[q, name] = [(n, score[n]) for n in sorted(catalog, key=lambda n: (-round(score[n], 6), first[n], n))][:k]
    return lists, want, sizes


@pytest.mark.parametrize("blocks", [(1_000, 4_000), (7, 20)])
@pytest.mark.parametrize("signed", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, blocks, signed):
    """Lists are one row per query and profile, however many blocks there are; the profiles of both configurations are made and searched once where they are equal."""
    lists, want, sizes = searched(spark, monkeypatch, blocks, signed)
    rows = lists.collect()
    assert len(rows) == len({(r.impression_id, tuple(r.configurations)) for r in rows}) and any(len(r.configurations) == 2 for r in rows)
    got = {(r.impression_id, c): r for r in rows for c in r.configurations}
    assert set(got) == set(want)
    for key, found in want.items():
        assert list(got[key].ids) == [n for n, _ in found] and list(got[key].scores) == pytest.approx([s for _, s in found], abs=1e-6) and got[key].catalog_size == sizes[key[0]]
    assert {r.fallback_reason for r in rows} >= {None, "empty_history"}


def test_search_in_cells_equals_pairs(spark):
    """The search that counts places in blocks finds and counts what the search by pairs does."""
    import numpy as np

    rng = np.random.default_rng(5)
    unit = lambda n: [list(map(float, x / np.linalg.norm(x))) for x in rng.normal(size=(n, 4))]
    base = [(f"N{i:03d}", x, i % 4) for i, x in enumerate(unit(120))]
    base[5] = ("N005", base[6][1], 2)  # tied with the next
    assigned = spark.createDataFrame(base, "vec_id string, embedding array<double>, cell int")
    queries = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(unit(9))], "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", 12 * i, [f"N{int(x):03d}" for x in rng.integers(0, 120, 6)]) for i in range(9)], "impression_id string, ts_us bigint, history array<string>")
    first = spark.createDataFrame([(f"N{i:03d}", int(rng.integers(0, 100))) for i in range(115)], "news_id string, first_us bigint")

    class Model:
        def clusterCenters(self):  # noqa: N802
            return [np.eye(4)[i] for i in range(4)]

    ways = [(1, 1), (1, 2), (3, 1), (3, 2)]
    rows = lambda df: sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select("query_id", "probes", "oversampling", "ids", "scores", *dense.COSTS, "unfilled", "oversampled").collect())
    got = rows(dense.eligible_search_in_cells(queries, asked, assigned, Model(), first, 7, ways))
    q = queries.withColumnRenamed("vec_id", "query_id")
    assert got == rows(dense._by_pairs(q, asked, assigned, Model(), first, 7, ways, 6)) and len(got) == 36 and any(r[5] > 1 for r in got)


def test_features_in_blocks_equal_those_by_joins(spark, monkeypatch):
    """Candidates leave the blocks with their columns, so that no join has candidates on a side; the values are those of the joins."""
    monkeypatch.setattr(features, "IMPRESSION_BLOCK", 3)
    articles = spark.createDataFrame([(f"N{i}", f"c{i % 3}", f"s{i % 4}", f"title {i % 5} word{i}", "" if i % 4 == 0 else f"text {i % 2} again") for i in range(12)], "news_id string, category string, subcategory string, title string, abstract string")
    observed = articles.select("news_id").filter("news_id <> 'N3'")
    shown = [(f"{i}", i, i * HOUR, [f"N{(i * j) % 14}" for j in range(i % 6)] + ["N1"] * (i % 2), [(k, f"N{(i + 3 * k) % 13}", (i + k) % 2 if i % 5 else None) for k in range(4)]) for i in range(11)]
    rows = spark.createDataFrame(shown, "impression_id string, ordinal bigint, ts_us bigint, history array<string>, candidates array<struct<position:int,news_id:string,clicked:tinyint>>")
    vectors = text.vectors(articles, observed)[0].join(observed, "news_id", "left_semi")
    own = features.with_history(rows, vectors, articles, observed)
    weights = text.tfidf(articles, observed).join(observed, "news_id", "left_semi")
    score = text.history_similarity(rows, weights, observed).withColumnRenamed("score", "tfidf_history_similarity")
    cand_ = feed.candidates(rows, ("ts_us", "ordinal")).join(score, ["impression_id", "news_id"], "left")
    made = lambda c: sorted(map(tuple, features.feature_table(c, rows, articles, observed).collect()))
    got = made(own)
    assert got == made(cand_) and len(got) == 41 and {r[9] for r in got} > {0.0}
