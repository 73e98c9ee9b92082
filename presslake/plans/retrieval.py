"""Queries of the catalog retrieval: configurations, search, metrics, validation, selection, dense projections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.operators import dense, projection, ranking, retrieval, selection, text
from presslake.plans.reference import _Feed, _observed, _Views
from presslake.session import StagedTable, cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOP_K = 100
#: The grid: texts, history lengths (None: all) and decays (None: the mean).
TEXTS = {
    "title": ("title",),
    "title_abstract": ("title", "abstract"),
    "title_abstract_category": ("title", "abstract", "category_token", "subcategory_token"),
}
LENGTHS, DECAYS = (10, 25, 50, None), (None, 0.5, 0.8)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def with_tokens(articles: DataFrame) -> DataFrame:
    """Articles with the words that stand for their category and subcategory."""
    return articles.withColumns({f"{c}_token": F.concat(F.lit(f"{c}_"), c) for c in ("category", "subcategory")})


def configuration_name(name: str, length: int | None, decay: float | None) -> str:
    kind = "mean" if decay is None else "recency"
    return f"text={name}__profile={kind}__history={'all' if length is None else length}__decay={'none' if decay is None else f'{decay:g}'}__exclude_history=true"


def grid(texts: tuple[str, ...] = tuple(TEXTS), lengths: tuple = LENGTHS, decays: tuple = DECAYS) -> dict[str, tuple[str, int | None, float | None]]:
    """Every configuration by its name."""
    return {configuration_name(t, n, d): (t, n, d) for t in texts for n in lengths for d in decays}


def asked_of(f: _Views, *parts: str) -> DataFrame:
    """The query set of the searches: the impressions of the partitions whose number is divisible by 20."""
    rows = f.rows.filter("try_cast(impression_id AS BIGINT) % 20 = 0")
    return rows.filter(F.col("part").isin(*parts)) if parts else rows


class Catalog:
    """What the searches of one fit need: availability and clicks of the fitting partitions; texts are weighted on demand."""

    def __init__(self, f: _Views, fit: tuple[str, ...]):
        self.feed, self.fit = f, fit
        f.stage()
        self.first_seen = StagedTable(retrieval.availability(f.rows)).read()
        self.clicks = ranking.clicks(f.candidates(*fit))
        self.made: dict[str, StagedTable] = {}
        self.vocabularies: dict[str, DataFrame] = {}
        self.articles = with_tokens(f.articles)
        self.observed = _observed(f, fit)

    def vectors(self, name: str) -> DataFrame:
        """Every article's vector under a text, made once."""
        if name not in self.made:
            vectors, vocabulary = text.vectors(self.articles, self.observed, TEXTS[name])
            self.made[name], self.vocabularies[name] = StagedTable(vectors), vocabulary
        return self.made[name].read()

    def lists(self, asked_rows: DataFrame, configurations: dict[str, tuple[str, int | None, float | None]], k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
        """(lists, asked): the texts are searched one after the other, each for all its profiles at once."""
        asked = StagedTable(retrieval.queries(asked_rows, self.articles, self.first_seen)).read()
        out = []
        for name in dict.fromkeys(t for t, _, _ in configurations.values()):
            ways = {c: (n, d) for c, (t, n, d) in configurations.items() if t == name}
            profile = retrieval.profiles(asked, self.vectors(name), list(ways.values()))
            out.append(retrieval.listed(list(ways), asked, profile, self.vectors(name), self.first_seen, self.clicks, k))
        return reduce(DataFrame.unionByName, out), asked

    def search(self, asked_rows: DataFrame, configurations: dict[str, tuple[str, int | None, float | None]], k: int = TOP_K) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(found, summary, asked)."""
        lists, asked = self.lists(asked_rows, configurations, k)
        return retrieval.ranks_of(lists), retrieval.summary_of(lists), asked


def evaluate(catalog: Catalog, asked_rows: DataFrame, configurations: dict[str, tuple[str, int | None, float | None]], k: int = TOP_K) -> DataFrame:
    lists, asked = catalog.lists(asked_rows, configurations, k)
    return retrieval.list_metrics(lists, asked, catalog.articles.count())


#: The configuration of the single searches.
DEFAULT = {configuration_name("title_abstract", 10, None): ("title_abstract", 10, None)}


@query
def retrieve_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best eligible articles of every query, with what is known of the query (the retrieval output)."""
    f = _Feed(spark, d).stage()
    lists, asked = Catalog(f, ("train",)).lists(asked_of(f), DEFAULT)
    hit = F.transform("ids", lambda x: F.array_contains("available", x))
    each = lists.join(asked, "impression_id").select("*", F.posexplode(F.arrays_zip("ids", "scores", "seen", hit.alias("hit"))).alias("at", "x"))
    return each.select(
        F.col("part").alias("partition"), "impression_id", "user_id", F.col("ts_us").alias("query_us"), (F.col("at") + 1).cast("bigint").alias("retrieved_rank"), F.col("x.ids").alias("retrieved_news_id"), F.col("x.scores").alias("score"),
        F.col("x.hit").alias("is_clicked_target"), F.col("x.seen").alias("was_in_history"), "catalog_size", F.col("fallback_reason").isNotNull().alias("fallback_used"),
        F.explode("configurations").alias("selected_configuration"),
    )


@query
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    f = _Feed(spark, d).stage()
    return evaluate(Catalog(f, ("train",)), asked_of(f), DEFAULT)


@query
def retrieval_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Queries without a profile or without a catalog, by reason, with their mean catalog size."""
    f = _Feed(spark, d).stage()
    _, summary, _ = Catalog(f, ("train",)).search(asked_of(f), DEFAULT)
    return summary.groupBy(F.coalesce("fallback_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("catalog_size"), 6).alias("mean_catalog_size"))


@query
def retrieval_violations(spark: SparkSession, d: str) -> DataFrame:
    """Validation of the retrieved lists: every count but the first is 0."""
    f = _Feed(spark, d).stage()
    catalog = Catalog(f, ("train",))
    found, _, asked = catalog.search(asked_of(f), DEFAULT)
    return retrieval.violations(found, asked, catalog.articles, catalog.first_seen)


@query
def retrieval_targets(spark: SparkSession, d: str) -> DataFrame:
    """Clicked targets of every query by their state at its time."""
    f = _Feed(spark, d)
    asked = retrieval.queries(asked_of(f), f.articles, retrieval.availability(f.rows))
    return asked.select("impression_id", "n_targets", F.size("available").cast("bigint").alias("n_available"), "n_unavailable", "n_missing")


@query
def static_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The articles that the impressions of test show at all."""
    f = _Feed(spark, d)
    return retrieval.static_catalog(f.rows.filter("part = 'test'"), f.articles)


@query
def retrieval_grid(spark: SparkSession, d: str) -> DataFrame:
    """Metrics on validation of all 36 configurations, the chosen one first."""
    f = _Feed(spark, d).stage()
    runs = evaluate(Catalog(f, ("train",)), asked_of(f, "validation"), grid())
    return selection.EXACT_RETRIEVAL.placed(runs.withColumnRenamed("configuration", "name"))


@query
def retrieval_selected(spark: SparkSession, d: str) -> DataFrame:
    """The configuration chosen on validation, refitted on train and validation and evaluated once on test."""
    f = _Feed(spark, d).stage()
    chosen = retrieval_grid(spark, d).filter("place = 1").select("name").first().name
    return evaluate(Catalog(f, ("train", "validation")), asked_of(f, "test"), {chosen: grid()[chosen]})


class Dense:
    """The projected articles of the default text, their profiles of the query set, and the exact search over them."""

    def __init__(self, f: _Views, asked_rows: DataFrame):
        self.catalog = Catalog(f, ("train",))
        ((self.name, (words, length, decay)),) = DEFAULT.items()
        self.articles = StagedTable(projection.dense_vectors(self.catalog.vectors(words), self.catalog.vocabularies[words], self.catalog.observed, 32)).read()
        self.asked = StagedTable(retrieval.queries(asked_rows, self.catalog.articles, self.catalog.first_seen)).read()
        place = F.transform("embedding", lambda x, i: i)
        self.long = self.articles.select("news_id", F.when(F.exists("embedding", lambda x: x != 0), place).otherwise(F.array().cast("array<int>")).alias("terms"), "embedding")
        self.weights = self.long.select("news_id", "terms", F.slice("embedding", 1, F.size("terms")).alias("weights"))
        self.profile = StagedTable(retrieval.profiles(self.asked, self.weights, [(length, decay)])).read()

    def exact(self, k: int = TOP_K) -> DataFrame:
        c = self.catalog
        return retrieval.listed([self.name], self.asked, self.profile, self.weights, c.first_seen, c.clicks, k)

    def vectors(self) -> DataFrame:
        """(vec_id, embedding): unit vectors of the queries that have a profile."""
        n = self.articles.agg(F.max(F.size("embedding"))).first()[0] or 1
        value = F.map_from_arrays("terms", F.transform("weights", lambda w: w / float(10**text.PLACES)))
        full = self.profile.filter("reason IS NULL").withColumn("m", value).select("impression_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        return full.withColumn("_n", norm).select(F.col("impression_id").alias("vec_id"), F.transform("v", lambda x: x / F.col("_n")).alias("embedding"))

    def indexed(self, n_cells: int):
        ((words, _, _),) = DEFAULT.values()
        worded = self.catalog.vectors(words).filter("size(terms) > 0").select("news_id")
        return dense.cells(self.articles.join(worded, "news_id", "left_semi").select(F.col("news_id").alias("vec_id"), "embedding"), n_cells)

    def approximate(self, index, ways: list[tuple[int, int]], k: int = TOP_K) -> DataFrame:
        """The search for every (probes, oversampling): lists and costs, one row per query and way."""
        model, assigned = index
        return StagedTable(dense.eligible_search_in_cells(self.vectors(), self.asked, assigned, model, self.catalog.first_seen, k, ways)).read()


#: Cells of the inverted file, and the probes and oversampling of the single searches and of the grid.
CELLS, PROBES, OVERSAMPLING = 16, 12, 2
PROBE_GRID, OVERSAMPLING_GRID = (4, 8, 12, 16), (2, 5)


@query
def ann_search(spark: SparkSession, d: str) -> DataFrame:
    """The approximate search under eligibility: twelve of sixteen cells, depth doubled while too few results are eligible."""
    f = _Feed(spark, d).stage()
    space = Dense(f, asked_of(f))
    found = space.approximate(space.indexed(CELLS), [(PROBES, OVERSAMPLING)]).select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "x"))
    return found.select(F.col("query_id").alias("impression_id"), (F.col("at") + 1).cast("bigint").alias("retrieved_rank"), F.col("x.ids").alias("retrieved_news_id"), F.col("x.scores").alias("score"))


@query
def ann_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What the approximate search cost and rejected, per query."""
    f = _Feed(spark, d).stage()
    space = Dense(f, asked_of(f))
    return space.approximate(space.indexed(CELLS), [(PROBES, OVERSAMPLING)]).drop("probes", "oversampling", "ids", "scores").withColumnRenamed("query_id", "impression_id")


@query
def ann_grid(spark: SparkSession, d: str) -> DataFrame:
    """Probes and oversampling on validation: agreement with the exact search, recall of clicked targets, cost; the chosen one first.

    Costs are the results examined (95th percentile) and the share of cells visited, as times of a cluster are not reproducible.
    """
    f = _Feed(spark, d).stage()
    space = Dense(f, asked_of(f, "validation"))
    runs = space.approximate(space.indexed(CELLS), [(p, o) for p in PROBE_GRID for o in OVERSAMPLING_GRID])
    way = ["probes", "oversampling"]
    # The results of a query depend on the cells alone, as the depth is doubled until they suffice; they are compared once per number of probes.
    once = runs.filter(F.col("oversampling") == OVERSAMPLING_GRID[0])
    key = lambda query_id: F.concat_ws("/", "probes", query_id).alias("query_id")
    rows = lambda df: df.select("query_id", F.posexplode("ids").alias("at", "vec_id")).select("query_id", (F.col("at") + 1).alias("rank"), "vec_id")
    exact = space.exact().filter("fallback_reason IS NULL").withColumn("probes", F.explode(F.array(*[F.lit(p) for p in PROBE_GRID]))).select(key("impression_id"), "ids")
    per = dense.agreements(rows(exact), rows(once.select(key("query_id"), "ids"))).withColumn("probes", F.split_part("query_id", F.lit("/"), F.lit(1)).cast("int"))
    mean = lambda c: F.round(F.avg(c), 6)
    agreement = per.groupBy("probes").agg(mean("set_recall_100").alias("agreement"), *[mean(c).alias(c) for c in ("top1_agreement", "jaccard_100", "mean_displacement_100")])
    targets = space.asked.select("impression_id", F.array_distinct("available").alias("t")).filter("size(t) > 0").withColumn("probes", F.explode(F.array(*[F.lit(p) for p in PROBE_GRID])))
    lists = targets.join(once.select(F.col("query_id").alias("impression_id"), "probes", "ids"), ["impression_id", "probes"], "left")
    hits = F.coalesce(F.size(F.array_intersect("t", "ids")), F.lit(0))
    recall = lists.groupBy("probes").agg(F.round(F.avg(F.when(F.col("ids").isNull(), 0.0).otherwise(hits / F.size("t"))), 6).alias("recall"))
    cost = runs.groupBy(*way).agg(
        F.sum("search_calls").alias("search_calls"), F.round(F.avg("examined"), 6).alias("mean_examined"), F.round(F.percentile("examined", F.lit(0.95)), 6).alias("p95"),
        F.round(F.avg(F.col("unfilled").cast("double")), 6).alias("unfilled_rate"),
    )
    row = agreement.join(recall, "probes").join(cost, "probes")
    name = F.format_string(f"ivf_cells={CELLS}__probes=%02d__oversampling=%d", "probes", "oversampling")
    return selection.APPROXIMATE.placed(cut(row.withColumns({"memory": F.col("probes") / CELLS, "name": name}).drop(*way)))


@query
def dense_retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval by 32-dimensional projections under the same eligibility, and what it loses against the sparse vectors."""
    f = _Feed(spark, d).stage()
    space = Dense(f, asked_of(f))
    own = retrieval.list_metrics(space.exact(), space.asked, space.catalog.articles.count())
    sparse = evaluate(space.catalog, asked_of(f), DEFAULT)
    loss = [F.round(F.col(f"own.{m}") - F.col(f"sparse.{m}"), 6).alias(f"{m}_loss") for m in ("recall_20", "recall_100", "ndcg_100", "mrr_100")]
    return own.alias("own").join(sparse.alias("sparse"), "configuration").select("own.*", *loss)
