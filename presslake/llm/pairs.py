"""Items that appear together, by basket collapsing.

Records with the same set of items are collapsed into one weighted basket;
pairs are enumerated once per distinct basket and their weights summed.

Before any pair is made, the baskets are cleaned without loss. Items too common
for the wished lift leave: the lift of a pair is at most n / count of its
commoner item, so no item above n / min_lift can be in a result; there are
provably few of them. Items below the least count leave by a bitmap of hashes of
the items that stay, a single row of bounded size; rare items whose hash meets
one that stays pass it and leave with the exact counts at the end.

A basket larger than LARGE is cut into chunks, and pairs of chunks are spread
over the tasks, so that no task enumerates all pairs of a huge basket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.session import StagedTable, cut

#: Items of a basket that one task enumerates alone, and items of a chunk of a larger one.
LARGE, CHUNK = 2_000, 500
#: Rare items leave by the bitmap only if they hold more than this share of all items of baskets; else the exact counts at the end are cheaper.
RARE_SHARE = 0.05
#: Bits per item that stays, and bits of the bitmap at most (a megabyte).
BITS_PER_ITEM, MOST_BITS = 16, 1 << 23


def baskets(df: DataFrame, record: str, items: list) -> DataFrame:
    """One row per record: (r, b) with b its distinct non-NULL items in order.

    Repeated rows of a record count once; a record with several contents takes
    the union of them. Rows with a NULL record are left out.
    """
    merged = F.array_sort(F.array_distinct(F.filter(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in items]), lambda x: x.isNotNull())))
    once = df.filter(F.col(record).isNotNull()).select(F.col(record).alias("r"), merged.alias("b")).distinct()
    several = once.groupBy("r").count().filter("count > 1")
    if several.isEmpty():
        return once
    united = (
        once.join(several.select("r"), "r", "left_semi").select("r", F.explode_outer("b").alias("x")).distinct().groupBy("r").agg(F.array_sort(F.collect_set("x")).alias("b"))
    )
    return once.join(several.select("r"), "r", "left_anti").unionByName(united)


def _bitmap(kept: DataFrame, bits: int) -> DataFrame:
    """One row (m): the hashes of the items as an array of 64-bit words."""
    place = F.pmod(F.xxhash64("x"), F.lit(bits))
    words = kept.select(place.alias("p")).select(F.floor(F.col("p") / 64).cast("bigint").alias("id"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    words = words.groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = kept.sparkSession.range(bits // 64).join(words, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("w"))
    return every.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w.bits).alias("m"))


def pair_scores(df: DataFrame, record: str, items: list, min_count: int, min_lift: int) -> DataFrame:
    """Pairs (item_a < item_b) with their counts and measures of association.

    Columns: item_a, item_b, n_records, count_a, count_b, n_both, lift and
    conviction (of a implying b; NULL where b always follows a). Kept are pairs
    with n_both >= min_count and n_both * n >= min_lift * count_a * count_b, in
    exact integer arithmetic. Records without items count in n. NULL items and
    records are left out; an empty table gives no pair.
    """
    weighted = StagedTable(baskets(df, record, items).groupBy("b").agg(F.count(F.lit(1)).alias("w")))
    total = weighted.read().agg(F.sum("w").alias("n")).first().n or 0
    counts = StagedTable(weighted.read().select(F.explode("b").alias("x"), "w").groupBy("x").agg(F.sum("w").alias("c")))
    # Items too common for the lift: fewer than min_lift times the average basket size, as their counts sum to n times that.
    common = [r.x for r in counts.read().filter(F.col("c") * min_lift > total).select("x").collect()]
    singles = counts.read().filter((F.col("c") >= min_count) & (F.col("c") * min_lift <= total))
    shares = counts.read().agg(F.sum(F.when(F.col("c") < min_count, F.col("c")).otherwise(0)).alias("rare"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("n")).first()
    n_singles = shares.n
    sift = (shares.rare or 0) > RARE_SHARE * (shares.all or 1)
    bits = max(64, min(MOST_BITS, 1 << (max(1, n_singles * BITS_PER_ITEM) - 1).bit_length()))
    held = weighted.read().crossJoin(F.broadcast(_bitmap(singles.select("x"), bits))) if sift else weighted.read()  # a single row

    def stays(x):
        if not sift:
            return ~x.isin(common)
        p = F.pmod(F.xxhash64(x), F.lit(bits))
        word = F.get("m", F.floor(p / 64).cast("int"))
        kept = F.getbit(word, (p % 64).cast("int")) == 1
        return kept & ~x.isin(common) if common else kept

    cleaned = held.select("w", (F.filter("b", stays) if sift or common else F.col("b")).alias("b")).filter(F.size("b") > 1)
    small = (
        cleaned.filter(F.size("b") <= LARGE)
        .select("w", F.col("b"), F.posexplode("b").alias("i", "item_a"))
        .select("w", "item_a", F.explode(F.expr("slice(b, i + 2, size(b))")).alias("item_b"))
    )
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size("b"), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice("b", i, F.lit(CHUNK)))
    large = (
        cleaned.filter(F.size("b") > LARGE)
        .select("w", chunks.alias("c"))
        .select("w", "c", F.posexplode("c").alias("i", "left"))
        .select("w", "left", F.explode(F.expr("slice(c, i + 1, size(c))")).alias("right"))
        .repartition(F.xxhash64("left", "right"))
        .select("w", F.explode("left").alias("item_a"), "right")
        .select("w", "item_a", F.explode("right").alias("item_b"))
        .filter("item_a < item_b")
    )
    pairs = small.unionByName(large).groupBy("item_a", "item_b").agg(F.sum("w").alias("n_both")).filter(F.col("n_both") >= min_count)
    a = singles.select(F.col("x").alias("item_a"), F.col("c").alias("count_a"))
    b = singles.select(F.col("x").alias("item_b"), F.col("c").alias("count_b"))
    n = F.lit(total).cast("bigint")
    exact = lambda *cs: [c.cast("decimal(19,0)") for c in cs]
    ca, cb, cab, nn = exact(F.col("count_a"), F.col("count_b"), F.col("n_both"), n)
    out = pairs.join(a, "item_a").join(b, "item_b").filter(cab * nn >= ca * cb * F.lit(min_lift).cast("decimal(9,0)"))
    x, y, xy = (F.col(c).cast("double") for c in ("count_a", "count_b", "n_both"))
    scored = out.select(
        "item_a", "item_b", n.alias("n_records"), "count_a", "count_b", "n_both",
        (xy * n / (x * y)).alias("lift"),
        F.when(xy < x, (n - y) * x / (n * (x - xy))).alias("conviction"),
    )
    scored = cut(scored)
    weighted.drop()
    counts.drop()
    return scored
