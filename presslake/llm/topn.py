"""Top N items within every group, by descending score bands.

The rows are cut into a few bands by global quantiles of the score and written
once, band by band, without a shuffle. A profile counts the rows of every group
in every band. Bands are then read from the top. Of each band only the rows of
groups that still lack items are taken (groups that are full, or have no row in
the band, are left out before any ranking), and what an open group has won so
far is ranked again with them, in exact tie order. A band in which no open group
has rows is not read; once no group is open, the rest is not read either.

Skew: groups that hold more than 1/HEAVY of all rows are fewer than HEAVY. Their
rows are told apart by name without a shuffle and are combined by (group, item)
first, so that each spreads over all tasks; the planner's group limit then keeps
at most N rows of a group per task. All others are shuffled once, by group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslake.session import StagedTable, cut

#: Shares of all rows, from the top, at which bands end; the last band takes the rest.
BAND_ENDS = (0.125, 0.35)
#: A group is heavy if it holds more than 1/HEAVY of all rows.
HEAVY = 512
#: Open groups that are broadcast at most; more are joined by shuffle.
MOST_BROADCAST = 100_000


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, band_ends: tuple[float, ...] = BAND_ENDS, rows_read: list | None = None) -> DataFrame:
    """(group, item, score) of the ``n`` best items of every group, ties to the smaller item.

    Scores compare unrounded; 0.0 and -0.0 are equal. Rows with a NULL, NaN or
    infinite score, a NULL group or a NULL item take no part. Repeated rows
    count once; an item that comes with several scores counts with its highest.
    Groups with fewer than ``n`` items return all of them. Other columns are
    ignored; an empty table returns no row. ``rows_read`` receives, for every
    band that is read, its number and the rows of open groups in it.
    """
    value = F.col(score).cast("double")
    finite = (value > float("-inf")) & (value < float("inf"))
    rows = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull() & finite).select(F.col(group).alias("g"), F.col(item).alias("i"), (value + F.lit(0.0)).alias("s"))
    # Quantiles of all rows: a fixed-size sketch per task.
    edges = rows.agg(F.percentile_approx("s", [1.0 - e for e in band_ends], 1000).alias("q")).first().q or []
    edges = sorted(set(edges), reverse=True)
    band = F.lit(len(edges))
    for k, edge in reversed(list(enumerate(edges))):
        band = F.when(F.col("s") >= edge, k).otherwise(band)
    bands = range(len(edges) + 1)
    staged = StagedTable(rows.withColumn("band", band), ["band"])
    profile = StagedTable(staged.read().groupBy("g").agg(*[F.count_if(F.col("band") == k).alias(f"c{k}") for k in bands]))

    def from_band(k: int):
        return sum((F.col(f"c{j}") for j in bands if j >= k), F.lit(0))

    total = profile.read().agg(F.sum(from_band(0)).alias("n")).first().n or 0
    heavy = [r.g for r in profile.read().filter(from_band(0) * HEAVY > total).select("g").collect()]  # fewer than HEAVY
    is_heavy = F.col("g").isin(heavy) if heavy else F.lit(False)
    order = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i"))

    def best(candidates: DataFrame) -> DataFrame:
        once = candidates.groupBy("g", "i").agg(F.max("s").alias("s"))
        return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).drop("r")

    finished: list[DataFrame] = []
    won: DataFrame | None = None  # of the open groups
    open_ = profile.read()
    for k in bands:
        ahead = open_.agg(F.count(F.lit(1)).alias("groups"), F.sum(f"c{k}").alias("rows")).first()
        if not ahead.groups:
            break
        if not ahead.rows:
            continue
        if rows_read is not None:
            rows_read.append((k, ahead.rows))
        own = staged.read().filter(F.col("band") == k).select("g", "i", "s")
        light, weighty = own.filter(~is_heavy), own.filter(is_heavy)
        if won is not None:
            here = open_.filter(F.col(f"c{k}") > 0).select("g")
            names = [r.g for r in here.filter(is_heavy).collect()] if heavy else []
            weighty = weighty.filter(F.col("g").isin(names) if names else F.lit(False)).unionByName(won.filter(is_heavy))
            few = ahead.groups <= MOST_BROADCAST
            light = light.join(F.broadcast(here) if few else here, "g", "left_semi").unionByName(won.filter(~is_heavy))
        ranked = best(light.repartition("g"))  # one shuffle serves the copies and the ranks
        if heavy:
            ranked = ranked.unionByName(best(weighty))
        ranked = cut(ranked)
        full = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("have")).filter(F.col("have") >= n).select("g")
        open_ = cut(open_.filter(from_band(k + 1) > 0).join(full, "g", "left_anti"))
        won = ranked.join(open_.select("g"), "g", "left_semi")
        finished.append(ranked.join(open_.select("g"), "g", "left_anti"))
    # Every group closes at the latest with the last band in which it has rows.
    out = finished[0] if finished else rows.limit(0)
    for more in finished[1:]:
        out = out.unionByName(more)
    staged.drop()
    profile.drop()
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score))
