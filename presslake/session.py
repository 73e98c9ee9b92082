"""Session-level helpers: shared storage for cutting lineage, and written intermediate tables.

Anything that must survive the loss of an executor goes to the folder the
cluster names in ``spark.checkpoint.dir``. Where that is unset, a folder of the
machine is chosen only if the session itself runs on this one machine (tests, a
laptop); on a cluster it is an error, as executors would write to their own disks.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session, set only where the cluster names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="presslake-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from reliable storage (eager)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class StagedTable:
    """A Parquet table in the shared folder, for data that is read several times.

    Unlike a checkpoint it keeps column pruning, filter push-down and partition
    pruning for its readers. ``drop()`` removes it once nothing lazy refers to it;
    what is left goes when the application ends.
    """

    def __init__(self, df: DataFrame, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
        self.schema = df.schema
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, its rows numbered 0, 1, 2, ... in their order; one count per partition reaches the driver."""
    rows = cut(df).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before, total = {}, 0
    for r in sorted(rows.groupBy("_p").count().collect(), key=lambda r: r["_p"]):
        before[r["_p"]], total = total, total + r["count"]
    start = F.create_map(*[F.lit(x) for pair in (before or {0: 0}).items() for x in pair])
    return rows.withColumn(name, (F.try_element_at(start, "_p") + F.col("_m")).cast("int")).drop("_p", "_m")


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps, which else stay until the driver happens to collect its garbage.

    Twice, as the listeners hold the last step's plan for a moment.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def spread(spark: SparkSession, n: int) -> list[int]:
    """``n`` group keys (bigint) that a shuffle deals to its partitions in turn, so that few large groups don't meet in one task."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = spark.sql(f"SELECT transform(sequence(0L, {40 * max(n, partitions)}L), x -> pmod(hash(x), {partitions})) AS p").first().p
    of: dict[int, list[int]] = {}
    for key, place in enumerate(places):
        of.setdefault(place, []).append(key)
    turns = [keys[turn] for turn in range(max(map(len, of.values()))) for _, keys in sorted(of.items()) if turn < len(keys)]
    return turns[:n]
