"""Session helpers shared by all operators: sessions, table loading, lineage cuts, size-checked joins."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = SparkSession.builder.master(master).appName("graphloom")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no copy of it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="graphloom-code-"), "graphloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*")):
            if f.suffix in (".py", ".npz"):
                z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)  # served by the driver to every executor
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names; a temporary one only in local mode, where all share the machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and cut the lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(df: DataFrame, least: int = 1) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """Rows with their place (0..) in a total order, in a column `name`; no task holds more than one range of them."""
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(width(df), *order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # one row per partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_p", "_local", "_before")


def hot_keys(df: DataFrame, key: str, share: float = 0.02, least: int = 10_000) -> DataFrame:
    """Keys with more than `share` of all rows (and more than `least` rows): at most 1 / share of them, by counting."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (
        counts.filter(F.col("_n") > least)
        .join(F.broadcast(total), F.col("_n") > F.col("_total") * share)  # one row against counts
        .select(key)
    )


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = 0.02, least: int = 10_000) -> DataFrame:
    """Join `left` with a `right` side that is unique by `key`, safe for keys that hold a large part of `left`.

    Hot keys number at most 1 / share, so the rows of `right` for them are broadcast; all other rows take the
    shuffle join. Nothing is dropped: the two parts are disjoint and united. Null keys stay in the second part.
    """
    spark = left.sparkSession
    hot = [r[0] for r in hot_keys(left, key, share, least).collect()]  # at most 1 / share values
    if not hot:
        return left.join(right, key, how)
    hot_df = spark.createDataFrame([(h,) for h in hot], left.select(key).schema)
    flagged = left.join(F.broadcast(hot_df.withColumn("_hot", F.lit(True))), key, "left")
    warm = flagged.filter(F.col("_hot").isNull()).drop("_hot").join(right, key, how)
    burning = flagged.filter(F.col("_hot")).drop("_hot").join(
        F.broadcast(right.join(F.broadcast(hot_df), key, "left_semi")), key, how
    )
    return burning.unionByName(warm)


def nonempty(run):
    """A mapInPandas function that yields no empty frames, whose string columns Arrow would not take."""

    @functools.wraps(run)
    def wrapped(batches):
        for frame in run(batches):
            if len(frame):
                yield frame

    return wrapped
