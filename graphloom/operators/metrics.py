"""Ranking, calibration and fusion metrics over (y, score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut, width

#: Inner edges of ten equal bins as floating point sums give them.
EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(rows: DataFrame, threshold: Column | float, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of score >= threshold; empty denominators give 0."""
    p = F.col("score") >= threshold
    y = F.col("y") == 1
    c = rows.groupBy(*(by or [])).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *(by or []), "tp", "fp", "fn", "tn", F.round(_ratio(tp, tp + fp), 6).alias("precision"), F.round(_ratio(tp, tp + fn), 6).alias("recall"),
        F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(_ratio(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"),
    )


def auc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """([by,] auc): area under the curve with ties at half; 0.5 if a class is empty.

    Rows are first counted per score; running sums go range by range of the distinct scores.
    """
    by = by or []
    per = rows.groupBy(*by, "score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    ranged = cut(per.repartitionByRange(width(per), *by, "score").withColumn("_p", F.spark_partition_id()))
    whole = ranged.groupBy(*by, "_p").agg(F.sum("n").alias("_n"))  # one row per partition and group
    before = whole.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by, F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "_p").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = ranged.withColumn("_in", inside).join(F.broadcast(before), [*by, "_p"]).withColumn("w", F.col("p") * (F.col("_before") + F.col("_in") + F.col("n") / 2))
    return wins.groupBy(*by).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(*by, F.round(F.when((F.col("p") == 0) | (F.col("n") == 0), F.lit(0.5)).otherwise(F.col("w") / (F.col("p") * F.col("n"))), 6).alias("auc"))


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))), 6).alias("brier"))


def calibration_bins(rows: DataFrame) -> DataFrame:
    """(bin, n, mean_score, rate) of ten bins, the last closed."""
    b = sum((F.col("score") >= e).cast("int") for e in EDGES)
    return rows.withColumn("bin", b).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("rate"))


def ece(rows: DataFrame) -> DataFrame:
    """Expected calibration error."""
    bins = calibration_bins(rows)
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n"), 6).alias("ece"))


def quantiles(rows: DataFrame, points: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated quantiles with the ends."""
    q = [F.round(F.percentile("score", F.lit(p)), 9).alias(f"p{round(p * 100):02d}") for p in points]
    return rows.agg(F.min("score").alias("min"), *q, F.max("score").alias("max"))


def fusion_grid(rows: DataFrame) -> DataFrame:
    """(alpha, threshold, f1, auc, accuracy, rank): weights of two scores (y, c, g), each with its best threshold, the best first.

    All 21 x 13 settings are evaluated in one pass: each row is multiplied by the 273 settings, a fixed number, and
    counted with partial sums before the shuffle.
    """
    grid = F.explode(F.sequence(F.lit(0), F.lit(20))).alias("a")
    wide = rows.select("y", "c", "g", grid).select("y", "c", "g", "a", F.explode(F.sequence(F.lit(4), F.lit(16))).alias("t"))
    score = F.round((F.col("a") * F.col("c") + (20 - F.col("a")) * F.col("g")) / 20, 9)
    p, y = score >= F.col("t") / 20, F.col("y") == 1
    c = wide.groupBy("a", "t").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count(F.lit(1)).alias("n"))
    scored = c.select(
        F.round(F.col("a") / 20, 2).alias("alpha"), F.round(F.col("t") / 20, 2).alias("threshold"), F.round(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"),
        F.round((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n"), 6).alias("accuracy"),
    )
    # the best threshold of each weight by f1 and accuracy, then the best weight by f1, auc and accuracy, the first on ties
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("alpha").orderBy(F.desc("f1"), F.desc("accuracy"), "threshold"))).filter("r = 1").drop("r")
    fused = rows.select("y", "c", "g", grid).select("y", "a", F.round((F.col("a") * F.col("c") + (20 - F.col("a")) * F.col("g")) / 20, 9).alias("score"))
    areas = auc(fused, ["a"]).select(F.round(F.col("a") / 20, 2).alias("alpha"), "auc")
    return best.join(areas, "alpha").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1"), F.desc("auc"), F.desc("accuracy"), "alpha")))  # 21 rows


def validation(rows: DataFrame) -> DataFrame:
    """(model, threshold, f1, auc, accuracy): each model alone with its best threshold; weights 1 and 0 of the fusion."""
    g = fusion_grid(rows).filter("alpha in (0, 1)")
    return g.select(F.when(F.col("alpha") == 1, "content").otherwise("graph").alias("model"), "threshold", "f1", "auc", "accuracy")
