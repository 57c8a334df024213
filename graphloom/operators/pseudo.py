"""Pseudo-labels: confidence, deduplication, conflict resolution, stability over rounds, soft targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut


def label_confidence(label: Column, combined: Column) -> Column:
    """How sure a row is of its own label."""
    return F.when(label == 1, combined).otherwise(1 - combined)


def best_rows(rows: DataFrame) -> DataFrame:
    """(src, dst, label, combined, ord): per pair and label the row with the highest confidence, the earliest on ties."""
    conf = label_confidence(F.col("label"), F.col("combined"))
    return rows.withColumn("conf", conf).groupBy("src", "dst", "label").agg(F.max_by(F.struct("combined", "ord"), F.struct("conf", (-F.col("ord")).alias("o"))).alias("b")).select(
        "src", "dst", "label", F.col("b.combined").alias("combined"), F.col("b.ord").alias("ord")
    )


def resolve_conflicts(gold: DataFrame, memory: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, label, conf, origin): pseudo rows after a round.

    New negatives that are positives in the gold rows (src, dst) go; a new row against a memory row of the other label
    wins only with a strictly higher confidence; then each pair and label keeps its most confident row, memory first.
    """
    conf = lambda d, origin: d.select("src", "dst", "label", label_confidence(F.col("label"), F.col("combined")).alias("conf"), F.lit(origin).alias("origin"))
    old = conf(memory, "memory")
    fresh = conf(new, "new").join(gold.select("src", "dst", F.lit(1).alias("gold")), ["src", "dst"], "left").filter(~((F.col("label") == 0) & F.col("gold").isNotNull())).drop("gold")
    fresh = fresh.groupBy("src", "dst", "label").agg(F.max("conf").alias("conf")).withColumn("origin", F.lit("new"))
    held = old.groupBy("src", "dst", "label").agg(F.max("conf").alias("conf")).withColumn("origin", F.lit("memory"))
    against = held.select("src", "dst", (1 - F.col("label")).alias("label"), F.col("conf").alias("other"))
    against_new = fresh.select("src", "dst", (1 - F.col("label")).alias("label"), F.col("conf").alias("other"))
    won = fresh.join(against, ["src", "dst", "label"], "left").filter(F.col("other").isNull() | (F.col("conf") > F.col("other"))).drop("other")
    kept = held.join(against_new, ["src", "dst", "label"], "left").filter(F.col("other").isNull() | (F.col("conf") >= F.col("other"))).drop("other")
    both = won.unionByName(kept)
    return both.groupBy("src", "dst", "label").agg(F.max_by(F.struct("conf", "origin"), F.struct("conf", (F.col("origin") == "memory").alias("m"))).alias("b")).select("src", "dst", "label", F.round("b.conf", 6).alias("conf"), F.col("b.origin").alias("origin"))


def _sighted(sightings: DataFrame) -> DataFrame:
    """Sightings with the stretch of one label that they stand in, whether they confirm, and the hits so far."""
    w = Window.partitionBy("pair").orderBy("round", "ord")
    turn = F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(0))
    staged = sightings.withColumn("turn", turn).withColumn("stretch", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("pair", "stretch").orderBy("round", "ord")
    fresh_round = F.coalesce(F.lag("round").over(inside) != F.col("round"), F.lit(True))
    fresh_teacher = F.row_number().over(Window.partitionBy("pair", "stretch", "teacher").orderBy("round", "ord")) == 1
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return staged.withColumn("hit", (fresh_round | fresh_teacher).cast("int")).withColumn("hits", F.sum("hit").over(so_far))


def stable_hits(sightings: DataFrame) -> DataFrame:
    """(pair, label, hits, conflicts, last_round): state of each pair after all rounds.

    sightings: (pair, round, teacher, label, ord). A change of label starts the count anew and is a conflict. Within a
    stretch of one label a sighting counts if its round is another than that of the one before, or if its teacher has
    not been met in the stretch.
    """
    per = _sighted(sightings).groupBy("pair", "stretch").agg(F.min("label").alias("label"), F.max("hits").alias("hits"), F.max("round").alias("last_round"))
    return per.groupBy("pair").agg(F.max_by(F.struct("label", "hits", "last_round"), "stretch").alias("s"), F.max("stretch").alias("conflicts")).select(
        "pair", F.col("s.label").alias("label"), F.col("s.hits").alias("hits"), F.col("conflicts"), F.col("s.last_round").alias("last_round")
    )


def newly_stable(sightings: DataFrame, min_hits: int = 2) -> DataFrame:
    """(pair, round, label, conf, teacher, row): the rows that the tracker gives out when a pair comes to `min_hits`.

    sightings also has `combined`. The row given is the surest of its stretch so far, the latest on ties. With
    `min_hits` of 1 a pair is given out once only, as any change of label finds it stable already.
    """
    conf = label_confidence(F.col("label"), F.col("combined"))
    seen = _sighted(sightings.withColumn("conf", conf))
    inside = Window.partitionBy("pair", "stretch").orderBy("round", "ord").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct("conf", "round", "ord", "teacher")).over(inside)
    out = seen.withColumn("best", best).filter((F.col("hit") == 1) & (F.col("hits") == min_hits))
    if min_hits <= 1:
        out = out.filter("stretch = 0")
    return out.select("pair", "round", "label", F.col("best.conf").alias("conf"), F.col("best.teacher").alias("teacher"), F.col("best.ord").alias("row"))


def soft_target(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.1)), F.lit(0.9))


#: Weights of pseudo rows in the first, second and later rounds.
BASES = (0.1, 0.2, 0.3)


def soft_weight(score: Column, iteration: Column | int = 1) -> Column:
    """Weight of a pseudo row by round (0..): the surer its soft target, the heavier, between 0.05 and 0.5."""
    i = F.lit(iteration) if isinstance(iteration, int) else iteration
    base = F.when(i <= 0, BASES[0]).when(i == 1, BASES[1]).otherwise(BASES[2])
    return F.least(F.greatest(base * 2 * F.abs(soft_target(score) - 0.5), F.lit(0.05)), F.lit(0.5))


def hard_target(c: Column, g: Column, judge: Column | None = None) -> Column:
    """Soft target of a mined negative: the least score, between 0.15 and 0.30."""
    return F.least(F.greatest(F.least(c, g) if judge is None else F.least(c, g, judge), F.lit(0.15)), F.lit(0.30))


def disagreement(c: Column, g: Column) -> Column:
    """Whether one model is high where the other is low."""
    return ((g >= 0.65) & (c <= 0.45)) | ((c >= 0.60) & (g <= 0.35))


def combined_score(model: Column, judge: Column, weight: float = 0.5) -> Column:
    """Mean of a judge's and a model's score."""
    return weight * judge + (1 - weight) * model


def finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def budget(n_positive: int, ratio: float = 0.1, multiplier: float = 2.0) -> tuple[int, int]:
    """(candidates, rows) of each sign that a round takes."""
    final = max(1, max(2, int(ratio * n_positive)) // 2)
    return max(1, int(final * multiplier)), final


def select_pseudo(scored: DataFrame, n_positive: int, ratio: float = 0.1, high: float = 0.8, low: float = 0.2, weight: float = 0.5) -> DataFrame:
    """(src, dst, label, combined): pseudo rows of a round from scored pairs (src, dst, model, judge).

    The surest candidates by the model above `high` and below `low`, then the surest of those by model and judge;
    candidates without a judge's score drop out.
    """
    candidates, final = budget(n_positive, ratio)
    both = combined_score(F.col("model"), F.col("judge"), weight)
    out = None
    for label, keep, order in ((1, F.col("model") >= high, F.desc), (0, F.col("model") <= low, F.asc)):
        part = scored.filter(keep).orderBy(order("model"), "src", "dst").limit(candidates).withColumn("combined", both).filter(finite(F.col("combined")))
        part = part.orderBy(order("combined"), "src", "dst").limit(final).select("src", "dst", F.lit(label).alias("label"), "combined")
        out = part if out is None else out.unionByName(part)
    return out


def mined_negatives(scored: DataFrame, most: int, judge_most: float = 0.30) -> DataFrame:
    """(src, dst, label, model, combined, disagreement): pairs (src, dst, content, graph, judge) on which the models disagree most.

    Twice as many as wanted are judged, those with a high judgement go, and the first `most` of the rest stay.
    """
    gap = F.abs(F.col("content") - F.col("graph"))
    met = scored.filter(disagreement(F.col("content"), F.col("graph"))).withColumn("disagreement", gap).orderBy(F.desc("disagreement"), "src", "dst").limit(2 * most)
    kept = met.filter(F.col("judge") <= judge_most).orderBy(F.desc("disagreement"), "src", "dst").limit(most)
    return kept.select("src", "dst", F.lit(0).alias("label"), F.greatest("content", "graph").alias("model"), hard_target(F.col("content"), F.col("graph"), F.col("judge")).alias("combined"), "disagreement")


def training_rows(pseudo: DataFrame, split: str = "train") -> DataFrame:
    """Pseudo rows (src, dst, label, combined, type) as label rows."""
    return pseudo.select(
        F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "label", F.lit(split).alias("split"), F.concat(F.lit("pseudo_"), F.col("type")).alias("negative_type"), F.lit(None).cast("double").alias("similarity"),
        "combined", label_confidence(F.col("label"), F.col("combined")).alias("label_confidence"),
    )


def training_frame(gold: DataFrame, negatives: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Gold, mined negative and pseudo rows in one frame."""
    return gold.unionByName(negatives, allowMissingColumns=True).unionByName(training_rows(pseudo), allowMissingColumns=True)


def quality(pseudo: DataFrame) -> DataFrame:
    """(total, mean_confidence, mean_judge): 0 and null where there is nothing to take a mean of; judgements are texts."""
    return pseudo.agg(F.count(F.lit(1)).alias("total"), F.round(F.coalesce(F.avg("label_confidence"), F.lit(0.0)), 6).alias("mean_confidence"), F.round(F.avg(F.col("judge").try_cast("double")), 6).alias("mean_judge"))


def best_round(metrics: DataFrame, order: tuple[str, ...] = ("auc", "f1", "accuracy")) -> DataFrame:
    """The round whose metrics, in this order, are highest, the earliest on ties."""
    return metrics.orderBy(*[F.desc_nulls_last(c) for c in order], "round").limit(1)


def soft_bce(logit: Column, target: Column) -> Column:
    """Binary cross entropy of a logit against a soft target."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def reverse_margin(forward: Column, backward: Column, margin: float = 0.25) -> Column:
    """What the probability of an edge lacks to exceed that of its reverse by a margin."""
    return F.greatest(margin - _probability(forward) + _probability(backward), F.lit(0.0))


def logit_cap(logit: Column, cap: float) -> Column:
    """Squared excess of a logit over a cap; nothing for a cap of 0."""
    return F.pow(F.greatest(F.abs(logit) - cap, F.lit(0.0)), F.lit(2.0)) if cap > 0 else F.lit(0.0)


def losses(rows: DataFrame, cap: float = 4.0, temperature: float = 2.0, least: float = 0.5) -> DataFrame:
    """(bce, reverse, capped, kd, kd_rows): losses of rows (logit, reverse_logit, target, weight); the teacher's term takes rows with a sure target only."""
    sure = F.abs(F.col("target") - 0.5) * 2
    clipped = F.least(F.greatest(F.col("target"), F.lit(1e-6)), F.lit(1 - 1e-6))
    taught = soft_bce(F.col("logit") / temperature, _probability(F.ln(clipped / (1 - clipped)) / temperature)) * sure
    r6 = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return rows.agg(
        r6(F.avg(soft_bce(F.col("logit"), F.col("target")) * F.col("weight")), "bce"), r6(F.avg(reverse_margin(F.col("logit"), F.col("reverse_logit"))), "reverse"), r6(F.avg(logit_cap(F.col("logit"), cap)), "capped"),
        r6(F.avg(F.when(sure >= least, taught)), "kd"), F.count_if(sure >= least).alias("kd_rows"),
    )


def alternate(scored: DataFrame, gold: DataFrame, n_positive: int, rounds: int = 4, ratio: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(memory, log) of rounds in which the two models teach in turn.

    scored: (src, dst, content, graph, judge). A round takes its teacher's surest pairs that memory doesn't hold, and
    resolve_conflicts merges them into memory (src, dst, label, conf, origin). log: (round, teacher, n_new, n_memory).
    Each round is written once to the shared checkpoint folder, so a lost executor costs one round.
    """
    spark = scored.sparkSession
    memory, log = None, []
    for r in range(rounds):
        teacher = ("content", "graph")[r % 2]
        open_ = scored if memory is None else scored.join(memory.select("src", "dst"), ["src", "dst"], "left_anti")
        new = cut(select_pseudo(open_.select("src", "dst", F.col(teacher).alias("model"), "judge"), n_positive, ratio))
        held = new.limit(0) if memory is None else memory.select("src", "dst", "label", F.when(F.col("label") == 1, F.col("conf")).otherwise(1 - F.col("conf")).alias("combined"))
        memory = cut(resolve_conflicts(gold, held, new))
        log.append((r, teacher, new.count(), memory.count()))
    return memory, spark.createDataFrame(log, "round int, teacher string, n_new long, n_memory long")
