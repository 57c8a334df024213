"""Queries of a typed relation graph: neighbours, siblings, chains, structural features, edge lists for models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def typed_edges(partof: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, type): part-of edges, and prerequisite edges from positive labels."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), "[ \t\r\n]+", " "))
    parts = partof.select(key("part_concept").alias("src"), key("whole_concept").alias("dst")).filter("src <> '' and dst <> '' and dst <> 'whole_concept'").withColumn("type", F.lit("part-of"))
    pre = labels.filter("label = 1").select(key("source").alias("src"), key("target").alias("dst")).filter("src <> dst").withColumn("type", F.lit("prerequisite"))
    return parts.unionByName(pre).distinct()


def confusable(concepts: DataFrame, k: int = 12) -> DataFrame:
    """(src, dst, rank): the first k canonical names that differ from a name in the first of its words only.

    Only the first k + 1 names of a group can be among anybody's first k.
    """
    n = concepts.filter(F.contains("canonical", F.lit(" "))).select("canonical", F.expr("substring(canonical, instr(canonical, ' ') + 1)").alias("rest")).distinct()
    heads = n.withColumn("r", F.row_number().over(Window.partitionBy("rest").orderBy("canonical"))).filter(F.col("r") <= k + 1).select("rest", F.col("canonical").alias("dst"))
    met = n.select(F.col("canonical").alias("src"), "rest").join(heads, "rest").filter("src <> dst")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("rank") <= k).select("src", "dst", "rank")


def similar(labels: DataFrame, k: int | None = 12) -> DataFrame:
    """(src, dst, weight, rank): the k names most similar to each, or all, both ways, by the label rows' similarity."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), "[ \t\r\n]+", " "))
    one = labels.filter("similarity is not null").select(key("source").alias("src"), key("target").alias("dst"), F.col("similarity").alias("weight")).filter("src <> dst")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    if k is None:
        return both
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))).filter(F.col("rank") <= k)


def neighbour_rows(edges: DataFrame) -> DataFrame:
    """(concept, relation, other): all neighbours of every concept in both directions of every relation."""
    out = edges.select(F.col("src").alias("concept"), F.concat("type", F.lit(":out")).alias("relation"), F.col("dst").alias("other"))
    return out.unionByName(edges.select(F.col("dst").alias("concept"), F.concat("type", F.lit(":in")).alias("relation"), F.col("src").alias("other")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(concept, relation, n, first): neighbours of every concept per direction of every relation."""
    return neighbour_rows(edges).groupBy("concept", "relation").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first"))


def sibling_parts(parts: DataFrame, k: int = 4) -> DataFrame:
    """(concept, sibling, whole, rank): the first k other parts of a concept's wholes, each part with its first whole.

    Fewer than k siblings are taken when a whole is come to, so its first 2 k + 1 parts are enough; a whole with very
    many parts meets each of its parts with so many rows, not with all of them.
    """
    heads = parts.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).filter(F.col("r") <= 2 * k + 1).select("dst", F.col("src").alias("sibling"))
    met = parts.select(F.col("src").alias("concept"), "dst").join(heads, "dst").filter("concept <> sibling")
    ranked = met.groupBy("concept", "sibling").agg(F.min("dst").alias("whole")).withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy("whole", "sibling")))
    return ranked.filter(F.col("rank") <= k)


def two_hop_chains(edges: DataFrame, k: int = 5) -> DataFrame:
    """(a, b, c, direction, rank): the first k simple chains of two edges that end (backward) or begin (forward) at each concept a."""
    both = edges.select(F.col("dst").alias("x"), F.col("src").alias("y"), F.lit(0).alias("way")).unionByName(edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(1).alias("way"))).filter("x <> y")
    on = both.select("way", F.col("x").alias("b"), F.col("y").alias("c")).withColumn("r", F.row_number().over(Window.partitionBy("way", "b").orderBy("c"))).filter(F.col("r") <= k + 1).drop("r")
    met = both.select("way", F.col("x").alias("a"), F.col("y").alias("b")).join(on, ["way", "b"]).filter("a <> c")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("way", "b", "c"))).filter(F.col("rank") <= k)
    return ranked.select("a", "b", "c", F.when(F.col("way") == 0, "backward").otherwise("forward").alias("direction"), "rank")


def structural_features(concepts: DataFrame, edges: DataFrame, confused: DataFrame) -> DataFrame:
    """(concept, n_prereqs, n_dependents, n_parts, n_wholes, has_two_hop, has_confusable) of every canonical concept.

    An edge runs from a prerequisite to what needs it. A chain of two edges counts whether it ends or begins at the concept.
    """
    pre = edges.filter("type = 'prerequisite'").select("src", "dst")
    part = edges.filter("type = 'part-of'").select("src", "dst")
    base = concepts.select(F.col("canonical").alias("concept"))
    n = lambda d, side, name: d.groupBy(F.col(side).alias("concept")).agg(F.count(F.lit(1)).alias(name))
    asked = lambda d, side: d.join(base.select(F.col("concept").alias(side)), side, "left_semi")
    # whether the other end of an edge goes on, apart from back to the concept, is told by its number of edges
    on = pre.groupBy(F.col("dst").alias("mid")).agg(F.count(F.lit(1)).alias("n"))
    back = asked(pre, "dst").select(F.col("dst").alias("concept"), F.col("src").alias("mid")).join(on, "mid").join(pre.select(F.col("src").alias("concept"), F.col("dst").alias("mid"), F.lit(1).alias("twin")), ["concept", "mid"], "left")
    on2 = pre.groupBy(F.col("src").alias("mid")).agg(F.count(F.lit(1)).alias("n"))
    forth = asked(pre, "src").select(F.col("src").alias("concept"), F.col("dst").alias("mid")).join(on2, "mid").join(pre.select(F.col("dst").alias("concept"), F.col("src").alias("mid"), F.lit(1).alias("twin")), ["concept", "mid"], "left")
    hop = back.unionByName(forth).filter(F.col("n") > F.coalesce("twin", F.lit(0))).select("concept", F.lit(1).alias("hop")).distinct()
    conf = confused.select(F.col("src").alias("concept"), F.lit(1).alias("conf")).distinct()
    for side in (n(pre, "dst", "n_prereqs"), n(pre, "src", "n_dependents"), n(part, "dst", "n_parts"), n(part, "src", "n_wholes"), hop, conf):
        base = base.join(side, "concept", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return base.select("concept", *[zero(c, c) for c in ("n_prereqs", "n_dependents", "n_parts", "n_wholes")], zero("hop", "has_two_hop"), zero("conf", "has_confusable"))


def activated_edges(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """(concept, hop, src, dst): for the first chain of each concept the edge of every hop, whichever way it runs."""
    first = chains.filter("rank = 1").select(F.col("a").alias("concept"), F.explode(F.array(F.struct(F.lit(1).alias("hop"), F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.lit(2).alias("hop"), F.col("b").alias("x"), F.col("c").alias("y")))).alias("h")).select("concept", "h.*")
    both = edges.select("src", "dst", F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(2).alias("way")).unionByName(edges.select("src", "dst", F.col("dst").alias("x"), F.col("src").alias("y"), F.lit(1).alias("way")))
    return first.join(both, ["x", "y"]).groupBy("concept", "hop").agg(F.min_by(F.struct("src", "dst"), "way").alias("e")).select("concept", "hop", "e.src", "e.dst")


def gnn_edges(nodes: DataFrame, semantic: DataFrame, prerequisite: DataFrame, excluded: DataFrame) -> DataFrame:
    """(src, dst, rel): self loops 0, semantic pairs both ways 1, prerequisites forward 2 and backward 3.

    Pairs of `excluded` carry no message in either direction.
    """
    pre = prerequisite.select("src", "dst").join(excluded.select("src", "dst"), ["src", "dst"], "left_anti")
    both = lambda d, r, s: d.select(F.col("src"), F.col("dst"), F.lit(r).alias("rel")).union(d.select(F.col("dst"), F.col("src"), F.lit(s).alias("rel")))
    return nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("rel")).unionByName(both(semantic, 1, 1)).unionByName(both(pre, 2, 3)).distinct()


def message_means(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(dst, rel, n, mean): mean over the neighbours of each node and relation of a node value."""
    return edges.join(values.select(F.col("node").alias("src"), "value"), "src").groupBy("dst", "rel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def fold_masks(positive: DataFrame, k: int = 5) -> DataFrame:
    """(fold, n_held, n_message): positives held out of the message graph of each fold, folds by digest."""
    f = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "src", "dst")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
    folds = positive.withColumn("own", f).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return folds.groupBy("fold").agg(F.count_if(F.col("own") == F.col("fold")).alias("n_held"), F.count_if(F.col("own") != F.col("fold")).alias("n_message"))


def ranking_eligible(positive: DataFrame) -> DataFrame:
    """(src, dst): positives whose reverse is no positive."""
    return positive.join(positive.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
