"""Hierarchies from parent-child rows (problem 6): path, depth, root and descendants of every node, loops reported.

Method: hash splitters. About one node in `every` is a splitter, chosen by a fixed hash of its name, and so is every
root. Each node walks to its next splitter by doubling steps, each step one join of the pointer table with itself in
which arrived pointers take no further part. The walk of the splitters themselves gives a reduced pointer graph, an
`every`-th of the size, which is solved by the same doubling; every node then takes root and depth from its splitter.
Nodes whose walk meets no splitter stand on, or below, a loop without one and are reported as such; splitters whose
reduced walk meets no root likewise.

Rounds are logarithmic in the longest gap and in the depth, so a chain of a million nodes takes some 20 joins.

Defined results: names are compared in lower case, trimmed, with single spaces, without a byte order mark; rows that
repeat the header, with a null or empty part, or a null or empty whole, are no edges; repeated edges count once; of
several wholes of a part the smallest name counts (a tree has one parent) and the others are given by `conflicts`;
a node that is its own whole is a loop of one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, lookup_join

EVERY = 8


def clean_name(x: Column) -> Column:
    """Lower case, trimmed, single spaces, without a byte order mark."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "﻿", ""), r"(?U)\s+", " ")))


def all_edges(df: DataFrame, part: str = "part_concept", whole: str = "whole_concept") -> DataFrame:
    """Distinct (node, parent) of the rows that are edges."""
    return (
        df.select(clean_name(F.col(part)).alias("node"), clean_name(F.col(whole)).alias("parent"))
        .filter((F.col("node") != "") & (F.col("parent") != "") & ~((F.col("node") == part) & (F.col("parent") == whole)))
        .distinct()
    )


def edges(df: DataFrame, part: str = "part_concept", whole: str = "whole_concept") -> DataFrame:
    """(node, parent), one row per node."""
    return all_edges(df, part, whole).groupBy("node").agg(F.min("parent").alias("parent"))


def conflicts(df: DataFrame, part: str = "part_concept", whole: str = "whole_concept") -> DataFrame:
    """(node, parent, n_parents): further wholes of parts that have several."""
    return (
        all_edges(df, part, whole)
        .groupBy("node")
        .agg(F.min("parent").alias("kept"), F.count(F.lit(1)).alias("n_parents"), F.collect_set("parent").alias("parents"))
        .filter("n_parents > 1")
        .select("node", F.explode("parents").alias("parent"), "n_parents", "kept")
        .filter("parent <> kept")
        .drop("kept")
    )


def _stops(node: Column, every: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(every)) == 0


def _double(pointers: DataFrame, payload: bool) -> DataFrame:
    """Pointers (node, ptr, dist, open[, path]) jumped until none that can still arrive is open.

    An open pointer stands on a node that is no stop. A round joins the open pointers with the pointers of the nodes
    they stand on, so after r rounds an open one has walked 2^r edges. A pointer with g edges to go implies others on
    its way with each smaller number, so every round closes one unless all that is open runs in a loop: a round that
    closes none is the last. A parent with very many children makes skewed join keys on the left only (the right side
    is unique), which the adaptive skew join splits.
    """
    live, before = cut(pointers), -1
    while True:
        now = live.filter("open").count()
        if now in (0, before):
            return live
        ahead = live.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("open").alias("open2"), *([F.col("path").alias("path2")] if payload else []))
        moved = live.filter("open").join(ahead, "ptr").select(
            "node", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("open2").alias("open"), *([F.concat("path", "path2").alias("path")] if payload else [])
        )
        live, before = cut(live.filter(~F.col("open")).unionByName(moved)), now


def solve(tree: DataFrame, every: int = EVERY, with_path: bool = False) -> DataFrame:
    """(node, root, depth[, path]) of every node of (node, parent); root null for nodes on a loop or below one.

    path holds the names from the node's parent up to the root.
    """
    tree = cut(tree)
    extra = [F.array("parent").alias("path")] if with_path else []
    is_root = tree.select("parent").distinct().join(tree.select(F.col("node").alias("parent")), "parent", "left_anti").withColumn("is_root", F.lit(True))
    first = cut(lookup_join(tree, is_root, "parent", "left").select("node", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("dist"), F.coalesce("is_root", F.lit(False)).alias("at_root"), *extra))
    walk = _double(first.withColumn("open", ~F.col("at_root") & ~_stops(F.col("ptr"), every)).drop("at_root"), with_path)

    # reduced graph: splitters that are no roots, each with its next stop
    roots = is_root.select(F.col("parent").alias("ptr"), "is_root")
    arrived = cut(lookup_join(walk.filter(~F.col("open")), roots, "ptr", "left").withColumn("at_root", F.coalesce("is_root", F.lit(False))).drop("is_root", "open"))
    splitters = arrived.filter(_stops(F.col("node"), every)).withColumn("open", ~F.col("at_root")).drop("at_root")
    # a splitter whose walk meets no further stop has no pointer; pointers onto it are dropped by the join, as loops
    solved = _double(splitters, with_path).filter(~F.col("open")).select(F.col("node").alias("ptr"), F.col("ptr").alias("root"), F.col("dist").alias("dist2"), *([F.col("path").alias("path2")] if with_path else []))
    direct = arrived.filter("at_root").select("node", F.col("ptr").alias("root"), F.col("dist").alias("depth"), *(["path"] if with_path else []))
    through = lookup_join(arrived.filter(~F.col("at_root")), solved, "ptr").select("node", "root", (F.col("dist") + F.col("dist2")).alias("depth"), *([F.concat("path", "path2").alias("path")] if with_path else []))
    known = direct.unionByName(through)
    return tree.select("node").join(known, "node", "left")


def found(df: DataFrame) -> DataFrame:
    """(concept, root_concept, depth); '' and -1 for names on a loop or below one."""
    return solve(edges(df)).select(F.col("node").alias("concept"), F.coalesce("root", F.lit("")).alias("root_concept"), F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"))


def paths(df: DataFrame) -> DataFrame:
    """(concept, root_concept, depth, path): path from the root down to the concept, joined by ' > '; null on loops."""
    solved = solve(edges(df), with_path=True)
    return solved.select(
        F.col("node").alias("concept"),
        F.coalesce("root", F.lit("")).alias("root_concept"),
        F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"),
        F.when(F.col("path").isNotNull(), F.array_join(F.concat(F.reverse("path"), F.array("node")), " > ")).alias("path"),
    )


def descendants(df: DataFrame) -> DataFrame:
    """(ancestor, concept, distance) of every pair of a name and a name below it, loops left out."""
    solved = solve(edges(df), with_path=True).filter(F.col("path").isNotNull())
    return solved.select("node", F.posexplode("path").alias("up", "ancestor")).select("ancestor", F.col("node").alias("concept"), (F.col("up") + 1).alias("distance"))


def loops(df: DataFrame) -> DataFrame:
    """(concept): names that stand on a loop, without those that only lead to one.

    The parent of a name without a root has none either. Who takes at least as many steps as there are such names ends
    on a loop, and every name of a loop is the end of one that stands on it; so the ends of 2^k steps are the loops'
    names. Steps double in each round, so there are as many rounds as the logarithm of the number of lost names.
    """
    tree = edges(df)
    steps = cut(solve(tree).filter(F.col("root").isNull()).select("node").join(tree, "node"))
    total, taken = steps.count(), 1
    while taken < total:
        steps = cut(steps.join(steps.select(F.col("node").alias("parent"), F.col("parent").alias("next")), "parent").select("node", F.col("next").alias("parent")))
        taken *= 2
    return steps.select(F.col("parent").alias("concept")).distinct()
