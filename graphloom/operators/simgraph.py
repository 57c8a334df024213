"""Similarity graphs: exact top-k neighbours by cosine in blocks, symmetrised adjacency, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut, nonempty, width

TOP = "src long, dst long, weight double"


def topk_cosine(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, block: int = 2048) -> DataFrame:
    """(src, dst, weight): the k most similar other vectors of each, ties by smaller id; zero vectors have cosine 0.

    Vectors are cut into blocks; each pair of blocks is one task, which multiplies two matrices and keeps k rows per
    source, so no pair of vectors leaves a task unless it is among its block's best. Work is quadratic, as the exact
    answer needs, and evenly spread; memory is two blocks.
    """
    rows = cut(vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")))
    blocks = max(1, -(-rows.count() // block))
    numbered = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = cut(numbered.groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("rows")))
    pairs = packed.select(F.col("b").alias("lb"), F.col("rows").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb")).join(
        packed.select(F.col("b").alias("rb"), F.col("rows").alias("r")), "rb"
    )

    def unit(part) -> tuple[np.ndarray, np.ndarray]:
        m = np.array([x["v"] for x in part], dtype=np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.array([x["id"] for x in part]), m / np.where(norm == 0, 1, norm)

    @nonempty
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right in zip(batch["l"], batch["r"]):
                (li, lm), (ri, rm) = unit(left), unit(right)
                order = np.argsort(ri, kind="stable")
                ri, rm = ri[order], rm[order]
                sim = lm @ rm.T
                sim[li[:, None] == ri[None, :]] = -np.inf
                take = min(k, len(ri))
                top = np.argsort(-np.round(sim, 12), axis=1, kind="stable")[:, :take]
                weight = np.take_along_axis(sim, top, 1)
                out = pd.DataFrame({"src": np.repeat(li, take), "dst": ri[top].ravel(), "weight": weight.ravel()})
                yield out[np.isfinite(out["weight"])]

    near = pairs.repartition(max(width(rows), blocks)).select("l", "r").mapInPandas(best, TOP)
    rank = Window.partitionBy("src").orderBy(F.desc(F.round("weight", 12)), "dst")
    return near.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def symmetrised(directed: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst: the larger of both directions where an absent one counts 0; zero is no edge."""
    pairs = directed.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", (F.col("src") < F.col("dst")).alias("up"))
    both = pairs.groupBy("src", "dst").agg(
        F.greatest(F.coalesce(F.max(F.when(F.col("up"), F.col("weight"))), F.lit(0.0)), F.coalesce(F.max(F.when(~F.col("up"), F.col("weight"))), F.lit(0.0))).alias("weight")
    )
    return both.filter("weight <> 0")


def pair_set(directed: DataFrame) -> DataFrame:
    """(src, dst), src < dst: pairs met in either direction, whatever their weight."""
    return directed.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): smallest id of the connected component, by label propagation with pointer jumping.

    Each round takes the smallest label among the neighbours and then the label of that label, so rounds are
    logarithmic for chains. Neighbour minima are pre-aggregated before the shuffle.
    """
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst"), F.col("src"))).distinct())
    labels = cut(nodes.select(F.col("node"), F.col("node").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("label", F.coalesce("near", F.col("label"))).alias("label"))
        hooked = cut(hooked)
        jumped = cut(
            hooked.join(hooked.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.least("label", F.coalesce("up", F.col("label"))).alias("label"))
        )
        if jumped.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").isEmpty():
            return jumped.withColumnRenamed("label", "component")
        labels = jumped


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_nodes, n_components, largest, coverage) of a graph."""
    sizes = components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.sum("size").alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest")).withColumn("coverage", F.round(F.col("largest") / F.col("n_nodes"), 6))


def adaptive_graph(vectors: DataFrame, k: int = 10, fallback_k: int = 20, least: float = 0.9) -> DataFrame:
    """Symmetrised graph with k neighbours, rebuilt with more of them if its largest component covers too little."""
    nodes = vectors.select(F.col("vec_id").cast("long").alias("node"))
    graph = cut(symmetrised(topk_cosine(vectors, k=k)))
    row = coverage(nodes, graph).first()
    return graph if row["coverage"] is None or row["coverage"] >= least else symmetrised(topk_cosine(vectors, k=fallback_k))
