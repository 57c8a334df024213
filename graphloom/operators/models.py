"""Arithmetic around models: graph scores, views, calibration; and what is handed to and taken from a language model."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.pseudo import label_confidence
from graphloom.session import cut


def bilinear_scores(pairs: DataFrame, vectors: DataFrame, weights: list[float]) -> DataFrame:
    """(src, dst, score) of pairs: sum over the dimensions of source, weight and target, vectors (node, v) joined from both sides."""
    w = F.array(*map(F.lit, weights))
    a, b = (vectors.select(F.col("node").alias(x), F.transform("v", lambda e: e.cast("double")).alias(f"_{x}")) for x in ("src", "dst"))
    terms = F.zip_with(F.zip_with("_src", "_dst", lambda x, y: x * y), w, lambda x, y: x * y)
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", F.aggregate(terms, F.lit(0.0), lambda x, y: x + y).alias("score"))


def thinned_view(edges: DataFrame, share: float, seed: int) -> DataFrame:
    """Edges (src, dst, rel) of a view of a graph: about `share` of them dropped by digest, self loops (rel 0) kept."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "src", "dst", "rel")), 1, 8), 16, 10).cast("double") / float(16**8)
    return edges.filter((F.col("rel") == 0) | (place >= share))


def thinned_features(vector: Column, node: Column, share: float, seed: int) -> Column:
    """Vector with about `share` of its entries set to 0 by digest and the others scaled up for it."""
    keep = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), node.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / float(16**8) >= share
    return F.transform(vector, lambda x, i: F.when(keep(i), x.cast("double") / (1 - share)).otherwise(0.0))


def fit_calibration(rows: DataFrame, rounds: int = 30) -> tuple[float, float]:
    """(temperature, bias) that minimise the cross entropy of y against logit / temperature + bias, temperature in 0.5 .. 10.

    Newton steps; each round is one aggregate over (logit, y, n), counted once per distinct logit, so nothing is collected.
    """
    per = cut(rows.groupBy("logit", "y").agg(F.count(F.lit(1)).alias("n")))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        x, n = F.col("logit"), F.col("n")
        p = 1 / (1 + F.exp(-(x * a + b)))
        e, h = (p - F.col("y")) * n, p * (1 - p) * n
        s = per.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in (("ga", e * x), ("gb", e), ("aa", h * x * x), ("ab", h * x), ("bb", h))]).first()
        hessian = np.array([[s["aa"], s["ab"]], [s["ab"], s["bb"]]]) + np.eye(2) * 1e-9
        step = np.linalg.solve(hessian, np.array([s["ga"], s["gb"]]))
        before = (a, b)
        a, b = float(np.clip(a - np.clip(step[0], -1, 1), 0.1, 2.0)), float(b - np.clip(step[1], -2, 2))
        if abs(a - before[0]) + abs(b - before[1]) < 1e-9:
            break
    return 1 / a, b


def confidence_by_pair(rows: DataFrame) -> DataFrame:
    """(src, dst, conf): confidence of the last row (src, dst, label, combined, ord) of each pair."""
    return rows.groupBy("src", "dst").agg(F.max_by(label_confidence(F.col("label"), F.col("combined")), "ord").alias("conf"))


def relation_counts(edges: DataFrame, others: DataFrame) -> DataFrame:
    """(type, n, n_shared): edges by type, and how many of them are pairs (src, dst) of other rows."""
    o = others.select("src", "dst", F.lit(1).alias("hit")).distinct()
    return edges.join(o, ["src", "dst"], "left").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_shared"))


def prompts(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, n, payload): all rows of a key as one JSON list in the order of their fields."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("payload"))


def excerpts(wanted: DataFrame, profiles: DataFrame, contexts: DataFrame, per: int = 3, most: int = 30, cut_at: int = 800) -> DataFrame:
    """(target, rank, concept, source, text): profile and the first `per` contexts of each concept (target, concept, ord), `most` in all."""
    p = wanted.join(profiles, "concept").select("target", "concept", "ord", F.lit(0).alias("k"), F.lit("profile").alias("source"), F.col("profile").alias("text"))
    c = contexts.withColumn("k", F.row_number().over(Window.partitionBy("concept").orderBy("id", "text"))).filter(F.col("k") <= per)
    rows = p.unionByName(wanted.join(c, "concept").select("target", "concept", "ord", "k", F.col("id").alias("source"), "text")).filter(F.trim("text") != "")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("ord", "concept", "k", "source"))).filter(F.col("rank") <= most)
    return ranked.select("target", "rank", "concept", "source", F.substring("text", 1, cut_at).alias("text"))


def definitions(concepts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(concept, definition, origin): profiles (concept, profile) laid onto concepts (concept); an unknown name makes a new concept."""
    j = concepts.select("concept", F.lit(1).alias("c")).join(profiles.select("concept", F.col("profile").alias("p")), "concept", "full")
    return j.select("concept", F.coalesce("p", F.lit("")).alias("definition"), F.when(F.col("c").isNull(), "new").when(F.col("p").isNull(), "bare").otherwise("known").alias("origin"))


def distractor_record(option: Column, correct: Column) -> Column:
    """What is said of a wrong option: why it may be taken, how it differs, and why it excludes the answer."""
    say = lambda text: F.format_string(text, option, correct)
    return F.struct(
        say("%s is locally related to %s in the graph or topic and may be confused by learners.").alias("reason"), say("%s is not the requested answer %s or its specified relation.").alias("diff"),
        say("Choosing %s would conflict with the definition or graph relation for %s.").alias("exclusive"),
    )


def lettered(options: Column) -> Column:
    """A list of options as a map from A, B, C and so on."""
    return F.map_from_entries(F.transform(options, lambda x, i: F.struct(F.char(i + 65).alias("k"), x.alias("v"))))


def backoff(attempt: int, status: int | None) -> float | None:
    """Seconds to wait before the next try of a request, or None if it must not be tried again: only 429 and server faults are."""
    return min(30.0, 2.0**attempt) if status is None or status == 429 or status >= 500 else None


def relative_asset(path: str, base: str) -> str:
    """Path of an asset as seen from a folder, with forward slashes; what lies outside stays as it is."""
    rel = os.path.relpath(path, base)
    return path if rel.startswith("..") else rel.replace(os.sep, "/")
