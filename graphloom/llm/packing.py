"""Filling containers (problem 9): items of varying size put into containers of fixed capacity with little left over.

Method: exact-complement hashing over the histogram of sizes, which has at most `capacity` entries however many items
there are. A container starts with the largest sizes that are left; as soon as its gap equals a single size, the sum
of two or of three sizes that are available, that combination fills it exactly. Each pattern found is consumed as
often as the counts allow, so that every pattern exhausts a size and their number depends on the capacity, not on the
data. When nothing fills a gap exactly, the largest size that fits goes in (best fit).

Items are numbered within their size without a global sort: counts per partition and size give each partition its
offsets, and the plan, a table of runs (size, ranks, container), is joined by size and rank. The plan is bounded by
the capacity and therefore broadcast.

Defined results: an item above the capacity is split into full containers and a rest that is packed like an item;
items of size 0 need no container (bin_id null); null sizes count as 0; equal ids are separate items. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

CAPACITY = 2048


class Sums:
    """Which sizes, and sums of two and three sizes, are available."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.capacity = len(counts) - 1
        self.pairs: dict[int, tuple[int, int]] = {}
        self.triples: dict[int, tuple[int, int, int]] = {}

    def has(self, sizes: tuple[int, ...]) -> bool:
        return all(self.counts[s] >= sizes.count(s) for s in sizes)

    def pair(self, gap: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """Two available sizes with this sum: the remembered ones, or the most plentiful."""
        if (known := self.pairs.get(gap)) and self.has(used + known):
            return known
        a = np.arange(1, gap // 2 + 1)
        if not len(a):
            return None
        left = self.counts[: gap].copy()
        for size in used:
            if size < gap:
                left[size] -= 1
        both = np.minimum(left[a], left[gap - a])
        if gap % 2 == 0:
            both[-1] = left[gap // 2] // 2  # the same size twice
        k = int(np.argmax(both))
        if both[k] <= 0:
            return None
        self.pairs[gap] = (int(gap - a[k]), int(a[k]))
        return self.pairs[gap]

    def triple(self, gap: int, used: tuple[int, ...]) -> tuple[int, int, int] | None:
        if (known := self.triples.get(gap)) and self.has(used + known):
            return known
        sizes = np.flatnonzero(self.counts[: gap - 1])
        for a in sizes[sizes >= gap / 3][::-1]:
            if self.has((*used, int(a))) and (rest := self.pair(gap - int(a), used + (int(a),))) is not None:
                self.triples[gap] = (int(a), *rest)
                return self.triples[gap]
        return None

    def complement(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three available sizes that fill the gap exactly."""
        if self.has((*used, gap)):
            return (gap,)
        return self.pair(gap, used) or self.triple(gap, used)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, sizes) of the containers: each pattern with its multiplicity."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] += n
    sums, out = Sums(left), []
    while True:
        sizes = np.flatnonzero(left)
        if not len(sizes):
            return out
        largest = int(sizes[-1])
        used, gap = (largest,), capacity - largest
        while gap:
            smallest = int(sizes[0])
            if gap < smallest:
                break
            # a gap that three items can't fill yet takes another large item first
            exact = sums.complement(gap, used) if gap <= 3 * largest else None
            if exact:
                used, gap = used + exact, 0
                break
            fits = sizes[sizes <= gap][::-1]
            best = next((int(s) for s in fits if left[s] > used.count(int(s))), None)
            if best is None:
                break
            used, gap = (*used, best), gap - best
        times = min(int(left[s]) // used.count(s) for s in set(used))
        for s in used:
            left[s] -= times
        out.append((times, used))


def runs(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end rank, first container, items per container) of the plan."""
    next_rank: dict[int, int] = {}
    out, container = [], 0
    for times, used in patterns:
        for s in sorted(set(used)):
            per = used.count(s)
            first = next_rank.get(s, 0)
            next_rank[s] = first + times * per
            out.append((s, first, first + times * per, container, per))
        container += times
    return out


def pack(items: DataFrame, id_col: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(id_col, part, part_size, bin_id): container of every item, or of each part of an item above the capacity."""
    spark = items.sparkSession
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    parts = items.select(id_col, n.alias("_n")).select(
        id_col, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0).cast("long")))).alias("part")
    )
    parts = cut(parts.select(id_col, F.col("part").cast("int").alias("part"), F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("part") * capacity).alias("part_size")).withColumn("_p", F.spark_partition_id()))
    by_size = parts.groupBy("part_size", "_p").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["part_size"]: r["n"] for r in by_size.groupBy("part_size").agg(F.sum("n").alias("n")).collect() if r["part_size"] > 0}  # at most `capacity` rows
    offsets = by_size.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("part_size").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = (
        parts.withColumn("local", F.row_number().over(Window.partitionBy("_p", "part_size").orderBy(id_col, "part")) - 1)
        .join(offsets, ["_p", "part_size"])
        .withColumn("rank", F.col("offset") + F.col("local"))
    )
    rows = runs(plan(counts, capacity))
    table = spark.createDataFrame(rows, "part_size long, first long, end long, container long, per long")
    hit = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    r, t = ranked.alias("r"), F.broadcast(table).alias("t")
    return r.join(t, (F.col("r.part_size") == F.col("t.part_size")) & hit, "left").select(
        id_col, "part", F.col("r.part_size").alias("part_size"), (F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).alias("bin_id")
    )


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(capacity, n_bins, n_full, tokens, least_bins, unused_share) of a packing."""
    bins = packed.filter(F.col("bin_id").isNotNull()).groupBy("bin_id").agg(F.sum("part_size").alias("used"))
    return bins.agg(
        F.lit(capacity).alias("capacity"),
        F.count(F.lit(1)).alias("n_bins"),
        F.count_if(F.col("used") == capacity).alias("n_full"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).alias("least_bins"),
        F.round(1 - F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("unused_share"),
    )
