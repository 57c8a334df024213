import random

from graphloom.operators import hierarchy as h

SCHEMA = "part_concept string, whole_concept string, node string, root long"


def rows(spark, pairs):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], SCHEMA)


def brute(pairs):
    parent = {}
    for a, b in pairs:
        if a and b:
            parent[a] = min(b, parent.get(a, b))
    out = {}
    for k in parent:
        seen, x, d = set(), k, 0
        while x in parent and x not in seen:
            seen.add(x)
            x, d = parent[x], d + 1
        out[k] = ("", -1) if x in parent else (x, d)
    return out


def got(df):
    return {r["concept"]: (r["root_concept"], r["depth"]) for r in h.found(df).collect()}


def test_random_forests_with_loops(spark):
    rng = random.Random(3)
    for n in (12, 60):
        pairs = [(f"n{i}", f"n{rng.randrange(n)}") for i in range(n) if rng.random() < 0.9]
        assert got(rows(spark, pairs)) == brute(pairs)


def test_chain_and_loops_of_every_kind(spark):
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("self", "self"), ("a", "b"), ("b", "a"), ("below", "a")]
    assert got(rows(spark, pairs)) == brute(pairs)
    assert {r["concept"] for r in h.loops(rows(spark, pairs)).collect()} == {"self", "a", "b"}


def test_dirty_rows(spark):
    pairs = [("﻿part_concept", "whole_concept"), (" A  b", "C"), ("a b", "c"), ("d", None), (None, "c"), ("", "c"), ("e", " ")]
    assert got(rows(spark, pairs)) == {"a b": ("c", 1)}
    assert got(rows(spark, [])) == {}


def test_paths_descendants_conflicts(spark):
    df = rows(spark, [("a", "b"), ("b", "c"), ("a", "z")])
    assert {r["concept"]: r["path"] for r in h.paths(df).collect()} == {"a": "c > b > a", "b": "c > b"}
    assert {tuple(r) for r in h.descendants(df).collect()} == {("b", "a", 1), ("c", "a", 2), ("c", "b", 1)}
    assert [tuple(r) for r in h.conflicts(df).collect()] == [("a", "z", 2)]
