"""Core operators on the shapes that the reference behaviour fixes, and the catalogue against DuckDB."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import keys
from graphloom.operators import aliases, evidence, graphq, labels, metrics, pseudo, simgraph
from graphloom.operators import publication, quiz
from graphloom.plans import catalogue, registry
from graphloom.sources import readers, sinks
from graphloom.streaming import increments

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def canon(v):
    return round(float(v), 5) if isinstance(v, float) else tuple(map(canon, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_catalogue_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    r = duck.execute(catalogue.SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    a = sorted((tuple(canon(x[c]) for c in cols) for x in df.collect()), key=repr)
    assert a == sorted((tuple(map(canon, x)) for x in r.fetchall()), key=repr)


def test_registry_has_sql_only_for_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_knn_of_four_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.1, 0.9]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    near = {(r["src"], r["dst"]) for r in simgraph.topk_cosine(v, k=1, block=2).collect() if r["src"] < 4}
    assert near == {(0, 1), (1, 0), (2, 3), (3, 2)}
    graph = simgraph.symmetrised(simgraph.topk_cosine(v.filter("vec_id < 4"), k=1))
    assert {(r["src"], r["dst"]) for r in graph.collect()} == {(0, 1), (2, 3)}
    row = simgraph.coverage(v.filter("vec_id < 4").select(F.col("vec_id").alias("node")), graph).first()
    assert (row["n_components"], row["coverage"]) == (2, 0.5)


def test_conflicts_keep_the_surer_row(spark):
    s = "src int, dst int, label int, combined double"
    gold = spark.createDataFrame([(0, 1)], "src int, dst int")
    memory = spark.createDataFrame([(7, 8, 1, 0.91), (1, 2, 0, 0.05)], s)
    new = spark.createDataFrame([(1, 2, 1, 0.70), (7, 8, 0, 0.20), (0, 1, 0, 0.01), (2, 3, 1, 0.85)], s)
    rows = {(r["src"], r["dst"], r["label"], r["origin"]) for r in pseudo.resolve_conflicts(gold, memory, new).collect()}
    assert rows == {(7, 8, 1, "memory"), (1, 2, 0, "memory"), (2, 3, 1, "new")}


def test_append_rows(spark):
    old = spark.createDataFrame([(0, 1, 1)], "src int, dst int, label int")
    new = spark.createDataFrame([(1, 0, 1, 1), (2, 1, 0, 1), (3, 0, 2, 1), (4, 0, 2, 1)], "ord int, src int, dst int, label int")
    assert {r["ord"]: r["status"] for r in labels.append_public_rows(old, new).collect()} == {1: "duplicate", 2: "conflict", 3: "accepted", 4: "duplicate"}


def test_metrics_with_empty_class_and_ties(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9)], "y int, score double")
    assert metrics.auc(rows).first()[0] == 0.75
    assert metrics.auc(rows.filter("y = 1")).first()[0] == 0.5
    assert metrics.confusion(rows.filter("y = 0"), 0.9).first()["f1"] == 0


def test_stability_in_batch_and_stream_agree(spark, tmp_path):
    data = [(1, 1, "a", 1, 1), (1, 1, "a", 1, 2), (1, 2, "b", 1, 3), (1, 3, "a", 0, 4), (2, 1, "a", 0, 5)]
    df = spark.createDataFrame(data, "pair long, round int, teacher string, label int, ord long")
    batch = {r["pair"]: (r["label"], r["hits"], r["conflicts"]) for r in pseudo.stable_hits(df).collect()}
    assert batch == {1: (0, 1, 1), 2: (0, 1, 0)}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = increments.stable_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["pair"]: (r["label"], r["hits"], r["conflicts"]) for r in spark.sql("select * from tracked").collect()} == batch


def test_alias_policies(spark):
    c = spark.createDataFrame([(0, "a", "x", None), (1, "b", "x", "y"), (2, "y", "z", None)], "concept_id int, canonical string, alias_1 string, alias_2 string")
    rows = aliases.alias_rows(c)
    as_dict = lambda d: {r["alias_key"]: r["concept_id"] for r in d.collect()}
    assert as_dict(aliases.first_wins(rows)) == {"a": 0, "x": 0, "b": 1, "y": 1, "z": 2}
    assert as_dict(aliases.unique_only(rows)) == {"a": 0, "b": 1, "y": 2, "z": 2}
    assert as_dict(aliases.last_wins(rows)) == {"a": 0, "x": 1, "b": 1, "y": 1, "z": 1}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿Alpha,"be\nta",alpha\n\nGamma\n')
    assert [tuple(r) for r in readers.concepts(spark, str(tmp_path / "c.csv")).orderBy("concept_id").collect()] == [(0, "alpha", ["be ta"]), (1, "gamma", [])]
    (tmp_path / "c.txt").write_text("a::;b::;a\nc\n")
    assert readers.concepts(spark, str(tmp_path / "c.txt")).count() == 2
    (tmp_path / "l.csv").write_text("a,b,1\na,,0\na,b,2\na,b\n")
    assert [r["reason"] for r in readers.labels_csv(spark, str(tmp_path / "l.csv")).orderBy("ord").collect()] == [None, "missing_name", "bad_label", "width"]
    (tmp_path / "l.tsv").write_text("a\tb\t1-\na\tb\t-1\na\tb\t-\n")
    assert [tuple(r)[1:] for r in readers.labels_tsv(spark, str(tmp_path / "l.tsv")).orderBy("ord").collect()] == [("a", "b", 1), ("b", "a", 1), ("a", "b", 0)]
    (tmp_path / "r.txt").write_text("a part-of b\nx\n")
    assert [tuple(r) for r in readers.relation_text(spark, str(tmp_path / "r.txt")).collect()] == [("a", "b")]
    assert readers.chapters("1-3,5") == [1, 2, 3, 5]
    with pytest.raises(ValueError):
        readers.chapters("3-1")
    assert readers.expand("${A:-x}-${B}", {"B": "y"}) == "x-y"
    assert sinks.write_json(str(tmp_path / "s.json"), {"a": 1}) and not sinks.write_json(str(tmp_path / "s.json"), {"a": 1})
    nodes = spark.createDataFrame([("a", "A"), ("b", "B&")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "part-of", None)], "src string, dst string, type string, weight double")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    assert "B&amp;" in (tmp_path / "g.graphml").read_text()
    with pytest.raises(ValueError):
        sinks.write_graphml(nodes.filter("id = 'a'"), edges, str(tmp_path / "h.graphml"))
    assert sinks.publish_if_complete(nodes, spark.createDataFrame([("c",)], "id string"), "id", str(tmp_path / "p")) == 1


def test_fuzzy_and_phrases(spark):
    assert evidence.fuzzy_equal("gradient descent", "gradient descents") and not evidence.fuzzy_equal("l1 norm", "l2 norm")
    t = spark.createDataFrame([(1, "Deep neural network and neural net"), (2, None)], "id long, text string")
    p = spark.createDataFrame([("neural network",), ("deep neural network",), ("neural net",)], "phrase string")
    assert {(r["phrase"], r["n"]) for r in evidence.phrase_matches(t, p, "id", "text").collect()} == {("deep neural network", 1), ("neural net", 1)}


def test_merge_compares_all_names_and_aliases(spark):
    rng = random.Random(3)
    made = ["regularization", "rgeularization", "regularizations", "xegularizations"]
    for _ in range(150):
        w = list(rng.choice(["sparse gradient descent", "deep network pruning", "l1 lattice", "l2 lattice", "one two three four five"]))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("abe ")
        made.append(" ".join("".join(w).split()))
    rows = [("g", n, len(made) - i, i) for i, n in enumerate(dict.fromkeys(made))]
    entries, want = [], {}
    for _, name, _, _ in rows:  # the rule without an index
        hit = next((e for e in entries if any(evidence.fuzzy_equal(name, other) for other in e)), None)
        if hit is None:
            entries.append(hit := [])
        hit.append(name)
        want[name] = hit[0]
    got = {r["name"]: r["merged_into"] for r in evidence.greedy_merge(spark.createDataFrame(rows, "group string, name string, relevance long, page long")).collect()}
    assert got == want and got["rgeularization"] == "regularization" and got["xegularizations"] == "regularization"
    assert not evidence.fuzzy_equal("xegularizations", "regularization")
    aliased = spark.createDataFrame([("g", "ridge", 2, 1, ["tikhonov"]), ("g", "weight decay", 1, 1, ["tikhonovs"])], "group string, name string, relevance long, page long, aliases array<string>")
    assert {r["merged_into"] for r in evidence.greedy_merge(aliased).collect()} == {"ridge"}


def test_keys(spark):
    row = spark.createDataFrame([("  Batch\tNormalised  Policies—bosses ",)], "x string").select(keys.clean_field(F.col("x")).alias("a"), keys.plural_key(F.col("x")).alias("b"), keys.slug(F.lit("!!")).alias("c"), keys.folded(F.lit("Straße")).alias("d")).first()
    assert row["b"] == "batch normalised policy bosse"  # -ses keeps its e by the rule
    assert row["c"] == "item" and row["d"] == "strasse"


def test_sibling_parts_of_a_hot_whole(spark):
    rows = spark.createDataFrame([(f"p{i:03d}", "w") for i in range(300)], "src string, dst string")
    got = graphq.sibling_parts(rows, 2)
    assert got.count() == 600 and got.filter("concept = 'p000'").orderBy("rank").first()["sibling"] == "p001"


def test_claims(spark):
    schema = "i int, claims array<struct<text: string, kind: string, ids: array<string>>>"
    ok, bare, back = ("a", "source_supported", ["1"]), ("a", "source_supported", []), ("b", "background_context", [])
    rows = [(0, [ok, back]), (1, []), (2, None), (3, [("a", "other", [])]), (4, [bare]), (5, [("b", "background_context", ["1"])]), (6, [back, back])]
    got = {r["i"]: r["r"] for r in spark.createDataFrame(rows, schema).select("i", publication.claims_reason(F.col("claims")).alias("r")).collect()}
    assert got == {0: "ok", 1: "none", 2: "none", 3: "kind", 4: "unsupported", 5: "background_ids", 6: "backgrounds"}


def test_features_read_prerequisites_backwards(spark):
    e = spark.createDataFrame([("cost function", "gradient descent", "prerequisite"), ("derivative", "cost function", "prerequisite"), ("hidden layer", "neural network", "part-of"), ("a", "b", "prerequisite"), ("b", "a", "prerequisite")], "src string, dst string, type string")
    names = spark.createDataFrame([(x,) for x in ("gradient descent", "cost function", "derivative", "neural network", "hidden layer", "a", "soft margin", "hard margin", "lone")], "canonical string")
    f = {r["concept"]: r for r in graphq.structural_features(names, e, graphq.confusable(names)).collect()}
    assert (f["gradient descent"]["n_prereqs"], f["gradient descent"]["has_two_hop"], f["derivative"]["n_prereqs"], f["derivative"]["has_two_hop"]) == (1, 1, 0, 1)
    assert (f["a"]["has_two_hop"], f["cost function"]["has_two_hop"], f["soft margin"]["has_confusable"], f["hidden layer"]["n_wholes"]) == (0, 0, 1, 1)
    features = graphq.structural_features(names, e, graphq.confusable(names))
    plans = {(r["concept"], r["plan"]) for r in quiz.plans(features).collect()}
    assert {("soft margin", "concept_discrimination"), ("gradient descent", "prerequisite_dependency"), ("neural network", "component_membership"), ("hidden layer", "whole_decomposition"), ("derivative", "multi_hop_reasoning"), ("lone", "definition")} <= plans
    levels = {(r["concept"], r["plan"]): (r["bloom"], r["difficulty"]) for r in quiz.levels(quiz.plans(features), features).collect()}
    assert levels["soft margin", "concept_discrimination"] == ("analysis", "medium") and levels["gradient descent", "prerequisite_dependency"] == ("application", "hard") and levels["lone", "definition"] == ("understanding", "easy")
    chains = {tuple(r)[:4] for r in graphq.two_hop_chains(e.filter("type = 'prerequisite'")).collect()}
    assert chains == {("gradient descent", "cost function", "derivative", "backward"), ("derivative", "cost function", "gradient descent", "forward")}


def test_checks_go_to_whoever_failed_first(spark):
    row = {c: True for c in quiz.CHECKS}
    rows = [row, row | {"on_topic": False, "bloom_aligned": False}, row | {"distractors_valid": False}, row | {"clear_language": False}, row | {"graph_faithful": False}, row | {"bloom_aligned": False}]
    got = [(r["passed"], r["route"]) for r in quiz.routed(spark.createDataFrame([tuple(x[c] for c in quiz.CHECKS) for x in rows], ", ".join(f"{c} boolean" for c in quiz.CHECKS))).collect()]
    assert got == [(True, None), (False, "planner"), (False, "answer_distractor"), (False, "writer"), (False, "answer_distractor"), (False, "writer")]
    given = spark.createDataFrame([({"stem_clarity": "yes", "clarity": "no"},)], "g map<string,string>")
    assert given.select(quiz.named_check(F.col("g"), "clear_language")).first()[0] == "yes"


def test_weak_options_and_mentions(spark):
    t = spark.createDataFrame([("Which method?", "confusion matrix"), ("Which metric?", "ridge regression"), ("Which concept?", "training error"), ("Which method?", "bootstrap"), ("Which error?", "recall")], "s string, o string")
    assert [r[0] for r in t.select(quiz.weak_option(quiz.expected_type(F.col("s")), quiz.concept_type(F.col("o")))).collect()] == [True, True, False, False, True]
    terms = spark.createDataFrame([("core loop",), ("loop",), ("k-means",), ("lone",)], "term string")
    texts = spark.createDataFrame([(1, "The Core  loop runs."), (2, "Loops of k-means."), (3, None)], "id int, text string")
    assert {tuple(r) for r in quiz.mentions(terms, texts).collect()} == {("core loop", 1), ("loop", 1), ("k-means", 2)}


def test_hits_of_the_stretch(spark):
    data = [(1, 1, "a", 1, 1, 0.6), (1, 1, "b", 1, 2, 0.9), (1, 2, "a", 1, 3, 0.7), (1, 2, "b", 1, 4, 0.8), (2, 1, "a", 1, 5, 0.9), (2, 2, "a", 0, 6, 0.2), (2, 3, "a", 0, 7, 0.3)]
    df = spark.createDataFrame(data, "pair long, round int, teacher string, label int, ord long, combined double")
    assert {r["pair"]: (r["label"], r["hits"], r["conflicts"]) for r in pseudo.stable_hits(df).collect()} == {1: (1, 3, 0), 2: (0, 2, 1)}
    assert {(r["pair"], r["round"], r["label"], r["row"]) for r in pseudo.newly_stable(df, 2).collect()} == {(1, 1, 1, 2), (2, 3, 0, 6)}
    assert {(r["pair"], r["row"]) for r in pseudo.newly_stable(df, 1).collect()} == {(1, 1), (2, 5)}


def test_random_pairs_are_whole_or_an_error(spark):
    nodes = spark.createDataFrame([(10 * k, k) for k in range(5)], "node long, n long")
    taken = spark.createDataFrame([(0, 10), (10, 0)], "src long, dst long")
    got = {tuple(r) for r in labels.random_pairs(nodes, taken, 18, 7).collect()}
    assert len(got) == 18 and not got & {(0, 10), (10, 0)} and all(a != b for a, b in got)
    with pytest.raises(ValueError):
        labels.random_pairs(nodes, taken, 19, 7)


def test_numbered_and_auc_over_many_ranges(spark):
    from graphloom.session import numbered

    rng = random.Random(4)
    rows = [(rng.randrange(50), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    assert [(r["a"], r["b"]) for r in sorted(numbered(df, "a", "b", name="place").collect(), key=lambda r: r["place"])] == sorted(rows)
    scored = [(k % 3 % 2, rng.randrange(20) / 20, k % 2) for k in range(200)]
    got = {r["g"]: r["auc"] for r in metrics.auc(spark.createDataFrame(scored, "y int, score double, g int"), ["g"]).collect()}
    for g in (0, 1):
        pos, neg = [s for y, s, h in scored if y and h == g], [s for y, s, h in scored if not y and h == g]
        assert abs(got[g] - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-5


def test_rounds_alternate_and_keep_gold(spark):
    scored = spark.createDataFrame([(k, k + 1, k / 40, 1 - k / 40, 0.5) for k in range(41)], "src int, dst int, content double, graph double, judge double")
    gold = spark.createDataFrame([(0, 1)], "src int, dst int")
    memory, log = pseudo.alternate(scored, gold, 40, 4, 0.2)
    assert [(r["teacher"], r["n_new"]) for r in log.orderBy("round").collect()] == [("content", 8), ("graph", 8), ("content", 3), ("graph", 0)]
    rows = {(r["src"], r["label"]) for r in memory.collect()}
    assert (40, 1) in rows and (0, 0) not in rows


def test_refused_options_are_replaced(spark):
    answered = spark.createDataFrame([("a", "p", "a", "x"), ("b", "p", "b", "x")], "concept string, plan string, correct string, basis string")
    made = spark.createDataFrame([("a", "p", "Which method fits?", {"A": "a", "B": "training error", "C": "ridge regression", "D": "c"}, "A"), ("b", "p", "Which one?", {"A": "b", "B": "c", "C": "d", "D": "e"}, "A")], "concept string, plan string, stem string, options map<string,string>, answer string")
    review = quiz.distractor_review(made)
    assert {(r["concept"], r["n_weak"], r["weak"], r["passed"], r["constraint"]) for r in review.collect()} == {("a", 1, "B=training error", False, "methods"), ("b", 0, "", True, "same type")}
    pool = spark.createDataFrame([("a", "training error", "s", 1, 1), ("a", "test set", "s", 1, 2), ("a", "greedy algorithm", "s", 1, 3), ("a", "a", "s", 1, 4)], "name string, option string, source string, prio int, rank int")
    assert [(r["option"], r["source"]) for r in quiz.revised(answered, made, review, pool).orderBy("rank").collect()] == [("greedy algorithm", "s"), ("hold-out validation", "synthetic"), ("bootstrap validation", "synthetic")]


def test_reports_on_cases_that_the_tables_lack(spark):
    from graphloom.operators import extraction, hierarchy

    rows = spark.createDataFrame([("1", "a", "The core loop runs."), ("2", "a", "core LOOP"), ("3", "b", "core loop"), ("4", "a", "the core-loop runs"), ("5", "a", "")], "id string, concept string, evidence string")
    assert {tuple(r) for r in publication.contained_evidence(rows).collect()} == {("2", "1")}
    parts = spark.createDataFrame([("X", "b"), ("x ", "A"), ("x", "a"), ("y", "z")], "part_concept string, whole_concept string")
    assert {tuple(r) for r in hierarchy.conflicts(parts).collect()} == {("x", "b", 2)}
    names = spark.createDataFrame([(1, f"n{k}") for k in range(20)] + [(2, "m"), (2, "m")], "chapter int, name string")
    assert {tuple(r) for r in extraction.thin_chapters(names).collect()} == {(2, 1)}
    pools = spark.createDataFrame([(1, 2, 0, "hard"), (1, 2, 0, None), (2, 3, 0, "hard"), (2, 3, 1, "none")], "source_id int, target_id int, label int, negative_type string")
    assert {tuple(r) for r in labels.overlapping_pools(pools).collect()} == {(1, 2, 2)}


def test_loops_by_doubling_match_brute_force(spark):
    from graphloom.operators import hierarchy

    rng = random.Random(11)
    parent = {f"n{k}": f"n{rng.randrange(60)}" for k in range(45)} | {f"c{k}": f"c{k + 1}" for k in range(40)} | {"c40": "c33"}
    on_loop = set()
    for x in parent:
        y, seen = parent[x], set()
        while y in parent and y not in seen and y != x:
            seen.add(y)
            y = parent[y]
        if y == x:
            on_loop.add(x)
    df = spark.createDataFrame(list(parent.items()), "part_concept string, whole_concept string")
    assert {r[0] for r in hierarchy.loops(df).collect()} == on_loop and on_loop
