"""Scalar functions, settings, extraction and profile operators on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import texts
from graphloom.operators import evidence, extraction, publication
from graphloom.sources import settings, sinks


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", list: "array<string>", dict: "map<string,string>", bytes: "binary", type(None): "string"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int") if values else spark.range(1)
    return row.select(column).first()[0]


def test_cleaning(spark):
    assert one(spark, texts.clean_text(F.col("t"), 12), t="  ﬁrst\x00  \t line and more ") == "first line a"
    assert one(spark, texts.append_sentences(F.col("a"), F.col("b")), a="A b. C d!", b="a B. E f? C d. 40) g.") == "A b. C d. E f. 40) g"
    assert one(spark, texts.append_sentences(F.col("a"), F.col("b")), a="A b.", b="a b!") == "A b."
    assert one(spark, texts.append_sentences(F.col("a"), F.col("b")), a="", b="X.") == "X"
    assert one(spark, texts.append_sentences(F.col("a"), F.col("b")), a="A.", b=None) == "A."
    assert [one(spark, texts.is_duplicate(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("The core-loop runs.", "core LOOP"), ("x", "!"), ("x", "y"))] == [True, False, False]
    assert one(spark, texts.marked_pages(F.col("t")), t="[PDF_PAGE 12 | x] a [PDF_PAGE 3 |") == [12, 3]
    assert [one(spark, texts.strict_int(F.col("t")), t=t) for t in (" 12", "true", "1.5", "-3", "")] == [12, None, None, -3, None]
    assert one(spark, texts.compact_formula(F.col("t")), t="A  =\n b") == "a=b"
    assert one(spark, texts.latex_escaped(F.col("t")), t=r"a_b \ {50%} ~^") == r"a\_b \textbackslash{} \{50\%\} \textasciitilde{}\textasciicircum{}"
    assert one(spark, texts.latex_escaped(F.col("t")), t=None) == ""
    assert one(spark, texts.latex_restored(F.col("t")), t="\x08eta \x0crac{1}{2} \theta \rho\t x") == r"\beta \frac{1}{2} \theta \rho" + "\t x"


def test_lists_and_maps(spark):
    assert one(spark, texts.unique_fields(F.col("l")), l=["A  b", "a b", "c"]) == ["A  b", "c"]
    assert one(spark, texts.unique_folded(F.col("l")), l=[" X", "x", "", "y"]) == ["X", "y"]
    assert one(spark, texts.merged_aliases(F.col("c"), F.col("l")), c="core loop", l=["Core-Loop", "CL", "cl", "main loop"]) == ["CL", "main loop"]
    assert one(spark, texts.public_fields(F.col("m"), ("z",)), m={"a": "1", "b": "", "path": "p", "z": "2"}) == {"a": "1"}
    assert one(spark, texts.fallback_profile(F.col("c"), F.col("l")), c="core loop", l=["CL", " "]).startswith("core loop is a machine learning course concept. It appears with related terms such as CL and")
    assert one(spark, texts.fallback_profile(F.col("c"), F.col("l"), 4), c="core loop", l=[]) == "core loop is a."
    assert one(spark, texts.embedding_text(F.col("c"), F.col("l"), F.col("p")), c="core loop", l=["CL"], p="It runs.") == "Concept: core loop\nAliases: CL\nProfile: It runs."
    assert one(spark, texts.image_kind(F.col("b")), b=b"RIFF\x00\x00\x00\x00WEBPxx") == "image/webp" and one(spark, texts.image_kind(F.col("b")), b=b"\xff\xd8\xff\xe0") == "image/jpeg" and one(spark, texts.image_kind(F.col("b")), b=b"%PDF") is None


def test_model_output(spark):
    assert json.loads(texts.rescued_json('```json\n{"a": [1, "}"]}\n```')) == {"a": [1, "}"]}
    assert json.loads(texts.rescued_json('Sure: {"a": {"b": 2}} and more }')) == {"a": {"b": 2}}
    assert texts.rescued_json("no object") is None and texts.rescued_json("[1]") is None and texts.rescued_json('{"a": ') is None
    assert one(spark, texts.json_rescue(F.col("t")), t='x {"k": 1}') == '{"k": 1}'
    assert one(spark, texts.relabelled(F.col("t"), F.lit("CABD")), t="The answer is A; option B and Choice c differ. An A stays.") == "The answer is C; option A and Choice B differ. An A stays."
    a, b = (texts.seeded_vector("core loop", 8, 42) for _ in range(2))
    assert (a == b).all() and abs(a).max() < 0.1 and one(spark, texts.seeded_vectors(8)(F.col("t")), t="core loop") == pytest.approx(a.tolist())


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_NAME", "x")
    assert [settings.scalar(t) for t in ("true", "None", "3", "1e3", "'a b'", "${SOME_NAME}", "${NO_SUCH:-7}", "")] == [True, None, 3, 1000.0, "a b", "x", 7, ""]
    assert settings.uncommented("a#b # c") == "a#b" and settings.uncommented('"a # b" # c') == '"a # b"'
    assert settings.flag("Yes") and not settings.flag("0") and settings.flag(" ", True) and settings.number("x", 2, int) == 2
    settings.register("one", k=5, extra="e")
    f = tmp_path / "c.yaml"
    f.write_text("k: 6  # more\nlist: [1, 2]\nitems:\n  - a\n  - b\n")
    got = settings.load({"k": 1, "seed": 42}, f, "one", given={"seed": None, "top": 3}, environment={"GRAPHLOOM_LEVEL": "0.5"})
    assert got == {"k": 6, "seed": 42, "extra": "e", "list": [1, 2], "items": ["a", "b"], "level": 0.5, "top": 3, "dataset": "one"}
    with pytest.raises(ValueError):
        settings.load({}, dataset="other", environment={})
    (tmp_path / ".env").write_text("export A='b' # c\n# D=1\nE=2#3\n")
    assert settings.env_file(tmp_path / ".env") == {"A": "b", "E": "2#3"}


def test_evidence_rules(spark):
    rows = [
        ("The core loop is a method that runs over all of the items in the list, again and again.", 4.25, True),
        ("core loop", -0.5, False),
        ("a b c d e a b c d e f and the loop of it", -2.25, False),
        ("4.2 core loop calculations and the method of it which is used there as", 4.0, False),
        ("x = y = z and nothing more stands here at all today, of which core loop.", 3.25, False),
    ]
    df = spark.createDataFrame([(t,) for t, *_ in rows], "t string").withColumn("n", F.array(F.lit("core loop"), F.lit("CL x")))
    got = df.select(evidence.quality(F.col("t"), F.col("n")), evidence.addable(F.col("t"), F.col("n"))).collect()
    assert [tuple(g) for g in got] == [(q, a) for _, q, a in rows]


def test_reconcile_keeps_the_better_text(spark):
    s = "c string, p string, evidence string, names array<string>"
    n = ["core loop"]
    good, fair, bad = "The core loop is a method that runs over all of the items in the list, again and again.", "The core loop stands in this line of some length, it seems.", "x"
    base = spark.createDataFrame([("a", "1", fair, n), ("b", "1", good, n), ("c", "1", good, n)], s)
    new = spark.createDataFrame([("a", "1", good, n), ("a", "1", bad, n), ("b", "1", fair, n), ("d", "1", good, n), ("e", "1", bad, n)], s)
    got = {(r["c"], r["evidence"], r["origin"]) for r in evidence.reconciled(base, new, ["c", "p"]).collect()}
    assert got == {("a", good, "replaced"), ("b", good, "kept"), ("c", good, "restored"), ("d", good, "added")}


def test_digit_runs_are_compared_one_by_one():
    assert not evidence.fuzzy_equal("layer 1 2 network model", "layer 12 network model") and evidence.fuzzy_equal("regularization", "rgeularization")


def test_phrases_do_not_depend_on_blocks(spark):
    t = spark.createDataFrame([(1, "the core loop of core loop trees"), (2, None), (3, "loop trees core")], "id int, t string")
    p = spark.createDataFrame([("core loop",), ("loop trees",), ("core loop trees",), ("core",)], "phrase string")
    want = {(1, "core loop", 1), (1, "core loop trees", 1), (3, "loop trees", 1), (3, "core", 1)}
    for block in (1, 2, 1000):
        assert {tuple(r) for r in evidence.phrase_matches(t, p, "id", "t", block).collect()} == want


def test_profile_and_claim_gates(spark):
    reason = lambda t, **k: one(spark, publication.profile_reason(F.lit("Core loop"), F.col("t"), 6, **k), t=t)
    assert [reason(t) for t in ("core loop: it runs.", "It runs.", "Core loop: a b c d e f", "Core loop: !", "Core loop: on this page", None)] == ["ok", "prefix", "long", "no_explanation", "context", "prefix"]
    assert reason("Core loop: x", used=F.array(F.lit("F1")), allowed=F.array(F.lit("F2"))) == "unknown_ids"
    gate = lambda w, s, c: one(spark, publication.confidence_gate(w, F.lit(s), F.lit(c)))
    assert [gate("concept", "printed", 0.7), gate("concept", "Handwritten ", 0.89), gate("formula", "mixed", 0.87), gate("visual", None, 1.0)] == [True, False, True, False]
    claims = lambda *cs: one(spark, publication.claims_reason(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(k).alias("kind"), F.array(*map(F.lit, i)).cast("array<string>").alias("ids")) for t, k, i in cs])))
    assert claims(("a", "source_supported", ["E1"]), ("b", "background_context", [])) == "ok"
    assert [claims(("a", "other", [])), claims(("a", "source_supported", [])), claims(("a", "background_context", ["E"])), claims(("a", "background_context", []), ("b", "background_context", []))] == ["kind", "unsupported", "background_ids", "backgrounds"]


def test_assets_and_registries(spark):
    answer = {"formulas": [{"concept": "Core loops", "latex": "$x = 1$", "pdf_page": "3", "confidence": "0.9"}, {"concept": "core loop", "latex": "x=1", "pdf_page": "3", "confidence": 0.95}, {"concept": "other", "latex": "y", "pdf_page": "3", "confidence": "1"}, {"concept": "core loop", "latex": "z", "pdf_page": "9", "confidence": "1"}, {"concept": "core loop", "latex": "w", "pdf_page": "3", "confidence": "0.7"}],
              "figures": [{"concept": "core loop", "figure_label": "Fig. 1", "caption": " A  loop ", "pdf_page": "4", "confidence": "0.8"}, {"concept": "core loop", "figure_label": "", "caption": "x", "pdf_page": "4", "confidence": "0.8"}]}
    raw = spark.createDataFrame([(1, json.dumps(answer)), (2, "no json"), (3, None)], "id int, json string")
    formulas, figures = extraction.assets(raw, spark.createDataFrame([("core loop",)], "name string"), 2, 5)
    assert [tuple(r)[:3] for r in formulas.collect()] == [("core loop", "x = 1", 3)] and [tuple(r)[:4] for r in figures.collect()] == [("core loop", 4, "Fig. 1", "A loop")]
    f = spark.createDataFrame([("b", "y", 2, 9), ("loop", "x", 1, 5), ("Loops", "x ", 1, 5), ("loop", "x", 1, 4)], "concept string, latex string, chapter int, pdf_page int")
    assert {(r["formula_id"], r["concept"], r["pdf_page"]) for r in extraction.formula_registry(f).collect()} == {("F0001", "loop", 4), ("F0002", "Loops", 5), ("F0003", "b", 9)}
    names = spark.createDataFrame([(1, "a", ".png", 1), (1, "a", ".png", 2), (2, "a", ".png", 3), (1, "b", ".png", 4)], "d int, stem string, suffix string, ord int")
    assert sorted(r["file_name"] for r in extraction.unique_names(names, ["d"]).collect()) == ["a.png", "a.png", "a_2.png", "b.png"]
    progress = extraction.unit_progress(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "unit int, page int"), spark.createDataFrame([(1, 1), (2, 1)], "unit int, page int"))
    assert {tuple(r) for r in progress.collect()} == {(1, 2, 1, False, 2), (2, 1, 1, True, None)}


def test_checkpoints_and_coverage(spark, tmp_path):
    expected = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, None), (4, "h4")], "id int, hash string")
    found = spark.createDataFrame([(1, "h1", True), (2, "old", True), (3, None, True), (9, "x", True)], "id int, hash string, ok boolean")
    status = extraction.triage(expected, found, ["hash"], F.col("ok"))
    assert {tuple(r) for r in status.collect()} == {(1, "valid"), (2, "stale"), (3, "valid"), (4, "missing")}
    assert sorted(r[0] for r in extraction.resume(status).collect()) == [2, 4] and [r[0] for r in extraction.resume(status, True, 1).collect()] == [1]
    names = spark.createDataFrame([("a",), ("b",)], "concept string")
    problems = extraction.uncovered(names, spark.createDataFrame([("a",), ("c",), (None,)], "concept string"))
    assert {tuple(r) for r in problems.collect()} == {("unmatched row", "c"), ("no evidence", "b")}
    with pytest.raises(ValueError):
        extraction.required(problems)
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.publish_if_complete(rows, spark.createDataFrame([(1,), (3,)], "k int"), "k", path) == 1
    assert sinks.publish_if_complete(rows, rows, "k", path) == 0 and sinks.publish_if_complete(rows, rows, "k", path) == 0
    reviews = F.array(F.struct(F.lit("s").alias("sentence"), F.lit("ok").alias("verdict"), F.array(F.lit("E1"), F.lit("E9")).alias("evidence_ids"), F.lit("").alias("reason")))
    r = spark.range(1).select(extraction.lenient_reviews(reviews, F.array(F.lit("E1"))).alias("r")).first()["r"][0]
    assert (r["evidence_ids"], r["reason"]) == (["E1"], "Reviewed by the model.")


def test_tiles(spark):
    assert one(spark, extraction.tile_to_body(F.array(*map(F.lit, (0.0, 500.0, 1000.0, 1000.0))), "bottom-right")) == [450.0, 725.0, 1000.0, 1000.0]


def test_calibration_finds_temperature_and_bias(spark):
    import math
    import random

    from graphloom.operators import models

    rng = random.Random(3)
    rows = [(x, int(rng.random() < 1 / (1 + math.exp(-(x / 2.5 + 0.4))))) for x in (rng.gauss(0, 4) for _ in range(6000))]
    t, b = models.fit_calibration(spark.createDataFrame(rows, "logit double, y int"))
    assert abs(t - 2.5) < 0.35 and abs(b - 0.4) < 0.15
    assert 0.5 <= models.fit_calibration(spark.createDataFrame([(1.0, 1), (-1.0, 0)], "logit double, y int"))[0] <= 10
    assert [models.backoff(a, s) for a, s in ((1, 429), (9, 503), (0, None), (1, 404))] == [2.0, 30.0, 1.0, None]
    assert one(spark, models.lettered(F.col("l")), l=["x", "y"]) == {"A": "x", "B": "y"}
    v = one(spark, models.thinned_features(F.array(*[F.lit(1.0)] * 200), F.lit("n"), 0.25, 7))
    assert 20 < v.count(0.0) < 80 and set(v) == {0.0, 1 / 0.75}


def test_first_boxes_are_the_greedy_fold(spark):
    import random

    rng = random.Random(9)
    boxes = []
    for i in range(150):
        x, y = rng.randrange(0, 700), rng.randrange(0, 700)
        boxes.append((i, rng.randrange(3), float(x), float(y), float(x + rng.randrange(100, 300)), float(y + rng.randrange(100, 300))))
    def iou(a, b):
        w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)
    kept = []
    for b in boxes:
        if all(k[1] != b[1] or iou(k, b) < 0.25 for k in kept):
            kept.append(b)
    df = spark.createDataFrame(boxes, "id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert {r["id"] for r in evidence.first_boxes(df, ["page"], 0.25).collect()} == {b[0] for b in kept}
    assert evidence.first_boxes(df.limit(0), ["page"], 0.25).count() == 0
