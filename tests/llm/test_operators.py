"""Each training-data operator on its hard cases, on nulls, empty tables, repeats, long texts and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import copies, encoding, entries, noise, overlap, packing, pii, truncation
from graphloom.llm.names import distance, slips, stem, words

CLASH = {"key": "k", "bucket": "b", "word": "w", "n": 1, "label": 2, "rank": 3, "_row": 4, "ids": "x", "part": 5, "states": 6}


def clash(df):
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items() if c not in df.columns})


# ---------------------------------------------------------------- hidden copies

FORMULAS = [
    ("f1", "Damped Sketching", r"\exp(z_{1}) = 3.5 \text{For all} z"),
    ("f2", "damped-sketching.", r"$ \exp \left( z_1 \right) \, = 3.5 \text{for  all} z . $"),
    ("f3", r"\[\exp(z_1)=3.5\text{for all}z\]", "damped sketching"),
    ("f4", "damped sketching", r"\exp(z_1) = 3.6 \text{for all} z"),
    ("f5", "damped sketching", r"\exp(Z_1) = 3.5 \text{for all} z"),
    ("f6", "damped sketchng", r"\exp(z_1) = 3.5 \text{for all} z"),
    ("f7", "damped sketching", r"\exp(z_{12}) = 1"),
    ("f8", "damped sketching", r"\exp(z_12) = 1"),
    ("f9", None, "x = 1"),
    ("g1", "a", None),
    (None, "damped sketching", "x"),
    (None, "damped sketching", "x"),
    (None, None, None),
]


def formulas(spark, rows):
    return clash(spark.createDataFrame(rows, "formula_id string, concept string, latex string"))


@pytest.mark.parametrize("limit", [1, 3, 50_000])
def test_copies(spark, limit):
    got = {tuple(r) for r in copies.hidden_copies(formulas(spark, FORMULAS), limit=limit).collect()}
    assert got == {("f1", "f2"), ("f1", "f3")}
    counts = {r["keep_id"]: r["copies"] for r in copies.collapse(formulas(spark, FORMULAS), limit=limit).collect()}
    assert counts == {"f1": 3, "f4": 1, "f5": 1, "f6": 1, "f7": 1, "f8": 1, "f9": 1, "g1": 1}


def test_copies_of_a_hot_group_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"h{i:05d}", "hot", "x = 1") for i in range(400)] + [(f"r{i:05d}", f"name {rng.randrange(40)}", f"y = {rng.randrange(9)}") for i in range(800)]
    groups = {}
    for i, a, b in rows:
        groups.setdefault((a, b), []).append(i)
    want = {(min(v), x) for v in groups.values() for x in v if x != min(v)}
    assert {tuple(r) for r in copies.hidden_copies(formulas(spark, rows), limit=16).collect()} == want


def test_trie_counts_keys():
    trie = copies.Trie()
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b\x00", b"b", b"abc", "é".encode(), "è".encode()]
    for k, key in enumerate(keys):
        trie.add(key, str(k))
    trie.add(b"abc", "3")  # an equal id counts once
    assert {k: len(v) for k, v in trie.terminals()} == {k: keys.count(k) for k in keys}


def test_copies_empty(spark):
    assert copies.hidden_copies(formulas(spark, [])).count() == 0
    assert copies.collapse(formulas(spark, [])).count() == 0


# ---------------------------------------------------------------- names and entries


def test_names():
    assert slips("sketching", "skecthing") == 1 and slips("abc", "xyz") == 3
    assert stem("penalties") == stem("penalty") and stem("regularised") == stem("regularized") and stem("neighbours") == stem("neighbor")
    d = lambda a, b, v=frozenset(): distance(words(a), words(b), v)
    assert d("dampd skecthing", "damped sketching") == 2
    assert d("dampedsketching", "damped sketching") == 0
    assert d("l1 norm", "l2 norm") is None
    assert d("left damped sketching", "damped sketching") is None
    assert d("inner bound", "outer bound") is None
    assert d("nested bound", "tested bound", frozenset({"nested"})) is None
    assert d("", "a") is None


def test_slips_count_per_word():
    assert distance(words("dmpaed skecthnig bonuds"), words("damped sketching bound")) == 5
    assert distance(words("dmpaed skecthnigx bonuds"), words("damped sketching bound")) is None


def test_entries(spark):
    concepts = spark.createDataFrame([(0, "damped sketching", "DSK", "core loop"), (1, "damped neighbour tree", None, "core loop"), (2, "l1 vocabulary estimator", "", None), (3, "l2 vocabulary estimator", None, None)], "concept_id int, canonical string, alias_1 string, alias_2 string")
    typed = {
        "dampd  sketching": 0, "Sketching, damped": 0, "sketching of damped": 0, "eq. for damped sketching": 0, "dsk": 0, "core loop": 0, "damped neighbor trees, cont.": 1, "l1 vocabulry estimator": 2,
        "l2vocabulary estimator": 3, "damped matching": -1, "l3 vocabulary estimator": -1, "tbd": -1, "": -1, "???": -1, "damped tree": -1,
    }
    rows = [(f"f{i}", t, "x = 1") for i, t in enumerate(typed)] + [("s", "x^{2} = 3", "damped sketching"), ("n", None, "damped sketching"), ("m", "damped sketching", None)]
    got = {r["formula_id"]: r["concept_id"] for r in entries.map_entries(formulas(spark, rows), concepts).collect()}
    assert got == {f"f{i}": v for i, v in enumerate(typed.values())} | {"s": 0, "m": 0}
    assert entries.map_entries(formulas(spark, []), concepts).count() == 0
    assert {r["concept_id"] for r in entries.map_entries(formulas(spark, rows), concepts.limit(0)).collect()} == {-1}
    by_block = entries.match_values(formulas(spark, rows).select(F.col("concept").alias("typed")), entries.concept_forms(concepts), block=1)
    assert {r["typed"]: r["entry"] for r in by_block.collect()}["dampd  sketching"] == 0


def test_entries_do_not_depend_on_blocks(spark):
    forms = [(k, "core loop") for k in (3, 5, 8, 9, 12)] + [(1, "damped sketching"), (2, "nested bound"), (20, "bounds of nested trees"), (21, "damped sketchings of trees")]
    typed = [("core loop",), ("Core  Loop",), ("loop, core",), ("dampd sketching",), ("tested bound",), ("nestd bound",), ("trees bounds",), ("core lop",), (None,)]
    forms, typed = spark.createDataFrame(forms, "entry int, form string"), spark.createDataFrame(typed, "typed string")
    got = [sorted(tuple(r) for r in entries.match_values(typed, forms, block=b).collect()) for b in (1, 7, 50_000)]
    assert got[0] == got[1] == got[2]
    assert {r[0]: r[1] for r in got[0]}["core loop"] == 3 and {r[0]: r[1] for r in got[0]}["loop, core"] == 3


# ---------------------------------------------------------------- overlap


def pairs(spark, rows):
    return clash(spark.createDataFrame(rows, "label_id long, source string, target string, split string"))


def test_overlap_matches_brute_force(spark):
    rng = random.Random(5)
    first, second = ["damped", "nested", "greedy", "l1", "l2", "inner"], ["boundary", "sketching", "relaxation", "estimator", "neighbour"]
    names = [f"{a} {b} {c}" for a in first for b in second for c in ("tree", "descent")]

    def slip(s):
        k = rng.randrange(4)
        i = rng.randrange(3, len(s) - 1)
        return [s, s.upper(), s[:i] + s[i + 1 :] if s[i].isalpha() else s, s.replace(" ", "-")][k]

    train = [(i, slip(rng.choice(names)), slip(rng.choice(names[:8])), "train") for i in range(150)]
    evaluation = [(1000 + i, slip(a), slip(b), rng.choice(["val", "test"])) for i, (_, a, b, _) in enumerate(train[:60])] + [(2000, train[0][2], train[0][1], "val"), (2001, None, "x", "val"), (2002, "!!", "x", "val")]
    same = lambda a, b: a is not None and b is not None and (distance(words(a), words(b)) is not None or distance(words(b), words(a)) is not None)
    want = {(t[0], e[0]) for t in train for e in evaluation if same(t[1], e[1]) and same(t[2], e[2])}
    got = {tuple(r) for r in overlap.found(pairs(spark, train), pairs(spark, evaluation)).collect()}
    assert got == want and got
    assert overlap.report(pairs(spark, train), pairs(spark, evaluation)).agg(F.sum("n_pairs")).first()[0] == len(want)


def test_overlap_of_short_and_joined_names(spark):
    alike = [("lasso", "lazso"), ("kernel", "krenel"), ("latent tree", "latet tree"), ("core loop", "coreloop"), ("damped sketching bound", "dmpedsketching bonud"), ("ab c de", "a bc de")]
    train = [(i, a, "entropic splitting", "train") for i, (a, _) in enumerate(alike)]
    evaluation = [(100 + i, b, "entropic spliting", "val") for i, (_, b) in enumerate(alike)] + [(200, "lasing", "entropic splitting", "val"), (201, "latent l1 tree", "entropic splitting", "val")]
    assert {tuple(r) for r in overlap.found(pairs(spark, train), pairs(spark, evaluation)).collect()} == {(i, 100 + i) for i in range(len(alike))}


def test_texts_within_two_slips_share_a_key():
    rng = random.Random(8)
    for _ in range(4000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 24)))
        b = list(a)
        for _ in range(2):
            i = rng.randrange(len(b) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                b.insert(i, rng.choice("abcd"))
            elif i < len(b):
                if kind == 1:
                    del b[i]
                elif kind == 2:
                    b[i] = rng.choice("abcd")
                elif i + 1 < len(b):
                    b[i], b[i + 1] = b[i + 1], b[i]
        b = "".join(b)
        if slips(a, b) <= 2:
            assert overlap._joined_keys(a, False) & overlap._joined_keys(b, True), (a, b)
            assert overlap._joined_keys(b, False) & overlap._joined_keys(a, True), (a, b)


def test_overlap_empty(spark):
    some = pairs(spark, [(1, "a b c", "d e f", "train")])
    assert overlap.found(some, pairs(spark, [])).count() == 0
    assert overlap.found(pairs(spark, []), some).count() == 0


# ---------------------------------------------------------------- encoding and packing


def texts(spark, rows):
    return clash(spark.createDataFrame(rows, "doc_id long, text string"))


def test_encoding_equals_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    cases = ["", None, "  \n\t", "Hello world, it's we'LL", "a" * 3000, "aaa aaaa   b\n\n ", "<|endoftext|> x", "naïve 漢字 👋🏽 é", "x = 3.14\\frac{1}{2}", "word " * 20_000, "Hello world, it's we'LL"]
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(texts(spark, list(enumerate(cases)))).collect()}
    assert got == {i: t.encode(c or "", add_special_tokens=False).ids for i, c in enumerate(cases)}
    sizes = {r["doc_id"]: r["n_tokens"] for r in encoding.token_counts(texts(spark, list(enumerate(cases)))).collect()}
    assert sizes == {i: len(v) for i, v in got.items()}
    assert encoding.encode(texts(spark, [])).count() == 0


def test_pairs_are_found_behind_used_sizes():
    import numpy as np

    counts = np.zeros(101, int)
    counts[[5, 6, 7, 8, 9, 11, 12, 13, 14, 15]] = 1
    assert packing.Sums(counts).pair(20, (15, 14, 13, 12)) == (11, 9)
    assert packing.Sums(counts).pair(20, (15, 14, 13, 12, 9)) is None


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_valid_and_tight(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 3, 7, 20, 33, 50, 64, 99, 100, 101, 250]) for _ in range(300)] + [None, 100, 100]
    items = clash(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long"))
    rows = packing.pack(items, capacity=100).collect()
    used, parts = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append(r["part_size"])
        if r["bin_id"] is None:
            assert r["part_size"] == 0
        else:
            used[r["bin_id"]] = used.get(r["bin_id"], 0) + r["part_size"]
    assert {i: sum(v) for i, v in parts.items()} == {i: s or 0 for i, s in enumerate(sizes)}
    assert all(len(v) == 1 or all(x == 100 for x in sorted(v)[1:]) for v in parts.values())
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    assert len(used) <= -(-sum(s or 0 for s in sizes) // 100) * 1.08 + 1
    assert packing.pack(items.limit(0), capacity=100).count() == 0


# ---------------------------------------------------------------- noise and cut texts

BODY = "The nimble form of the embedding needs many extra terms. The answer key treats the preference network as factored. The first-order rule amplifies the residual."


def passages(spark, rows):
    return clash(spark.createDataFrame(rows, "passage_id long, text string, page int, pdf_file string"))


def noisy():
    clean = [(100 + i, BODY, 7, "f.pdf") for i in range(40)]
    return clean + [
        (1, "The nimble form of the em-\nbedding needs many extra terms. The first-\norder rule amplifies the residual.", 7, "f.pdf"),
        (2, "The nimb1e form of the ernbedding needs many €xtra terms.", 7, "f.pdf"),
        (3, "The nimble form of the embedding\n\n- 278 -\n\nneeds many extra terms.", 278, "f.pdf"),
        (4, "CHAPTER 4. NIMBLE REWARD PENALTY | 218\n\nThe nimble form of the embedding needs many extra terms.", 218, "f.pdf"),
        (5, "4.5 Nimble residual\n\nThe naïve form of the embedding needs\n12\nextra terms.", 99, "f.pdf"),
        (6, None, 1, "f.pdf"), (7, "", 1, "f.pdf"), (8, "  \n \n", None, None), (9, "xiv\n" + BODY, None, "f.pdf"), (10, "the ﬁrst rule", 1, None),
    ]


def test_noise(spark):
    got = {}
    for r in noise.found(passages(spark, noisy())).collect():
        got.setdefault(r["passage_id"], set()).add(r["noise"])
    assert got == {1: {"hyphenation"}, 2: {"misread"}, 3: {"page_number"}, 4: {"header", "page_number"}, 9: {"page_number"}, 10: {"misread"}}
    clean = {r["passage_id"]: r["clean"] for r in noise.repair(passages(spark, noisy())).collect()}
    assert clean[1] == "The nimble form of the embedding needs many extra terms. The first-order rule amplifies the residual."
    assert clean[2] == "The nimble form of the embedding needs many extra terms."
    assert clean[3] == clean[4] == "The nimble form of the embedding needs many extra terms."
    assert clean[6] is None and clean[7] == "" and clean[10] == "the first rule"


def test_noise_empty_and_long(spark):
    assert noise.found(passages(spark, [])).count() == 0
    assert noise.repair(passages(spark, [(1, (BODY + "\n") * 3000, 1, "f")])).count() == 1


def test_line_model_learns_from_seed_labels():
    lines = ["MY RUNNING TITLE", "", "a line of text that goes on", "and ends here.", "12"]
    page = [noise.line_features(lines, 12) for _ in range(50)]
    assert noise.LineModel().fit(page).decode(page[0]) == [noise.HEADER, noise.BREAK, noise.BODY, noise.BODY, noise.NUMBER]
    over = ["a line of text that goes on", "", "MY RUNNING TITLE", "", "and ends here with a bro-", "ken word.", "", "Next."]
    assert noise.LineModel().fit([noise.line_features(over, 12)] * 20).decode(noise.line_features(over, 12, {4})) == [noise.BODY, noise.GAP, noise.HEADER, noise.GAP, noise.SPLIT, noise.BODY, noise.BREAK, noise.BODY]
    assert noise.LineModel().fit([]).decode([]) == []


def test_long_words_are_repaired(spark):
    long = "abstimmungs" * 20
    rows = [(100 + i, f"The {long} holds.", 7, "f") for i in range(45)] + [(1, "The " + long.replace("m", "rn", 1)[:-1] + "5 holds.", 7, "f"), (2, "The " + long[:-1] + " holds.", 7, "f"), (3, "x" * 30_000 + " holds.", 7, "f")]
    assert {tuple(r) for r in noise.found(passages(spark, rows)).collect()} == {(1, "misread")}
    assert noise.reaches("ernbedd1ng", "embedding") and not noise.reaches("embedding", "embedding") and not noise.reaches("ernb3dd1ng", "embedding")


def contexts(spark, rows):
    return clash(spark.createDataFrame(rows, "context_id string, dataset string, evidence string"))


def test_cut_texts(spark):
    full = [(f"ok{i}", "D", "We keep the boundary values. The score of the boundary grows, which gives $x = 1$") for i in range(20)]
    rows = full + [
        ("word", "D", "We keep the boundary values. The score of the bound"[:-1]), ("sentence", "D", "We keep the boundary values. The score of"), ("dots", "D", "We keep the bou…"), ("open", "D", "The score grows (see Section 14."),
        ("maths", "D", "The score of $x"), ("formula", "D", "The boundary grows, which gives $y$"), ("quote", "D", "“We keep the values.”"), ("bracket", "D", "We keep the values. [12]"), ("caption", "D", "Figure 3: the boundary on the score"),
        ("keys", "D", "Keywords: boundary, score"), ("null", "D", None), ("blank", "D", "  "), ("word", "D", "We keep the boundary values. The score of the boun"),
    ]
    p = [(1, "We keep the boundary values.\n\n- 12 -", 12, "f"), (2, "We keep the boundary val", 12, "f"), (3, None, None, None)]
    got = {tuple(r) for r in truncation.found(passages(spark, p), contexts(spark, rows)).collect()}
    assert got == {("source_context", x) for x in ("word", "sentence", "dots", "open", "maths")} | {("passage", "2")}
    rates = {(r["tbl"], r["source"]): (r["n"], r["n_cut"]) for r in truncation.rates(passages(spark, p), contexts(spark, rows)).collect()}
    assert rates[("passage", "f")] == (2, 1)


def test_cut_texts_empty(spark):
    assert truncation.found(passages(spark, []), contexts(spark, [])).count() == 0


# ---------------------------------------------------------------- personal information

NOTE = "Submitted by: Lars Wexerby\nAddress: 73 Vasker Blvd, Apt 5B, Lindelau, ZZ 00662\nPhone: +44 7700 900794 On this page the passport X0983823 of Dr. Mirela van Brothwin was graded. Contact: lars.wexerby@example.org."


def test_pii(spark):
    rows = [(1, NOTE), (2, None), (3, ""), (4, "The Rebmibten-Fopsefban Bound beats precision@58 here. Load block3@stage4.ckpt before it. The seed was 2036-555-006."), (5, NOTE), (6, ("The score of the boundary grows slowly. " * 4000) + NOTE)]
    want = {("name", "Lars Wexerby"), ("address", "73 Vasker Blvd, Apt 5B, Lindelau, ZZ 00662"), ("phone", "+44 7700 900794"), ("email", "lars.wexerby@example.org")}
    got = {}
    for r in pii.found(texts(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["pii_type"], r["pii_text"]))
    assert set(got) == {1, 5, 6}
    assert all(want <= v for v in got.values())
    masked = {r["doc_id"]: r["masked"] for r in pii.mask(texts(spark, rows)).collect()}
    assert masked[2] is None and masked[3] == "" and masked[4] == rows[3][1]
    assert masked[1].startswith("Submitted by: [NAME]\nAddress: [ADDRESS]\nPhone: [PHONE] On this page")
    assert pii.found(texts(spark, [])).count() == 0


def test_training_lowers_the_loss():
    import numpy as np

    from graphloom.llm import pii_train

    rng = np.random.default_rng(0)
    ids, y = pii_train.windows([NOTE] * 8, rng, mark=True)
    w = pii_train.initial(rng, 8, 8)
    first, grads = pii_train.step(w, ids, y)
    w2 = {k: v.astype(np.float64) for k, v in w.items()}
    w2["move"][0, 1] += 1e-4
    up, _ = pii_train.step(w2, ids, y)
    w2["move"][0, 1] -= 2e-4
    down, _ = pii_train.step(w2, ids, y)
    assert abs((up - down) / 2e-4 - grads["move"][0, 1]) < 1e-4
    assert pii_train.step(pii_train.train(ids, y, seconds=6, batch=16, say=lambda *_: None), ids, y)[0] < first


def test_mentions_come_from_the_network_alone():
    import numpy as np

    from graphloom.llm.pii import FIRST, TYPES

    text = "ask Lars Wexerby, Mira Brothwin or call +44 7700 900794 now"
    y = np.zeros(len(text), np.int8)
    assert pii.mentions(text, y) == []
    for surface, kind in (("Lars Wexerby", "name"), ("Mira Brothwi", "name"), ("+44 7700 900794", "phone")):
        a = text.index(surface)
        y[a : a + len(surface)] = TYPES.index(kind) + 1
        y[a] = FIRST
    y[-3:] = TYPES.index("phone") + 1  # no phone number: three letters
    assert [(text[a:b], k) for a, b, k in pii.mentions(text, y)] == [("Lars Wexerby", "name"), ("Mira Brothwin", "name"), ("+44 7700 900794", "phone")]
