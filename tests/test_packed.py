import pytest

from graphloom.operators import packed as p

SCHEMA = "summary_id long, key_topics string, pos int, topic string, value string"


def df(spark, texts):
    return spark.createDataFrame([(i, t, 9, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def values(spark, texts, **kw):
    out = {}
    for r in sorted(p.unpack(df(spark, texts), **kw).collect(), key=lambda r: (r["summary_id"], r["pos"])):
        out.setdefault(r["summary_id"], []).append(r["topic"])
    return [out.get(i, []) for i in range(len(texts))]


CASES = [
    ("a b|c d||e f", ["a b", "c d", "e f"]),
    ('"a, b c"; d e', ["a, b c", "d e"]),
    ('"the ""x"" y"|z w', ['the "x" y', "z w"]),
    ("f (g, h), i j", ["f (g, h)", "i j"]),
    ("p(z\\|v) q | r s", ["p(z|v) q", "r s"]),
    ('["a b", "c, d e", null, 3]', ["a b", "c, d e", "3"]),
    ("1. a b 2. c d 3. e 4", ["a b", "c d", "e 4"]),
    ("(1) a b; (2) c d", ["a b", "c d"]),
    ("• a b • c d", None),
    ("* a b\r\n* c d", ["a b", "c d"]),
    ("a/b c / d e", ["a/b c", "d e"]),
    ("'if a; then b' | the learner's c", ["if a; then b", "the learner's c"]),
    ("'unclosed a | b c", ["'unclosed a", "b c"]),
    (" | ; ", []),
    ("", []),
    (None, []),
    ("[]", []),
]


def test_segmentation(spark):
    cases = [c for c in CASES if c[1] is not None]
    assert values(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def test_dictionary_protects_delimiters(spark):
    texts = ['"reward, layered sketching"|a b', "reward, layered sketching; a b", "a b, c d"]
    assert values(spark, texts)[1] == ["reward, layered sketching", "a b"]
    assert values(spark, texts)[2] == ["a b", "c d"]


@pytest.mark.parametrize("limit", [300_000, 0])
def test_known_whole_value_beats_its_pieces(spark, limit):
    texts = ['"reward, layered sketching"|a b', '["u, v, w"]', "m\\, n", "reward, layered sketching; a b", "layered sketching, reward", "reward; layered sketching", "u, v, w, a b", "c d, m, n", '"reward", layered sketching']
    assert values(spark, texts, max_values=limit)[3:] == [
        ["reward, layered sketching", "a b"], ["layered sketching", "reward"], ["reward", "layered sketching"], ["u, v, w", "a b"], ["c d", "m, n"], ["reward", "layered sketching"],
    ]


def test_join_path_gives_the_same(spark):
    texts = [c[0] for c in CASES] + ["reward, layered sketching; a b", '"reward, layered sketching"']
    assert values(spark, texts, max_values=0) == values(spark, texts)


def test_empty_repeated_and_long(spark):
    assert values(spark, []) == []
    long = "|".join(["x y"] * 20_000)
    assert [len(v) for v in values(spark, [long, long])] == [20_000, 20_000]


@pytest.mark.parametrize("text", ["\x00", "((((", '"' * 999, "\\", "[[1,2],{}]"])
def test_odd_texts_do_not_fail(spark, text):
    values(spark, [text])


@pytest.mark.parametrize("limit", [1, 2, 100_000])
def test_one_two_and_three_inner_delimiters(spark, limit):
    texts = [
        '"a, b"; "c, d, e"; "f | g; h, i"', "a, b, x", "x, c, d, e, y", "z; f | g; h, i; a, b", "a; b", "c, d", "y", "b",
        '"p, q"', '"q, r"', "r", "p, q, r",
    ]
    got = values(spark, texts, max_values=limit)
    assert got[1:6] == [["a, b", "x"], ["x", "c, d, e", "y"], ["z", "f|g; h, i", "a, b"], ["a", "b"], ["c", "d"]]
    assert got[11] == ["p, q", "r"]  # of covers that overlap the one that leaves a known value


def test_own_pieces_do_not_vouch(spark):
    assert values(spark, ["a, b", "b, c", "a, b, c"]) == [["a", "b"], ["b", "c"], ["a", "b", "c"]]


def test_shards_are_salted_and_parted(spark, monkeypatch):
    monkeypatch.setattr(p, "TEXTS", 2)
    texts = [f'"a, v{k}"' for k in range(9)] + [f"a, v{k % 9}, w{k}" for k in range(40)]
    assert values(spark, texts, max_values=2)[9:] == [[f"a, v{k % 9}", f"w{k}"] for k in range(40)]
