"""Cut texts (problem 3): values that end before their text did, and the share of them per source.

Method: the corpus vocabulary is kept as a trie in table form, one row per node (prefix) with the count of the words
that end there and of those that go on; a value's final token is looked up in it by a join, so the trie has no size
limit. A value without a closing mark whose final token is an unknown proper prefix of known words ends inside a word.
Lengths that are much more frequent than their neighbours are field limits, and a value of such a length without a
closing mark is cut whatever its last word. A cut between two words off the limits leaves no prefix: such a value is a
case if its final token is a word of the trie and no closing mark follows. Open brackets and formulas and marks of
omission are evidence by themselves. Whether a text may end in a formula is learnt from what the corpus shows after the
word before the formula. Page footers after the body are left out first, by the line model of the noise operator.

Defined results: null and blank values are no cases; a record delivered twice counts once; captions (`Figure 3: ...`)
and keyword lists are cases only if they end in an unknown prefix at a field limit. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.noise import BODY, fit_line_model, line_features
from graphloom.llm.vocabulary import FORMULA_RE, strip_edges, word_counts
from graphloom.session import cut, lookup_join, nonempty

OMISSION = re.compile(r"(?:\[(?:\.{3}|…)\]|\.{3}|…)$")
CLOSERS = "\"'”’»)]*"
LABEL = re.compile(r"(?:[A-Z][a-z]+ [A-Z]?\d+(?:\.\d+)*[:.] |(?:key ?words|topics|terms|index)\s*: )[^.!?]*$", re.I)
ABBREVIATION = re.compile(r"[(\[]?(?:Fig|Figs|Eq|Eqs|Sec|Tab|Ch|No|pp?|cf|vs|e\.g|i\.e)\.$")
ENDING = "tbl string, rec_key string, source string, ending string, token string, lead string, length int"


def ending(text: str) -> tuple[str, str, str]:
    """(kind, final token, word before a final formula).

    Kinds: omission, open, formula, number, done, label, bare.
    """
    t = text.rstrip()
    words = t.split()
    token = strip_edges(words[-1]).lower() if words else ""
    if OMISSION.search(t):
        bare = OMISSION.sub("", t).rstrip()
        return "omission", (strip_edges(bare.split()[-1]).lower() if bare.split() else ""), ""
    if LABEL.match(t) and "\n" not in t:
        return "label", token, ""
    if t.count("$") % 2:
        return "open", "", ""
    core = t.rstrip(CLOSERS)
    sentences = re.split(r"(?<=[.!?])\s+(?=[A-Z])", t)
    k = len(sentences) - 1
    last = sentences[k]
    while k and ABBREVIATION.match(sentences[k - 1].rsplit(None, 1)[-1]):  # no sentence ended there
        k -= 1
        last = f"{sentences[k]} {last}"
    bare_last = FORMULA_RE.sub(" ", last)
    if bare_last.count("(") > bare_last.count(")") or bare_last.rfind("[") > max(map(bare_last.rfind, ")]")):
        return "open", token, ""
    if t.endswith("$"):
        before = t[: t.rfind("$", 0, len(t) - 1)].split()
        return "formula", "", (before[-1].lower() if before else "")
    if core.endswith((".", "!", "?")):
        return ("number" if re.search(r"(?<![\[\d.])\d+\.$", t) else "done"), token, ""
    if t[-1] in CLOSERS:  # bracket or quotation after the sentence
        return "done", token, ""
    return "bare", token, ""


def _endings(tbl: str, model) -> object:
    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, source, text, page in zip(batch["rec_key"], batch["source"], batch["text"], batch["page"]):
                body = text
                if model is not None:
                    lines = text.rstrip().split("\n")
                    own = None if pd.isna(page) else int(page)
                    states = model.value.decode(line_features(lines, own))
                    k = len(lines)
                    while k > 1 and (states[k - 1] != BODY or not lines[k - 1].strip()):
                        k -= 1
                    if lines[k - 1].strip():
                        body = "\n".join(lines[:k])
                if body.strip():
                    out.append((tbl, key, source, *ending(body), len(text)))
            yield pd.DataFrame(out, columns=["tbl", "rec_key", "source", "ending", "token", "lead", "length"])

    return run


#: Characters of a word that are laid out as nodes; longer tokens are met by this prefix and then compared.
DEEP = 60


def trie(words: DataFrame) -> DataFrame:
    """(prefix, n_word, n_below): nodes of the vocabulary trie with the words that end at or go on below each, down to DEEP characters."""
    nodes = words.select("n", "word", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(DEEP)))).alias("k"))
    ends = F.col("k") == F.length("word")
    return nodes.groupBy(F.substring("word", F.lit(1), F.col("k")).alias("prefix")).agg(
        F.sum(F.when(ends, F.col("n")).otherwise(0)).alias("n_word"), F.sum(F.when(~ends, F.col("n")).otherwise(0)).alias("n_below")
    )


def looked_up(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, n_word, n_below) of distinct tokens in the trie of the vocabulary."""
    near = tokens.filter(F.length("token") <= DEEP).join(trie(words).withColumnRenamed("prefix", "token"), "token")
    head = lambda c: F.substring(c, 1, DEEP)
    far = tokens.filter(F.length("token") > DEEP).withColumn("head", head("token")).join(words.filter(F.length("word") > DEEP).withColumn("head", head("word")), "head").filter(F.startswith("word", "token"))
    same = F.col("word") == F.col("token")
    return near.unionByName(far.groupBy("token").agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("n_word"), F.sum(F.when(~same, F.col("n")).otherwise(0)).alias("n_below")))


def length_limits(values: DataFrame, least: int = 5, ratio: float = 4.0) -> DataFrame:
    """(tbl, length): lengths at least `ratio` times as frequent as the mean of the five on either side."""
    counts = values.groupBy("tbl", "length").agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("tbl").orderBy("length").rangeBetween(-5, 5)
    return counts.withColumn("near", (F.sum("n").over(around) - F.col("n")) / 10).filter((F.col("n") >= least) & (F.col("n") >= ratio * F.greatest("near", F.lit(1.0)))).select("tbl", "length")


def formula_leads(texts: DataFrame) -> DataFrame:
    """(lead, end_share): how often a formula after this word ends its text or sentence."""
    found = F.regexp_extract_all("text", F.lit(r"(?U)(\S+)\s+\$[^$\n]+\$\s*([.!?]|\z|\S)"), F.lit(0))
    one = texts.select(F.explode(found).alias("m"))
    lead, after = F.lower(F.regexp_extract("m", r"(?U)^(\S+)", 1)), F.regexp_extract("m", r"(?U)\$\s*(\S?)$", 1)
    tail = F.when(F.col("m").rlike(r"\$\s*$"), True).otherwise(after.isin(".", "!", "?", "$"))
    return one.select(lead.alias("lead"), tail.cast("int").alias("ends")).groupBy("lead").agg(F.avg("ends").alias("end_share"))


def judged(passages: DataFrame, contexts: DataFrame) -> DataFrame:
    """(tbl, rec_key, source, kind) of every non-blank value; kind null unless it is cut: word or sentence."""
    spark = passages.sparkSession
    p = passages.select(F.col("passage_id").cast("string").alias("rec_key"), F.col("pdf_file").alias("source"), "text", F.col("page").cast("int").alias("page"))
    c = contexts.select(F.col("context_id").alias("rec_key"), F.col("dataset").alias("source"), F.col("evidence").alias("text"), F.lit(None).cast("int").alias("page"))
    p, c = (x.filter(F.length(F.trim("text")) > 0) for x in (p, c))
    model = spark.sparkContext.broadcast(fit_line_model(p, "text", "page", "rec_key"))
    ends = cut(p.mapInPandas(_endings("passage", model), ENDING).unionByName(c.mapInPandas(_endings("source_context", None), ENDING)))
    both = p.select("text").unionByName(c.select("text"))
    leads = formula_leads(both)
    # endings without a token, or without a word before a formula, take no part in the joins: '' would be a hot key
    nodes = cut(looked_up(ends.filter("token <> ''").select("token").distinct(), word_counts(both)))
    nothing = lambda d, *cs: d.withColumns({c: F.lit(None).cast(t) for c, t in cs})
    with_token = lookup_join(ends.filter("token <> ''"), nodes, "token", "left").unionByName(nothing(ends.filter("token = ''"), ("n_word", "long"), ("n_below", "long")))
    looked = (
        lookup_join(with_token.filter("lead <> ''"), leads, "lead", "left").unionByName(nothing(with_token.filter("lead = ''"), ("end_share", "double")))
        .join(length_limits(ends).withColumn("limit", F.lit(True)), ["tbl", "length"], "left")
    )
    inside = (F.coalesce("n_below", F.lit(0)) > 0) & (F.coalesce("n_word", F.lit(0)) * 20 < F.coalesce("n_below", F.lit(0)))
    at_limit = F.coalesce("limit", F.lit(False))
    # without a length limit a bare ending must be met in the trie: as a proper prefix, or as a word after which texts go on
    met = inside | (F.coalesce("n_word", F.lit(0)) > 0)
    is_cut = (
        F.when(F.col("ending").isin("omission", "open"), True)
        .when(F.col("ending") == "bare", met | at_limit)
        .when(F.col("ending") == "formula", (F.coalesce("end_share", F.lit(1.0)) < 0.5) & ~F.col("lead").rlike("[.!?:]$"))
        .when(F.col("ending") == "number", at_limit)
        .when(F.col("ending") == "label", at_limit & inside)
        .otherwise(False)
    )
    return looked.select("tbl", "rec_key", "source", F.when(is_cut, F.when(inside, "word").otherwise("sentence")).alias("kind"))


def found(passages: DataFrame, contexts: DataFrame) -> DataFrame:
    """(tbl, rec_key) of the records whose value is cut."""
    return judged(passages, contexts).filter(F.col("kind").isNotNull()).select("tbl", "rec_key").distinct()


def rates(passages: DataFrame, contexts: DataFrame) -> DataFrame:
    """(tbl, source, n, n_cut, n_in_word, share): how often each pdf_file and dataset truncates."""
    one = judged(passages, contexts).groupBy("tbl", "source", "rec_key").agg(F.max("kind").alias("kind"))
    return one.groupBy("tbl", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("kind").isNotNull()).alias("n_cut"),
        F.count_if(F.col("kind") == "word").alias("n_in_word"),
        F.round(F.count_if(F.col("kind").isNotNull()) / F.count(F.lit(1)), 6).alias("share"),
    )
