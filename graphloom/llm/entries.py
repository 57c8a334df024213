"""Free entries (problem 5): names typed by hand, mapped to the closest entry of a reference list.

Method: distinct values are normalised (filler words dropped, turned word order turned back), candidates come from an
inverted index of character trigrams of the reference forms, scored by weighted cosine, and are accepted above a
threshold and with a margin over the next entry. An exact check of the words follows: each word must agree up to
inflection, spelling and slips, so that another content word makes another concept.

The words and the gram weights of the whole reference list are joined to the values and forms first. Then the list is
read in blocks of `block` forms, each broadcast in turn, and the best two entries of a value over all blocks decide; so
the list has no size limit and blocks of any size give the same rows. Values are deduplicated before and joined back
after.

Defined results: null names: no row (for found) or entry null; a name that denotes none: -1; a form that stands for
several entries, met exactly: the smallest id of them. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.names import distance, stem, words
from graphloom.session import cut, lookup_join, nonempty

#: Words that people put around a name.
FILLERS = frozenset("the a an our concept of eq equation for technique method definition in general cont continued see text".split())
MATHS = r"[\\=^{}<>]"


def typed_name(name: Column, other: Column) -> Column:
    """The one of two fields that holds the name, when the formula may stand in either."""
    return F.when(F.regexp_count(name, F.lit(MATHS)) > F.regexp_count(other, F.lit(MATHS)), other).otherwise(name)


def readings(text: str, vocabulary: frozenset[str]) -> list[list[str]]:
    """Word lists that a typed text may mean: without fillers, as it stands and with its order turned back."""
    keep = lambda ws: [w for w in ws if w not in FILLERS or stem(w) in vocabulary]
    out = [keep(words(text))]
    if "," in text:
        head, _, rest = text.partition(",")
        if keep(words(rest)):
            out.append(keep(words(rest)) + keep(words(head)))
    ws = words(text)
    if "of" in ws[1:-1]:
        k = ws.index("of", 1)
        if keep(ws[:k]):
            out.append(keep(ws[k + 1 :]) + keep(ws[:k]))
    return [r for k, r in enumerate(out) if r and r not in out[:k]]


def grams(text: str) -> Counter:
    padded = f"^{text}$"
    return Counter(padded[i : i + 3] for i in range(len(padded) - 2))


#: Slips of an exact hit by the r-th reading are EXACT + r, so that earlier readings win over all blocks.
EXACT = -10


class FormIndex:
    """Inverted index of character trigrams over some forms (entry, form, weights) of the reference list."""

    def __init__(self, forms: list[tuple[int, str, dict[str, float]]]) -> None:
        self.forms = [(i, words(f)) for i, f, _ in forms]
        lists: dict[str, list] = defaultdict(list)
        for k, (_, form, idf) in enumerate(forms):
            c = {g: n * idf[g] for g, n in grams("".join(words(form))).items()}
            norm = math.sqrt(sum(w * w for w in c.values())) or 1.0
            for g, w in c.items():
                lists[g].append((k, w / norm))
        self.lists = {g: (np.array([k for k, _ in v]), np.array([w for _, w in v])) for g, v in lists.items()}
        self.exact: dict[str, int] = {}
        for i, w in self.forms:
            key = "".join(w)
            self.exact[key] = min(i, self.exact.get(key, i))

    def candidates(self, reading: list[str], idf: dict[str, float], least: float) -> list[tuple[int, float]]:
        """(form, cosine) of all forms with a weighted cosine of at least `least`; grams that no form has weigh nothing."""
        c = {g: n * idf[g] for g, n in grams("".join(reading)).items() if g in idf}
        met = [g for g in c if g in self.lists]
        if not met:
            return []
        norm = math.sqrt(sum(w * w for w in c.values()))
        at = np.concatenate([self.lists[g][0] for g in met])
        score = np.bincount(at, np.concatenate([self.lists[g][1] * c[g] for g in met]), len(self.forms)) / norm
        return [(int(k), float(score[k])) for k in np.flatnonzero(score >= least)]

    def best(self, text: str, vocabulary: frozenset[str], idf: dict[str, float], least: float) -> list[tuple[int, int, float]]:
        """(entry, slips, cosine) of the closest entries that pass the check, closest first, one form each."""
        best: dict[int, tuple[int, float]] = {}
        for r, reading in enumerate(readings(text, vocabulary)):
            if (entry := self.exact.get("".join(reading))) is not None:
                return [(entry, EXACT + r, 1.0)]
            for k, score in self.candidates(reading, idf, least):
                entry, form = self.forms[k]
                if len("".join(form)) < 5 and form != reading:
                    continue  # an acronym is met exactly or not at all
                n = distance(reading, form, vocabulary)
                if n is not None and (entry not in best or (n, -score) < (best[entry][0], -best[entry][1])):
                    best[entry] = (n, score)
        return sorted(((e, n, s) for e, (n, s) in best.items()), key=lambda x: (x[1], -x[2], x[0]))[:2]


def _search(forms, least: float):
    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = FormIndex(forms.value)
        for batch in batches:
            out = [(t, e, n, s) for t, own, idf in zip(batch["typed"], batch["own"], batch["idf"]) for e, n, s in index.best(t, frozenset(own), dict(idf), least)]
            yield pd.DataFrame(out, columns=["typed", "entry", "slips", "score"])

    return run


@nonempty
def _stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(t, s) for t in batch["text"] for s in {stem(w) for w in words(t)}], columns=["text", "stem"])


@nonempty
def _form_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(t, g) for t in batch["text"] for g in grams("".join(words(t)))], columns=["text", "gram"])


@nonempty
def _value_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(t, g) for t, own in zip(batch["text"], batch["own"]) for g in {g for r in readings(t, frozenset(own)) for g in grams("".join(r))}], columns=["text", "gram"])


def _collected(rows: DataFrame, pairs: DataFrame, column: str, kind: str) -> DataFrame:
    """`rows` (text, ...) with what `pairs` (text, ...) gathered by text, empty where there is nothing."""
    return rows.join(pairs, "text", "left").withColumn(column, F.coalesce(column, F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind)))


def match_values(values: DataFrame, forms: DataFrame, least: float = 0.45, margin: float = 0.02, block: int = 50_000) -> DataFrame:
    """(typed, entry, slips, score) of the distinct texts `typed` that denote an entry of forms (entry INT, form STRING).

    Accepted: an exact form (slips -1; of several entries the smallest id), or a cosine of at least `least` and words
    that pass the check, with fewer slips than the next entry or a cosine that is better by `margin`.
    """
    spark = values.sparkSession
    forms = cut(forms.filter(F.col("form").isNotNull() & (F.trim("form") != "")).distinct())
    n_forms = forms.count()
    blocks = max(1, math.ceil(n_forms / block))
    texts = forms.select(F.col("form").alias("text"))
    vocabulary = texts.mapInPandas(_stems, "text string, stem string").select("stem").distinct()
    # a form of several entries counts once for each, as it stands in the index once for each
    in_forms = texts.mapInPandas(_form_grams, "text string, gram string")
    weights = cut(in_forms.groupBy("gram").agg((1 + F.log(F.lit(float(n_forms)) / F.count(F.lit(1)))).alias("w")))
    gathered = lambda pairs: pairs.join(weights, "gram").groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("idf"))

    asked = cut(values.select(F.col("typed").alias("text")).filter(F.col("text").isNotNull()).distinct().repartition(spark.sparkContext.defaultParallelism * 2))
    own = asked.mapInPandas(_stems, "text string, stem string").join(vocabulary, "stem").groupBy("text").agg(F.collect_set("stem").alias("own"))
    asked = _collected(asked, own, "own", "array<string>")
    asked = cut(_collected(asked, gathered(asked.mapInPandas(_value_grams, "text string, gram string")), "idf", "map<string,double>").withColumnRenamed("text", "typed"))
    numbered = cut(
        _collected(forms.withColumnRenamed("form", "text"), gathered(in_forms.distinct()), "idf", "map<string,double>").withColumn("block", F.pmod(F.xxhash64("entry"), F.lit(blocks)))
    )
    found = None
    for b in range(blocks):
        part = [(r["entry"], r["text"], r["idf"]) for r in numbered.filter(F.col("block") == b).collect()]  # one block
        hits = asked.mapInPandas(_search(spark.sparkContext.broadcast(part), least), "typed string, entry int, slips int, score double")
        found = hits if found is None else found.unionByName(hits)
    ranked = found.groupBy("typed").agg(F.array_sort(F.collect_list(F.struct("slips", (-F.col("score")).alias("minus"), "entry"))).alias("r"))
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    clear = second.isNull() | (first["slips"] < 0) | (first["slips"] < second["slips"]) | (second["minus"] - first["minus"] >= margin)
    return ranked.filter(clear).select("typed", first["entry"].alias("entry"), F.greatest(first["slips"], F.lit(-1)).alias("slips"), (-first["minus"]).alias("score"))


def concept_forms(concepts: DataFrame, id_col: str = "concept_id") -> DataFrame:
    """(entry, form) of the canonical names and aliases; canonical names come first where an alias is ambiguous."""
    alias_columns = sorted(c for c in concepts.columns if c.startswith("alias_"))
    return concepts.select(F.col(id_col).cast("int").alias("entry"), F.explode(F.array("canonical", *alias_columns)).alias("form")).filter(F.col("form").isNotNull())


def map_entries(df: DataFrame, concepts: DataFrame, id_col: str = "formula_id", name: str = "concept", latex: str = "latex") -> DataFrame:
    """(id_col, concept_id): one row per record with a non-null name field; -1 where it denotes no entry."""
    typed = cut(df.filter(F.col(name).isNotNull()).select(id_col, F.coalesce(typed_name(F.col(name), F.coalesce(F.col(latex), F.lit(""))), F.lit("")).alias("typed")))
    matched = match_values(typed.select("typed"), concept_forms(concepts)).select("typed", F.col("entry").alias("concept_id"))
    return lookup_join(typed, matched, "typed", "left").select(id_col, F.coalesce("concept_id", F.lit(-1)).alias("concept_id"))


def unmatched(df: DataFrame, concepts: DataFrame) -> DataFrame:
    """(typed, n_records): names that denote no entry, with their records."""
    typed = cut(df.filter(F.col("concept").isNotNull()).select(typed_name(F.col("concept"), F.coalesce("latex", F.lit(""))).alias("typed")))
    matched = match_values(typed, concept_forms(concepts)).select("typed")
    return typed.groupBy("typed").agg(F.count(F.lit(1)).alias("n_records")).join(matched, "typed", "left_anti")
