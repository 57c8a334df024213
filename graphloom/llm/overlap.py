"""Overlap of splits (problem 7): evaluation records that also stand in the training split, exactly or nearly.

Method: two joins over the distinct names of each side, not over rows, find every pair that names.distance may allow,
and names.distance decides. Neither join has a threshold.

Names of as many words: the distinct words of both sides that are near each other meet by their deletion
neighbourhoods, the texts that up to two deletions leave (words within two slips share one). The names are then walked
word by word as paths from their first word: a pair of paths goes on where the next words are near, so only pairs
that agree so far are carried on.

Joined words: texts without spaces that are within two slips have a half with at most one, so they share what one
deletion leaves of the first or of the second half; texts of up to SHORT characters share what two deletions leave of the
whole. The keys hold the digits and the number of words, so that only names of different numbers of words meet.
Names of as many words whose texts without spaces are equal meet by that text.

Rows are then joined by equality of both matched names, so that copies meet only where they are asked for. Hot names
cost one path, whatever their number of rows.

Defined results: rows with a null source or target match nothing; names without letters or digits match nothing;
repeated rows give one pair each. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.names import allowed, distance, stem, word_slips, words
from graphloom.session import cut, nonempty

#: Texts of up to this length are keyed as a whole; two longer, since the other text may be, on the same keys.
SHORT = 10


def name_key(x: Column) -> Column:
    """Letters and digits in lower case, words parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)[^\p{L}\p{N}\p{M}]+", " "))


@nonempty
def _worded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ws = [words(k) for k in batch["key"]]
        yield pd.DataFrame({"key": batch["key"], "words": ws, "path": [" ".join(w) for w in ws], "text": ["".join(w) for w in ws]})


def _described(names: DataFrame) -> DataFrame:
    """(key, words, path, text) of the distinct names: their words, joined by spaces and without."""
    # each name makes hundreds of keys later, so few names must not end up in one task
    keys = names.select("key").filter(F.length("key") > 0).distinct().repartition(4 * names.sparkSession.sparkContext.defaultParallelism, "key")
    return cut(keys.mapInPandas(_worded, "key string, words array<string>, path string, text string").filter(F.size("words") > 0))


def deletions(text: str, most: int) -> set[str]:
    """What is left of the text after up to `most` deletions."""
    out = last = {text}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


@nonempty
def _word_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(w, crc32(k.encode())) for w in batch["word"] for k in deletions(stem(w), allowed(stem(w))) | deletions(w, allowed(stem(w)))]
        yield pd.DataFrame(out, columns=["word", "k"])


@nonempty
def _near_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[pd.Series([word_slips(a, b) is not None for a, b in zip(batch["lword"], batch["rword"])], index=batch.index, dtype=bool)]


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lword, rword): words of both sides that may stand for each other in names of as many words."""
    keyed = lambda side, p: side.select(F.explode("words").alias("word")).distinct().mapInPandas(_word_keys, "word string, k long").withColumnRenamed("word", f"{p}word")
    # keys are many times the words that the planner sees, so it must not broadcast them
    met = keyed(left, "l").join(keyed(right, "r").hint("merge"), "k").select("lword", "rword").distinct()
    return cut(met.mapInPandas(_near_words, met.schema))


def _steps(side: DataFrame, p: str) -> DataFrame:
    """(i, parent, word, path): the distinct steps of the names' paths, the i-th word following the path of those before it."""
    w = F.col("words")
    at = side.select("words", F.explode(F.sequence(F.lit(1), F.size(w))).alias("i")).select("i", F.array_join(F.slice(w, F.lit(1), F.col("i") - 1), " ").alias(f"{p}parent"), F.element_at(w, F.col("i")).alias(f"{p}word"), F.array_join(F.slice(w, F.lit(1), F.col("i")), " ").alias(f"{p}path"))
    return cut(at.distinct())


def word_by_word(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lkey, rkey) of the names of as many words that are near each other word by word."""
    near, ls, rs = near_words(left, right), _steps(left, "l"), _steps(right, "r")
    longest = min(side.agg(F.coalesce(F.max("i"), F.lit(0))).first()[0] for side in (ls, rs))
    lnames, rnames = (side.select(F.col("key").alias(f"{p}key"), F.col("path").alias(f"{p}path")) for side, p in ((left, "l"), (right, "r")))
    out, pairs = None, None
    for i in range(1, longest + 1):
        here = ls.filter(F.col("i") == i).drop("i")
        on = here if pairs is None else pairs.select(F.col("lpath").alias("lparent"), F.col("rpath").alias("rparent")).join(here, "lparent")
        pairs = cut(on.join(near, "lword").join(rs.filter(F.col("i") == i).drop("i"), ["rword"] if i == 1 else ["rparent", "rword"]).select("lpath", "rpath"))
        done = pairs.join(lnames, "lpath").join(rnames, "rpath").select("lkey", "rkey")
        out = done if out is None else out.unionByName(done)
    return lnames.join(rnames, F.lit(False)).select("lkey", "rkey") if out is None else out


def _joined_keys(text: str, probe: bool) -> set[str]:
    """Keys of a text without spaces; a probe has those of all halves that a text within two slips may have."""
    m = len(text)
    out = {f"w{k}" for k in deletions(text, 2)} if m <= SHORT + 2 else set()
    if m > SHORT:
        # the other text's halves are at most one letter longer or shorter; cut at the same place, texts with one slip before it share a deletion
        firsts, seconds = (range(m // 2 - 1, m // 2 + 2), range((m + 1) // 2 - 1, (m + 1) // 2 + 2)) if probe else ([m // 2], [m - m // 2])
        out |= {f"a{k}" for h in firsts for k in deletions(text[:h], 1)} | {f"b{k}" for h in seconds for k in deletions(text[m - h :], 1)}
    return out


def _text_keys(counts: list[int], probe: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(key, k) by which names meet names of other numbers of words; `counts` are those of the other side."""

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                out = []
                for key, ws, text in zip(batch["key"][at : at + 500], batch["words"][at : at + 500], batch["text"][at : at + 500]):
                    n, digits = len(ws), "".join(c for c in text if c.isdigit())
                    met = [c for c in counts if c != n and (abs(c - n) <= 2 or c == 1 or n == 1)]
                    if met:
                        keys = {k for form in {text, stem(text)} for k in _joined_keys(form, probe)}
                        out += [(key, crc32(f"{k} {digits} {(c, n) if probe else (n, c)}".encode())) for k in keys for c in met]
                yield pd.DataFrame(out, columns=["key", "k"])

    return run


def joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lkey, rkey) of the names whose texts without spaces may be within two slips (equal, if they have as many words)."""
    counts = lambda side: sorted(r[0] for r in side.select(F.size("words")).distinct().collect())  # noqa: E731  # word counts of names
    lk = left.select("key", "words", "text").mapInPandas(_text_keys(counts(right), False), "key string, k long").withColumnRenamed("key", "lkey")
    rk = right.select("key", "words", "text").mapInPandas(_text_keys(counts(left), True), "key string, k long").withColumnRenamed("key", "rkey")
    equal = left.select(F.col("key").alias("lkey"), "text").join(right.select(F.col("key").alias("rkey"), "text"), "text")
    return lk.join(rk.hint("merge"), "k").select("lkey", "rkey").distinct().unionByName(equal.select("lkey", "rkey"))


@nonempty
def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = [distance(words(a), words(b)) is not None or distance(words(b), words(a)) is not None for a, b in zip(batch["lkey"], batch["rkey"])]
        yield batch[pd.Series(keep, index=batch.index, dtype=bool)]


def similar_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lkey, rkey) of the distinct names `key` of both sides that denote the same thing."""
    left, right = _described(left), _described(right)
    pairs = word_by_word(left, right).unionByName(joined(left, right)).distinct()
    return pairs.mapInPandas(_check, pairs.schema)


def _keyed(df: DataFrame, id_col: str, prefix: str, source: str, target: str) -> DataFrame:
    return df.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(
        F.col(id_col).alias(f"{prefix}_id"), name_key(F.col(source)).alias(f"{prefix}_source"), name_key(F.col(target)).alias(f"{prefix}_target"), *([F.col("split")] if "split" in df.columns and prefix == "eval" else [])
    )


def overlaps(train: DataFrame, evaluation: DataFrame, id_col: str = "label_id", source: str = "source", target: str = "target") -> DataFrame:
    """(train_id, eval_id, eval_source, split) of all pairs of rows with the same source and target."""
    t, e = cut(_keyed(train, id_col, "train", source, target)), cut(_keyed(evaluation, id_col, "eval", source, target))
    names = lambda d, p: d.select(F.col(f"{p}_source").alias("key")).union(d.select(F.col(f"{p}_target").alias("key")))
    same = cut(similar_names(names(t, "train"), names(e, "eval")))
    # distinct evaluation pairs, each with the training spellings of both of its names
    pairs = e.select("eval_source", "eval_target").distinct()
    spelled = (
        pairs.join(same.select(F.col("rkey").alias("eval_source"), F.col("lkey").alias("train_source")), "eval_source")
        .join(same.select(F.col("rkey").alias("eval_target"), F.col("lkey").alias("train_target")), "eval_target")
    )
    met = cut(spelled.join(t.select("train_source", "train_target").distinct(), ["train_source", "train_target"]))
    return (
        e.join(met, ["eval_source", "eval_target"])
        .join(t, ["train_source", "train_target"])
        .select("train_id", "eval_id", "eval_source", *(["split"] if "split" in e.columns else []))
        .dropDuplicates(["train_id", "eval_id"])
    )


def found(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(train_id, eval_id) of all overlaps."""
    return overlaps(train, evaluation).select("train_id", "eval_id")


def report(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(split, source, n_eval, n_train, n_pairs): overlapping rows per split and source of the evaluation rows."""
    return overlaps(train, evaluation).groupBy("split", F.col("eval_source").alias("source")).agg(
        F.count_distinct("eval_id").alias("n_eval"), F.count_distinct("train_id").alias("n_train"), F.count(F.lit(1)).alias("n_pairs")
    )
