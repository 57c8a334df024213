"""Texts of evidence, profiles, items and configuration, as column expressions; Arrow functions where the JVM has none."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.keys import clean_field, plain_key

ENDS = "[.!?。！？]+$"
#: Words of a text in English, and phrases that need the page beside them.
ENGLISH_WORD = "[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
CONTEXT_DEPENDENT = r"\b(?:the|this|that)\s+(?:attached|provided|supplied|above|below)\s+(?:image|figure|diagram|slide)\b|\b(?:on|in)\s+this\s+(?:page|slide)\b"


@F.pandas_udf(T.StringType())
def compatible(x: pd.Series) -> pd.Series:
    """Compatibility composition, which the JVM functions lack."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def clean_text(x: Column, most: int = 1000) -> Column:
    """Compatible characters, NUL as a blank, single blanks, at most `most` characters. Texts in ASCII stay in the JVM."""
    plain = F.when(x.rlike("[^\\x00-\\x7f]"), compatible(x)).otherwise(x)
    return F.substring(F.trim(F.regexp_replace(plain, r"(?U)[\s\x00]+", " ")), 1, most)


def clean_evidence(x: Column) -> Column:
    return clean_text(x, 800)


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def append_sentences(old: Column, new: Column) -> Column:
    """Old text and the sentences of the new one that it lacks, joined by one full stop."""
    seen = F.transform(sentences(old), plain_key)
    more = F.filter(sentences(new), lambda s: ~F.array_contains(seen, plain_key(s)))
    left = F.rtrim(F.regexp_replace(F.rtrim(old), ENDS, ""))
    right = F.array_join(F.transform(more, lambda s: F.trim(F.regexp_replace(s, ENDS, ""))), ". ")
    return F.when(F.coalesce(F.size(more), F.lit(0)) < 1, old).when(F.coalesce(left, F.lit("")) == "", right).otherwise(F.concat(left, F.lit(". "), right))


def is_duplicate(old: Column, new: Column) -> Column:
    """Whether a new text stands in the old one after normalisation; an empty one doesn't."""
    return (plain_key(new) != "") & F.contains(plain_key(old), plain_key(new))


def english_words(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(ENGLISH_WORD), F.lit(0)))


def fallback_profile(concept: Column, aliases: Column, most: int = 120) -> Column:
    """Profile of a concept of which nothing else is known; aliases are an array."""
    some = F.filter(F.transform(aliases, lambda a: F.trim(a)), lambda a: a != "")
    names = F.when(F.coalesce(F.size(some), F.lit(0)) > 0, F.array_join(F.slice(some, 1, 3), ", ")).otherwise(concept)
    text = F.concat(concept, F.lit(" is a machine learning course concept. It appears with related terms such as "), names, F.lit(" and is used to describe model ideas, data, optimization, or evaluation."))
    ws = F.split(text, r"\s+")
    return F.when(F.size(ws) > most, F.concat(F.regexp_replace(F.array_join(F.slice(ws, 1, most), " "), "[.,;:]+$", ""), F.lit("."))).otherwise(text)


def embedding_text(concept: Column, aliases: Column, profile: Column) -> Column:
    """What is encoded for a concept: name, other names, profile, one to a line."""
    names = F.array_join(F.filter(F.transform(aliases, lambda a: F.trim(a)), lambda a: a != ""), ", ")
    other = F.when((F.coalesce(names, F.lit("")) != "") & (names != concept), F.concat(F.lit("Aliases: "), names))
    return F.concat_ws("\n", F.concat(F.lit("Concept: "), concept), other, F.concat(F.lit("Profile: "), profile))


def pair_texts(source: Column, source_profile: Column, target: Column, target_profile: Column) -> tuple[Column, Column]:
    """Texts of the two sides of a pair."""
    return F.concat(F.lit("Candidate prerequisite: "), source, F.lit(". "), source_profile), F.concat(F.lit("Target concept: "), target, F.lit(". "), target_profile)


def marked_pages(chunk: Column) -> Column:
    """Pages that marks in a chunk name."""
    return F.transform(F.regexp_extract_all(chunk, F.lit(r"\[PDF_PAGE\s+(\d+)\s+\|"), F.lit(1)), lambda x: x.cast("int"))


def strict_int(x: Column) -> Column:
    """Integer of a text of digits, null for anything else, so also for true and false."""
    return F.when(F.trim(x.cast("string")).rlike(r"^[+-]?\d+$"), F.trim(x.cast("string")).try_cast("long"))


def unique_by(values: Column, key=lambda x: x) -> Column:
    """The first of the values of each key, in their order."""
    return F.aggregate(values, F.filter(values, lambda _: F.lit(False)), lambda got, v: F.when(F.exists(got, lambda g: key(g) == key(v)), got).otherwise(F.concat(got, F.array(v))))


def unique_fields(values: Column) -> Column:
    return unique_by(values, clean_field)


def unique_folded(values: Column) -> Column:
    return unique_by(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), F.lower)


def merged_aliases(canonical: Column, *lists: Column, key=plain_key) -> Column:
    """All aliases once each, without those that are the canonical name."""
    return F.filter(unique_by(F.flatten(F.array(*lists)), key), lambda a: key(a) != key(canonical))


def public_fields(fields: Column, excluded: tuple[str, ...] = ()) -> Column:
    """A map without empty values and without fields that only the machine needs."""
    return F.map_filter(fields, lambda k, v: ~k.isin("path", "order", *excluded) & v.isNotNull() & (v != ""))


def image_kind(data: Column) -> Column:
    """Media type of an image by its first bytes, null if it is none."""
    h = F.hex(F.substring(data, 1, 12))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
    )


def compact_formula(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"(?U)\s+", "")


def rescued_json(text: str) -> str | None:
    """The JSON object in a model's output: the whole text, or the first balanced object in it; null if there is none."""
    t = text.strip().strip("`")
    t = t[4:].strip() if t[:4].lower() == "json" else t
    decoder = json.JSONDecoder()
    try:
        value = json.loads(t)
    except ValueError:
        start = t.find("{")
        if start < 0:
            return None
        try:
            value = decoder.raw_decode(t, start)[0]
        except ValueError:
            return None
    return json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else None


@F.pandas_udf(T.StringType())
def json_rescue(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else rescued_json(s))


REFERENCE = re.compile(r"(\b(?:option|choice)\s*|\b(?:correct\s+answer|answer)\s*(?:is|:)\s*|correct\s+answer\s*(?:is|:)?\s*)([A-D])(?![A-Za-z])", re.I)


@F.pandas_udf(T.StringType())
def relabelled(text: pd.Series, moves: pd.Series) -> pd.Series:
    """Option labels in prose moved all at once; `moves` gives the new labels of A, B, C, D as four letters."""
    return pd.Series([None if t is None or m is None else REFERENCE.sub(lambda x, m=m: x.group(1) + m["ABCD".index(x.group(2).upper())], t) for t, m in zip(text, moves)], dtype=object)


#: Characters that LaTeX reads as commands, and what prints them.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_escaped(x: Column) -> Column:
    """A text for LaTeX, character by character in one pass; null as an empty text."""
    table = F.create_map(*[F.lit(v) for pair in LATEX.items() for v in pair])
    return F.coalesce(F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.element_at(table, c), c)), ""), F.lit(""))


def latex_restored(x: Column) -> Column:
    """Commands whose first letters were read as control characters."""
    for seen, tails, letter in (("\\x08", "oldsymbol|ar|eta", "b"), ("\t", "extbf|ext|imes|heta|ilde|anh", "t"), ("\\x0c", "rac", "f"), ("\r", "ho", "r")):
        x = F.regexp_replace(x, f"{seen}(?=(?:{tails}))", f"\\\\{letter}")
    return x


def seeded_vector(text: str, dim: int, seed: int) -> np.ndarray:
    """The same small normal vector for a text in every run."""
    start = int.from_bytes(hashlib.sha256(f"{seed}:{text}".encode()).digest()[:8], "little") % 2**32
    return np.random.default_rng(start).normal(0.0, 0.01, size=dim).astype(np.float32)


def seeded_vectors(dim: int, seed: int = 42):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else seeded_vector(s, dim, seed).tolist())

    return run


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values whose mask is 1; 0 if there are none."""
    picked = F.transform(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["v"].cast("double") * z["m"])
    return F.aggregate(picked, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, b: a + b), F.lit(1.0))


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
