"""Corpus vocabulary: counts of the words of a text column, over all rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formulas, which hold no words.
FORMULA = r"\$[^$\n]*\$"
#: What may surround a word without belonging to it.
EDGE = r"^[(\[{\"'“‘„«.,;:!?…*_–—-]+|[)\]}\"'”’»“.,;:!?…*_–—-]+$"
EDGE_RE = re.compile(EDGE)
FORMULA_RE = re.compile(FORMULA)


def tokens(text: Column) -> Column:
    """Words of a text with what surrounds them cut off; formulas left out."""
    bare = F.regexp_replace(text, FORMULA, " ")
    return F.filter(F.transform(F.split(bare, r"(?U)\s+"), lambda t: F.regexp_replace(t, EDGE, "")), lambda t: F.length(t) > 0)


def strip_edges(token: str) -> str:
    return EDGE_RE.sub("", token)


def word_counts(texts: DataFrame, column: str = "text", lower: bool = True) -> DataFrame:
    """(word, n) over all rows; partial sums are made before the shuffle, so frequent words cost nothing more."""
    words = texts.select(F.explode(tokens(F.col(column))).alias("word"))
    if lower:
        words = words.select(F.lower("word").alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
