"""Normalisation keys as column expressions. Unicode forms that the JVM has no function for take an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[a-z0-9]+(?:[-'][a-z0-9]+)?"


def clean_field(x: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(x), r"[ \t\r\n]+", " "))


def normalize_text(x: Column) -> Column:
    """Lower case; zero-width spaces and underscores become spaces."""
    return F.translate(F.lower(x), "​_", "  ")


def tokens(x: Column) -> Column:
    """Words of letters and digits, with inner hyphens and apostrophes."""
    return F.regexp_extract_all(normalize_text(x), F.lit(WORD), F.lit(0))


def phrase_token(x: Column) -> Column:
    """One token for a phrase."""
    return F.concat(F.lit("__phrase__"), F.array_join(tokens(x), "_"))


def singular(t: Column) -> Column:
    """A token without its plural ending: long words in -ies, -es (not -ses) and -s (not -ss)."""
    n = F.length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(F.substr(t, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & t.endswith("es") & ~t.endswith("ses"), F.substr(t, F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.substr(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def plain_key(x: Column) -> Column:
    """Letters and digits in lower case, parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def plural_key(x: Column) -> Column:
    """plain_key with every token in the singular."""
    return F.array_join(F.transform(F.split(plain_key(x), " "), singular), " ")


def concept_name(x: Column, most: int = 120) -> Column:
    """Name for display: one kind of dash, no outer punctuation, tight hyphens, at most `most` characters."""
    x = F.regexp_replace(F.lower(x), "[‐-―−]", "-")
    x = F.regexp_replace(x, r"[ \t\r\n]*-[ \t\r\n]*", "-")
    x = F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))
    return F.substring(F.regexp_replace(x, r"^[.,;:!?\"'()\[\]{} -]+|[.,;:!?\"'()\[\]{} -]+$", ""), 1, most)


def slug(x: Column, most: int = 60) -> Column:
    """Lower-case ASCII words joined by hyphens; `item` if nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.when(s == "", F.lit("item")).otherwise(s)


def latex_key(x: Column) -> Column:
    """A formula without dollar signs at its ends and without white space."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"^\$+|\$+$", ""), r"[ \t\r\n]+", "")


def balanced(x: Column, left: str, right: str) -> Column:
    """Whether a text has as many of one bracket as of the other."""
    return F.length(F.translate(x, left, "")) == F.length(F.translate(x, right, ""))


def clean_pdf_text(x: Column) -> Column:
    """Ligatures spelt out, words joined over line ends, at most one blank line in a row."""
    for glyph, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        x = F.replace(x, F.lit(glyph), F.lit(letters))
    x = F.regexp_replace(x, r"([A-Za-z])-\n([a-z])", "$1$2")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


@F.pandas_udf(T.StringType())
def folded(x: pd.Series) -> pd.Series:
    """Compatibility composition and full case folding, which the JVM functions lack."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def ascii_folded(x: pd.Series) -> pd.Series:
    """Letters without their accents, other characters outside ASCII dropped."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def safe_int(x: Column, default: int | None = None) -> Column:
    """Integer or the default."""
    return F.coalesce(x.try_cast("long"), F.lit(default).cast("long"))


def safe_float(x: Column, default: float | None = None) -> Column:
    """Finite number or the default."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(default).cast("double")).otherwise(d)


def truthy(x: Column) -> Column:
    """Loose reading of yes and no."""
    v = F.lower(F.trim(x.cast("string")))
    return F.when(v.isin("true", "yes", "1", "y", "pass", "passed"), True).when(v.isin("false", "no", "0", "n", "fail", "failed"), False)


def logit(p: Column) -> Column:
    """Log odds, clipped away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def calibrated(l: Column, temperature: float, bias: float) -> Column:  # noqa: E741
    """Probability of a logit after temperature and bias."""
    return 1 / (1 + F.exp(-(l / temperature + bias)))
