"""Comparison of names as people type them: tokens, stems, slips of a letter, joined words."""

from __future__ import annotations

import re
from functools import lru_cache

WORD = re.compile(r"[^\W_]+")

#: British endings and the American ones that stand for them, longest first.
SPELLINGS = [("isation", "ization"), ("ising", "izing"), ("ised", "ized"), ("iser", "izer"), ("ise", "ize"), ("our", "or"), ("elling", "eling"), ("elled", "eled"), ("tre", "ter")]


def words(name: str | None) -> list[str]:
    """Lower-case runs of letters and digits; letters of compatibility forms and combining marks are left as they are."""
    return WORD.findall(name.lower()) if name else []


@lru_cache(200_000)
def stem(word: str) -> str:
    """Singular in American spelling; words with digits are left alone."""
    if any(c.isdigit() for c in word):
        return word
    w = word
    if len(w) > 4 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif len(w) > 4 and w.endswith(("ches", "shes", "sses", "xes")):
        w = w[:-2]
    elif len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
        w = w[:-1]
    for british, american in SPELLINGS:
        if w.endswith(british):
            return w[: -len(british)] + american
        if british == "our" and "our" in w[2:]:
            w = w.replace("our", "or")
    return w


@lru_cache(200_000)
def slips(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that make a into b; most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def allowed(word: str) -> int:
    """Slips that a word of this length may have."""
    return 0 if len(word) < 4 or any(c.isdigit() for c in word) else 1 if len(word) < 6 else 2


def word_slips(a: str, b: str) -> int | None:
    """Slips between two words that stand at the same place of a name, None if they are different words."""
    x, y = stem(a), stem(b)
    if x == y:
        return 0
    n = min(slips(x, y), slips(a, b))
    return n if n <= min(allowed(x), allowed(y)) else None


def distance(typed: list[str], meant: list[str], vocabulary=frozenset()) -> int | None:
    """Slips between two names, None if they are different names.

    Names of as many words are compared word by word: stems may differ by the slips that their length allows each, and a
    typed word that is itself a word of `vocabulary` (stems) stands for no other. Otherwise the words may be joined:
    then the texts without spaces are compared, and digits must agree.
    """
    if not typed or not meant:
        return None
    if len(typed) == len(meant):
        total = 0
        for a, b in zip(typed, meant):
            n = word_slips(a, b)
            if n is None or (stem(a) != stem(b) and stem(a) in vocabulary):
                total = None
                break
            total += n
        if total is not None:
            return total
    if abs(len(typed) - len(meant)) > 2 and len(typed) != 1 and len(meant) != 1:
        return None
    a, b = "".join(typed), "".join(meant)
    if a != b and [c for c in a if c.isdigit()] != [c for c in b if c.isdigit()]:
        return None
    if len(typed) == len(meant):
        return None if a != b else 0
    few = min(slips(a, b), slips(stem(a), stem(b)))
    if few > 2 or (few and _odd_word(typed, meant)):
        return None
    return few


def _odd_word(typed: list[str], meant: list[str]) -> bool:
    """Whether the shorter name's words can't be had by joining whole neighbours of the longer one, within slips."""
    short, long = (typed, meant) if len(typed) < len(meant) else (meant, typed)

    def fits(i: int, j: int) -> bool:
        if i == len(short):
            return j == len(long)
        joined = ""
        for k in range(j, len(long)):
            joined += long[k]
            if len(joined) > len(short[i]) + 2:
                break
            if min(slips(stem(short[i]), stem(joined)), slips(short[i], joined)) <= max(1, allowed(joined)) and fits(i + 1, k + 1):
                return True
        return False

    return not fits(0, 0)
