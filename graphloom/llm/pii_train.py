"""Training of the tagger of personal information, in numpy.

Labelled spans come in two rounds from a bounded sample of documents (`ROWS`, those with the smallest hashes of their
ids). First round: patterns of each type, accepted where the words around them say what they are; a small network is
trained on these. Second round: the sample is labelled anew with what that network finds, set to the ends that the
patterns give, and the network that the operator uses is trained on these spans with their first characters marked.
Patterns and word lists stand in this module only and take no part in the operator. Characters of other texts of the
sample are labelled as none. Each document is taken as it is and three times with other names, words and numbers in
its mentions (`varied`). Windows with and without mentions are mixed; a part is turned into capitals, since some
texts are. A twentieth of the documents is held out; `scores` gives recall and precision of exact spans on it by type.

    python -m graphloom.llm.pii_train DOCUMENTS.parquet OUT.npz [SECONDS [FIRST_ROUND.npz]]
"""

from __future__ import annotations

import multiprocessing
import os
import sys
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import regex

from graphloom.llm.pii import FIRST, N_CHARS, TYPES, WINDOW, Tagger, encode, mentions

ROWS, HIDDEN, EMBED = 9000, 32, 16

# ---------------------------------------------------------------- patterns of the types, for labelling

TOKEN = r"(?:\p{Lu}[\p{L}\p{M}’']+(?:-\p{L}[\p{L}\p{M}’']*)*)"
INITIAL = r"(?:\p{Lu}\.)"
PARTICLE = r"(?:(?i:de la|de los|de|van der|van den|van|von der|von|del|della|di|da|dos|bin|ibn|ter|zu) |(?i:al-|el-|d’|d'))"
ROAD = r"(?i:Street|St\.|St|Avenue|Ave\.|Ave|Road|Rd\.|Rd|Boulevard|Blvd\.|Blvd|Drive|Dr\.|Dr|Lane|Ln\.|Ln|Court|Ct\.|Ct|Terrace|Gardens|Row|Place|Pl|Square|Sq|Way|Close|Crescent|Mews|Grove|Hill|Park|Walk)"
CITY = rf"(?:{TOKEN}(?: {TOKEN})?)"
WEB = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
AT, DOT = r"(?: ?[@＠] ?| ?[\[(](?i:at)[\])] ?| AT )", r"(?:\.| ?[\[(](?i:dot)[\])] ?| DOT )"

GRAMMAR = {
    "email": [rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}_%+-]+(?:\.[\p{{L}}\p{{N}}_%+-]+)*{AT}{WEB}(?:{DOT}{WEB})*{DOT}(?!(?i:ckpt|cached|py|ipynb|pt|bin|json|csv|txt|log)\b)\p{{L}}{{2,}}(?![\p{{L}}\p{{N}}])"],
    "phone": [
        r"(?<![\p{L}\d.+/-])(?:\+|00 ?)\d{1,3}[ .-]?(?:\(0?\d{0,4}\)[ .-]?)?\d(?:[ ./-]?\d){5,12}(?![\p{L}\d])",
        r"(?<![\p{L}\d.+/-])\(\d{2,5}\)[ .-]?\d{3,4}(?:[ .-]?\d{2,4}){1,3}(?![\p{L}\d])",
        r"(?<![\p{L}\d.+/-])(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}(?![\p{L}\d])",
        r"(?<![\p{L}\d.+/-])0\d{1,4}(?:[ ./-]\d{2,8}){1,5}(?![\p{L}\d])",
        r"(?<![\p{L}\d.+/-])0\d{9,12}(?![\p{L}\d])",
    ],
    "identity": [
        r"(?<![\p{L}\d.-])\d{3}[- ]\d{2}[- ]\d{4}(?![\p{L}\d]|\.\p{L})",
        r"(?<![\p{L}\d.-])\d{2}(?: \d{3}){3}(?![\p{L}\d])",
        r"(?<![\p{L}\d.-])(?:\p{Lu}{1,2}-?\d{7}|\p{Lu}{2} \d{6,7}|\p{L}\d{6,8})(?![\p{L}\d])",
        r"(?<![\p{L}\d.-])\p{Lu}{2} ?\d{2} ?\d{2} ?\d{2} ?\p{Lu}(?![\p{L}\d])",
        r"(?<![\p{L}\d.-])\d{8}-?\p{Lu}(?![\p{L}\d])",
        r"(?<=(?i:nummer|number|étudiant|no\.?|ID|DNI|NIF|passport|matricule|alumno|identity)(?::|\.| is)? )(?<!(?i:block)\s+(?i:id)\s+)\d{6,9}(?![\p{L}\d-])",
    ],
    "address": [
        rf"(?<![\p{{L}}\d])(?:(?i:Flat|Unit|Apt|Apartment|Suite) \d+\w?, )?\d+\p{{L}}? {TOKEN} {ROAD}(?:, (?i:Apt|Apartment|Unit|Flat|Suite)\.? \w+)?, {CITY}(?:,? (?:\p{{Lu}}{{2}} \d{{5}}|\p{{Lu}}{{1,2}}\d\w? \d\p{{Lu}}{{2}}))?(?![\p{{L}}\d])",
        rf"(?<![\p{{L}}\d])(?:{TOKEN}[ -])?\p{{Lu}}[\p{{L}}\p{{M}}]*(?i:straße|strasse|str\.|weg|platz|gasse|allee|ring) \d+ ?\p{{L}}?, \d{{4,5}} {CITY}(?![\p{{L}}\d])",
        rf"(?<![\p{{L}}\d])\d+(?: ?(?i:bis|ter))?,? (?i:rue|avenue|boulevard|place|chemin|impasse|allée|quai) (?i:de la |de l’|de l'|des |du |de )?{TOKEN}, \d{{5}} {CITY}(?![\p{{L}}\d])",
        rf"(?<![\p{{L}}\d])(?i:Calle|Avenida|Avda\.|Plaza|Paseo|Via|Rua) (?i:de la |del |de )?{TOKEN},? \d+\w?, \d{{5}} {CITY}(?![\p{{L}}\d])",
    ],
    "name": [
        rf"(?<![\p{{L}}\d.’'-])(?:{TOKEN}|{INITIAL})(?: {INITIAL})* {PARTICLE}?{TOKEN}(?![\p{{L}}\d-])",
        rf"(?<![\p{{L}}\d.’'-])(?:{PARTICLE})?{TOKEN}, (?:{TOKEN}|{INITIAL})(?: {INITIAL})*(?![\p{{L}}\d-])",
        rf"(?<![\p{{L}}\d.’'-]){TOKEN} {INITIAL}(?=\s*(?:$|\n|,))",
    ],
}
def _spaced(pattern: str) -> str:
    """The pattern with every space standing for any run of up to four blanks of one line."""
    blanks = " \\t\\u00a0\\u2000-\\u200b\\u202f\\u3000"
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append((blanks if inside else f"(?:[{blanks}]{{1,4}})") if c == " " else c)
        k += 1
    return "".join(out)


COMPILED = {t: [regex.compile(_spaced(p)) for p in ps] for t, ps in GRAMMAR.items()}
#: Titles, which don't belong to a name.
TITLE = regex.compile(r"^(?:(?i:Dr|Prof|Professor|Mr|Mrs|Ms|Mme|Mlle|Herr|Frau|Sr|Sra|Señor|Señora|Don|Doña|Alumno|Alumna|Madame|Monsieur|Doctor)\.? )+")


def matches(text: str, kind: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """All mentions of a type between two places that the grammar allows, also overlapping ones."""
    for pattern in COMPILED[kind]:
        for m in pattern.finditer(text, start, len(text) if end is None else end, overlapped=True):
            yield m.span()


#: Words that begin a sentence or label before a name, or stand for something else than people.
NO_NAME = frozenset("the der die das den dem ein eine see in im am an by for from to and hi hello dear thanks prof dr if when this that these every each no one most both call ping load block version checkpoint course section step table figure report use printed address phone contact office hours submitted questions answer abgegeben rückfragen sprechstunde corrigé copie entregado alumna alumno para por le la les el los il elle main road hidden layer matrikelnummer ssn dni nif calle flat apt tel phone passport numéro nombre".split())
#: What methods and results are called.
THINGS = frozenset("bound network operator propagation bagging quadrature theorem lemma method algorithm transform estimator filter tree search descent sampling averaging update criterion regression relaxation schedule selection alignment projection splitting pruning reweighting consensus matching encoding sketching routing distance penalty factorisation smoothing hashing ensemble pooling interpolation ranking objective map avenue".split())
BEFORE_COMMA = regex.compile(rf"(?:{TOKEN}|{INITIAL}|\b(?:de|van|von|del|da|al))[ -]$")
TITLES = frozenset("dr prof professor mr mrs ms mme mlle herr frau sr sra don alumno alumna".split())
THING = regex.compile(r"^[ -](?i:Bound|Network|Operator|Propagation|Bagging|Quadrature|Theorem|Lemma|Method|Algorithm|Transform|Estimator|Filter|Tree|Search|Descent|Sampling|Averaging|Update|Map|Avenue)\b|^ \p{Lu}[\p{Ll}]+")


def _is_name(text: str, a: int, b: int) -> bool:
    """Whether the words of a mention can be a person's name where they stand."""
    tokens = regex.findall(r"[\p{L}\p{M}’']+", text[a:b].lower())
    if any(t in NO_NAME for t in tokens[:2]) or tokens[-1] in NO_NAME or any(t in THINGS for t in tokens):
        return False
    if "," in text[a:b]:  # the surname comes first: nothing of a name before it, no house number after it
        before = BEFORE_COMMA.search(text[max(0, a - 30) : a])
        if before and regex.search(r"(?i:abgegeben|eingereicht|rendue|entregado) (?:von|par|por) $", text[max(0, a - 16) : a]):
            before = None
        if regex.match(r" \d", text[b : b + 2]) or (before and not {before.group().strip(" -.").lower()} & (NO_NAME | TITLES)):
            return False
    if text[a:b].isupper():
        return True
    return not (regex.search(r"\b(?i:the|der|die|das) $", text[max(0, a - 5) : a]) and THING.match(text[b : b + 30]))


def settle(text: str, kind: str, start: int, end: int) -> tuple[int, int] | None:
    """The mention of this type that overlaps a run: the longest one, for names in capitals the closest one."""
    lo, hi = max(0, start - 200), min(len(text), end + 200)
    best, score = None, 0.0
    for a, b in matches(text, kind, lo, hi):
        if kind == "name":
            if m := TITLE.match(text[a:b]):
                a += m.end()
            elif text[a : a + 4] == "von " and regex.search(r"(?i:abgegeben|eingereicht) $", text[max(0, a - 12) : a]):
                a += 4
            if not regex.search(r"\s|\u200b", text[a:b]) or not _is_name(text, a, b):
                continue
        both = min(b, end) - max(a, start)
        if both <= 0:
            continue
        near = both / (max(b, end) - min(a, start))
        s = near if kind == "name" and text[a:b].isupper() else b - a + near if near >= 0.2 else near
        if s > score + 1e-9:
            best, score = (a, b), s
    return best if score >= 0.2 else None


def runs(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, start, end) of stretches of one label; gaps of up to two characters are closed."""
    at = np.flatnonzero(labels)
    out: list[tuple[int, int, int]] = []
    if not len(at):
        return out
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(labels[at]) != 0)) + 1
    for piece in np.split(at, cuts):
        label, a, b = int(labels[piece[0]]), int(piece[0]), int(piece[-1]) + 1
        if out and out[-1][0] == label and a - out[-1][2] <= 2:
            out[-1] = (label, out[-1][1], b)
        else:
            out.append((label, a, b))
    return out


def labelled(text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of what a first-round network finds, set to the ends of the patterns."""
    found: list[tuple[int, int, str]] = []
    for label, a, b in runs(labels):
        kind = TYPES[label - 1]
        span = settle(text, kind, a, b)
        if span is None:  # what only looks like another type
            for kind in ("email", "address"):
                if span := settle(text, kind, a, b):
                    break
        if span:
            found.append((*span, kind))
    seen = {(text[a:b], kind) for a, b, kind in found}
    for surface, kind in seen:  # the same text elsewhere in the document
        at = text.find(surface)
        while at >= 0:
            end = at + len(surface)
            if not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                found.append((at, end, kind))
            at = text.find(surface, end)
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(set(found), key=lambda x: (x[0] - x[1], x[0], TYPES.index(x[2]))):  # longest first
        if all(b <= c or a >= d for c, d, _ in out):
            out.append((a, b, kind))
    return sorted(out)



_N = "|".join(f"(?:{p})" for p in GRAMMAR["name"][:2]).replace(r"(?<![\p{L}\d.’'-])", "")
#: Words that introduce a name or follow one.
BEFORE = r"(?:[Ss]ubmitted by:? |I asked |go(?:es)? to |was graded for |Office hours: |submission by |Contact: |bitte an |bei (?:Frau |Herrn? )|Corrigé par (?:Mme |M\. )?|rendue par |Abgegeben von |[Ee]ntregado por |Alumn[oa] |name=|Name: |Dr\. |Prof\. |Mme |Frau |Herr |Mr\. |Mrs\. |Ms\. |(?:^|\n)\s*[—–-] ?|(?:Dr|Prof)\. [^.\n]{3,40} and |explaining [^.!\n]{3,60}!\s*[—–] ?|sheet to |Student: |by )"
NAME_AFTER = regex.compile(rf"(?i:{BEFORE})({_N})", regex.M)
NAME_BEFORE = regex.compile(rf"({_N})(?= (?:says that|wrote the|corrected the|and (?:{_N}) corrected)| <[^>]*@)")
IDENTITY = regex.compile(r"(?:SSN|[Ss]ocial security number|[Pp]assport|PASSPORT|(?:[Nn]ational )?(?<!Block )ID|Matrikelnummer|numéro d['’]étudiant|NI number|DNI|NIF|[Ss]tudent (?:number|no\.?|ID)|[Ii]dentity (?:number|card)|Ausweis\w*)(?:[: ]| is | no\.? |\s)*$", regex.I)
NOT_PHONE = regex.compile(r"(?:seed was|Version|rows|shape|Checkpoint|Block id|code|room|x|to|number|ID|DNI|SSN|passport) $", regex.I)


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, label) of the mentions that their surroundings confirm."""
    out = []
    for kind in ("email", "address"):
        for p in COMPILED[kind]:
            out += [(*m.span(), kind) for m in p.finditer(text)]
    for p in COMPILED["identity"]:
        out += [(*m.span(), "identity") for m in p.finditer(text) if IDENTITY.search(text, max(0, m.start() - 40), m.start())]
    for p in COMPILED["phone"]:
        out += [(*m.span(), "phone") for m in p.finditer(text) if sum(c.isdigit() for c in m.group()) >= 9 and not NOT_PHONE.search(text, max(0, m.start() - 14), m.start())]
    for p in (NAME_AFTER, NAME_BEFORE):
        for m in p.finditer(text, overlapped=True):
            a, b = m.span(1)
            if t := TITLE.match(text[a:b]):
                a += t.end()
            if " " in text[a:b] and _is_name(text, a, b) and not regex.search(r"(?i:\b(?:the|bound|network|operator|section|figure|road|layer|avenue)\b)", text[a:b]):
                out.append((a, b, "name"))
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(out, key=lambda x: (TYPES.index(x[2]), x[0] - x[1])):
        if all(b <= c or a >= d for c, d, _ in kept):
            kept.append((a, b, kind))
    return [(a, b, TYPES.index(k) + 1) for a, b, k in kept]


Spans = list[tuple[int, int, int]]


def numbered(found: list[tuple[int, int, str]]) -> Spans:
    return [(a, b, TYPES.index(k) + 1) for a, b, k in found]


def character_labels(n: int, spans: Spans, mark: bool) -> np.ndarray:
    y = np.zeros(n, np.int8)
    for a, b, k in spans:
        y[a:b] = k
        if mark:
            y[a] = FIRST
    return y


VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnprstvwxz"


def varied(text: str, spans: Spans, rng: np.random.Generator, share: float = 0.6) -> str:
    """The text with other letters and digits in its mentions, so that no names are learnt by heart; places stay.

    Capitalised words keep their case pattern, vowels and consonants their kind; a part of the words stays as it is, so
    that words which mark a type are still met. Mail addresses change in their small letters before the last dot.
    """
    out = list(text)
    for a, b, k in spans:
        kind = TYPES[k - 1]
        end = a + max(text[a:b].rfind("."), text[a:b].upper().rfind("DOT")) if kind == "email" else b
        for m in regex.finditer(r"\p{Ll}{3,}" if kind == "email" else r"(?<=\p{Lu})\p{Ll}{2,}|\p{Lu}{4,}", text[a:end]):
            if rng.random() < share:
                for i in range(a + m.start(), a + m.end()):
                    low = out[i].lower()
                    pool = VOWELS if low in VOWELS else CONSONANTS if low in CONSONANTS else ""
                    if pool and rng.random() < 0.8:
                        c = pool[rng.integers(len(pool))]
                        out[i] = c.upper() if out[i].isupper() else c
        if kind != "email":
            for i in range(a, b):
                if out[i].isdigit() and not (i == a and out[i] == "0") and rng.random() < share:
                    out[i] = str(rng.integers(0 if i > a else 1, 10))
    return "".join(out)


def windows(texts: list[str], rng: np.random.Generator, label: Callable[[int, str], Spans] = lambda _, t: weak_spans(t), mark: bool = False, vary: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, labels) of windows around mentions, and of others."""
    ids, labels = [], []
    for i, text in enumerate(texts):
        spans = label(i, text)
        text = varied(text, spans, rng) if vary and spans else text
        upper = len(text.upper()) == len(text) and rng.random() < 0.08
        coded = encode(text.upper() if upper else text)
        y = character_labels(len(text), spans, mark)
        starts = {max(0, int((a + b) // 2 - rng.integers(20, WINDOW - 20))) for a, b, _ in spans}
        if len(text) > 40:
            starts |= {int(rng.integers(0, max(1, len(text) - 60))) for _ in range(1 + len(text) // 800)} | {0}
        for s in starts:
            row, lab = np.zeros(WINDOW, np.int16), np.zeros(WINDOW, np.int8)
            n = min(WINDOW, len(coded) - s)
            row[:n], lab[:n] = coded[s : s + n], y[s : s + n]
            ids.append(row)
            labels.append(lab)
    return np.array(ids), np.array(labels)


def initial(rng: np.random.Generator, hidden: int = HIDDEN, embed: int = EMBED) -> dict[str, np.ndarray]:
    k = len(TYPES) + 2
    w = {"emb": rng.normal(0, 0.3, (N_CHARS, embed)), "bo": np.zeros(k), "move": np.eye(k) * 1.0}
    for d in "fb":
        w |= {f"wx_{d}": rng.normal(0, embed**-0.5, (embed, 4 * hidden)), f"wh_{d}": rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)), f"b_{d}": np.zeros(4 * hidden), f"wo_{d}": rng.normal(0, 0.3, (hidden, k))}
        w[f"b_{d}"][hidden : 2 * hidden] = 1.0  # remember at first
    return {n: v.astype(np.float32) for n, v in w.items()}


def _run(w: dict, ids: np.ndarray, d: str) -> tuple[np.ndarray, list]:
    """Hidden states and what the way back needs; gate order: in, forget, out, new."""
    n, t = ids.shape
    wh = w[f"wh_{d}"]
    size = wh.shape[0]
    table = w["emb"] @ w[f"wx_{d}"] + w[f"b_{d}"]
    h = c = np.zeros((n, size), np.float32)
    out, kept = np.empty((t, n, size), np.float32), [None] * t
    for k in range(t) if d == "f" else range(t - 1, -1, -1):
        z = table[ids[:, k]] + h @ wh
        s = 0.5 * np.tanh(0.5 * z[:, : 3 * size]) + 0.5
        g = np.tanh(z[:, 3 * size :])
        c2 = s[:, size : 2 * size] * c + s[:, :size] * g
        tc = np.tanh(c2)
        kept[k] = (h, c, s, g, tc)
        c, h = c2, s[:, 2 * size :] * tc
        out[k] = h
    return out, kept


def _back(w: dict, grads: dict, ids: np.ndarray, d: str, dout: np.ndarray, kept: list) -> None:
    n, t = ids.shape
    wh = w[f"wh_{d}"]
    size = wh.shape[0]
    dh = dc = np.zeros((n, size), np.float32)
    dz_all = np.empty((t, n, 4 * size), np.float32)
    dwh = np.zeros_like(wh)
    for k in range(t - 1, -1, -1) if d == "f" else range(t):
        h, c, s, g, tc = kept[k]
        i, f, o = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :]
        dh = dh + dout[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[k]
        dz[:, :size] = dc * g * i * (1 - i)
        dz[:, size : 2 * size] = dc * c * f * (1 - f)
        dz[:, 2 * size : 3 * size] = dh * tc * o * (1 - o)
        dz[:, 3 * size :] = dc * i * (1 - g * g)
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    by_char = np.zeros((N_CHARS, 4 * size), np.float32)
    np.add.at(by_char, ids.T.ravel(), dz_all.reshape(-1, 4 * size))
    grads[f"wh_{d}"] = dwh
    grads[f"b_{d}"] = by_char.sum(0)
    grads[f"wx_{d}"] = w["emb"].T @ by_char
    grads["emb"] = grads.get("emb", 0) + by_char @ w[f"wx_{d}"].T


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def step(w: dict, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Negative log likelihood of the labels under the CRF, per character, and its gradients."""
    hf, kf = _run(w, ids, "f")
    hb, kb = _run(w, ids, "b")
    e = hf @ w["wo_f"] + hb @ w["wo_b"] + w["bo"]
    t, n, k = e.shape
    move, yt = w["move"], y.T.astype(np.int64)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for i in range(1, t):
        alpha[i] = _logsum(alpha[i - 1][:, :, None] + move[None], 1) + e[i]
    for i in range(t - 2, -1, -1):
        beta[i] = _logsum(move[None] + (e[i + 1] + beta[i + 1])[:, None, :], 2)
    log_z = _logsum(alpha[-1], 1)
    rows = np.arange(n)
    gold = e[np.arange(t)[:, None], rows[None], yt].sum(0) + move[yt[:-1], yt[1:]].sum(0)
    scale = 1.0 / (n * t)
    de = np.exp(alpha + beta - log_z[None, :, None])
    pair = np.zeros_like(move)
    for i in range(t - 1):
        pair += np.exp(alpha[i][:, :, None] + move[None] + (e[i + 1] + beta[i + 1])[:, None, :] - log_z[:, None, None]).sum(0)
    np.subtract.at(pair, (yt[:-1].ravel(), yt[1:].ravel()), 1)
    de[np.arange(t)[:, None], rows[None], yt] -= 1
    de *= scale
    grads = {"move": pair * scale, "bo": de.sum((0, 1))}
    for d, h, kept in (("f", hf, kf), ("b", hb, kb)):
        grads[f"wo_{d}"] = np.tensordot(h, de, ([0, 1], [0, 1]))
        _back(w, grads, ids, d, de @ w[f"wo_{d}"].T, kept)
    return float((log_z - gold).sum() * scale), grads


def _step(job: tuple) -> tuple[float, dict]:
    return step(*job)


def train(
    ids: np.ndarray, y: np.ndarray, seconds: float = 240, batch: int = 192, rate: float = 0.008, seed: int = 7, say=print, hidden: int = HIDDEN, processes: int = 1
) -> dict[str, np.ndarray]:
    """Weights after Adam steps for at most `seconds`; a step's batch is shared out among processes."""
    rng = np.random.default_rng(seed)
    w = initial(rng, hidden)
    m, v = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
    pool = multiprocessing.get_context("fork").Pool(processes) if processes > 1 else None
    began, k, loss, size = time.time(), 0, 0.0, max(1, batch // processes)
    while time.time() - began < seconds:
        jobs = [(w, ids[pick], y[pick]) for pick in rng.integers(0, len(ids), (processes, size))]
        parts = pool.map(_step, jobs, 1) if pool else [step(*jobs[0])]
        now = sum(p[0] for p in parts) / processes
        grads = {n: sum(p[1][n] for p in parts) / processes for n in w}
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        k += 1
        pace = rate * min(1.0, k / 30) * max(0.02, 1 - (time.time() - began) / seconds)
        for n in w:
            g = grads[n] * min(1.0, 1.0 / max(norm, 1e-9))
            m[n] = 0.9 * m[n] + 0.1 * g
            v[n] = 0.995 * v[n] + 0.005 * g * g
            w[n] = (w[n] - pace * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.995**k)) + 1e-7)).astype(np.float32)
        loss = 0.95 * loss + 0.05 * now if k > 1 else now
        if k % 200 == 0:
            say(f"{k} steps, {time.time() - began:.0f} s, loss {loss:.6f}")
    if pool:
        pool.terminate()
    return w


def scores(net: Tagger, texts: list[str], truth: list[Spans]) -> dict[str, tuple[int, float, float]]:
    """(mentions, recall, precision) by type, of the distinct mentions of every text, with exact ends."""
    n, hit, said = Counter(), Counter(), Counter()
    for text, labels, spans in zip(texts, net.labels(texts), truth):
        true, got = {(text[a:b], TYPES[k - 1]) for a, b, k in spans}, {(text[a:b], k) for a, b, k in mentions(text, labels)}
        n.update(k for _, k in true)
        said.update(k for _, k in got)
        hit.update(k for _, k in true & got)
    return {k: (n[k], round(hit[k] / max(1, n[k]), 4), round(hit[k] / max(1, said[k]), 4)) for k in TYPES}


def sample(path: str, rows: int = ROWS) -> list[str]:
    """At most `rows` texts, those with the smallest hashes of their ids."""
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '{path}' where length(text) > 0 order by hash(doc_id) limit {int(rows)}").fetchall()]


def main(path: str, out: str, seconds: float = 300, first_round: str | None = None, processes: int = os.cpu_count() or 1) -> None:
    texts = sample(path)
    held, rest = texts[: len(texts) // 20], texts[len(texts) // 20 :]
    rng = np.random.default_rng(7)
    if first_round:
        with np.load(first_round) as data:
            first = Tagger(dict(data))
    else:
        first = Tagger(train(*windows(rest, rng), seconds, processes=processes, hidden=20))
    truth = [numbered(labelled(t, y)) for t, y in zip(texts, first.labels(texts))]
    parts = [windows(rest, rng, lambda i, _: truth[len(held) + i], True, vary) for vary in (False, True, True, True)]
    ids, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    weights = {n: x.astype(np.float16) for n, x in train(ids, y, seconds, batch=256, processes=processes).items()}
    np.savez_compressed(out, **weights)
    print("held-out documents:", scores(Tagger(weights), held, truth[: len(held)]))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], float(sys.argv[3]) if len(sys.argv) > 3 else 300, sys.argv[4] if len(sys.argv) > 4 else None)
