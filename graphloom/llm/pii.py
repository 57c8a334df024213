"""Personal information in free text (problem 10): found by type and replaced with typed placeholders.

Method: a character-level bidirectional LSTM with CRF transitions, trained in numpy (see pii_train). A text is cut
into overlapping windows; all windows of a block of texts run through the network together; every window is decoded
by Viterbi, and each character takes the label of the window in which it stands furthest from the edges. A mention is
a first character and the stretch of characters of one type behind it. Mentions are reconciled over the whole text:
they are widened to whole words, an abbreviation with a full stop before a name (a title) is cut off, those that can't
be of their type are dropped (a mail without an at sign and a domain, a phone number of three digits, a name with
digits), and a mention found once counts wherever the same text stands again in it. No list of words and no pattern
finds a mention or sets its ends.

Texts in capitals, of any script and of any length are read whole; windows of all texts of a block are batched, so a
long text costs no more than as many short ones.

Defined results: null and empty texts have no mentions and stay as they are; equal mentions of a text give one row;
repeated ids are handled row by row and give each row once. Extra columns are ignored.
"""

from __future__ import annotations

import io
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import nonempty, width

TYPES = ["email", "phone", "identity", "address", "name"]
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
WINDOW, MARGIN, BATCH = 192, 24, 768
#: Label of the first character of a mention.
FIRST = len(TYPES) + 1
ABBREVIATION = re.compile(r"[^\W\d_]{2,5}\.\s+(?=\w)")
AT = re.compile(r"\w(?:\s?[@＠]\s?|\W+at\W+)\w(?:.*?)(?:\.|\W*\bdot\b\W*)[^\W\d]{2,}$", re.I | re.S)

# ---------------------------------------------------------------- characters

_ASCII = {c: k for k, c in enumerate(string.ascii_letters + string.digits + string.punctuation + " \n\t", 5)}
N_CHARS = 5 + len(_ASCII) + 3


@lru_cache(100_000)
def char_id(c: str) -> int:
    """0 pads; ASCII characters stand for themselves, others for their kind."""
    if c in _ASCII:
        return _ASCII[c]
    if c.isupper():
        return 1
    if c.islower():
        return 2
    if c.isalpha():
        return 3
    if c.isspace():
        return _ASCII[" "]
    return {"–": N_CHARS - 3, "—": N_CHARS - 2, "•": N_CHARS - 1}.get(c, 4)


def encode(text: str) -> np.ndarray:
    return np.fromiter(map(char_id, text), dtype=np.int16, count=len(text))


# ---------------------------------------------------------------- network


class Tagger:
    """BiLSTM over characters with CRF transitions; labels are 0 for none, 1 + k inside TYPES[k], FIRST for the first character of a mention."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        w = {k: np.asarray(v, dtype=np.float32) for k, v in weights.items()}
        self.w = w
        # the input product of a gate depends on the character alone; a sigmoid is a tanh of half its argument
        self.inputs, self.back = {}, {}
        for d in "fb":
            table, wh = np.ascontiguousarray(w["emb"] @ w[f"wx_{d}"] + w[f"b_{d}"]), w[f"wh_{d}"].copy()
            gates = 3 * wh.shape[0]
            table[:, :gates] *= 0.5
            wh[:, :gates] *= 0.5
            self.inputs[d], self.back[d] = table, wh

    def _lstm(self, ids: np.ndarray, d: str) -> np.ndarray:
        """Hidden states (time, window, unit) of (window, time) characters."""
        n, t = ids.shape
        table, wh = self.inputs[d], self.back[d]
        size = wh.shape[0]
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        out, z = np.empty((t, n, size), np.float32), np.empty((n, 4 * size), np.float32)
        by_time = np.ascontiguousarray(ids.T)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            np.matmul(h, wh, out=z)
            z += table[by_time[k]]
            np.tanh(z, out=z)
            gates = z[:, : 3 * size]
            gates += 1
            gates *= 0.5
            c *= gates[:, size : 2 * size]
            c += gates[:, :size] * z[:, 3 * size :]
            h = gates[:, 2 * size :] * np.tanh(c)
            out[k] = h
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(time, window, label) scores."""
        out = self._lstm(ids, "f") @ self.w["wo_f"]
        out += self._lstm(ids, "b") @ self.w["wo_b"]
        return out + self.w["bo"]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """(window, time) labels by Viterbi."""
        e = self.emissions(ids)
        t, n, k = e.shape
        e = np.ascontiguousarray(e.transpose(0, 2, 1))
        move = self.w["move"]
        score, before = e[0].copy(), np.empty((t, k, n), np.float32)
        for i in range(1, t):
            before[i] = score
            best = score[0] + move[0][:, None]
            for j in range(1, k):
                np.maximum(best, score[j] + move[j][:, None], out=best)
            score = best + e[i]
        path = np.empty((t, n), np.int8)
        path[-1] = score.argmax(0)
        into = np.ascontiguousarray(move.T)
        for i in range(t - 1, 0, -1):  # the best way back from the scores that were kept
            path[i - 1] = (before[i] + into[path[i]].T).argmax(0)
        return path.T

    def labels(self, texts: list[str]) -> list[np.ndarray]:
        """Label of every character of every text, from overlapping windows."""
        step = WINDOW - 2 * MARGIN
        coded = [encode(t) for t in texts]
        jobs = [(k, s) for k, c in enumerate(coded) for s in range(0, max(1, len(c) - 2 * MARGIN), step)]
        out = [np.zeros(len(c), np.int8) for c in coded]
        for b in range(0, len(jobs), BATCH):
            part = jobs[b : b + BATCH]
            ids = np.zeros((len(part), WINDOW), np.int16)
            for r, (k, s) in enumerate(part):
                piece = coded[k][s : s + WINDOW]
                ids[r, : len(piece)] = piece
            found = self.decode(ids)
            for r, (k, s) in enumerate(part):
                n = min(WINDOW, len(coded[k]) - s)
                lo = 0 if s == 0 else MARGIN  # what lies nearer to the edge comes from the neighbour
                hi = n if s + WINDOW >= len(coded[k]) else WINDOW - MARGIN
                out[k][s + lo : s + hi] = found[r, lo:hi]
        return out


def spans(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, start, end) of the mentions: a first character and the stretch behind it, or a stretch without one."""
    out: list[tuple[int, int, int]] = []
    at = np.flatnonzero(labels)
    if not len(at):
        return out
    cuts = np.flatnonzero((np.diff(at) > 1) | (labels[at[1:]] == FIRST)) + 1
    for piece in np.split(at, cuts):
        inside = labels[piece][labels[piece] != FIRST]
        if len(inside):
            out.append((int(np.bincount(inside).argmax()), int(piece[0]), int(piece[-1]) + 1))
    return out


def whole(text: str, a: int, b: int) -> tuple[int, int]:
    """The span widened to whole words, without blanks and marks around it."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not (text[b - 1].isalnum() or text[b - 1] in ".)"):
        b -= 1
    while a > 0 and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while 0 < b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    return a, b


def possible(kind: str, surface: str) -> bool:
    """Whether a text can be of the type at all, by its digits, blanks and signs alone."""
    digits = sum(c.isdigit() for c in surface)
    if kind == "email":
        return bool(AT.search(surface))
    if kind == "phone":
        return 7 <= digits <= 16 and not any(c.isalpha() for c in surface)
    if kind == "identity":
        return digits >= 5
    if kind == "address":
        return digits > 0 and any(c.isalpha() for c in surface)
    return digits == 0 and any(c.isspace() or c == "\u200b" for c in surface)


def mentions(text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, type) of the mentions of a text, without overlaps, in order."""
    found: list[tuple[int, int, str]] = []
    for label, a, b in spans(labels):
        kind = TYPES[label - 1]
        a, b = whole(text, a, b)
        if kind == "name" and (m := ABBREVIATION.match(text, a, b)):  # a title is no part of a name
            a = m.end()
        if a < b and possible(kind, text[a:b]):
            found.append((a, b, kind))
    for surface, kind in {(text[a:b], kind) for a, b, kind in found}:  # the same text elsewhere in the document
        at = text.find(surface)
        while at >= 0:
            end = at + len(surface)
            if not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                found.append((at, end, kind))
            at = text.find(surface, end)
    out: list[tuple[int, int, str]] = []
    taken = np.zeros(len(text), bool)
    for a, b, kind in sorted(set(found), key=lambda x: (x[0] - x[1], x[0], TYPES.index(x[2]))):  # longest first
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((a, b, kind))
    return sorted(out)


@lru_cache(2)
def tagger(weights: bytes) -> Tagger:
    """One network per process, from the bytes of a weights file."""
    with np.load(io.BytesIO(weights)) as data:
        return Tagger(dict(data))


def _blocks(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[list[int], list[str]]]:
    ids, part, size = [], [], 0
    for k, t in enumerate(texts):
        if not t:
            continue
        ids.append(k)
        part.append(t)
        size += len(t)
        if size >= most:
            yield ids, part
            ids, part, size = [], [], 0
    if part:
        yield ids, part


def _spans(texts: list[str | None], weights: bytes) -> Iterator[tuple[int, str, list[tuple[int, int, str]]]]:
    net = tagger(weights)
    for ids, part in _blocks(texts):
        for k, t, labels in zip(ids, part, net.labels(part)):
            yield k, t, mentions(t, labels)


def found(df: DataFrame, id_col: str = "doc_id", text: str = "text", weights: str | None = None) -> DataFrame:
    """(id_col, pii_type, pii_text): one row per document, type and distinct mention."""

    network = Path(weights or WEIGHTS).read_bytes()  # 17 KB, sent with the function

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, kinds, surfaces = [], [], []
            own = batch[id_col].tolist()
            for k, t, spans in _spans(batch[text].tolist(), network):
                for kind, surface in sorted({(kind, t[a:b]) for a, b, kind in spans}):
                    ids.append(own[k])
                    kinds.append(kind)
                    surfaces.append(surface)
            yield pd.DataFrame({id_col: ids, "pii_type": kinds, "pii_text": surfaces})

    return _even(df, id_col, text).mapInPandas(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, pii_type string, pii_text string")


def mask(df: DataFrame, id_col: str = "doc_id", text: str = "text", weights: str | None = None) -> DataFrame:
    """(id_col, masked): texts with every mention replaced by its type in square brackets."""

    network = Path(weights or WEIGHTS).read_bytes()  # 17 KB, sent with the function

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[text].tolist()
            for k, t, spans in _spans(list(out), network):
                for a, b, kind in reversed(spans):
                    t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
                out[k] = t
            yield pd.DataFrame({id_col: batch[id_col], "masked": out})

    return _even(df, id_col, text).mapInPandas(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, masked string")


def _even(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Texts spread over all cores, if the scan has fewer splits than there are: the network is far dearer than a shuffle of the texts."""
    spark = df.sparkSession
    cores = max(width(df), 3 * spark.sparkContext.defaultParallelism)
    rows = df.select(id_col, text)
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, F.xxhash64(id_col))
