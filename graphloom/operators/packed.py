"""Packed fields (problem 2): several values in one string, split into one row per value with its position.

Method: dictionary-guided segmentation. A first pass over all records cuts each string at its delimiters outside
quotes, brackets and escapes, and gives the dictionary of the values that were met whole: quoted, escaped, in JSON or
alone in their record. Pieces of a bare cut aren't in it, since the cut is what is to be decided. A second pass runs a
multi-pattern automaton of the dictionary's values that hold delimiters over the texts, keeps the matches that begin
and end at possible cuts, and dynamic programming picks the cheapest cover: a delimiter may stay inside a value only if
that whole value is known, a known whole value costs less than any pieces of it, and among covers that overlap the one
that leaves known values wins. So `reward, layered sketching` stays whole where it was seen quoted elsewhere, while
other topics are parted. A piece that is itself quoted, escaped or from JSON is never joined with its neighbours.

The dictionary is sharded by the first piece of its values, with at most `max_values` values in a shard's automaton; a
distinct text goes only to the shards of its own pieces, and shards that many texts ask for are salted. Nothing is
broadcast, and the same path runs at every size.

Defined results: null, empty and delimiter-only fields give no rows; positions count the non-empty values from 1;
repeated values stay; a JSON array gives its elements (nulls left out); an unclosed quote is an ordinary character;
repeated record ids give the rows of each record. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, lookup_join, nonempty, width

#: Delimiters, quotes with their closing marks, and characters that a backslash escapes.
DELIMITERS = "|;,\t\n\r、；，｜·•"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
ESCAPED = "|;,/\"'\\\t\n"
MARKER = re.compile(r"\s*(?:[•*·–-]\s+|\(?(\d{1,4})[.)]\s+)")
INLINE = re.compile(r"(?:(?<=\s)|^)\(?(\d{1,4})[.)]\s+")

#: Costs of a value: known, known with delimiters inside (less than two known pieces), met in bare cuts only.
KNOWN, JOINED, UNKNOWN = 1.0, 1.5, 3.0
#: Distinct texts that one salt of a shard takes.
TEXTS = 200_000

#: Delimiter text before a piece, the piece, and whether quotes, escapes or JSON held it together.
Piece = tuple[str, str, bool]


def atoms(text: str) -> tuple[list[Piece], bool]:
    """The pieces between delimiters outside protection; whether from JSON."""
    t = text.strip()
    if t.startswith("["):
        try:
            values = json.loads(t)
            if isinstance(values, list):
                return [("\n", v if isinstance(v, str) else json.dumps(v, ensure_ascii=False), True) for v in values if v is not None], True
        except ValueError:
            pass
    out, cur, gap, i, n, depth, start, held, open_quotes = [], [], "", 0, len(t), 0, True, False, set()
    while i < n:
        c = t[i]
        if c == "\\" and i + 1 < n and t[i + 1] in ESCAPED:
            cur.append(t[i + 1])
            i, start, held = i + 2, False, True
            continue
        if start and c in QUOTES and c not in open_quotes:
            end, inner = _quoted(t, i)
            if end:
                cur.append(inner)
                i, start, held = end, False, True
                continue
            open_quotes.add(c)  # no closing mark in the rest
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        slash = c == "/" and 0 < i < n - 1 and t[i - 1].isspace() and t[i + 1].isspace()
        if (depth == 0 or c in "\n\r\t") and (c in DELIMITERS or slash):
            out.append((gap, "".join(cur), held))
            cur, gap, start, held, depth = [], c, True, False, 0
        else:
            start = start and c.isspace()
            cur.append(c)
        i += 1
    out.append((gap, "".join(cur), held))
    return out, False


def _quoted(t: str, i: int) -> tuple[int, str]:
    """End and content of the quoted value that begins at i; end 0 if nothing closes it before a delimiter."""
    q, j, n, buf = QUOTES[t[i]], i + 1, len(t), []
    while j < n:
        if t[j] == "\\" and j + 1 < n:
            buf.append(t[j + 1])
            j += 2
        elif t[j] == q:
            if j + 1 < n and t[j + 1] == q:
                buf.append(q)
                j += 2
                continue
            k = j + 1
            while k < n and t[k] == " ":
                k += 1
            if k >= n or t[k] in DELIMITERS or t[k : k + 2] in ("/ ", "/"):
                return j + 1, "".join(buf)
            buf.append(q)
            j += 1
        else:
            buf.append(t[j])
            j += 1
    return 0, ""


def unmark(pieces: list[Piece]) -> list[Piece]:
    """Pieces without bullets and numbering; numbered lists on one line are cut at their numbers."""
    full = [(g, p.strip(), h) for g, p, h in pieces if p.strip()]
    if not full:
        return []
    first = MARKER.match(full[0][1])
    if first is None:
        return full
    if first.group(1) is None:  # bullets
        return [(g, MARKER.sub("", p, count=1) if (m := MARKER.match(p)) and m.group(1) is None else p, h) for g, p, h in full]
    out, want = [], int(first.group(1))
    for gap, piece, held in full:
        last = 0
        for m in INLINE.finditer(piece):
            if int(m.group(1)) == want:  # numbers that continue the list are marks, others belong to the text
                if piece[last : m.start()].strip():
                    out.append((gap, piece[last : m.start()].strip(), held))
                gap, last, want = "\n", m.end(), want + 1
        if piece[last:].strip():
            out.append((gap, piece[last:].strip(), held))
    return out


def cover(pieces: list[Piece], spans: Iterable[tuple[int, int]], singles: Iterable[int] = ()) -> list[str]:
    """Cheapest cover of the pieces by values; `spans` are known values from piece i up to piece j, `singles` known pieces."""
    joined, known = defaultdict(list), set(singles)
    for i, j in sorted(spans):
        joined[j].append(i)
    if not joined:
        return [p for _, p, _ in pieces]
    n = len(pieces)
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1] + (KNOWN if pieces[j - 1][2] or j - 1 in known else UNKNOWN), j - 1
        for i in joined[j]:
            if best[i] + JOINED < best[j]:
                best[j], back[j] = best[i] + JOINED, i
    out, j = [], n
    while j:
        out.append(_text(pieces[back[j] : j]))
        j = back[j]
    return out[::-1]


def _gap(gap: str) -> str:
    return " / " if gap == "/" else gap if gap == "|" else f"{gap} "


def _text(pieces: list[Piece]) -> str:
    """Pieces with the delimiters between them."""
    return pieces[0][1] + "".join(_gap(g) + p for g, p, _ in pieces[1:])


def stretches(pieces: list[Piece]) -> list[tuple[int, int]]:
    """(start, end) of the runs of two or more pieces that nothing holds together."""
    out, i = [], 0
    while i < len(pieces):
        j = i + 1
        if not pieces[i][2]:
            while j < len(pieces) and not pieces[j][2]:
                j += 1
            if j > i + 1:
                out.append((i, j))
        i = j
    return out


def matches(pieces: list[Piece], automaton) -> list[tuple[int, int]]:
    """(i, j) of the automaton's values that reach from the start of piece i to the end of piece j - 1."""
    out = []
    for a, b in stretches(pieces):
        text = _text(pieces[a:b])
        starts, ends, at = {}, {}, 0
        for k in range(a, b):
            if k > a:
                at += len(_gap(pieces[k][0]))
            starts[at] = k
            at += len(pieces[k][1])
            ends[at] = k + 1
        for last, size in automaton.iter(text):
            i, j = starts.get(last + 1 - size), ends.get(last + 1)
            if i is not None and j is not None and j > i + 1:
                out.append((i, j))
    return out


def _first_pass(column: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cuts = (unmark(atoms(text)[0]) for text in batch[column].dropna())
            out = []
            for value in (v for pieces in cuts for _, v, held in pieces if held or len(pieces) == 1):
                parts = [(g, p.strip(), h) for g, p, h in atoms(value)[0] if p.strip()] or [("", value, True)]
                out.append((_text(parts), parts[0][1], len(parts) - 1))
            yield pd.DataFrame(out, columns=["value", "first", "cuts"])

    return run


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, first, cuts, n): values that the corpus has whole, apart from bare cuts, with their first piece, the delimiters that they hold and their count."""
    return df.select(column).mapInPandas(_first_pass(column), "value string, first string, cuts int").groupBy("value", "first", "cuts").agg(F.count(F.lit(1)).alias("n"))


@nonempty
def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(tid, first): pieces with which a value of several pieces may begin."""
    for batch in batches:
        out = []
        for tid, text in zip(batch["tid"], batch["text"]):
            pieces = unmark(atoms(text)[0])
            out += [(tid, first) for first in {pieces[k][1] for a, b in stretches(pieces) for k in range(a, b - 1)}]
        yield pd.DataFrame(out, columns=["tid", "first"])


@nonempty
def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(tid, k, p) for tid, text in zip(batch["tid"], batch["text"]) for k, (_, p, _) in enumerate(unmark(atoms(text)[0]))], columns=["tid", "k", "value"])


@nonempty
def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard, the shard's values before its texts, to (tid, i, j) of the matches."""
    import ahocorasick

    shard, automaton, ready = None, None, False
    for batch in batches:
        out = []
        for key, tid, text in zip(zip(batch["shard"], batch["sub"], batch["salt"]), batch["tid"], batch["text"]):
            if key != shard:
                shard, automaton, ready = key, ahocorasick.Automaton(), False
            if tid < 0:
                automaton.add_word(text, len(text))
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            out += [(tid, i, j) for i, j in matches(unmark(atoms(text)[0]), automaton)]
        yield pd.DataFrame(out, columns=["tid", "i", "j"])


def known_spans(texts: DataFrame, values: DataFrame, max_values: int) -> DataFrame:
    """(text, spans, singles) of the texts (tid, text) in which values with delimiters inside are met."""
    several = values.filter("cuts > 0").select("value", "first")
    shards = max(1, -(-several.count() // max(1, max_values)))
    # a first piece with more values than a shard may hold is parted again, and its texts go to all parts
    firsts = several.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / max(1, max_values)).cast("int").alias("parts"))
    shard = F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int").alias("shard")
    sent = cut(
        texts.mapInPandas(_asked, "tid long, first string").join(firsts, "first")
        .select("tid", shard, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sub")).distinct()
    )
    salts = sent.groupBy("shard", "sub").agg(F.ceil(F.count(F.lit(1)) / TEXTS).cast("int").alias("salts"))
    held = several.join(firsts, "first").select(shard, F.pmod(F.xxhash64("value"), F.col("parts")).cast("int").alias("sub"), F.col("value").alias("text"))
    patterns = held.join(salts, ["shard", "sub"]).select("shard", "sub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-1).cast("long").alias("tid"), "text")
    asking = sent.join(salts, ["shard", "sub"]).join(texts, "tid").select("shard", "sub", F.pmod(F.xxhash64("tid"), F.col("salts")).cast("int").alias("salt"), "tid", "text")
    met = cut(
        patterns.unionByName(asking).repartition(width(texts), "shard", "sub", "salt").sortWithinPartitions("shard", "sub", "salt", F.col("tid") >= 0)
        .mapInPandas(_match, "tid long, i int, j int").groupBy("tid").agg(F.collect_set(F.struct("i", "j")).alias("spans"))
    )
    asked = texts.join(met.select("tid"), "tid", "left_semi")
    singles = asked.mapInPandas(_pieces, "tid long, k int, value string").join(values.filter("cuts = 0").select("value"), "value").groupBy("tid").agg(F.collect_set("k").alias("singles"))
    return cut(texts.join(met, "tid").join(singles, "tid", "left").select("text", "spans", "singles"))


def _second_pass(id_col: str, column: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, pos, topics = [], [], []
            for rec, text, spans, singles in zip(batch[id_col], batch[column], batch["spans"], batch["singles"]):
                spans = [] if spans is None else [(s["i"], s["j"]) for s in spans]
                for k, topic in enumerate(cover(unmark(atoms(text)[0]), spans, () if singles is None else singles), 1):
                    ids.append(rec)
                    pos.append(k)
                    topics.append(topic)
            yield pd.DataFrame({id_col: ids, "pos": pos, "topic": topics})

    return run


def unpack(df: DataFrame, id_col: str = "summary_id", column: str = "key_topics", max_values: int = 100_000) -> DataFrame:
    """(id_col, pos, topic): one row per value of every record. `max_values`: values in one shard of the dictionary."""
    values = cut(dictionary(df, column))
    rows = df.filter(F.col(column).isNotNull()).select(id_col, column)
    spans = None
    if not values.filter("cuts > 0").isEmpty():
        texts = cut(rows.select(F.col(column).alias("text")).distinct().withColumn("tid", F.monotonically_increasing_id()))
        spans = known_spans(texts.select("tid", "text"), values, max_values)
    if spans is None or spans.isEmpty():
        asked = rows.withColumns({"spans": F.lit(None).cast("array<struct<i:int,j:int>>"), "singles": F.lit(None).cast("array<int>")})
    else:
        asked = lookup_join(rows, spans.withColumnRenamed("text", column), column, "left")
    id_type = df.schema[id_col].dataType.simpleString()
    return asked.select(id_col, column, "spans", "singles").mapInPandas(_second_pass(id_col, column), f"`{id_col}` {id_type}, pos int, topic string")


def topic_counts(df: DataFrame, id_col: str = "summary_id", column: str = "key_topics") -> DataFrame:
    """(topic, n_records, n_rows, first_pos): how often each value stands in the corpus."""
    return unpack(df, id_col, column).groupBy("topic").agg(
        F.count_distinct(id_col).alias("n_records"), F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos")
    )
