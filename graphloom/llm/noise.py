"""Noise in text from scanned pages (problem 1): found by kind, and repaired into readable paragraphs.

Method: the lines of a passage are labelled by a hidden Markov model with the states body, header, number (a printed
page number alone), break (a blank line that parts paragraphs), gap (a blank line inside a paragraph, as a page break
leaves it) and split (a body line whose last word goes on in the next line), from layout features: letter case, length,
numbering, closing punctuation, whether the page's own number stands in the line, how the text goes on over a blank
line, and what the corpus says about a hyphen at the end. The model starts from seed rules on a bounded sample of
passages (`sample`, chosen by hash) and is refined by Viterbi training. Header and number lines are taken out, and the
body is reassembled along breaks and splits. Misread words are those that the corpus hardly knows and that one or two
exchanges of look-alike characters turn into a word it knows well; lines can't tell them. Both kinds of counts cover
all passages and are met by joins, so the vocabulary has no size limit.

Defined results: null and empty texts have no noise and stay as they are; a null page number only switches off the
features that need it; repeated ids are handled row by row. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.vocabulary import FORMULA_RE, strip_edges, word_counts
from graphloom.session import cut, nonempty

BODY, HEADER, NUMBER, BREAK, GAP, SPLIT = range(6)
STATES = 6
COLUMNS = np.arange(STATES)
HYPHENS = "-‐‑¬­"

#: Characters and groups that optical recognition takes for others, seen form first.
LOOKALIKES = [
    ("€", "e"), ("†", "t"), ("|", "l"), ("|", "i"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("!", "l"), ("!", "i"), ("$", "s"), ("@", "a"), ("£", "e"), ("¢", "c"), ("©", "c"), ("ß", "b"),
    ("à", "a"), ("á", "a"), ("â", "a"), ("ä", "a"), ("å", "a"), ("è", "e"), ("é", "e"), ("ê", "e"), ("ë", "e"), ("ì", "i"), ("í", "i"), ("î", "i"), ("ï", "i"), ("ò", "o"), ("ó", "o"), ("ô", "o"), ("ö", "o"), ("ø", "o"), ("ù", "u"), ("ú", "u"), ("û", "u"), ("ü", "u"), ("ç", "c"), ("ñ", "n"), ("ı", "i"),
    ("vv", "w"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("ii", "u"), ("nn", "m"), ("c", "e"), ("e", "c"), ("h", "b"), ("b", "h"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("f", "t"), ("t", "f"), ("u", "n"), ("n", "u"), ("n", "ri"), ("ri", "n"), ("a", "o"), ("o", "a"), ("s", "5"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"), ("j", "i"), ("i", "j"), ("tl", "d"), ("in", "m"), ("m", "in"), ("iii", "m"), ("w", "vv"), ("fi", "h"), ("r", "n"), ("s", "a"), ("D", "O"), ("O", "D"),
]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
ODD = re.compile(r"[^a-zA-Z'’-]")

NUMBER_ALONE = re.compile(r"[\W_]*(?:page|p\.|pg\.?|seite|s\.)?\s*(\d{1,5})(?:\s*(?:of|/|von)\s*\d{1,5})?[\W_]*", re.I)
ROMAN = re.compile(r"[\W_]*(?=[ivxlc])(?:x[lc]|l?x{0,3})(?:i[vx]|v?i{0,3})[\W_]*")
HEADING = re.compile(r"\d+(?:\.\d+)*\.?\s+[A-Z][^A-Z]*$")
WORD = re.compile(r"[^\W\d_][\w'’|€†-]*")

# ---------------------------------------------------------------- line model


def features(line: str, page: int | None) -> tuple[int, ...]:
    """Layout features of a line: kind of number, letter case, length, closing mark, prefix, what stands over a blank line, hyphen."""
    text = line.strip()
    if not text:
        return (0, 0, 0, 0, 0, 0, 0)
    numbers = [int(x) for x in re.findall(r"(?<![\d.,/])\d{1,5}(?![\d,]|\.\d)", text)]
    own = page is not None and (page in numbers)
    alone = NUMBER_ALONE.fullmatch(text)
    if alone:
        number = 3 if (own or page is None) and not re.search(r"\d[.\])]*\.$", text) else 0
    elif ROMAN.fullmatch(text) and text[-1] not in ").":
        number = 3
    else:
        edge = own and (re.match(rf"\D{{0,3}}{page}\b(?!\.\d)", text) or re.search(rf"(?<![\d.]){page}\W{{0,3}}$", text))
        number = 1 if edge else 0
    bare = re.sub(r"^\d{1,5}\s*[|\t ]\s*|\s*[|\t ]\s*\d{1,5}$", "", text) if number == 1 else text
    words = [w for w in WORD.findall(bare) if len(w) > 1]
    main = re.split(r", |\s·\s", bare)[0]
    main_words = [w for w in WORD.findall(main) if len(w) > 1 and w not in ("on", "of", "and", "for", "the", "in", "to")]
    if not words or "\\" in text or "$" in text:
        case = 1
    elif bare.upper() == bare and len(words) >= 2:
        case = 4
    elif len(main_words) >= 3 and all(w[0].isupper() for w in main_words) and len(words) <= 12:
        case = 3
    elif HEADING.match(text):
        case = 2
    else:
        case = 1
    length = 1 if len(words) <= 3 else 2 if len(words) <= 9 else 3
    end = 1 if text[-1] in ".!?" else 2 if text[-1] in ",;:-¬‐­" else 3
    prefix = 2 if re.match(r"(?:chapter|lecture|unit|part|section|notes on)\b", bare, re.I) and case in (3, 4) else 1
    return (number + 1, case, length, end, prefix, 0, 0)


SIZES = (5, 5, 4, 4, 3, 3, 3)


def line_features(lines: list[str], page: int | None, splits: Container[int] = ()) -> list[tuple[int, ...]]:
    """Features of all lines; `splits` are the lines whose last word the corpus takes for a broken one.

    A blank line has 1 if the text goes on over it (no sentence ends before it, and what was taken for printed lines
    between is left out), else 2. A line with a hyphen at its end has 1, with a broken word 2.
    """
    out = [features(x, page) for x in lines]
    last = ""  # end of the text so far
    printed = [f[0] == 4 or (f[1] in (3, 4) and f[3] == 3) for f in out]
    for k, x in enumerate(lines):
        text = x.strip()
        if not text:
            near = any(printed[max(0, k - 2) : k]) or any(printed[k + 1 : k + 3])
            on = near and last and last[-1] not in ".!?:”\")" and not HEADING.match(last)
            out[k] = (*out[k][:5], 1 if on else 2, 0)
        elif not printed[k]:
            last = text
            if k in splits:
                out[k] = (*out[k][:6], 2)
            elif text[-1] in HYPHENS:
                out[k] = (*out[k][:6], 1)
    return out


def seed(f: tuple[int, ...]) -> int:
    """Label that the features suggest by themselves."""
    number, case, _, end, _, over, hyphen = f
    if number == 0:
        return GAP if over == 1 else BREAK
    if hyphen == 2:
        return SPLIT
    if number == 4:
        return NUMBER
    if case in (3, 4) and end == 3:
        return HEADER
    return BODY


class LineModel:
    """Hidden Markov model over line features that are independent given the state."""

    def __init__(self) -> None:
        self.start = np.zeros(STATES)
        self.move = np.zeros((STATES, STATES))
        self.emit = [np.zeros((STATES, n)) for n in SIZES]
        self.sums: dict[tuple[int, ...], np.ndarray] = {}

    def fit(self, passages: list[list[tuple[int, ...]]], rounds: int = 3) -> LineModel:
        """Counts from seed labels, then Viterbi training: label, count again."""
        labels = [[seed(f) for f in p] for p in passages]
        for _ in range(rounds):
            start, move, emit = np.full(STATES, 0.5), np.full((STATES, STATES), 0.5), [np.full((STATES, n), 0.05) for n in SIZES]
            emit[-1][SPLIT] = 0.001, 0.001, 1.0  # the sample is labelled before the corpus is asked for hyphens
            emit[-1][BODY] = 1.0, 1.0, 0.001
            for p, ls in zip(passages, labels):
                if not ls:
                    continue
                start[ls[0]] += 1
                for a, b in zip(ls, ls[1:]):
                    move[a, b] += 1
                for f, s in zip(p, ls):
                    for e, v in zip(emit, f):
                        e[s, v] += 1
            self.start = np.log(start / start.sum())
            self.move = np.log(move / move.sum(1, keepdims=True))
            self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in emit]
            self.sums = {}
            labels = [self.decode(p) for p in passages]
        return self

    def emission(self, f: tuple[int, ...]) -> np.ndarray:
        """Score of a line's features in each state; there are few different ones."""
        got = self.sums.get(f)
        if got is None:
            got = self.sums[f] = sum(e[:, v] for e, v in zip(self.emit, f))
        return got

    def decode(self, passage: list[tuple[int, ...]]) -> list[int]:
        """Most likely states of the lines."""
        if not passage:
            return []
        score, back = self.start + self.emission(passage[0]), []
        for f in passage[1:]:
            via = score[:, None] + self.move
            best = via.argmax(0)
            back.append(best)
            score = via[best, COLUMNS] + self.emission(f)
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def fit_line_model(df: DataFrame, text: str = "text", page: str = "page", id_col: str = "passage_id", sample: int = 2000) -> LineModel:
    """Model fitted on at most `sample` passages, those with the smallest hashes of their ids."""
    rows = df.filter(F.length(text) > 0).select(text, page, F.xxhash64(id_col).alias("h")).orderBy("h").limit(sample).collect()
    return LineModel().fit([line_features(r[0].split("\n"), r[1]) for r in rows])


# ---------------------------------------------------------------- words


def fixes(word: str) -> set[str]:
    """Forms that one or two exchanges of look-alikes make of a lower-case word."""
    exchange = lambda w: {w[:i] + good + w[i + len(bad) :] for bad, good in LOOKALIKES for i in _places(w, bad)}
    once = exchange(word)
    return once.union(*map(exchange, once)) - {word}


def _places(w: str, bad: str) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(bad), w)]


def unodd(word: str) -> str:
    """All plainly odd characters exchanged, each for its first meaning."""
    for bad, good in LOOKALIKES:
        if ODD.match(bad) and bad in word and not bad.isdigit():
            word = word.replace(bad, good)
    for bad, good in LIGATURES.items():
        word = word.replace(bad, good)
    return word


#: Words above this length aren't laid out in all their forms; they meet by an unchanged third and are then compared.
LONG = 48


def reaches(word: str, good: str) -> bool:
    """Whether one or two exchanges of look-alikes turn a word into another."""
    states = {(0, 0, 0)}  # places in both words, exchanges
    while states:
        after = set()
        for i, j, n in states:
            while i < len(word) and j < len(good) and word[i] == good[j]:
                after |= {(i + len(x), j + len(y), n + 1) for x, y in LOOKALIKES if n < 2 and word.startswith(x, i) and good.startswith(y, j)}
                i, j = i + 1, j + 1
            if i == len(word) and j == len(good):
                return word != good
            after |= {(i + len(x), j + len(y), n + 1) for x, y in LOOKALIKES if n < 2 and word.startswith(x, i) and good.startswith(y, j)}
        states = after
    return False


def _long_misreads(words: DataFrame, known: DataFrame) -> DataFrame:
    """(good, m, word, n, plain) of the words above LONG letters, which share their first, last or middle 16 letters with the good ones."""

    def keys(w: Column, shifts: tuple[int, ...]) -> Column:
        middle = [F.concat(F.lit("m"), F.substring(w, 17 + s, 16)) for s in shifts]
        return F.explode(F.array_distinct(F.array(F.concat(F.lit("a"), F.substring(w, 1, 16)), F.concat(F.lit("z"), F.substring(w, -16, 16)), *middle))).alias("k")

    @nonempty
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = [unodd(w) == g for w, g in zip(batch["word"], batch["good"])]
            keep = [p or reaches(w, g) for p, w, g in zip(plain, batch["word"], batch["good"])]
            yield batch.assign(plain=plain)[pd.Series(keep, index=batch.index, dtype=bool)]

    shifts = tuple(range(-4, 5))  # two exchanges in front move the middle by up to four letters
    met = words.filter(F.length("word") > LONG).select("word", "n", keys(F.col("word"), shifts)).join(known.filter(F.length("good") > LONG - 5).select("good", "m", keys(F.col("good"), (0,))), "k")
    return met.filter("word <> good").select("good", "m", "word", "n").distinct().mapInPandas(check, "good string, m long, word string, n long, plain boolean")


def misread_words(words: DataFrame, least: int = 5, ratio: float = 20.0) -> DataFrame:
    """(word, good): words that stand for a word at least `ratio` times as frequent and met `least` times.

    Words of four letters or more qualify by any look-alike, shorter ones and words with digits only by odd characters.
    """

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"]):
                forms = fixes(word)
                forms.add(unodd(word))
                forms.discard(word)
                rows += [(word, n, x, x == unodd(word)) for x in forms if x.isascii() or not word.isascii()]
                if len(rows) > 200_000:
                    yield pd.DataFrame(rows, columns=["word", "n", "good", "plain"])
                    rows = []
            yield pd.DataFrame(rows, columns=["word", "n", "good", "plain"])

    spark = words.sparkSession
    known = words.select(F.col("word").alias("good"), F.col("n").alias("m")).filter(F.col("m") >= least)
    top = words.agg(F.max("n")).first()[0] or 0
    # a piece of a formula is no word; only words so rare that a known word can be `ratio` times as frequent are laid out
    asked = words.filter((F.col("n") * ratio <= top) & ~F.col("word").rlike(r"^[0-9.,:%/()\[\]-]+$") & ~F.col("word").rlike(r"\\|^\$|\$$") & F.col("word").rlike(r"\p{L}"))
    asked = asked.filter((F.length("word") >= 4) | F.col("word").rlike(r"[^a-zA-Z'’-]"))
    short = asked.filter(F.length("word") <= LONG).repartition(4 * spark.sparkContext.defaultParallelism, "word").mapInPandas(run, "word string, n long, good string, plain boolean").join(known.hint("merge"), "good")  # forms are many times the words that the planner sees
    return (
        short.unionByName(_long_misreads(asked, known))
        .filter(F.col("m") >= F.col("n") * ratio)
        .groupBy("word")
        .agg(F.max_by("good", F.struct("plain", "m", "good")).alias("good"))
    )


# ---------------------------------------------------------------- passages


def _body(lines: list[str], states: list[int]) -> list[tuple[int, str]]:
    """Body lines with their line number."""
    return [(k, x.rstrip("\r")) for k, (x, s) in enumerate(zip(lines, states)) if s in (BODY, SPLIT) and x.strip()]


def _breaks(body: list[tuple[int, str]]) -> list[tuple[int, str, str, str]]:
    """(place in body, first part, hyphen, second part) of words at line ends with a hyphen."""
    out = []
    for k in range(len(body) - 1):
        line, following = body[k][1].rstrip(), body[k + 1][1].lstrip()
        if line and line[-1] in HYPHENS and len(line) > 1 and following and (following[0].isalpha() or ODD.match(following[0])):
            first = FORMULA_RE.sub(" ", line[:-1]).split()
            if first and line[-2:-1].strip() and any(c.isalpha() for c in first[-1]):
                second = following.split()[0]
                out.append((k, first[-1], line[-1], second))
    return out


def _asked(first: str, second: str) -> tuple[str, str, str]:
    a, b = strip_edges(first).lower(), strip_edges(second).lower()
    return unodd(a + b), unodd(f"{a}-{b}"), unodd(b)


def _misread_break(first: str, second: str, counts: dict[str, int]) -> bool:
    """Whether a broken word holds odd characters without which the corpus knows it."""
    raw = strip_edges(first).lower() + strip_edges(second).lower()
    joined = _asked(first, second)[0]
    return raw != joined and counts.get(joined, 0) > 0


def is_broken(first: str, hyphen: str, second: str, counts: dict[str, int]) -> bool:
    """Whether a word was broken here, rather than a compound at its own hyphen."""
    joined, compound, rest = _asked(first, second)
    whole, own = counts.get(joined, 0), counts.get(compound, 0)
    if whole or own:
        return whole >= own
    return hyphen != "-" or not counts.get(rest, 0)


def _tokens(lines: list[str]) -> list[str]:
    return [t for line in lines for t in (strip_edges(x) for x in FORMULA_RE.sub(" ", line).split()) if t]


def annotate(df: DataFrame, id_col: str = "passage_id", text: str = "text", page: str = "page", sample: int = 2000) -> DataFrame:
    """(row, id_col, states, breaks, misreads, lines): labels, broken words and misread words of every passage."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(fit_line_model(df, text, page, id_col, sample))
    rows = cut(df.filter(F.length(text) > 0).select(F.monotonically_increasing_id().alias("_row"), id_col, F.col(text).alias("_text"), F.col(page).cast("int").alias("_page")))

    @nonempty
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, t, p in zip(batch["_row"], batch["_text"], batch["_page"]):
                lines = t.split("\n")
                own = None if pd.isna(p) else int(p)
                states = model.value.decode(line_features(lines, own))
                body = _body(lines, states)
                breaks = _breaks(body)
                at = {k for k, *_ in breaks}
                loose = []  # words of the body that are not broken
                for k, (_, line) in enumerate(body):
                    ws = FORMULA_RE.sub(" ", line).split()
                    loose += [w for w in (ws[1:] if k - 1 in at else ws)[: -1 if k in at else None]]
                words = [x for x in (strip_edges(w).lower() for w in loose) if x]
                out.append((row, states, sorted(set(words)), [list(map(str, b)) for b in breaks], sorted({x for _, a, _, b in breaks for x in _asked(a, b)})))
            yield pd.DataFrame(out, columns=["_row", "states", "words", "breaks", "asked"])

    labelled = cut(rows.select("_row", "_text", "_page").mapInPandas(label, "_row long, states array<int>, words array<string>, breaks array<array<string>>, asked array<string>"))
    counts = cut(word_counts(rows, "_text"))
    bad = cut(misread_words(counts).withColumn("n", F.lit(None).cast("long")))
    # misread words and the counts that hyphens ask for come back in one shuffle
    both = (
        labelled.select("_row", F.explode("words").alias("word")).join(bad, "word").select("_row", "word", "good", "n")
        .unionByName(labelled.select("_row", F.explode("asked").alias("word")).join(counts, "word").select("_row", "word", F.lit(None).cast("string").alias("good"), "n"))
    )
    got = both.groupBy("_row").agg(*[F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("word", c)))).alias(name) for c, name in (("good", "misreads"), ("n", "met"))])

    @nonempty
    def relabel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Labels again where the corpus was asked for hyphens."""
        for batch in batches:
            out = []
            for t, p, states, breaks, met in zip(batch["_text"], batch["_page"], batch["states"], batch["breaks"], batch["met"]):
                if len(breaks):
                    lines, counts_ = t.split("\n"), dict(met or {})
                    body = _body(lines, states)
                    splits = {body[int(b[0])][0] for b in breaks if is_broken(b[1], b[2], b[3], counts_)}
                    states = model.value.decode(line_features(lines, None if pd.isna(p) else int(p), splits))
                out.append(list(states))
            batch["states"] = out
            yield batch

    noted = rows.join(labelled.select("_row", "states", "breaks"), "_row").join(got, "_row", "left")
    return noted.mapInPandas(relabel, noted.schema)


def found(df: DataFrame, id_col: str = "passage_id", text: str = "text", page: str = "page") -> DataFrame:
    """(id_col, noise): one row per passage and kind of noise."""

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, kinds = [], []
            for rec, t, p, states, breaks, misreads, met in zip(batch[id_col], batch["_text"], batch["_page"], batch["states"], batch["breaks"], batch["misreads"], batch["met"]):
                lines = t.split("\n")
                counts = dict(met or {})
                own = None if pd.isna(p) else int(p)
                kind = set()
                if SPLIT in states:
                    kind.add("hyphenation")
                if misreads or any(c in LIGATURES for c in t) or any(_misread_break(b[1], b[3], counts) for b in breaks):
                    kind.add("misread")
                for line, s in zip(lines, states):
                    if s == HEADER:
                        kind.add("header")
                        if features(line, own)[0] == 2:
                            kind.add("page_number")
                    elif s == NUMBER:
                        kind.add("page_number")
                for x in sorted(kind):
                    ids.append(rec)
                    kinds.append(x)
            yield pd.DataFrame({id_col: ids, "noise": kinds})

    id_type = df.schema[id_col].dataType.simpleString()
    noted = annotate(df, id_col, text, page).select(id_col, "_text", "_page", "states", "breaks", "misreads", "met")
    return noted.mapInPandas(run, f"`{id_col}` {id_type}, noise string")


def rebuild(lines: list[str], states: list[int], breaks: list[list[str]], misreads: dict[str, str]) -> str:
    """Paragraphs of the words that were printed."""
    body = _body(lines, states)
    hyphen = {int(b[0]) for b in breaks}
    out, paragraph, glue = [], "", ""
    for k, (at, line) in enumerate(body):
        if k and re.match(r"\d{1,2}[.)] ", line.lstrip()) and paragraph.endswith((".", "!", "?", ":")):  # list items
            glue = "\n"
        if k and k - 1 not in hyphen and BREAK in states[body[k - 1][0] + 1 : at]:
            out.append(paragraph)
            paragraph, glue = "", ""
        text = line.strip()
        if k in hyphen:
            text = text[:-1] if states[at] == SPLIT else text[:-1] + "-"
        paragraph += glue + text
        glue = "" if k in hyphen else " "
    out.append(paragraph)
    return "\n\n".join(" ".join(_mend(w, misreads) for w in p.split(" ")) for p in out if p)


def _mend(token: str, misreads: dict[str, str]) -> str:
    for bad, good in LIGATURES.items():
        token = token.replace(bad, good)
    core = strip_edges(token)
    good = misreads.get(core.lower())
    if not core or good is None:
        return token
    good = good.upper() if core.isupper() and len(core) > 1 else good[0].upper() + good[1:] if core[0].isupper() else good
    return token.replace(core, good, 1)


def repair(df: DataFrame, id_col: str = "passage_id", text: str = "text", page: str = "page") -> DataFrame:
    """(id_col, clean): every passage as readable paragraphs; null and empty texts unchanged."""

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            clean = [
                rebuild(t.split("\n"), list(states), [list(b) for b in breaks], dict(misreads or {}))
                for t, states, breaks, misreads in zip(batch["_text"], batch["states"], batch["breaks"], batch["misreads"])
            ]
            yield pd.DataFrame({id_col: batch[id_col], "clean": clean})

    id_type = df.schema[id_col].dataType.simpleString()
    noted = annotate(df, id_col, text, page).select(id_col, "_text", "states", "breaks", "misreads")
    blank = df.filter(F.col(text).isNull() | (F.length(text) == 0)).select(id_col, F.col(text).alias("clean"))
    return noted.mapInPandas(run, f"`{id_col}` {id_type}, clean string").unionByName(blank)
