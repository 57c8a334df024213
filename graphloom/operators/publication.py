"""Validation, audit and publication steps: gates with reasons, tiered search, sentence unions, checks of items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import balanced, plain_key
from graphloom.functions.texts import CONTEXT_DEPENDENT, clean_text, english_words, is_duplicate
from graphloom.session import cut, nonempty

#: Least confidence by what is read and by kind of source.
THRESHOLDS = {
    "concept": {"printed": 0.70, "mixed": 0.80, "handwritten": 0.90},
    "formula": {"printed": 0.82, "mixed": 0.87, "handwritten": 0.92},
    "visual": {"printed": 0.78, "mixed": 0.82, "handwritten": 0.90},
}
MIN_RELEVANCE, MIN_ASSET_CONFIDENCE = 0.65, 0.80


def confidence_gate(what: str, source_type: Column, confidence: Column) -> Column:
    """Whether a confidence passes the threshold of its kind of source; none passes from a source of no known kind."""
    kind = F.lower(F.trim(source_type))
    least = F.lit(None).cast("double")
    for name, value in THRESHOLDS[what].items():
        least = F.when(kind == name, value).otherwise(least)
    return F.coalesce(confidence >= least, F.lit(False))


def latex_valid(x: Column) -> Column:
    """Whether a formula is short enough, certain, and has its brackets in pairs."""
    sure = ~F.lower(x).rlike(r"\?|illegible|unclear|unknown|cannot read")
    return (F.length(x) > 0) & (F.length(x) <= 1000) & sure & balanced(x, "{", "}") & balanced(x, "[", "]") & balanced(x, "(", ")")


def box_reason(box: Column) -> Column:
    """Why a box of a page of 1000 by 1000 is refused: shape, order, range, or its share of the page."""
    area = (box[2] - box[0]) * (box[3] - box[1]) / 1e6
    return (
        F.when(F.size(box) != 4, "shape").when((box[0] >= box[2]) | (box[1] >= box[3]), "order").when((box[0] < 0) | (box[1] < 0) | (box[2] > 1000) | (box[3] > 1000), "range")
        .when(area < 0.002, "small").when(area > 0.68, "large").otherwise("ok")
    )


def profile_reason(name: Column, text: Column, most: int = 200, used: Column | None = None, allowed: Column | None = None) -> Column:
    """Why a profile is refused: it lacks the name before a colon, is too long, explains nothing, needs the page beside it, or uses unknown ids."""
    t = clean_text(text, 20_000)
    prefix = F.concat(name, F.lit(":"))
    unknown = F.lit(False) if used is None else F.size(F.array_except(used, allowed)) > 0
    return (
        F.when(~F.coalesce(F.startswith(F.lower(t), F.lower(prefix)), F.lit(False)), "prefix").when(english_words(t) > most, "long").when(english_words(t) <= english_words(prefix), "no_explanation")
        .when(F.lower(t).rlike(CONTEXT_DEPENDENT), "context").when(unknown, "unknown_ids").otherwise("ok")
    )


def claims_reason(claims: Column) -> Column:
    """Why a list of claims (text, kind, ids) is refused: none, unknown kind, support without or background with ids."""
    return (
        F.when(claims.isNull() | (F.size(claims) == 0), "none")
        .when(F.exists(claims, lambda c: F.coalesce(F.trim(c["text"]), F.lit("")) == ""), "empty")
        .when(F.exists(claims, lambda c: ~c["kind"].isin("source_supported", "background_context")), "kind")
        .when(F.exists(claims, lambda c: (c["kind"] == "source_supported") & (F.size(c["ids"]) == 0)), "unsupported")
        .when(F.exists(claims, lambda c: (c["kind"] == "background_context") & (F.size(c["ids"]) > 0)), "background_ids")
        .when(F.size(F.filter(claims, lambda c: c["kind"] == "background_context")) > 1, "backgrounds")
        .otherwise("ok")
    )


def decision_report(expected: DataFrame, decisions: DataFrame) -> DataFrame:
    """(status, n): decisions (pair_id, label) against the expected pair ids."""
    d = decisions.groupBy("pair_id").agg(F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("label").isin(-1, 0, 1), 0).otherwise(1)).alias("bad"))
    e = expected.select("pair_id", F.lit(1).alias("e")).distinct()
    status = F.when(F.col("k").isNull(), "missing").when(F.col("e").isNull(), "unknown").when(F.col("k") > 1, "repeated").when(F.col("bad") == 1, "bad_label").otherwise("ok")
    return e.join(d, "pair_id", "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def anchor_report(expected: DataFrame, decisions: DataFrame) -> DataFrame:
    """(status, n): anchors (left_id, right_id expected) whose decisions (left_id, right_id, label) name each of its pairs exactly once with a known label."""
    d = decisions.groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("k"), F.max((~F.col("label").isin(-1, 0, 1)).cast("int")).alias("bad"))
    e = expected.select("left_id", "right_id", F.lit(1).alias("e")).distinct()
    one = e.join(d, ["left_id", "right_id"], "full").groupBy("left_id").agg(F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unknown"), F.count_if(F.col("k") > 1).alias("repeated"), F.max(F.coalesce("bad", F.lit(0))).alias("bad"))
    status = F.when(F.col("unknown") > 0, "unknown").when(F.col("repeated") > 0, "repeated").when(F.col("bad") == 1, "bad_label").when(F.col("missing") > 0, "missing").otherwise("ok")
    return one.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def tiered_search(asked: DataFrame, names: DataFrame, k: int = 10, block: int = 100_000) -> DataFrame:
    """(q, name, tier, rank): exact names, else the k shortest names that hold the text, also inside words, else those with most common words.

    `asked` (q) is a stated set of questions; it is searched in the names in blocks of `block`. Ties go by length and name.
    """
    q, n = cut(asked.select("q").distinct()), names.select("name").distinct()
    exact = q.join(n, F.col("q") == F.col("name")).select("q", "name", F.lit(1).alias("tier"), F.lit(0).alias("score"))
    rest = cut(q.join(exact.select("q").distinct(), "q", "left_anti"))
    blocks = max(1, -(-rest.count() // block))
    inside = None
    for b in range(blocks):
        part = [r[0] for r in rest.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect() if r[0]]  # one block
        shared = names.sparkSession.sparkContext.broadcast(part)

        @nonempty
        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for text in shared.value:
                automaton.add_word(text, text)
            automaton.make_automaton()
            for batch in batches:
                yield pd.DataFrame([(t, name) for name in batch["name"] if len(automaton) for t in {t for _, t in automaton.iter(name)}], columns=["q", "name"])

        hits = n.mapInPandas(run, "q string, name string")
        inside = hits if inside is None else inside.unionByName(hits)
    inside = cut(inside)
    word = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("w")
    last = rest.join(inside.select("q").distinct(), "q", "left_anti").select("q", word(F.col("q"))).join(n.select("name", word(F.col("name"))), "w").groupBy("q", "name").agg((-F.count(F.lit(1))).cast("int").alias("score"))
    both = exact.unionByName(inside.select("q", "name", F.lit(2).alias("tier"), F.lit(0).alias("score"))).unionByName(last.select("q", "name", F.lit(3).alias("tier"), "score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("tier", "score", F.length("name"), "name"))).filter(F.col("rank") <= k).select("q", "name", "tier", "rank")


def sentence_union(rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """(keys, text, n): the distinct sentences of all rows of a key, in the order of first appearance."""
    s = rows.filter(F.col(text).isNotNull()).select(*keys, F.col(order).alias("_o"), F.posexplode(F.split(F.trim(text), r"(?<=[.!?])\s+")).alias("_p", "_s")).filter("_s <> ''")
    first = s.groupBy(*keys, "_s").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_s"))).alias("l")).select(*keys, F.array_join(F.col("l._s"), " ").alias("text"), F.size("l").alias("n"))


def contained_evidence(rows: DataFrame) -> DataFrame:
    """(id, other): rows (id, concept, evidence) whose normalised text stands inside another one of the same concept.

    Equal texts count once, for the smallest id. Candidates share the concept and the text's longest word.
    """
    k = rows.select("id", "concept", plain_key(F.col("evidence")).alias("k")).filter("k <> ''").groupBy("concept", "k").agg(F.min("id").alias("id"))
    ws = F.split("k", " ")
    probe = k.withColumn("w", F.expr("array_max(transform(split(k, ' '), t -> struct(length(t) as n, t as t))).t"))
    full = k.select("concept", F.col("id").alias("other"), F.col("k").alias("k2"), F.explode(F.array_distinct(ws)).alias("w"))
    met = probe.join(full, ["concept", "w"]).filter((F.col("id") != F.col("other")) & F.contains("k2", "k"))
    return met.groupBy("id").agg(F.min("other").alias("other"))


def public_rows(decided: DataFrame, ratio: int = 2, cap: int = 1000, seed: int = 42) -> DataFrame:
    """(pair_id, source, target, label): positives with their direction, and sampled negatives, in pair order.

    decided: (pair_id, left_id, right_id, label in -1, 0, 1). Negatives are the first by digest: `ratio` for each
    positive, or `cap` if there is none.
    """
    pos = decided.filter("label <> 0").select("pair_id", F.when(F.col("label") == 1, F.col("left_id")).otherwise(F.col("right_id")).alias("source"), F.when(F.col("label") == 1, F.col("right_id")).otherwise(F.col("left_id")).alias("target"), F.lit(1).alias("label"))
    n = pos.count()
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pair_id").cast("string")))
    neg = decided.filter("label = 0").orderBy(h, "pair_id").limit(ratio * n if n else cap).select("pair_id", F.col("left_id").alias("source"), F.col("right_id").alias("target"), F.lit(0).alias("label"))
    return pos.unionByName(neg)


def audit_actions(baseline: DataFrame, proposed: DataFrame) -> DataFrame:
    """(concept, part, action): what to do with proposed evidence (concept, part, evidence, score, ok) against the baseline.

    Each side counts by its best row. KEEP if there is no proposal or the baseline has its text, REPLACE if it scores
    higher, else APPEND; ADD_ROW for a new place if the proposal is addable, else DROP.
    """
    best = lambda d, name: d.withColumn("_r", F.row_number().over(Window.partitionBy("concept", "part").orderBy(F.desc("score"), "evidence"))).filter("_r = 1").select("concept", "part", F.struct("score", "evidence", "ok").alias(name))
    action = (
        F.when(F.col("b").isNull(), F.when(F.col("p.ok"), "ADD_ROW").otherwise("DROP")).when(F.col("p").isNull() | is_duplicate(F.col("b.evidence"), F.col("p.evidence")), "KEEP")
        .when(F.col("p.score") > F.col("b.score"), "REPLACE").otherwise("APPEND")
    )
    return best(baseline, "b").join(best(proposed, "p"), ["concept", "part"], "full").select("concept", "part", action.alias("action"))


def prefixed_union(frames: dict[str, DataFrame], column: str) -> DataFrame:
    """(dataset, name): names of several datasets kept apart by a prefix."""
    out = None
    for prefix, df in frames.items():
        part = df.filter(F.col(column).isNotNull()).select(F.lit(prefix).alias("dataset"), F.concat(F.lit(f"{prefix}:"), F.lower(F.trim(column))).alias("name")).distinct()
        out = part if out is None else out.unionByName(part)
    return out
