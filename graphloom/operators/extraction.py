"""What is taken from pages: candidates and assets checked, merged into registries with sequential ids; profiles and checkpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import latex_key, plural_key
from graphloom.functions.texts import clean_evidence, fallback_profile
from graphloom.operators.publication import MIN_ASSET_CONFIDENCE, MIN_RELEVANCE
from graphloom.session import numbered

#: Overlapping tiles of a page's body, and the fewest and most concepts of a chapter.
TILES = {"top-left": (0.00, 0.00, 0.55, 0.55), "top-right": (0.45, 0.00, 1.00, 0.55), "bottom-left": (0.00, 0.45, 0.55, 1.00), "bottom-right": (0.45, 0.45, 1.00, 1.00)}
LEAST, MOST = 20, 100
ASSETS = "struct<formulas:array<struct<concept:string,latex:string,pdf_page:string,equation_label:string,confidence:string>>,figures:array<struct<concept:string,figure_label:string,caption:string,pdf_page:string,confidence:string>>>"


def relevant(relevance: Column, evidence_page: Column, anchor_page: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Whether a candidate is relevant and its pages lie in the part that was read."""
    ok = F.coalesce(relevance >= MIN_RELEVANCE, F.lit(False))
    return ok if lo is None else ok & evidence_page.between(lo, hi) & anchor_page.between(lo, hi)


def first_of(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def assets(raw: DataFrame, concepts: DataFrame, lo: int, hi: int) -> tuple[DataFrame, DataFrame]:
    """(formulas, figures) of JSON answers (id, json): those of allowed concepts (name) on pages lo..hi, sure enough and not empty, each once."""
    known = concepts.select(plural_key(F.col("name")).alias("k"), F.col("name").alias("concept")).dropDuplicates(["k"])
    read = raw.select("id", F.from_json("json", ASSETS).alias("a"))
    page = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    sure = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    one = lambda side: read.select("id", F.posexplode(f"a.{side}").alias("pos", "x")).select("id", "pos", plural_key(F.col("x.concept")).alias("k"), "x").join(known, "k").select("id", "pos", "k", "concept", page(F.col("x.pdf_page")).alias("pdf_page"), sure(F.col("x.confidence")).alias("confidence"), "x")
    fits = F.col("pdf_page").between(lo, hi) & (F.col("confidence") >= MIN_ASSET_CONFIDENCE)
    f = one("formulas").withColumn("latex", F.trim(F.regexp_replace(F.trim("x.latex"), r"^\$+|\$+$", ""))).withColumn("label", F.trim(F.coalesce("x.equation_label", F.lit("")))).filter(fits & (F.coalesce(F.col("latex"), F.lit("")) != ""))
    g = one("figures").withColumn("label", F.trim(F.coalesce("x.figure_label", F.lit("")))).withColumn("caption", clean_evidence(F.col("x.caption"))).filter(fits & (F.col("label") != "") & (F.coalesce(F.col("caption"), F.lit("")) != ""))
    formulas = first_of(f.withColumn("lk", latex_key(F.col("latex"))), ["k", "lk", "pdf_page"], "id", "pos").select("concept", "latex", "pdf_page", "label", "confidence")
    figures = first_of(g.withColumn("fk", plural_key(F.col("label"))), ["k", "pdf_page", "fk"], "id", "pos").select("concept", "pdf_page", "label", "caption", "confidence")
    return formulas, figures


def chapter_selection(candidates: DataFrame, most: int = MOST) -> DataFrame:
    """(chapter, name, page, rank) of merged candidates (chapter, name, relevance, evidence, page): the best `most` of each chapter, in page order."""
    best = Window.partitionBy("chapter").orderBy(F.desc("relevance"), F.desc(F.length("evidence")), "page", "name")
    kept = candidates.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("chapter").orderBy("page", "name"))).select("chapter", "name", "page", "rank")


def thin_chapters(candidates: DataFrame, least: int = LEAST) -> DataFrame:
    """(chapter, n): chapters with fewer concepts than they must have."""
    return candidates.groupBy("chapter").agg(F.count_distinct("name").alias("n")).filter(F.col("n") < least)


def anchors(candidates: DataFrame) -> DataFrame:
    """(page, names): names by the page that they are anchored to."""
    return candidates.groupBy("page").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))


def formula_registry(formulas: DataFrame, prefix: str = "F") -> DataFrame:
    """(formula_id, concept, latex, chapter, pdf_page): formulas once per concept, formula and page, with ids in page order."""
    keyed = formulas.withColumn("ck", plural_key(F.col("concept"))).withColumn("lk", latex_key(F.col("latex")))
    once = first_of(keyed, ["ck", "lk", "pdf_page"], "chapter", "concept", "latex")
    placed = numbered(once, F.asc("chapter"), F.asc("pdf_page"), F.asc("ck"), F.asc("lk"), name="n")
    return placed.select(F.format_string(f"{prefix}%04d", F.col("n") + 1).alias("formula_id"), "concept", "latex", "chapter", "pdf_page")


def metadata_registry(rows: DataFrame) -> DataFrame:
    """(concept, chapter, page, evidence): occurrences once each, the first in order."""
    keyed = rows.withColumn("ck", plural_key(F.col("concept")))
    return first_of(keyed, ["ck", "chapter", "page", "evidence"], "concept").drop("ck")


def concept_registry(occurrences: DataFrame) -> DataFrame:
    """(canonical, first_chapter, first_page, aliases, n): spellings that differ in case, marks and plural only as one concept.

    The spelling met first is the canonical one, the others are aliases; names are in order of first appearance.
    """
    one = occurrences.groupBy(plural_key(F.col("name")).alias("k"), "name").agg(F.min(F.struct("chapter", "page")).alias("at"), F.count(F.lit(1)).alias("n"))
    head = one.filter("k <> ''").groupBy("k").agg(F.min(F.struct("at", "name")).alias("h"), F.array_sort(F.collect_list("name")).alias("names"), F.sum("n").alias("n"))
    # a spelling whose key is that of the canonical name is no alias; other names come by merging
    return head.select(F.col("h.name").alias("canonical"), F.col("h.at.chapter").alias("first_chapter"), F.col("h.at.page").alias("first_page"), F.size("names").alias("n_spellings"), "n")


def tile_to_body(box: Column, tile: str) -> Column:
    """A box (x0, y0, x1, y1 in thousandths of a tile) in thousandths of the page's body, to two places."""
    x0, y0, x1, y1 = TILES[tile]
    place = lambda k, a, b: F.round((a + box[k] / 1000.0 * (b - a)) * 1000.0, 2)
    return F.array(place(0, x0, x1), place(1, y0, y1), place(2, x0, x1), place(3, y0, y1))


def page_violations(assets_: DataFrame, retained: DataFrame) -> DataFrame:
    """(page, n_assets, n_lost): assets (page, concept) of concepts that were not retained (page, concept) on their page."""
    key = plural_key(F.col("concept"))
    kept = retained.select("page", key.alias("k"), F.lit(1).alias("ok")).distinct()
    return assets_.withColumn("k", key).join(kept, ["page", "k"], "left").groupBy("page").agg(F.count(F.lit(1)).alias("n_assets"), F.count_if(F.col("ok").isNull()).alias("n_lost"))


def unique_names(files: DataFrame, folder: list[str]) -> DataFrame:
    """Files (folder..., stem, suffix, ord) with names of their own: the first keeps the stem, others get _2, _3 and so on."""
    r = F.row_number().over(Window.partitionBy(*folder, "stem", "suffix").orderBy("ord"))
    return files.withColumn("_r", r).withColumn("file_name", F.concat("stem", F.when(F.col("_r") > 1, F.concat(F.lit("_"), F.col("_r").cast("string"))).otherwise(""), "suffix")).drop("_r")


def unit_progress(expected: DataFrame, done: DataFrame) -> DataFrame:
    """(unit, n_expected, n_done, complete, next): pages (unit, page) of each unit, whether exactly they are done, and the first that isn't."""
    e, d = expected.select("unit", "page", F.lit(1).alias("e")).distinct(), done.select("unit", "page", F.lit(1).alias("d")).distinct()
    j = e.join(d, ["unit", "page"], "full")
    open_ = F.col("e").isNotNull() & F.col("d").isNull()
    return j.groupBy("unit").agg(F.count("e").alias("n_expected"), F.count("d").alias("n_done"), (F.count_if(F.col("e").isNull() | F.col("d").isNull()) == 0).alias("complete"), F.min(F.when(open_, F.col("page"))).alias("next"))


def profile_chain(concepts: DataFrame, cache: DataFrame, source: DataFrame) -> DataFrame:
    """(concept, profile, origin) of concepts (concept, aliases): from the cache, else from the source profiles, else by template."""
    j = concepts.join(cache.select("concept", F.col("profile").alias("c")), "concept", "left").join(source.select("concept", F.col("profile").alias("s")), "concept", "left")
    return j.select("concept", F.coalesce("c", "s", fallback_profile(F.col("concept"), F.col("aliases"))).alias("profile"), F.when(F.col("c").isNotNull(), "cache").when(F.col("s").isNotNull(), "source").otherwise("fallback").alias("origin"))


def uncovered(concepts: DataFrame, rows: DataFrame) -> DataFrame:
    """(problem, name): rows (concept) that no concept has, and concepts without rows; both must be empty where coverage is required."""
    c = concepts.select("concept").distinct()
    r = rows.filter("concept is not null").select("concept").distinct()
    return r.join(c, "concept", "left_anti").select(F.lit("unmatched row").alias("problem"), F.col("concept").alias("name")).unionByName(c.join(r, "concept", "left_anti").select(F.lit("no evidence").alias("problem"), F.col("concept").alias("name")))


def required(problems: DataFrame) -> None:
    """An error that names the first problems, if there are any."""
    some = [tuple(r) for r in problems.limit(5).collect()]
    if some:
        raise ValueError(f"not covered: {some}")


def repeated_names(concepts: DataFrame, key: Column) -> DataFrame:
    """(key, n): normalised names that several concepts share, or that are empty."""
    return concepts.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or key = ''")


def input_hash(struct: Column) -> Column:
    """Digest of a struct as JSON with its fields in the given order, which should be that of their names."""
    return F.sha2(F.to_json(struct, {"ignoreNullFields": "false"}), 256)


def triage(expected: DataFrame, checkpoints: DataFrame, same: list[str], valid: Column | None = None) -> DataFrame:
    """(id, status) of expected units (id, same...): missing without a checkpoint, stale if one of `same` differs or its content is invalid, else valid."""
    c = checkpoints.select("id", *[F.col(k).alias(f"_{k}") for k in same], (F.lit(True) if valid is None else valid).alias("_ok"), F.lit(1).alias("_there"))
    equal = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in same])
    return expected.join(c, "id", "left").select("id", F.when(F.col("_there").isNull(), "missing").when(equal & F.coalesce("_ok", F.lit(False)), "valid").otherwise("stale").alias("status"))


def resume(status: DataFrame, force: bool = False, only: int | None = None) -> DataFrame:
    """(id): units to work on: all if forced, one by its id, or those that aren't valid."""
    rows = status if only is None else status.filter(F.col("id") == only)
    return (rows if force else rows.filter("status <> 'valid'")).select("id")


def lenient_reviews(reviews: Column, allowed: Column) -> Column:
    """Sentence reviews (sentence, verdict, evidence_ids, reason) with only allowed ids and a reason for each; null entries go."""
    kept = F.filter(reviews, lambda r: r.isNotNull())
    return F.transform(
        kept, lambda r: F.struct(r["sentence"].alias("sentence"), r["verdict"].alias("verdict"), F.array_intersect(F.coalesce(r["evidence_ids"], F.array().cast("array<string>")), allowed).alias("evidence_ids"), F.when(F.coalesce(F.trim(r["reason"]), F.lit("")) == "", "Reviewed by the model.").otherwise(r["reason"]).alias("reason"))
    )


def max_per_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.max(value).alias("top"))


def encoded(texts: DataFrame, vocabulary: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, ids): words (id, words) as their ids in a vocabulary (token, id), in order; unknown words and empty texts drop out."""
    ws = texts.select(F.col(id_col).alias("_id"), F.posexplode("words").alias("pos", "token"))
    met = ws.join(vocabulary.select("token", F.col("id").alias("_t")), "token")
    return met.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]).alias("ids")).select(F.col("_id").alias(id_col), "ids")


def embedding_source(concepts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(concept, source, token) of concepts (concept, aliases) in a vocabulary (token) of words and phrases.

    The phrase of the name, else of the first known alias, else the mean of its known words, else a seeded vector.
    """
    v = vocabulary.select("token").distinct()
    from graphloom.functions.keys import phrase_token, tokens

    own = concepts.select("concept", phrase_token(F.col("concept")).alias("token")).join(v, "token").select("concept", F.col("token").alias("a"))
    alias = concepts.select("concept", F.posexplode("aliases").alias("pos", "alias")).filter("alias is not null").select("concept", "pos", phrase_token(F.col("alias")).alias("token")).join(v, "token").groupBy("concept").agg(F.min_by("token", "pos").alias("b"))
    word = concepts.select("concept", F.posexplode(tokens(F.col("concept"))).alias("pos", "token")).join(v, "token").groupBy("concept").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "+").alias("c"))
    j = concepts.select("concept").join(own, "concept", "left").join(alias, "concept", "left").join(word, "concept", "left")
    return j.select("concept", F.when(F.col("a").isNotNull(), "canonical_phrase").when(F.col("b").isNotNull(), "alias_phrase").when(F.col("c").isNotNull(), "word_average").otherwise("deterministic_random").alias("source"), F.coalesce("a", "b", "c", F.lit("<deterministic_random>")).alias("token"))
