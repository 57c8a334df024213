"""Queries of evidence, extraction, profiles and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import keys, texts
from graphloom.operators import aliases, evidence, extraction, publication, quiz
from graphloom.plans.catalogue import ALIAS_SQL, CLEAN, FIRST_SQL, PLAIN, UNIQUE_SQL, UNIVERSE, WORDS, _aliases, query, vocab_counts
from graphloom.plans.questions import _features
from graphloom.session import table

PLURAL = """array_to_string(list_transform(string_split({k}, ' '), lambda t: CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 4 AND t LIKE '%es' AND t NOT LIKE '%ses' THEN t[:-3] WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END), ' ')"""
KEY = PLURAL.format(k=PLAIN)
LATEX_KEY = r"regexp_replace(regexp_replace(trim(latex), '^\$+|\$+$', '', 'g'), '[ \t\r\n]+', '', 'g')"
NAMES = f"{FIRST_SQL}, nm AS (SELECT concept_id, list(alias ORDER BY pos) AS names FROM (SELECT concept_id, 0 AS pos, canonical AS alias FROM mlr_concepts UNION ALL SELECT concept_id, 1, alias_1 FROM mlr_concepts UNION ALL SELECT concept_id, 2, alias_2 FROM mlr_concepts UNION ALL SELECT concept_id, 3, alias_3 FROM mlr_concepts UNION ALL SELECT concept_id, 4, alias_4 FROM mlr_concepts UNION ALL SELECT concept_id, 5, alias_5 FROM mlr_concepts) WHERE alias IS NOT NULL GROUP BY 1)"
ROWS = f"""{NAMES}, rw AS (SELECT DISTINCT context_id, dataset, {CLEAN.format('concept')} AS concept, coalesce(fields['chapter'], fields['pdf_file'], '') AS part, coalesce(fields['pdf_page'], '') AS page, evidence, coalesce(nm.names, [concept]) AS names FROM source_context c LEFT JOIN dim ON dim.alias_key = {CLEAN.format('c.concept')} LEFT JOIN nm ON nm.concept_id = dim.concept_id WHERE evidence IS NOT NULL AND concept IS NOT NULL)"""
VERB = r"(^|[^a-z0-9_])(is|are|called|referred|defined|means|method|algorithm|problem|function|process|consists|involves|used|wherein|because|therefore)([^a-z0-9_]|$)"
DAMAGE = " OR ".join(f"contains(evidence, '{m}')" for m in evidence.DAMAGED)
QUALITY = rf"""qa AS (SELECT *, len(list_filter(names, lambda n: {PLAIN.format('n')} <> '' AND contains({PLAIN.format('evidence')}, {PLAIN.format('n')}))) > 0 AS has_name, regexp_matches(lower(evidence), '{VERB}') AS explains, regexp_extract_all(lower(evidence), '[\p{{L}}\p{{N}}_]+') AS w FROM rw),
qb AS (SELECT *, len(list_filter(range(1, len(w) + 1), lambda i: len(list_filter(range(5, 16), lambda s: i + 2 * s - 1 <= len(w) AND w[i:i + s - 1] = w[i + s:i + 2 * s - 1])) > 0)) > 0 AS repeated, ({DAMAGE}) AS damaged FROM qa),
qc AS (SELECT *, round((CASE WHEN length(evidence) >= 160 THEN 2.0 WHEN length(evidence) >= 60 THEN 1.5 WHEN length(evidence) >= 35 THEN 0.75 WHEN length(evidence) < 30 THEN -2.0 ELSE 0 END + CASE WHEN regexp_matches(evidence, '[.!?。！？]$') THEN 0.25 ELSE 0 END + CASE WHEN has_name THEN 1.5 ELSE 0 END + CASE WHEN explains THEN 1.0 ELSE 0 END - CASE WHEN damaged THEN 1.5 ELSE 0 END - CASE WHEN repeated THEN 3.0 ELSE 0 END)::DOUBLE, 3) AS score FROM qb),
qd AS (SELECT *, length(evidence) >= 35 AND score >= 3.5 AND (has_name OR explains) AND coalesce(lower(regexp_extract_all(evidence, '[A-Za-z]+')[-1]), '') NOT IN ({', '.join(f"'{x}'" for x in evidence.WEAK_ENDINGS)})
AND NOT (({' + '.join(f"(length(evidence) - length(replace(evidence, '{m}', '')))" for m in evidence.FORMULA_MARKS)}) >= 2 AND NOT explains) AND NOT regexp_matches(lower(evidence), '^\s*\d+(\.\d+)+\s+[^.]{{0,80}}calculations?([^a-z0-9_]|$)') AND NOT ({' OR '.join(f"contains(evidence, '{m}')" for m in evidence.DAMAGED_FORMULAS)}) AS addable FROM qc)"""


def _evidence_rows(spark, d):
    dim = aliases.first_wins(_aliases(spark, d))
    c = table(spark, d, "mlr_concepts")
    columns = ["canonical", *sorted(x for x in c.columns if x.startswith("alias_"))]
    names = c.select("concept_id", F.array_compact(F.array(*columns)).alias("names"))
    f = F.col("fields")
    rows = table(spark, d, "source_context").filter("evidence is not null and concept is not null").select("context_id", "dataset", keys.clean_field(F.col("concept")).alias("concept"), F.col("concept").alias("raw"), F.coalesce(f["chapter"], f["pdf_file"], F.lit("")).alias("part"), F.coalesce(f["pdf_page"], F.lit("")).alias("page"), "evidence")
    known = dim.withColumnRenamed("alias_key", "concept").join(names, "concept_id").select("concept", "names")
    return rows.join(known, "concept", "left").withColumn("names", F.coalesce("names", F.array("raw"))).drop("raw").distinct()


@query(f"WITH {ROWS}, {QUALITY} SELECT context_id, max(score) AS quality, bool_or(addable) AS addable FROM qd GROUP BY 1")
def evidence_quality(spark, d):
    r = _evidence_rows(spark, d).select("context_id", evidence.quality(F.col("evidence"), F.col("names")).alias("q"), evidence.addable(F.col("evidence"), F.col("names")).alias("a"))
    return r.groupBy("context_id").agg(F.max("q").alias("quality"), F.bool_or("a").alias("addable"))


BASE = "dataset IN ('MLR', 'OCS', 'TUT', 'LAB')"


@query(f"""WITH {ROWS}, {QUALITY}, o AS (SELECT DISTINCT concept, part, evidence, score FROM qd WHERE {BASE}), r AS (SELECT DISTINCT concept, part, evidence, score, addable FROM qd WHERE NOT {BASE}), b AS (SELECT concept, part, evidence AS e2, score AS s2, addable FROM (SELECT *, row_number() OVER (PARTITION BY concept, part ORDER BY score DESC, evidence) AS k FROM r) WHERE k = 1)
SELECT DISTINCT concept, part, CASE WHEN s2 > score THEN e2 ELSE evidence END AS evidence, CASE WHEN s2 > score THEN s2 ELSE score END AS score, CASE WHEN s2 > score THEN 'replaced' WHEN s2 IS NULL THEN 'restored' ELSE 'kept' END AS origin FROM o LEFT JOIN b USING (concept, part)
UNION SELECT concept, part, e2, s2, 'added' FROM b WHERE addable AND NOT EXISTS (SELECT 1 FROM o WHERE o.concept = b.concept AND o.part = b.part)""")
def locator_best_of(spark, d):
    r = _evidence_rows(spark, d)
    return evidence.reconciled(r.filter(BASE), r.filter(f"not ({BASE})"), ["concept", "part"])


@query(f"""WITH {ROWS}, {QUALITY}, o AS (SELECT concept, part, score AS s1, evidence AS e1 FROM (SELECT *, row_number() OVER (PARTITION BY concept, part ORDER BY score DESC, evidence) AS k FROM qd WHERE {BASE}) WHERE k = 1), r AS (SELECT concept, part, score AS s2, evidence AS e2, addable FROM (SELECT *, row_number() OVER (PARTITION BY concept, part ORDER BY score DESC, evidence) AS k FROM qd WHERE NOT {BASE}) WHERE k = 1)
SELECT coalesce(o.concept, r.concept) AS concept, coalesce(o.part, r.part) AS part, CASE WHEN o.concept IS NULL THEN CASE WHEN addable THEN 'ADD_ROW' ELSE 'DROP' END WHEN r.concept IS NULL THEN 'KEEP' WHEN {PLAIN.format('e2')} <> '' AND contains({PLAIN.format('e1')}, {PLAIN.format('e2')}) THEN 'KEEP' WHEN s2 > s1 THEN 'REPLACE' ELSE 'APPEND' END AS action
FROM o FULL JOIN r ON o.concept = r.concept AND o.part = r.part""")
def audit_actions(spark, d):
    r = _evidence_rows(spark, d).withColumns({"score": evidence.quality(F.col("evidence"), F.col("names")), "ok": evidence.addable(F.col("evidence"), F.col("names"))})
    return publication.audit_actions(r.filter(BASE), r.filter(f"not ({BASE})"))


APPEND = r"""s AS (SELECT context_id, list_filter(list_transform(string_split_regex(regexp_replace(a, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda t: trim(t)), lambda t: t <> '') AS x, list_filter(list_transform(string_split_regex(regexp_replace(b, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda t: trim(t)), lambda t: t <> '') AS y, a FROM t)"""


@query(rf"""WITH t AS (SELECT context_id, min(trim(regexp_replace(evidence, '[ \t\r\n]+', ' ', 'g'))) AS a, max(trim(regexp_replace(evidence, '[ \t\r\n]+', ' ', 'g'))) || ' ' || min(trim(coalesce(concept, ''))) || '.' AS b FROM source_context WHERE evidence IS NOT NULL GROUP BY 1), {APPEND},
m AS (SELECT *, list_filter(y, lambda q: NOT list_contains(list_transform(x, lambda p: {PLAIN.format('p')}), {PLAIN.format('q')})) AS more FROM s)
SELECT context_id, CASE WHEN len(more) = 0 THEN a WHEN rtrim(regexp_replace(rtrim(a), '[.!?]+$', '')) = '' THEN array_to_string(list_transform(more, lambda q: trim(regexp_replace(q, '[.!?]+$', ''))), '. ') ELSE rtrim(regexp_replace(rtrim(a), '[.!?]+$', '')) || '. ' || array_to_string(list_transform(more, lambda q: trim(regexp_replace(q, '[.!?]+$', ''))), '. ') END AS text, {PLAIN.format('b')} <> '' AND contains({PLAIN.format('a')}, {PLAIN.format('b')}) AS contained FROM m JOIN t USING (context_id, a)""")
def appended_evidence(spark, d):
    clean = F.trim(F.regexp_replace("evidence", "[ \t\r\n]+", " "))
    t = table(spark, d, "source_context").filter("evidence is not null").groupBy("context_id").agg(F.min(clean).alias("a"), F.max(clean).alias("m"), F.min(F.trim(F.coalesce("concept", F.lit("")))).alias("c"))
    b = F.concat("m", F.lit(" "), "c", F.lit("."))
    return t.select("context_id", texts.append_sentences(F.col("a"), b).alias("text"), texts.is_duplicate(F.col("a"), b).alias("contained"))


@query(f"""WITH {FIRST_SQL}, ca AS (SELECT concept_id, trim(replace(replace(lower(a), chr(8203), ' '), '_', ' ')) AS a FROM (SELECT concept_id, canonical AS a FROM mlr_concepts UNION SELECT concept_id, alias_1 FROM mlr_concepts UNION SELECT concept_id, alias_2 FROM mlr_concepts) WHERE a IS NOT NULL), sm AS (SELECT summary_id AS id, summary FROM dgl_page_summaries WHERE summary IS NOT NULL),
h AS (SELECT DISTINCT concept_id::VARCHAR AS concept, id FROM ca JOIN sm ON a <> '' AND contains(replace(replace(lower(summary), chr(8203), ' '), '_', ' '), a)) SELECT concept, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY id)::INT AS rank FROM h) WHERE rank <= 3""")
def alias_snippets(spark, d):
    c = table(spark, d, "mlr_concepts")
    a = c.select(F.col("concept_id").cast("string").alias("concept"), F.explode(F.array("canonical", "alias_1", "alias_2")).alias("alias")).filter("alias is not null")
    return evidence.alias_snippets(a, table(spark, d, "dgl_page_summaries").filter("summary is not null").select(F.col("summary_id").alias("id"), F.col("summary").alias("text"))).select("concept", "id", "rank")


@query(f"""WITH m AS (SELECT canonical, substr(canonical, instr(canonical, ' ') + 1) AS rest FROM mlr_concepts WHERE contains(canonical, ' ')), w AS (SELECT canonical AS target, canonical AS concept, 0 AS ord FROM mlr_concepts UNION ALL SELECT target, concept, ord FROM (SELECT a.canonical AS target, b.canonical AS concept, row_number() OVER (PARTITION BY a.canonical ORDER BY b.canonical)::INT AS ord FROM m a JOIN m b ON a.rest = b.rest AND a.canonical <> b.canonical) WHERE ord <= 12),
x AS (SELECT DISTINCT lower(trim(concept)) AS concept, context_id AS id FROM source_context WHERE concept IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY id) AS r FROM x), j AS (SELECT target, w.concept, id, ord, r FROM w JOIN r ON r.concept = w.concept WHERE r <= CASE WHEN ord = 0 THEN 5 ELSE 2 END)
SELECT target, concept, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord, concept, r)::INT AS rank FROM j) WHERE rank <= 15""")
def source_contexts(spark, d):
    from graphloom.operators import graphq

    c = table(spark, d, "mlr_concepts")
    w = c.select(F.col("canonical").alias("target"), F.col("canonical").alias("concept"), F.lit(0).alias("ord")).unionByName(graphq.confusable(c).select(F.col("src").alias("target"), F.col("dst").alias("concept"), F.col("rank").alias("ord")))
    x = table(spark, d, "source_context").filter("concept is not null").select(F.lower(F.trim("concept")).alias("concept"), F.col("context_id").alias("id")).distinct()
    return evidence.first_contexts(w, x)


CANDS = "cn AS (SELECT try_cast(fields['chapter'] AS INT) AS chapter, lower(trim(concept)) AS name, max(coalesce(try_cast(fields['confidence'] AS DOUBLE), 0.7)) AS relevance, max(evidence) AS evidence, min(try_cast(fields['pdf_page'] AS INT)) AS page FROM source_context WHERE concept IS NOT NULL AND evidence IS NOT NULL GROUP BY 1, 2)"


def _candidates(spark, d):
    f = F.col("fields")
    r = table(spark, d, "source_context").filter("concept is not null and evidence is not null")
    return r.groupBy(f["chapter"].try_cast("int").alias("chapter"), F.lower(F.trim("concept")).alias("name")).agg(F.max(F.coalesce(f["confidence"].try_cast("double"), F.lit(0.7))).alias("relevance"), F.max("evidence").alias("evidence"), F.min(f["pdf_page"].try_cast("int")).alias("page"))


@query(f"""WITH {CANDS}, k AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY relevance DESC, length(evidence) DESC, page NULLS FIRST, name) AS r FROM cn WHERE relevance >= 0.65) SELECT chapter, name, page, row_number() OVER (PARTITION BY chapter ORDER BY page NULLS FIRST, name)::INT AS rank FROM k WHERE r <= 100""")
def chapter_concepts(spark, d):
    c = _candidates(spark, d)
    return extraction.chapter_selection(c.filter(extraction.relevant(F.col("relevance"), F.col("page"), F.col("page"))))


@query(f"WITH {CANDS} SELECT chapter, count(DISTINCT name) AS n FROM cn GROUP BY 1 HAVING count(DISTINCT name) < 20")
def thin_chapters(spark, d):
    return extraction.thin_chapters(_candidates(spark, d))


@query(f"WITH {CANDS} SELECT page, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM cn GROUP BY 1")
def anchor_pages(spark, d):
    return extraction.anchors(_candidates(spark, d))


@query(f"""WITH k AS (SELECT concept, latex, chapter, pdf_page, {KEY.format('concept')} AS ck, {LATEX_KEY} AS lk FROM mlr_formula WHERE concept IS NOT NULL AND latex IS NOT NULL), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ck, lk, pdf_page ORDER BY chapter NULLS FIRST, concept, latex) AS r FROM k) WHERE r = 1)
SELECT printf('F%04d', row_number() OVER (ORDER BY chapter NULLS FIRST, pdf_page, ck, lk)) AS formula_id, concept, latex, chapter, pdf_page FROM o""")
def formula_registry(spark, d):
    return extraction.formula_registry(table(spark, d, "mlr_formula").filter("concept is not null and latex is not null"))


@query(f"""WITH o AS (SELECT {KEY.format('concept')} AS k, concept AS name, coalesce(chapter, 0) AS chapter, pdf_page AS page FROM mlr_formula WHERE concept IS NOT NULL), s AS (SELECT k, name, min(chapter * 1000000 + page) AS pos, count(*) AS n FROM o WHERE k <> '' GROUP BY 1, 2), h AS (SELECT k, name, pos, row_number() OVER (PARTITION BY k ORDER BY pos, name) AS r, count(*) OVER (PARTITION BY k) AS c, sum(n) OVER (PARTITION BY k) AS t FROM s)
SELECT name AS canonical, (pos // 1000000)::INT AS first_chapter, (pos % 1000000)::INT AS first_page, c::INT AS n_spellings, t::BIGINT AS n FROM h WHERE r = 1""")
def concept_registry(spark, d):
    return extraction.concept_registry(table(spark, d, "mlr_formula").filter("concept is not null").select(F.col("concept").alias("name"), F.coalesce("chapter", F.lit(0)).alias("chapter"), F.col("pdf_page").alias("page")))


@query(f"""WITH r AS (SELECT concept, try_cast(fields['chapter'] AS INT) AS chapter, try_cast(fields['pdf_page'] AS INT) AS page, evidence, {KEY.format('concept')} AS ck FROM source_context WHERE concept IS NOT NULL AND evidence IS NOT NULL) SELECT concept, chapter, page, evidence FROM (SELECT *, row_number() OVER (PARTITION BY ck, chapter, page, evidence ORDER BY concept) AS k FROM r) WHERE k = 1""")
def metadata_registry(spark, d):
    f = F.col("fields")
    return extraction.metadata_registry(table(spark, d, "source_context").filter("concept is not null and evidence is not null").select("concept", f["chapter"].try_cast("int").alias("chapter"), f["pdf_page"].try_cast("int").alias("page"), "evidence"))


@query("""WITH t(tile, a, b, c, e) AS (VALUES ('top-left', 0.0::DOUBLE, 0.0::DOUBLE, 0.55::DOUBLE, 0.55::DOUBLE), ('top-right', 0.45::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.55::DOUBLE), ('bottom-left', 0.0::DOUBLE, 0.45::DOUBLE, 0.55::DOUBLE, 1.0::DOUBLE), ('bottom-right', 0.45::DOUBLE, 0.45::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE))
SELECT passage_id, tile, floor(round((a + bbox[1] / 1000 * (c - a)) * 1000, 2) + 0.005)::BIGINT AS x0, floor(round((b + bbox[2] / 1000 * (e - b)) * 1000, 2) + 0.005)::BIGINT AS y0, floor(round((a + bbox[3] / 1000 * (c - a)) * 1000, 2) + 0.005)::BIGINT AS x1, floor(round((b + bbox[4] / 1000 * (e - b)) * 1000, 2) + 0.005)::BIGINT AS y1 FROM passage, t WHERE bbox IS NOT NULL AND len(bbox) = 4""")
def tile_boxes(spark, d):
    p = table(spark, d, "passage").filter("bbox is not null and size(bbox) = 4")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tile"), extraction.tile_to_body(F.col("bbox"), t).alias("b")) for t in extraction.TILES])).alias("t")
    return p.select("passage_id", each).select("passage_id", "t.tile", *[F.floor(F.col("t.b")[k] + 0.005).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"""WITH k AS (SELECT DISTINCT try_cast(fields['pdf_page'] AS INT) AS page, {KEY.format('concept')} AS k FROM source_context WHERE concept IS NOT NULL) SELECT pdf_page AS page, count(*) AS n_assets, count(*) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.page = f.pdf_page AND k.k = {KEY.format('f.concept')})) AS n_lost FROM mlr_formula f WHERE concept IS NOT NULL GROUP BY 1""")
def page_references(spark, d):
    kept = table(spark, d, "source_context").filter("concept is not null").select(F.col("fields")["pdf_page"].try_cast("int").alias("page"), "concept")
    return extraction.page_violations(table(spark, d, "mlr_formula").filter("concept is not null").select(F.col("pdf_page").alias("page"), "concept"), kept)


@query("""WITH f AS (SELECT summary_id, lecture, CASE WHEN trim(regexp_replace(lower(coalesce(page_title, '')), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'item' ELSE trim(regexp_replace(lower(coalesce(page_title, '')), '[^a-z0-9]+', '-', 'g'), '-') END AS stem FROM dgl_page_summaries)
SELECT summary_id, stem || CASE WHEN r > 1 THEN '_' || r ELSE '' END || '.png' AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY lecture, stem ORDER BY summary_id) AS r FROM f)""")
def unique_file_names(spark, d):
    f = table(spark, d, "dgl_page_summaries").select("summary_id", "lecture", keys.slug(F.coalesce("page_title", F.lit("")), 1000).alias("stem"), F.lit(".png").alias("suffix"), F.col("summary_id").alias("ord"))
    return extraction.unique_names(f, ["lecture"]).select("summary_id", "file_name")


@query("""WITH d AS (SELECT DISTINCT lecture AS unit, pdf_page AS page FROM dgl_page_summaries), e AS (SELECT unit, unnest(range(1, m + 1)) AS page FROM (SELECT unit, max(page) AS m FROM d GROUP BY 1))
SELECT unit, count(e.page) AS n_expected, count(d.page) AS n_done, count(*) = count(d.page) AND count(*) = count(e.page) AS complete, min(CASE WHEN d.page IS NULL THEN e.page END)::INT AS next FROM e FULL JOIN d USING (unit, page) GROUP BY 1""")
def unit_progress(spark, d):
    done = table(spark, d, "dgl_page_summaries").select(F.col("lecture").alias("unit"), F.col("pdf_page").alias("page")).distinct()
    expected = done.groupBy("unit").agg(F.max("page").alias("m")).select("unit", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("page"))
    return extraction.unit_progress(expected, done)


@query("""WITH p AS (SELECT passage_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k, CASE WHEN bbox IS NULL THEN '' ELSE array_to_string(list_transform(bbox, lambda x: round(x)::INT), ',') END AS b FROM passage WHERE text IS NOT NULL AND source_type = 'handwritten') SELECT k AS key, b AS box, min(passage_id) AS passage_id, count(*) AS n FROM p GROUP BY 1, 2""")
def uncertain_once(spark, d):
    p = table(spark, d, "passage").filter("text is not null and source_type = 'handwritten'")
    box = F.coalesce(F.array_join(F.transform("bbox", lambda x: F.round(x).cast("int").cast("string")), ","), F.lit(""))
    return p.groupBy(keys.plain_key(F.col("text")).alias("key"), box.alias("box")).agg(F.min("passage_id").alias("passage_id"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- profiles and checkpoints

ALIASES = "[alias_1, alias_2, alias_3, alias_4, alias_5]"
TEMPLATE = f"canonical || ' is a machine learning course concept. It appears with related terms such as ' || CASE WHEN len(list_filter({ALIASES}, lambda a: a IS NOT NULL AND trim(a) <> '')) > 0 THEN array_to_string(list_filter({ALIASES}, lambda a: a IS NOT NULL AND trim(a) <> '')[1:3], ', ') ELSE canonical END || ' and is used to describe model ideas, data, optimization, or evaluation.'"


def _profiles(spark, d, where: str):
    p = table(spark, d, "documents").filter(f"{where} and concept is not null and text is not null")
    return p.groupBy(F.lower(F.trim("concept")).alias("concept")).agg(F.min_by("text", "doc_id").alias("profile"))


def _named(spark, d):
    return table(spark, d, "mlr_concepts").select(F.col("canonical").alias("concept"), F.array_compact(F.array(*[f"alias_{k}" for k in range(1, 6)])).alias("aliases"))


PROFILE = "SELECT lower(trim(concept)) AS concept, arg_min(text, doc_id) AS profile FROM documents WHERE {} AND concept IS NOT NULL AND text IS NOT NULL GROUP BY 1"


@query(f"""WITH c AS ({PROFILE.format("source = 'profiles-01'")}), s AS ({PROFILE.format("source LIKE 'profiles%'")}) SELECT canonical AS concept, coalesce(c.profile, s.profile, {TEMPLATE}) AS profile, CASE WHEN c.profile IS NOT NULL THEN 'cache' WHEN s.profile IS NOT NULL THEN 'source' ELSE 'fallback' END AS origin FROM mlr_concepts m LEFT JOIN c ON c.concept = canonical LEFT JOIN s ON s.concept = canonical""")
def profile_chain(spark, d):
    return extraction.profile_chain(_named(spark, d), _profiles(spark, d, "source = 'profiles-01'"), _profiles(spark, d, "source like 'profiles%'"))


@query(f"""SELECT concept_id, 'Concept: ' || canonical || CASE WHEN array_to_string(list_filter({ALIASES}, lambda a: a IS NOT NULL), ', ') NOT IN ('', canonical) THEN chr(10) || 'Aliases: ' || array_to_string(list_filter({ALIASES}, lambda a: a IS NOT NULL), ', ') ELSE '' END || chr(10) || 'Profile: ' || {TEMPLATE} AS text FROM mlr_concepts""")
def embedding_texts(spark, d):
    c = table(spark, d, "mlr_concepts").withColumn("aliases", F.array_compact(F.array(*[f"alias_{k}" for k in range(1, 6)])))
    return c.select("concept_id", texts.embedding_text(F.col("canonical"), F.col("aliases"), texts.fallback_profile(F.col("canonical"), F.col("aliases"))).alias("text"))


@query(f"""WITH p AS ({PROFILE.format("source LIKE 'profiles%'")}) SELECT label_id, 'Candidate prerequisite: ' || source || '. ' || coalesce(a.profile, '') AS a, 'Target concept: ' || target || '. ' || coalesce(b.profile, '') AS b FROM train_labels_initial l LEFT JOIN p a ON a.concept = {CLEAN.format('source')} LEFT JOIN p b ON b.concept = {CLEAN.format('target')} WHERE label = 1""")
def pair_texts(spark, d):
    p = _profiles(spark, d, "source like 'profiles%'")
    t = table(spark, d, "train_labels_initial").filter("label = 1").withColumns({"s": keys.clean_field(F.col("source")), "t": keys.clean_field(F.col("target"))})
    j = t.join(p.select(F.col("concept").alias("s"), F.col("profile").alias("ps")), "s", "left").join(p.select(F.col("concept").alias("t"), F.col("profile").alias("pt")), "t", "left")
    a, b = texts.pair_texts(F.col("source"), F.coalesce("ps", F.lit("")), F.col("target"), F.coalesce("pt", F.lit("")))
    return j.select("label_id", a.alias("a"), b.alias("b"))


TEXT = "CASE WHEN length(evidence) % 3 = 0 THEN evidence ELSE concept || ': ' || evidence END"


@query(rf"""WITH t AS (SELECT DISTINCT context_id, concept, trim(regexp_replace(replace({TEXT}, '…', '...'), '[ \t\r\n\x{{a0}}]+', ' ', 'g')) AS t FROM source_context WHERE evidence IS NOT NULL AND concept IS NOT NULL), w AS (SELECT *, len(regexp_extract_all(t, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) AS n, len(regexp_extract_all(concept, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) AS m FROM t)
SELECT context_id, CASE WHEN NOT starts_with(lower(t), lower(concept) || ':') THEN 'prefix' WHEN n > 40 THEN 'long' WHEN n <= m THEN 'no_explanation' WHEN regexp_matches(lower(t), '\b(?:the|this|that)\s+(?:attached|provided|supplied|above|below)\s+(?:image|figure|diagram|slide)\b|\b(?:on|in)\s+this\s+(?:page|slide)\b') THEN 'context' ELSE 'ok' END AS reason FROM w""")
def profile_validation(spark, d):
    r = table(spark, d, "source_context").filter("evidence is not null and concept is not null")
    t = F.when(F.length("evidence") % 3 == 0, F.col("evidence")).otherwise(F.concat("concept", F.lit(": "), "evidence"))
    return r.select("context_id", "concept", t.alias("t")).distinct().select("context_id", publication.profile_reason(F.col("concept"), F.col("t"), 40).alias("reason")).distinct()


@query(f"""WITH {UNIQUE_SQL}, r AS (SELECT DISTINCT coalesce(m.canonical, {CLEAN.format('c.concept')}) AS concept FROM source_context c LEFT JOIN udim ON udim.alias_key = {CLEAN.format('c.concept')} LEFT JOIN mlr_concepts m ON m.concept_id = udim.concept_id WHERE c.concept IS NOT NULL)
SELECT 'unmatched row' AS problem, concept AS name FROM r WHERE concept NOT IN (SELECT canonical FROM mlr_concepts) UNION ALL SELECT 'no evidence', canonical FROM mlr_concepts WHERE canonical NOT IN (SELECT concept FROM r)""")
def coverage_problems(spark, d):
    c = table(spark, d, "mlr_concepts").select("concept_id", F.col("canonical").alias("concept"))
    rows = aliases.resolve(table(spark, d, "source_context").filter("concept is not null").select(F.col("concept").alias("raw")), aliases.unique_only(_aliases(spark, d)), "raw", "concept_id").join(c, "concept_id", "left").select(F.coalesce("concept", keys.clean_field(F.col("raw"))).alias("concept"))
    return extraction.uncovered(c, rows)


@query(f"SELECT {PLAIN.format('concept')} AS key, count(*) AS n FROM mlr_formula WHERE concept IS NOT NULL GROUP BY 1 HAVING count(*) > 1 OR {PLAIN.format('concept')} = ''")
def repeated_names(spark, d):
    return extraction.repeated_names(table(spark, d, "mlr_formula").filter("concept is not null"), keys.plain_key(F.col("concept")))


HASHED = """h AS (SELECT lecture, pdf_file, pdf_page, summary_id, sha256('{"page":' || pdf_page || ',"summary":' || coalesce('"' || regexp_replace(summary, '[^ -~]|["\\\\]', '', 'g') || '"', 'null') || '}') AS hash FROM dgl_page_summaries)""".replace("[^ -~]|[\"\\\\]", "[^ !#-.0-\\[\\]-~]")


@query(f"""WITH {HASHED}, k AS (SELECT *, row_number() OVER (PARTITION BY lecture, pdf_file, pdf_page ORDER BY summary_id) AS r FROM h), e AS (SELECT max(summary_id) AS id, arg_max(hash, summary_id) AS hash FROM h GROUP BY lecture, pdf_file, pdf_page), c AS (SELECT a.id, h.hash FROM (SELECT lecture, pdf_file, pdf_page, max(summary_id) AS id FROM h GROUP BY 1, 2, 3) a JOIN k h ON h.lecture = a.lecture AND h.pdf_file = a.pdf_file AND h.pdf_page = a.pdf_page AND h.r = 1 WHERE a.id % 4 <> 0)
SELECT e.id, CASE WHEN c.id IS NULL THEN 'missing' WHEN c.hash = e.hash THEN 'valid' ELSE 'stale' END AS status FROM e LEFT JOIN c ON c.id = e.id""")
def checkpoint_triage(spark, d):
    """The last delivery of a page is expected, its first one is the checkpoint; a quarter of the checkpoints is taken for lost."""
    from pyspark.sql import Window

    plain = F.regexp_replace("summary", r"[^ !#-.0-\[\]-~]", "")
    h = table(spark, d, "dgl_page_summaries").withColumn("hash", extraction.input_hash(F.struct(F.col("pdf_page").alias("page"), plain.alias("summary"))))
    page = ["lecture", "pdf_file", "pdf_page"]
    e = h.groupBy(*page).agg(F.max("summary_id").alias("id"), F.max_by("hash", "summary_id").alias("hash"), F.min_by("hash", "summary_id").alias("first"))
    return extraction.triage(e.select("id", "hash"), e.filter("id % 4 <> 0").select("id", F.col("first").alias("hash")), ["hash"])


# ---------------------------------------------------------------- texts

ESCAPE = "array_to_string(list_transform(string_split(latex, ''), lambda c: CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.LATEX.items()) + " ELSE c END), '')"


@query(rf"SELECT formula_id, {ESCAPE} AS escaped, regexp_replace(lower(latex), '[ \t\r\n\x0b\x0c\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', '', 'g') AS compact FROM mlr_formula WHERE latex IS NOT NULL")
def latex_texts(spark, d):
    x = F.col("latex")
    return table(spark, d, "mlr_formula").filter("latex is not null").select("formula_id", texts.latex_escaped(x).alias("escaped"), texts.compact_formula(x).alias("compact"))


@query(rf"SELECT context_id, max(left(trim(regexp_replace(replace(evidence, '…', '...'), '[ \t\r\n\x0b\x0c\x00\x{{a0}}]+', ' ', 'g')), 100)) AS text FROM source_context WHERE evidence IS NOT NULL GROUP BY 1")
def clean_texts(spark, d):
    r = table(spark, d, "source_context").filter("evidence is not null")
    return r.groupBy("context_id").agg(F.max(texts.clean_text(F.col("evidence"), 100)).alias("text"))


@query(f"""WITH m AS (SELECT concept_id, canonical, list_filter([canonical, alias_1, alias_2, alias_3, alias_4, alias_5, upper(alias_1)], lambda a: a IS NOT NULL) AS l FROM mlr_concepts) SELECT concept_id, array_to_string(list_filter(list_filter(l, lambda a, i: list_position(list_transform(l, lambda x: {PLAIN.format('x')}), {PLAIN.format('a')}) = i), lambda a: {PLAIN.format('a')} <> {PLAIN.format('canonical')}), '|') AS aliases FROM m""")
def merged_aliases(spark, d):
    lists = F.array_compact(F.array("canonical", *[f"alias_{k}" for k in range(1, 6)], F.upper("alias_1")))
    return table(spark, d, "mlr_concepts").select("concept_id", F.array_join(texts.merged_aliases(F.col("canonical"), lists), "|").alias("aliases"))


@query("""SELECT context_id, max(array_to_string(list_sort(list_transform(list_filter(map_entries(fields), lambda e: e.value IS NOT NULL AND e.value <> '' AND e.key NOT IN ('path', 'order', 'pdf_file')), lambda e: e.key || '=' || e.value)), ';')) AS fields FROM source_context WHERE fields IS NOT NULL GROUP BY 1""")
def public_fields(spark, d):
    f = texts.public_fields(F.col("fields"), ("pdf_file",))
    return table(spark, d, "source_context").filter("fields is not null").groupBy("context_id").agg(F.max(F.array_join(F.array_sort(F.transform(F.map_entries(f), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")).alias("fields"))


@query("""SELECT chapter, max(pdf_page) AS top FROM mlr_formula GROUP BY 1""")
def max_per_round(spark, d):
    return extraction.max_per_group(table(spark, d, "mlr_formula"), "chapter", "pdf_page")


@query("""SELECT vec_id, round(coalesce(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: x::DOUBLE)), 0) / greatest(len(list_filter(embedding, lambda x: x > 0)), 1), 6) AS mean FROM embeddings""")
def masked_means(spark, d):
    mask = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    return table(spark, d, "embeddings").select("vec_id", F.round(texts.masked_mean(F.col("embedding"), mask), 6).alias("mean"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), x AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM w), c AS (SELECT token, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 5), v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM c)
SELECT doc_id, count(*)::INT AS n, md5(string_agg(id::VARCHAR, ' ' ORDER BY pos)) AS ids FROM x JOIN v USING (token) GROUP BY 1""")
def word_encoding(spark, d):
    docs = table(spark, d, "documents").select("doc_id", keys.tokens(F.col("text")).alias("words"))
    e = extraction.encoded(docs, vocab_counts(spark, d), "doc_id")
    return e.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join("ids", " ")).alias("ids"))


@query(f"""WITH w AS (SELECT unnest({WORDS}) AS token FROM documents), c AS (SELECT token FROM w GROUP BY 1 HAVING count(*) >= 5), {ALIAS_SQL}, m AS (SELECT canonical, regexp_extract_all(lower(canonical), '[a-z0-9]+(?:[-''][a-z0-9]+)?') AS ws FROM mlr_concepts), k AS (SELECT canonical, array_to_string(list_filter(ws, lambda t: t IN (SELECT token FROM c)), '+') AS known FROM m)
SELECT canonical AS concept, CASE WHEN known = '' THEN 'deterministic_random' ELSE 'word_average' END AS source, CASE WHEN known = '' THEN '<deterministic_random>' ELSE known END AS token FROM (SELECT m.canonical, coalesce((SELECT string_agg(u.t, '+' ORDER BY u.i) FROM (SELECT unnest(m.ws) AS t, generate_subscripts(m.ws, 1) AS i) u WHERE u.t IN (SELECT token FROM c)), '') AS known FROM m)""")
def embedding_sources(spark, d):
    return extraction.embedding_source(_named(spark, d), vocab_counts(spark, d))


@query(f"""WITH e AS ({UNIVERSE}), d AS (SELECT event_id % 600 AS left_id, (event_id * 7) % 600 AS right_id, count(*) AS k, max((event_id % 7 - 1 NOT IN (-1, 0, 1))::INT) AS bad FROM events GROUP BY 1, 2), o AS (SELECT left_id, count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (e.pair_id IS NULL) AS unknown, count(*) FILTER (k > 1) AS repeated, max(coalesce(bad, 0)) AS bad FROM e FULL JOIN d USING (left_id, right_id) GROUP BY 1)
SELECT CASE WHEN unknown > 0 THEN 'unknown' WHEN repeated > 0 THEN 'repeated' WHEN bad = 1 THEN 'bad_label' WHEN missing > 0 THEN 'missing' ELSE 'ok' END AS status, count(*) AS n FROM o GROUP BY 1""")
def anchor_validation(spark, d):
    from graphloom.operators import labels

    decisions = table(spark, d, "events").select((F.col("event_id") % 600).alias("left_id"), ((F.col("event_id") * 7) % 600).alias("right_id"), (F.col("event_id") % 7 - 1).alias("label"))
    return publication.anchor_report(labels.pair_universe(table(spark, d, "mlr_concepts"), "concept_id"), decisions)


@query("""WITH j AS (SELECT c.canonical, f.chapter, dn.canonical IS NOT NULL AS done FROM mlr_concepts c LEFT JOIN (SELECT lower(concept) AS canonical, min(try_cast(fields['chapter'] AS INT)) AS chapter FROM source_context GROUP BY 1) f USING (canonical) LEFT JOIN (SELECT DISTINCT lower(concept) AS canonical FROM documents WHERE concept IS NOT NULL AND source LIKE 'quiz%') dn ON dn.canonical = c.canonical)
SELECT count(*) AS total, count(*) FILTER (NOT done AND chapter IS NOT NULL) AS generated, count(*) FILTER (done) AS skipped, count(*) FILTER (NOT done AND chapter IS NULL) AS failed FROM j""")
def batch_summary(spark, d):
    from graphloom.plans.catalogue import batch_jobs

    return quiz.job_summary(batch_jobs(spark, d))
