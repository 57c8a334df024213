"""Queries of question planning over the relation graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import keys
from graphloom.operators import aliases, graphq, quiz
from graphloom.plans.catalogue import CHAINS, CLEAN, EDGES, FIRST_SQL, _aliases, _edges, query
from graphloom.session import cut, table

CONF = """n AS (SELECT DISTINCT canonical, substr(canonical, instr(canonical, ' ') + 1) AS rest FROM mlr_concepts WHERE contains(canonical, ' ')), conf AS (SELECT * FROM (SELECT a.canonical AS src, b.canonical AS dst, row_number() OVER (PARTITION BY a.canonical ORDER BY b.canonical)::INT AS rank FROM n a JOIN n b ON a.rest = b.rest AND a.canonical <> b.canonical) WHERE rank <= 12)"""
SIM = f"""l AS (SELECT {CLEAN.format('source')} AS a, {CLEAN.format('target')} AS b, similarity FROM train_labels_initial WHERE similarity IS NOT NULL), simall AS (SELECT src, dst, max(similarity) AS weight FROM (SELECT a AS src, b AS dst, similarity FROM l UNION ALL SELECT b, a, similarity FROM l) WHERE src <> dst GROUP BY 1, 2),
sim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst)::INT AS rank FROM simall) WHERE rank <= 12)"""
SIDES = """pre AS (SELECT dst AS c, src AS o FROM e WHERE type = 'prerequisite'), dep AS (SELECT src AS c, dst AS o FROM e WHERE type = 'prerequisite'), part AS (SELECT dst AS c, src AS o FROM e WHERE type = 'part-of'), whole AS (SELECT src AS c, dst AS o FROM e WHERE type = 'part-of')"""
FEATURES = f"""{EDGES}, {CONF}, {SIDES}, hop AS (SELECT DISTINCT p.c FROM pre p JOIN pre q ON q.c = p.o AND q.o <> p.c UNION SELECT DISTINCT p.c FROM dep p JOIN dep q ON q.c = p.o AND q.o <> p.c),
ft AS (SELECT canonical AS concept, (SELECT count(*) FROM pre WHERE c = canonical) AS n_prereqs, (SELECT count(*) FROM dep WHERE c = canonical) AS n_dependents, (SELECT count(*) FROM part WHERE c = canonical) AS n_parts, (SELECT count(*) FROM whole WHERE c = canonical) AS n_wholes,
(canonical IN (SELECT c FROM hop))::INT AS has_two_hop, (canonical IN (SELECT src FROM conf))::INT AS has_confusable FROM mlr_concepts)"""
PLANS = """pl AS (SELECT concept, 'concept_discrimination' AS plan, 1 AS prio FROM ft WHERE has_confusable = 1 UNION ALL SELECT concept, 'prerequisite_dependency', 2 FROM ft WHERE n_prereqs + n_dependents > 0 UNION ALL SELECT concept, 'component_membership', 3 FROM ft WHERE n_parts > 0 UNION ALL SELECT concept, 'whole_decomposition', 3 FROM ft WHERE n_parts = 0 AND n_wholes > 0
UNION ALL SELECT concept, 'multi_hop_reasoning', 4 FROM ft WHERE has_two_hop = 1 UNION ALL SELECT concept, 'definition', 5 FROM ft WHERE has_confusable + has_two_hop = 0 AND n_prereqs + n_dependents + n_parts + n_wholes = 0)"""
ANSWERS = """an AS (SELECT concept, plan, CASE WHEN plan = 'prerequisite_dependency' AND n_prereqs > 0 THEN (SELECT min(o) FROM pre WHERE c = concept) WHEN plan IN ('component_membership', 'whole_decomposition') AND n_parts > 0 THEN (SELECT min(o) FROM part WHERE c = concept) ELSE concept END AS correct, n_prereqs, n_parts FROM pl JOIN ft USING (concept)),
ban AS (SELECT concept, plan, concept AS option FROM an UNION SELECT a.concept, a.plan, p.o FROM an a JOIN pre p ON p.c = a.concept WHERE a.plan = 'prerequisite_dependency' UNION SELECT a.concept, a.plan, p.o FROM an a JOIN part p ON p.c = a.concept WHERE a.plan IN ('component_membership', 'whole_decomposition'))"""
POOL = f"""{SIM}, sib AS (SELECT c, o, min(w) AS w FROM (SELECT x.c, y.o, x.o AS w FROM whole x JOIN part y ON y.c = x.o AND y.o <> x.c) GROUP BY 1, 2), sib8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY w, o)::INT AS rank FROM sib) WHERE rank <= 8),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY side, o)::INT AS rank FROM (SELECT c, o, 0 AS side FROM pre UNION ALL SELECT c, o, 1 FROM dep)) WHERE rank <= 12),
pool AS (SELECT name, option, arg_min(source, prio * 100 + rank) AS source, min(prio * 100 + rank) AS place FROM (SELECT src AS name, dst AS option, 'similar/confusable' AS source, 1 AS prio, rank FROM conf UNION ALL SELECT c, o, 'sibling-part-of', 2, rank FROM sib8 UNION ALL SELECT c, o, 'prereq-neighbor', 3, rank FROM near UNION ALL SELECT src, dst, 'same_topic', 4, rank FROM sim) GROUP BY 1, 2)"""
WRONG = f"""{POOL}, met AS (SELECT concept, plan, option, min(place) AS place, arg_min(source, place) AS source FROM (SELECT a.concept, a.plan, p.option, p.source, p.place + a.t AS place FROM (SELECT concept, plan, correct AS name, 0 AS t FROM an UNION ALL SELECT concept, plan, concept, 1000 FROM an) a JOIN pool p ON p.name = a.name) GROUP BY 1, 2, 3),
metok AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM ban b WHERE b.concept = m.concept AND b.plan = m.plan AND b.option = m.option)), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept, plan ORDER BY place, option) AS r FROM metok) WHERE r <= 3),
uni AS (SELECT src AS option FROM e UNION SELECT dst FROM e UNION SELECT canonical FROM mlr_concepts), cnt AS (SELECT a.concept, a.plan, count(t.option) AS n FROM an a LEFT JOIN top t ON t.concept = a.concept AND t.plan = a.plan GROUP BY 1, 2),
tail AS (SELECT concept, plan, option, n + rr AS r FROM (SELECT c.concept, c.plan, u.option, c.n, row_number() OVER (PARTITION BY c.concept, c.plan ORDER BY u.option) AS rr FROM cnt c, uni u WHERE c.n < 3 AND NOT EXISTS (SELECT 1 FROM ban b WHERE b.concept = c.concept AND b.plan = c.plan AND b.option = u.option) AND NOT EXISTS (SELECT 1 FROM top t WHERE t.concept = c.concept AND t.plan = c.plan AND t.option = u.option)) WHERE n + rr <= 3),
wr AS (SELECT concept, plan, option, source, r::INT AS rank FROM top UNION ALL SELECT concept, plan, option, 'same_topic', r::INT FROM tail)"""
STEM = """CASE WHEN plan = 'prerequisite_dependency' THEN 'According to the prerequisite relations in the knowledge graph, which concept should typically be mastered before learning "' || concept || '"?' WHEN plan IN ('component_membership', 'whole_decomposition') THEN 'According to the part-of relations in the knowledge graph, which concept is a component of "' || concept || '"?'
WHEN plan = 'concept_discrimination' THEN 'Based on the concept definition and confusable relations, which option best matches the meaning or boundary of "' || concept || '"?' ELSE 'Based on the concept definition, which option best matches the meaning of "' || concept || '"?' END"""
ITEMS = f"""op AS (SELECT concept, plan, option, rank, substr('ABCDEFGH', row_number() OVER (PARTITION BY concept, plan ORDER BY sha256('42|' || concept || '|' || plan || '|' || option), option)::INT, 1) AS label FROM (SELECT concept, plan, correct AS option, 0 AS rank FROM an UNION ALL SELECT concept, plan, option, rank FROM wr)),
it AS (SELECT concept, plan, {STEM} AS stem, max(CASE WHEN rank = 0 THEN label END) AS answer, max(CASE WHEN rank = 0 THEN option END) AS correct, string_agg(label || '=' || option, ';' ORDER BY label) AS options, 'The correct concept is ' || max(CASE WHEN rank = 0 THEN option END) || ', supported by the graph and definition.' || coalesce(' ' || string_agg(CASE WHEN rank > 0 THEN option || ' is incorrect because it differs from ' || x || ' in its role or definition.' END, ' ' ORDER BY rank), '') AS explanation
FROM (SELECT op.*, an.correct AS x FROM op JOIN an USING (concept, plan)) GROUP BY 1, 2)"""
ALL = f"{FEATURES}, {PLANS}, {ANSWERS}, {WRONG}, {ITEMS}"
LEVELS = """lv AS (SELECT concept, plan, CASE WHEN plan IN ('concept_discrimination', 'multi_hop_reasoning') THEN 'analysis' WHEN plan = 'prerequisite_dependency' THEN CASE WHEN has_two_hop = 1 THEN 'application' ELSE 'understanding' END WHEN plan IN ('component_membership', 'whole_decomposition') THEN CASE WHEN n_parts > 1 THEN 'analysis' ELSE 'understanding' END ELSE 'understanding' END AS bloom,
CASE WHEN has_two_hop = 1 OR n_prereqs >= 3 OR n_parts >= 4 THEN 'hard' WHEN has_confusable = 1 OR n_prereqs > 0 OR n_parts > 0 THEN 'medium' ELSE 'easy' END AS difficulty FROM pl JOIN ft USING (concept))"""


def _concepts(spark, d):
    return table(spark, d, "mlr_concepts")


def _labels(spark, d):
    return table(spark, d, "train_labels_initial")


def _confused(spark, d):
    return graphq.confusable(_concepts(spark, d))


def _features(spark, d):
    return graphq.structural_features(_concepts(spark, d), _edges(spark, d), _confused(spark, d))


class _Made:
    """What the question queries share: every step of the plan, each written once."""

    def __init__(self, spark, d):
        self.edges, self.concepts, self.labels = cut(_edges(spark, d)), _concepts(spark, d), _labels(spark, d)
        self.features = cut(graphq.structural_features(self.concepts, self.edges, graphq.confusable(self.concepts)))
        self.planned = quiz.plans(self.features)
        self.answered = cut(quiz.answers(self.planned, self.edges))
        banned = cut(quiz.forbidden(self.answered, self.edges))
        pool = cut(quiz.candidate_pool(self.answered.select(F.col("concept").alias("name")).union(self.answered.select("correct")), self.edges, self.concepts, self.labels))
        self.universe = self.edges.select(F.col("src").alias("option")).union(self.edges.select("dst")).union(self.concepts.select("canonical")).distinct()
        self.wrong = cut(quiz.distractors(self.answered, banned, pool, self.universe))
        self.items = cut(quiz.items(self.answered, self.wrong))


@query(f"WITH {FEATURES} SELECT * FROM ft")
def structural_features(spark, d):
    return _features(spark, d)


@query(f"WITH {FEATURES}, {PLANS} SELECT * FROM pl")
def plan_types(spark, d):
    return quiz.plans(_features(spark, d))


@query(f"""WITH {FEATURES}, x AS (SELECT src AS concept, 'concept_discrimination' AS plan, src, dst, dst AS o, 6 AS most FROM conf UNION ALL SELECT c, 'prerequisite_dependency', o, c, o, 4 FROM pre UNION ALL SELECT c, 'prerequisite_dependency', c, o, o, 4 FROM dep WHERE c NOT IN (SELECT c FROM pre)
UNION ALL SELECT c, 'component_membership', o, c, o, 4 FROM part UNION ALL SELECT c, 'whole_decomposition', c, o, o, 4 FROM whole WHERE c NOT IN (SELECT c FROM part))
SELECT concept, plan, src, dst, rank FROM (SELECT *, row_number() OVER (PARTITION BY concept, plan ORDER BY o)::INT AS rank FROM x WHERE concept IN (SELECT canonical FROM mlr_concepts)) WHERE rank <= most""")
def plan_edges(spark, d):
    return quiz.plan_edges(_features(spark, d), _edges(spark, d), _confused(spark, d))


@query(f"WITH {FEATURES}, {PLANS}, {LEVELS} SELECT * FROM lv")
def plan_levels(spark, d):
    f = _features(spark, d)
    return quiz.levels(quiz.plans(f), f)


@query(f"""WITH {FEATURES}, {PLANS}, {ANSWERS} SELECT concept, plan, correct, CASE WHEN plan = 'prerequisite_dependency' AND n_prereqs > 0 THEN 'Prerequisite edge ' || correct || ' -> ' || concept || ' means ' || correct || ' must be learned before ' || concept || '.'
WHEN plan IN ('component_membership', 'whole_decomposition') AND n_parts > 0 THEN 'Part-of edge ' || correct || ' -> ' || concept || ' means ' || correct || ' is a component of ' || concept || '.' ELSE 'Definition of ' || concept || '.' END AS basis FROM an""")
def correct_answers(spark, d):
    return quiz.answers(quiz.plans(_features(spark, d)), _edges(spark, d))


@query(f"WITH {FEATURES}, {SIM} SELECT src AS concept, dst AS other, weight, rank FROM sim")
def similar_names(spark, d):
    return graphq.similar(_labels(spark, d)).select(F.col("src").alias("concept"), F.col("dst").alias("other"), "weight", "rank")


@query(f"WITH {FEATURES}, {PLANS}, {ANSWERS}, {WRONG} SELECT * FROM wr")
def distractor_pool(spark, d):
    return _Made(spark, d).wrong


@query(f"WITH {ALL} SELECT concept, plan, label, option FROM op")
def option_shuffle(spark, d):
    return _Made(spark, d).items.select("concept", "plan", F.explode("options").alias("label", "option"))


@query(f"WITH {ALL} SELECT * FROM it")
def question_items(spark, d):
    made = _Made(spark, d).items
    return made.withColumn("options", F.array_join(F.transform(F.map_entries("options"), lambda x: F.concat_ws("=", x["key"], x["value"])), ";"))


@query(f"""WITH {ALL}, {LEVELS}, o4 AS (SELECT concept, plan, string_agg(label, '' ORDER BY label) = 'ABCD' AS s, count(DISTINCT option) = 4 AS u, count(*) FILTER (rank > 0) = 3 AS w FROM op GROUP BY 1, 2)
SELECT concept, plan, s AND u AS unique_answer, s AS answerable, contains(stem, concept) OR plan = 'prerequisite_dependency' AS on_topic, s AND stem LIKE '%?' AS clear_language, u AS options_exclusive, u AND w AS distractors_valid, bloom IS NOT NULL AS bloom_aligned, true AS graph_faithful, contains(explanation, correct) AS explanation_supported,
s AND u AND w AS passed, CASE WHEN s AND u AND w THEN NULL ELSE 'answer_distractor' END AS route, CASE WHEN NOT (s AND u) THEN 'unique_answer failed' WHEN NOT w THEN 'distractors/options failed' END AS reason FROM it JOIN o4 USING (concept, plan) JOIN lv USING (concept, plan)""")
def item_checks(spark, d):
    m = _Made(spark, d)
    return quiz.item_checks(m.items, quiz.levels(m.planned, m.features), m.wrong)


EXPECT = "CASE WHEN regexp_matches(lower(stem), 'procedure|method|technique|approach|algorithm') THEN 'method' WHEN regexp_matches(lower(stem), 'metric|measure|score|ratio|rate') THEN 'metric' WHEN regexp_matches(lower(stem), 'test set|validation set|dataset') THEN 'dataset' WHEN regexp_matches(lower(stem), 'error|loss') THEN 'error' END"
KIND = "CASE WHEN regexp_matches(lower({x}), 'error|loss|cost') THEN 'error' WHEN regexp_matches(lower({x}), 'set|dataset|fold') THEN 'dataset' WHEN regexp_matches(lower({x}), 'matrix') THEN 'matrix' WHEN regexp_matches(lower({x}), 'accuracy|precision|recall|f1|score|auc|rate|ratio|metric') THEN 'metric' WHEN regexp_matches(lower({x}), '{m}') THEN 'method' END"
METHOD = "validation|cross validation|bootstrap|hold[- ]?out|algorithm|method|approach|technique|regression|clustering|model"


@query(f"""WITH {ALL}, k AS (SELECT it.concept, it.plan, {EXPECT} AS expected, op.label, op.option, {KIND.format(x='op.option', m=METHOD)} AS actual FROM it JOIN op USING (concept, plan) WHERE op.rank > 0), w AS (SELECT *, (expected IS NOT NULL AND actual IS NOT NULL AND expected <> actual) AS weak FROM k)
SELECT concept, plan, expected, count(*) FILTER (weak) AS n_weak, coalesce(string_agg(CASE WHEN weak THEN label || '=' || option END, '; ' ORDER BY label), '') AS weak, count(*) FILTER (weak) = 0 AS passed, CASE expected WHEN 'method' THEN 'methods' WHEN 'metric' THEN 'metrics' ELSE 'same type' END AS constraint FROM w GROUP BY 1, 2, 3""")
def distractor_review(spark, d):
    return quiz.distractor_review(_Made(spark, d).items)


PROFILES = "pf AS (SELECT lower(trim(concept)) AS concept, arg_min(text, doc_id) AS profile FROM documents WHERE source LIKE 'profiles%' AND concept IS NOT NULL AND text IS NOT NULL GROUP BY 1), cx AS (SELECT context_id AS id, lower(trim(concept)) AS concept, evidence FROM source_context WHERE concept IS NOT NULL AND evidence IS NOT NULL), mc AS (SELECT concept_id, canonical FROM mlr_concepts)"
BOUND = "regexp_matches({t}, '(^|[^a-z0-9])' || regexp_replace({x}, '([^a-z0-9 ])', '\\\\\\1', 'g') || '($|[^a-z0-9])')"
COURSE = f"""{FIRST_SQL}, {PROFILES}, tm AS (SELECT DISTINCT u.option AS term, m.canonical AS concept FROM uni u LEFT JOIN dim ON dim.alias_key = {CLEAN.format('u.option')} LEFT JOIN mc m ON m.concept_id = dim.concept_id), oth AS (SELECT term, {CLEAN.format('term')} AS x FROM tm WHERE concept IS NULL),
ev AS (SELECT term, 'concept' AS kind, count(*) AS n FROM tm WHERE concept IS NOT NULL GROUP BY 1 UNION ALL SELECT term, 'profile', count(*) FROM tm JOIN pf USING (concept) GROUP BY 1 UNION ALL SELECT term, 'metadata', count(*) FROM tm JOIN cx USING (concept) GROUP BY 1
UNION ALL SELECT term, 'profile_mention', count(*) FROM oth JOIN (SELECT {CLEAN.format('profile')} AS t FROM pf) ON contains(t, x) AND {BOUND.format(t='t', x='x')} GROUP BY 1 UNION ALL SELECT term, 'metadata_mention', count(*) FROM oth JOIN (SELECT {CLEAN.format('evidence')} AS t, id FROM (SELECT DISTINCT id, evidence FROM cx)) ON contains(t, x) AND {BOUND.format(t='t', x='x')} GROUP BY 1)"""


def _course_evidence(spark, d, terms):
    c = _concepts(spark, d)
    dim = aliases.first_wins(_aliases(spark, d)).join(c.select("concept_id", F.col("canonical").alias("concept")), "concept_id").select("alias_key", "concept")
    name = F.lower(F.trim("concept")).alias("concept")
    profiles = table(spark, d, "documents").filter("source like 'profiles%' and concept is not null and text is not null").groupBy(name).agg(F.min_by("text", "doc_id").alias("profile"))
    contexts = table(spark, d, "source_context").filter("concept is not null and evidence is not null").select(F.col("context_id").alias("id"), name, "evidence")
    return quiz.course_evidence(terms, dim, profiles, contexts)


@query(f"WITH RECURSIVE {FEATURES}, uni AS (SELECT src AS option FROM e UNION SELECT dst FROM e UNION SELECT canonical FROM mlr_concepts), {COURSE} SELECT * FROM ev".replace("WITH RECURSIVE", "WITH"))
def course_evidence(spark, d):
    e = _edges(spark, d)
    terms = e.select(F.col("src").alias("term")).union(e.select("dst")).union(_concepts(spark, d).select("canonical")).distinct()
    return _course_evidence(spark, d, terms)


SCOPE = f"""{COURSE}, conf2 AS (SELECT a.canonical AS name, b.canonical AS option FROM n a JOIN n b ON a.rest = b.rest AND a.canonical <> b.canonical), rl AS (SELECT name, option, 100 AS score, 'confusable' AS relation, 1 AS o FROM conf2 UNION ALL SELECT c, o, 85, 'sibling-part-of', 2 FROM sib UNION ALL SELECT c, o, 75, 'prerequisite', 3 FROM pre UNION ALL SELECT c, o, 75, 'prerequisite', 4 FROM dep
UNION ALL SELECT c, o, 75, 'part-of', 5 FROM part UNION ALL SELECT c, o, 75, 'part-of', 6 FROM whole UNION ALL SELECT src, dst, 65, 'similarity', 7 FROM simall),
sc AS (SELECT concept, plan, option, max(score) AS score, arg_max(relation, score * 10 - o) AS relation FROM (SELECT concept, plan, concept AS name FROM an UNION SELECT concept, plan, correct FROM an) JOIN rl USING (name) GROUP BY 1, 2, 3),
cd AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.concept, sc.plan ORDER BY score DESC, option)::INT AS rank FROM sc WHERE NOT EXISTS (SELECT 1 FROM op WHERE op.concept = sc.concept AND op.plan = sc.plan AND op.option = sc.option) AND option <> sc.concept) WHERE rank <= 40 AND option IN (SELECT term FROM ev))"""


def _scope(spark, d):
    m = _Made(spark, d)
    evidenced = cut(_course_evidence(spark, d, m.universe.select(F.col("option").alias("term"))).select("term").distinct())
    return m, evidenced, quiz.scope_candidates(m.answered, m.wrong, m.edges, m.concepts, m.labels, evidenced)


@query(f"WITH {ALL}, {SCOPE} SELECT * FROM cd")
def scope_candidates(spark, d):
    return _scope(spark, d)[2]


SCOPE_EXPECT = "CASE WHEN regexp_matches(lower(stem), 'method|technique|approach|algorithm') THEN 'method' WHEN regexp_matches(lower(stem), 'metric|measure|score|ratio|rate') THEN 'metric' WHEN regexp_matches(lower(stem), 'dataset|training set|validation set|test set') THEN 'dataset' WHEN regexp_matches(lower(stem), 'error|loss|cost') THEN 'error' END"


@query(f"""WITH {ALL}, {SCOPE}, lost AS (SELECT concept, plan, label, option, row_number() OVER (PARTITION BY concept, plan ORDER BY label) AS place FROM op WHERE rank > 0 AND option NOT IN (SELECT term FROM ev)),
gd AS (SELECT cd.concept, cd.plan, cd.option AS replacement, row_number() OVER (PARTITION BY cd.concept, cd.plan ORDER BY rank) AS place FROM cd JOIN it USING (concept, plan) WHERE score >= 65 AND coalesce({SCOPE_EXPECT} = {KIND.format(x='cd.option', m='algorithm|method|approach|technique|regression|clustering|model')}, true))
SELECT concept, plan, label, option, replacement FROM lost LEFT JOIN gd USING (concept, plan, place)""")
def scope_replacements(spark, d):
    m, evidenced, candidates = _scope(spark, d)
    return quiz.scope_replacements(m.items, candidates, evidenced)


@query(f"WITH {ALL} SELECT op.concept, op.plan, 'option_' || op.label AS label, op.option, wr.source FROM op JOIN wr ON wr.concept = op.concept AND wr.plan = op.plan AND wr.option = op.option")
def published_distractors(spark, d):
    m = _Made(spark, d)
    return quiz.published(m.items, m.wrong)


@query("""WITH f AS (SELECT lower(trim(concept)) AS concept, formula_id, latex FROM mlr_formula WHERE concept IS NOT NULL AND latex IS NOT NULL)
SELECT canonical AS concept, count(*) AS n_formulas, min(formula_id) AS formula_id, arg_min(latex, formula_id) AS latex FROM mlr_concepts JOIN f ON f.concept = canonical GROUP BY 1""")
def calculation_plans(spark, d):
    f = table(spark, d, "mlr_formula").filter("concept is not null and latex is not null").select(F.lower(F.trim("concept")).alias("concept"), "formula_id", "latex")
    return quiz.calculations(_concepts(spark, d), f)


@query(r"""SELECT concept_id, canonical, (length(canonical) > 0 AND length(canonical) <= 100 AND regexp_matches(canonical, '[a-z]') AND len(string_split_regex(trim(canonical), '[ \t]+')) <= 10 AND NOT regexp_matches(canonical, '^(?:chapter|section|example|exercise)[ \t]+[0-9]+(?:\.[0-9]+)*$')) AS valid,
NOT (contains(canonical, 'youtube') OR contains(canonical, 'github') OR contains(canonical, 'special thank') OR contains(canonical, 'recall box') OR contains(canonical, 'dgl')) AS unblocked, """ + KIND.format(x="canonical", m=METHOD) + """ AS kind FROM mlr_concepts""")
def concept_types(spark, d):
    c = F.col("canonical")
    return _concepts(spark, d).select("concept_id", "canonical", quiz.valid_name(c).alias("valid"), quiz.unblocked(c).alias("unblocked"), quiz.concept_type(c).alias("kind"))
