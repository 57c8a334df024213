"""Queries of the core operators over the driver's tables, each with its SQL.

Every entry is (name, DataFrame function, SQL). The SQL is written for DuckDB and uses its own functions, so it is an
independent statement of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import keys
from graphloom.operators import aliases, evidence, graphq, labels, metrics, pseudo, publication, quiz, simgraph
from graphloom.session import cut, numbered, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- aliases

ALIAS_SQL = r"""aliases AS (
  SELECT concept_id, pos, trim(regexp_replace(lower(alias), '[ \t\r\n]+', ' ', 'g')) AS alias_key FROM (
    SELECT concept_id, 0 AS pos, canonical AS alias FROM mlr_concepts UNION ALL
    SELECT concept_id, 1, alias_1 FROM mlr_concepts UNION ALL SELECT concept_id, 2, alias_2 FROM mlr_concepts UNION ALL
    SELECT concept_id, 3, alias_3 FROM mlr_concepts UNION ALL SELECT concept_id, 4, alias_4 FROM mlr_concepts UNION ALL
    SELECT concept_id, 5, alias_5 FROM mlr_concepts) WHERE alias IS NOT NULL)"""
FIRST_SQL = ALIAS_SQL + ", dim AS (SELECT alias_key, arg_min(concept_id, concept_id * 10 + pos) AS concept_id FROM aliases GROUP BY 1)"


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return aliases.alias_rows(table(spark, d, "mlr_concepts"))


@query(f"WITH {FIRST_SQL} SELECT * FROM dim")
def alias_first_wins(spark, d):
    return aliases.first_wins(_aliases(spark, d))


@query(f"""WITH {ALIAS_SQL} SELECT alias_key, coalesce(min(CASE WHEN pos = 0 THEN concept_id END), CASE WHEN count(DISTINCT concept_id) = 1 THEN min(concept_id) END) AS concept_id
FROM aliases GROUP BY 1 HAVING coalesce(min(CASE WHEN pos = 0 THEN concept_id END), CASE WHEN count(DISTINCT concept_id) = 1 THEN min(concept_id) END) IS NOT NULL""")
def alias_unique(spark, d):
    return aliases.unique_only(_aliases(spark, d))


@query()
def alias_last_wins(spark, d):
    return aliases.last_wins(_aliases(spark, d))


@query(f"WITH {ALIAS_SQL} SELECT alias_key, count(DISTINCT concept_id) AS n_concepts FROM aliases GROUP BY 1 HAVING count(DISTINCT concept_id) > 1")
def alias_ambiguous(spark, d):
    return aliases.ambiguous(_aliases(spark, d))


CLEAN = r"trim(regexp_replace(lower({}), '[ \t\r\n]+', ' ', 'g'))"


@query(f"""WITH {FIRST_SQL} SELECT l.split, count(*) AS n, count(s.concept_id) AS n_source, count(t.concept_id) AS n_target, count(*) FILTER (s.concept_id IS NULL AND t.concept_id IS NULL) AS n_neither
FROM train_labels_initial l LEFT JOIN dim s ON s.alias_key = {CLEAN.format('l.source')} LEFT JOIN dim t ON t.alias_key = {CLEAN.format('l.target')} GROUP BY 1""")
def label_endpoints(spark, d):
    dim = aliases.first_wins(_aliases(spark, d))
    rows = aliases.resolve(aliases.resolve(table(spark, d, "train_labels_initial"), dim, "source", "s"), dim, "target", "t")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("n_source"), F.count("t").alias("n_target"), F.count_if(F.col("s").isNull() & F.col("t").isNull()).alias("n_neither"))


UNIQUE_SQL = ALIAS_SQL + ", udim AS (SELECT alias_key, coalesce(min(CASE WHEN pos = 0 THEN concept_id END), CASE WHEN count(DISTINCT concept_id) = 1 THEN min(concept_id) END) AS concept_id FROM aliases GROUP BY 1 HAVING coalesce(min(CASE WHEN pos = 0 THEN concept_id END), CASE WHEN count(DISTINCT concept_id) = 1 THEN min(concept_id) END) IS NOT NULL)"


@query(f"""WITH {UNIQUE_SQL} SELECT dataset, count(*) AS n, count(concept) AS n_named, count(udim.concept_id) AS n_matched, count(*) FILTER (concept IS NOT NULL AND udim.concept_id IS NULL) AS n_unmatched
FROM source_context c LEFT JOIN udim ON udim.alias_key = {CLEAN.format('c.concept')} GROUP BY 1""")
def profile_join_report(spark, d):
    rows = aliases.resolve(table(spark, d, "source_context"), aliases.unique_only(_aliases(spark, d)), "concept", "cid")
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("concept").alias("n_named"), F.count("cid").alias("n_matched"), F.count_if(F.col("concept").isNotNull() & F.col("cid").isNull()).alias("n_unmatched"))


PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


# ---------------------------------------------------------------- keys and texts


@query(r"""SELECT concept_id, canonical, regexp_extract_all(lower(canonical), '[a-z0-9]+(?:[-''][a-z0-9]+)?') AS toks,
'__phrase__' || array_to_string(regexp_extract_all(lower(canonical), '[a-z0-9]+(?:[-''][a-z0-9]+)?'), '_') AS phrase,
array_to_string(list_transform(string_split(trim(regexp_replace(lower(canonical), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t:
  CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 4 AND t LIKE '%es' AND t NOT LIKE '%ses' THEN t[:-3] WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END), ' ') AS plural_key,
CASE WHEN trim(regexp_replace(lower(canonical), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'item' ELSE trim(regexp_replace(lower(canonical), '[^a-z0-9]+', '-', 'g'), '-') END AS slug
FROM mlr_concepts""")
def name_keys(spark, d):
    c = F.col("canonical")
    return table(spark, d, "mlr_concepts").select("concept_id", "canonical", keys.tokens(c).alias("toks"), keys.phrase_token(c).alias("phrase"), keys.plural_key(c).alias("plural_key"), keys.slug(c, 1000).alias("slug"))


WORDS = r"regexp_extract_all(replace(replace(lower(text), chr(8203), ' '), '_', ' '), '[a-z0-9]+(?:[-''][a-z0-9]+)?')"


@query(f"""WITH w AS (SELECT unnest({WORDS}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 5)
SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM c""")
def vocab_counts(spark, d):
    words = table(spark, d, "documents").select(F.explode(keys.tokens(F.col("text"))).alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return numbered(counts, F.desc("n"), F.col("token"), name="id")


@query(f"""WITH w AS (SELECT unnest({WORDS}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 5)
SELECT token, round(pow(n, 0.75) / sum(pow(n, 0.75)) OVER (), 9) AS p FROM c""")
def neg_sampling_dist(spark, d):
    words = table(spark, d, "documents").select(F.explode(keys.tokens(F.col("text"))).alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").withColumn("w", F.pow(F.col("n").cast("double"), F.lit(0.75)))
    total = counts.agg(F.sum("w").alias("total"))
    return counts.join(F.broadcast(total)).select("token", F.round(F.col("w") / F.col("total"), 9).alias("p"))  # one row


@query(r"""WITH t AS (SELECT passage_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[-''][a-z0-9]+)?') AS toks FROM passage WHERE text IS NOT NULL),
p AS (SELECT passage_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM t)
SELECT a.token AS center, b.token AS context, count(*) AS n FROM p a JOIN p b ON a.passage_id = b.passage_id AND b.pos - a.pos BETWEEN -5 AND 5 AND a.pos <> b.pos GROUP BY 1, 2""")
def skipgram_pairs(spark, d):
    return evidence.skipgrams(table(spark, d, "passage").filter("text is not null"), keys.tokens(F.col("text")), 5)


@query(r"""SELECT formula_id, (length(latex) > 0 AND length(latex) <= 1000 AND NOT regexp_matches(lower(latex), '\?|illegible|unclear|unknown|cannot read') AND length(replace(latex, '{', '')) = length(replace(latex, '}', '')) AND length(replace(latex, '(', '')) = length(replace(latex, ')', '')) AND length(replace(latex, '[', '')) = length(replace(latex, ']', ''))) AS valid,
regexp_replace(regexp_replace(trim(latex), '^\$+|\$+$', '', 'g'), '[ \t\r\n]+', '', 'g') AS latex_key FROM mlr_formula WHERE latex IS NOT NULL""")
def latex_validity(spark, d):
    x = F.col("latex")
    return table(spark, d, "mlr_formula").filter("latex is not null").select("formula_id", publication.latex_valid(x).alias("valid"), keys.latex_key(x).alias("latex_key"))


@query(r"""SELECT passage_id, len(regexp_extract_all(text, '[A-Za-z]+(?:[''-][A-Za-z]+)*')) AS words, len(regexp_extract_all(text, '[A-Za-z]+(?:[''-][A-Za-z]+)*')) <= 120 AS short FROM passage WHERE text IS NOT NULL""")
def word_count_filter(spark, d):
    n = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+(?:['-][A-Za-z]+)*"), F.lit(0)))
    return table(spark, d, "passage").filter("text is not null").select("passage_id", n.cast("long").alias("words"), (n <= 120).alias("short"))


@query(r"""SELECT formula_id, 'FORMULA-' || upper(substr(sha256(coalesce(concept, '') || '|' || coalesce(latex, '')), 1, 12)) AS stable_id FROM mlr_formula""")
def stable_ids(spark, d):
    h = F.sha2(F.concat(F.coalesce("concept", F.lit("")), F.lit("|"), F.coalesce("latex", F.lit(""))), 256)
    return table(spark, d, "mlr_formula").select("formula_id", F.concat(F.lit("FORMULA-"), F.upper(F.substring(h, 1, 12))).alias("stable_id"))


@query(r"""SELECT passage_id, replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(13), '') = text AS plain,
length(trim(regexp_replace(regexp_replace(replace(replace(replace(text, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS n FROM passage WHERE text IS NOT NULL""")
def pdf_text_clean(spark, d):
    x = F.col("text")
    plain = x
    for glyph, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("\r", "")):
        plain = F.replace(plain, F.lit(glyph), F.lit(letters))
    return table(spark, d, "passage").filter("text is not null").select("passage_id", (plain == x).alias("plain"), F.length(keys.clean_pdf_text(x)).cast("long").alias("n"))


# ---------------------------------------------------------------- labels


@query("""SELECT split, coalesce(negative_type, 'missing') AS negative_type, count(*) AS n, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
count(DISTINCT CASE WHEN label = 1 THEN source_id::BIGINT * 10000000000 + target_id END) AS n_pos_edges,
count(*) FILTER (source IS NULL OR trim(source) = '' OR target IS NULL OR trim(target) = '' OR label IS NULL OR label NOT IN (0, 1) OR source_id = target_id) AS n_invalid
FROM (SELECT * FROM train_labels_initial UNION ALL SELECT * FROM test_neg) GROUP BY 1, 2""")
def label_stats(spark, d):
    return labels.label_stats(table(spark, d, "train_labels_initial").unionByName(table(spark, d, "test_neg")))


@query("SELECT DISTINCT source_id AS src, target_id AS dst FROM train_labels_initial WHERE label = 1 AND source_id <> target_id")
def gold_edges(spark, d):
    return labels.edges(table(spark, d, "train_labels_initial"))


@query("""WITH g AS (SELECT source_id AS src, target_id AS dst, label_id FROM train_labels_initial WHERE label = 1 AND source_id <> target_id)
SELECT dst AS src, src AS dst, min(label_id) AS ord FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.src = a.dst AND b.dst = a.src) GROUP BY 1, 2 ORDER BY ord LIMIT 500""")
def reverse_negatives(spark, d):
    return labels.reverse_negatives(table(spark, d, "train_labels_initial"), 500)


@query("""WITH g AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM train_labels_initial WHERE label = 1 AND source_id <> target_id),
p AS (SELECT *, ('0x' || substr(md5('42|' || src || '|' || dst), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS place FROM g)
SELECT src, dst, CASE WHEN place < 0.6::DOUBLE THEN 'train' WHEN place < 0.7::DOUBLE THEN 'val' ELSE 'test' END AS split FROM p""")
def hash_split(spark, d):
    return labels.hash_split(labels.edges(table(spark, d, "train_labels_initial")))


@query("""WITH g AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM train_labels_initial WHERE label = 1 AND source_id <> target_id),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || src || '|' || dst), src, dst) AS rn, count(*) OVER () AS n FROM g)
SELECT CASE WHEN rn <= round_even(n * 0.6, 0) THEN 'train' WHEN rn <= round_even(n * 0.6, 0) + round_even(round_even(n * 0.6, 0) * 0.1, 0) THEN 'val' ELSE 'test' END AS split, count(*) AS n_pairs, min(src) AS lo FROM r GROUP BY 1""")
def exact_split(spark, d):
    return labels.exact_split(labels.edges(table(spark, d, "train_labels_initial"))).groupBy("split").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("src").alias("lo"))


@query("""WITH t AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM train_labels_initial), e AS (SELECT DISTINCT split, source_id AS src, target_id AS dst FROM test_neg)
SELECT split, count(*) AS n_pairs, count(a.src) AS n_leaked, count(b.src) AS n_reversed FROM e LEFT JOIN t a ON a.src = e.src AND a.dst = e.dst LEFT JOIN t b ON b.src = e.dst AND b.dst = e.src GROUP BY 1""")
def leakage_check(spark, d):
    return labels.leakage(table(spark, d, "train_labels_initial"), table(spark, d, "test_neg"))


@query("""WITH t AS (SELECT source_id AS src, target_id AS dst, split || ':' || coalesce(negative_type, 'missing') AS pool FROM (SELECT * FROM train_labels_initial UNION ALL SELECT * FROM test_neg) WHERE label = 0) SELECT src, dst, count(DISTINCT pool) AS n_pools FROM t GROUP BY 1, 2 HAVING count(DISTINCT pool) > 1""")
def overlapping_pools(spark, d):
    """Negative pairs that stand in several pools of either table, by split and kind."""
    t = table(spark, d, "train_labels_initial").unionByName(table(spark, d, "test_neg"))
    return labels.overlapping_pools(t.withColumn("negative_type", F.concat_ws(":", "split", F.coalesce("negative_type", F.lit("missing")))))


UNIVERSE = "SELECT row_number() OVER (ORDER BY a.concept_id, b.concept_id) - 1 AS pair_id, a.concept_id AS left_id, b.concept_id AS right_id FROM mlr_concepts a JOIN mlr_concepts b ON a.concept_id < b.concept_id"
#: Score of an ordered pair of indexes, a stand-in for a model that hasn't been trained.
MOCK = "((src * 997 + dst * 37) % 1000) / 1000.0::DOUBLE"


def mock_score(i, j):
    return ((i * 997 + j * 37) % 1000) / F.lit(1000.0)


@query(UNIVERSE)
def pair_universe(spark, d):
    return labels.pair_universe(table(spark, d, "mlr_concepts"), "concept_id")


@query("SELECT a.concept_id AS left_id, count(*) AS n, string_agg(b.concept_id::VARCHAR, ',' ORDER BY b.concept_id) AS rights FROM mlr_concepts a JOIN mlr_concepts b ON a.concept_id < b.concept_id GROUP BY 1")
def anchor_groups(spark, d):
    pairs = labels.pair_universe(table(spark, d, "mlr_concepts"), "concept_id")
    return pairs.groupBy("left_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("right_id")).cast("array<string>"), ",").alias("rights"))


CANDIDATES = f"""cand AS (SELECT src, dst, {MOCK} AS score FROM (SELECT a.concept_id AS src, b.concept_id AS dst FROM mlr_concepts a JOIN mlr_concepts b ON a.concept_id <> b.concept_id) p WHERE NOT EXISTS (SELECT 1 FROM conf x WHERE x.src = p.src AND x.dst = p.dst))"""
EXCLUDED = "conf AS (SELECT a.concept_id AS src, b.concept_id AS dst FROM mlr_concepts a JOIN mlr_concepts b ON a.concept_id <> b.concept_id AND string_split(a.canonical, ' ')[-1] = string_split(b.canonical, ' ')[-1] AND string_split(a.canonical, ' ')[1] = string_split(b.canonical, ' ')[1])"


def _candidates(spark, d):
    """All ordered pairs of concepts but those that share first and last word."""
    c = table(spark, d, "mlr_concepts").select("concept_id", F.substring_index("canonical", " ", 1).alias("f"), F.substring_index("canonical", " ", -1).alias("l"))
    same = c.select(F.col("concept_id").alias("src"), "f", "l").join(c.select(F.col("concept_id").alias("dst"), "f", "l"), ["f", "l"]).filter("src <> dst")
    return labels.candidate_pairs(c, "concept_id", same)


@query(f"WITH {EXCLUDED}, {CANDIDATES} SELECT src, dst, score FROM cand")
def candidate_scores(spark, d):
    return _candidates(spark, d).select("src", "dst", mock_score(F.col("src"), F.col("dst")).alias("score"))


TRAIN = "(SELECT count(*) FROM train_labels_initial WHERE label = 1)"
JUDGED = "sc AS (SELECT src, dst, score AS model, CASE WHEN (src + dst) % 7 = 0 THEN NULL ELSE ((src * 31 + dst * 17) % 100) / 100.0::DOUBLE END AS judge FROM cand)"


def _judged(spark, d):
    i, j = F.col("src"), F.col("dst")
    return _candidates(spark, d).select("src", "dst", mock_score(i, j).alias("model"), F.when((i + j) % 7 != 0, ((i * 31 + j * 17) % 100) / F.lit(100.0)).alias("judge"))


@query(f"""WITH {EXCLUDED}, {CANDIDATES}, {JUDGED}, bud AS (SELECT greatest(1, greatest(2, floor(0.1::DOUBLE * {TRAIN})::BIGINT) // 2) AS k), pc AS (SELECT *, row_number() OVER (ORDER BY model DESC, src, dst) AS r FROM sc WHERE model >= 0.8::DOUBLE), nc AS (SELECT *, row_number() OVER (ORDER BY model, src, dst) AS r FROM sc WHERE model <= 0.2::DOUBLE),
p AS (SELECT src, dst, 0.5::DOUBLE * judge + 0.5::DOUBLE * model AS combined FROM pc WHERE r <= 2 * (SELECT k FROM bud) AND judge IS NOT NULL), n AS (SELECT src, dst, 0.5::DOUBLE * judge + 0.5::DOUBLE * model AS combined FROM nc WHERE r <= 2 * (SELECT k FROM bud) AND judge IS NOT NULL)
SELECT src, dst, 1 AS label, round(combined, 9) AS combined FROM (SELECT *, row_number() OVER (ORDER BY combined DESC, src, dst) AS r FROM p) WHERE r <= (SELECT k FROM bud) UNION ALL SELECT src, dst, 0, round(combined, 9) FROM (SELECT *, row_number() OVER (ORDER BY combined, src, dst) AS r FROM n) WHERE r <= (SELECT k FROM bud)""")
def pseudo_topk(spark, d):
    n = table(spark, d, "train_labels_initial").filter("label = 1").count()
    return pseudo.select_pseudo(_judged(spark, d), n).withColumn("combined", F.round("combined", 9))


@query(f"""WITH {EXCLUDED}, {CANDIDATES}, s AS (SELECT src, dst, score AS content, ((src * 53 + dst * 29) % 100) / 100.0::DOUBLE AS graph, ((src * 31 + dst * 17) % 100) / 100.0::DOUBLE AS judge FROM cand),
m AS (SELECT *, abs(content - graph) AS gap FROM s WHERE (graph >= 0.65::DOUBLE AND content <= 0.45::DOUBLE) OR (content >= 0.60::DOUBLE AND graph <= 0.35::DOUBLE)), t AS (SELECT *, row_number() OVER (ORDER BY gap DESC, src, dst) AS r FROM m), k AS (SELECT *, row_number() OVER (ORDER BY gap DESC, src, dst) AS q FROM t WHERE r <= 400 AND judge <= 0.30::DOUBLE)
SELECT src, dst, 0 AS label, greatest(content, graph) AS model, greatest(least(content, graph, judge, 0.30::DOUBLE), 0.15::DOUBLE) AS combined, round(gap, 9) AS disagreement FROM k WHERE q <= 200""")
def mined_negatives(spark, d):
    i, j = F.col("src"), F.col("dst")
    s = _candidates(spark, d).select("src", "dst", mock_score(i, j).alias("content"), ((i * 53 + j * 29) % 100 / F.lit(100.0)).alias("graph"), ((i * 31 + j * 17) % 100 / F.lit(100.0)).alias("judge"))
    return pseudo.mined_negatives(s, 200).withColumn("disagreement", F.round("disagreement", 9))


@query()
def alternate_teaching(spark, d):
    i, j = F.col("src"), F.col("dst")
    s = _candidates(spark, d).select("src", "dst", mock_score(i, j).alias("content"), ((i * 53 + j * 29) % 100 / F.lit(100.0)).alias("graph"), ((i * 31 + j * 17) % 100 / F.lit(100.0)).alias("judge"))
    gold = labels.edges(table(spark, d, "train_labels_initial"))
    return pseudo.alternate(s, gold, table(spark, d, "train_labels_initial").filter("label = 1").count())[1]


# ---------------------------------------------------------------- splits and pools of negatives

LABEL_NODES = f"nd AS (SELECT node, min(name) AS name, row_number() OVER (ORDER BY node) - 1 AS n FROM (SELECT source_id AS node, {PLAIN.format('source')} AS name FROM train_labels_initial UNION ALL SELECT target_id, {PLAIN.format('target')} FROM train_labels_initial) GROUP BY 1)"
GOLD_SPLIT = """gd AS (SELECT source_id AS src, target_id AS dst, min(label_id) AS ord FROM train_labels_initial WHERE label = 1 AND source_id <> target_id GROUP BY 1, 2), pl AS (SELECT *, ('0x' || substr(md5('42|' || src || '|' || dst), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS place FROM gd),
sp AS (SELECT src, dst, CASE WHEN place < 0.6::DOUBLE THEN 'train' WHEN place < 0.7::DOUBLE THEN 'val' ELSE 'test' END AS split, ord FROM pl)"""
SIMILAR = """ws AS (SELECT node, list_distinct(string_split(name, ' ')) AS w FROM nd), sm AS (SELECT a.node AS src, b.node AS dst, round(len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)), 9) AS similarity FROM ws a JOIN ws b ON a.node <> b.node AND len(list_intersect(a.w, b.w)) > 0)"""
POOLS = """rv AS (SELECT dst AS src, src AS dst, min(ord) AS ord FROM sp WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM gd WHERE gd.src = sp.dst AND gd.dst = sp.src) GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 20), tn AS (SELECT src AS node FROM sp WHERE split = 'train' UNION SELECT dst FROM sp WHERE split = 'train'),
hd AS (SELECT src, dst, similarity FROM sm WHERE src IN (SELECT node FROM tn) AND dst IN (SELECT node FROM tn) AND NOT EXISTS (SELECT 1 FROM gd WHERE gd.src = sm.src AND gd.dst = sm.dst) AND NOT EXISTS (SELECT 1 FROM rv WHERE rv.src = sm.src AND rv.dst = sm.dst) ORDER BY 3 DESC, 1, 2 LIMIT 20),
t1 AS (SELECT src, dst FROM gd UNION SELECT src, dst FROM rv UNION SELECT src, dst FROM hd), fn AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM train_labels_initial WHERE label = 0 AND source_id <> target_id),
fr AS (SELECT src, dst FROM fn WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.src = fn.src AND t1.dst = fn.dst) ORDER BY md5('345|' || src || '|' || dst), src, dst LIMIT (SELECT round_even(1.5 * count(*), 0)::BIGINT FROM sp WHERE split = 'train')), t2 AS (SELECT * FROM t1 UNION SELECT * FROM fr)"""
DRAW = """{name} AS (SELECT src, dst FROM (SELECT a.node AS src, b.node AS dst, k FROM (SELECT i, j, min(k) AS k FROM (SELECT k, ('0x' || substr(md5('{seed}|' || k), 1, 8))::BIGINT % (SELECT count(*) FROM nd) AS i, ('0x' || substr(md5('{seed}|' || k), 9, 8))::BIGINT % (SELECT count(*) FROM nd) AS j FROM range((SELECT 4 * count(*) FROM sp WHERE split = '{split}')) r(k)) WHERE i <> j GROUP BY 1, 2) JOIN nd a ON a.n = i JOIN nd b ON b.n = j)
WHERE NOT EXISTS (SELECT 1 FROM {taken} t WHERE t.src = a0 AND t.dst = b0) ORDER BY k LIMIT (SELECT count(*) FROM sp WHERE split = '{split}'))"""
DRAW = DRAW.replace("t.src = a0 AND t.dst = b0", "t.src = q.src AND t.dst = q.dst").replace("JOIN nd b ON b.n = j)\nWHERE", "JOIN nd b ON b.n = j) q\nWHERE")
PARTS = f"{LABEL_NODES}, {GOLD_SPLIT}, {SIMILAR}, {POOLS}, {DRAW.format(name='vr', seed=143, split='val', taken='t2')}, t3 AS (SELECT * FROM t2 UNION SELECT * FROM vr), {DRAW.format(name='tr', seed=244, split='test', taken='t3')}"


def _named_nodes(spark, d):
    t = table(spark, d, "train_labels_initial")
    both = t.select(F.col("source_id").alias("node"), keys.plain_key(F.col("source")).alias("name")).union(t.select("target_id", keys.plain_key(F.col("target"))))
    return both.groupBy("node").agg(F.min("name").alias("name"))


def _label_nodes(spark, d):
    return cut(_named_nodes(spark, d))


def _pools(spark, d):
    t = table(spark, d, "train_labels_initial")
    gold = cut(t.filter("label = 1 and source_id <> target_id").groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.min("label_id").alias("ord")))
    splits = labels.hash_split(gold, kept=("ord",))
    nodes = numbered(t.select(F.col("source_id").alias("node")).union(t.select("target_id")).distinct(), "node")
    return splits, gold, labels.negative_pools(splits, gold, labels.edges(t, 0), nodes, _named_nodes(spark, d), 20, 20)


@query(f"WITH {PARTS} SELECT src, dst, 'reverse' AS pool FROM rv UNION ALL SELECT src, dst, 'hard' FROM hd UNION ALL SELECT src, dst, 'label_file_random' FROM fr UNION ALL SELECT src, dst, 'val_random' FROM vr UNION ALL SELECT src, dst, 'test_random' FROM tr")
def negative_pools(spark, d):
    return _pools(spark, d)[2]


@query("SELECT unnest(['positives in several splits', 'gold in no split', 'positives outside gold', 'negatives in gold', 'negatives in several pools']) AS rule, 0::BIGINT AS n")
def split_violations(spark, d):
    splits, gold, pools = _pools(spark, d)
    return labels.split_violations(splits, gold, pools)


@query(f"""WITH {LABEL_NODES}, {GOLD_SPLIT}, {SIMILAR}, tn AS (SELECT src AS node FROM gd UNION SELECT dst FROM gd)
SELECT src, dst, similarity FROM sm WHERE src IN (SELECT node FROM tn) AND dst IN (SELECT node FROM tn) AND NOT EXISTS (SELECT 1 FROM gd WHERE gd.src = sm.src AND gd.dst = sm.dst) ORDER BY similarity DESC, src, dst LIMIT 200""")
def hard_negatives(spark, d):
    gold = labels.edges(table(spark, d, "train_labels_initial"))
    return labels.hard_negatives(gold, gold, gold.limit(0), _label_nodes(spark, d), 200)


@query(f"""WITH {LABEL_NODES}, {GOLD_SPLIT}, {SIMILAR} SELECT g.src, g.dst, coalesce(similarity, 0) AS similarity FROM gd g LEFT JOIN sm ON sm.src = g.src AND sm.dst = g.dst""")
def attached_similarity(spark, d):
    return labels.attach_similarity(labels.edges(table(spark, d, "train_labels_initial")), _label_nodes(spark, d))


@query("""WITH t AS (SELECT * FROM train_labels_initial UNION ALL SELECT * FROM test_neg) SELECT 'missing id' AS rule, count(*) FILTER (source_id IS NULL OR target_id IS NULL OR source_index IS NULL OR target_index IS NULL) AS n FROM t UNION ALL SELECT 'negative id', count(*) FILTER (least(source_id, target_id, source_index, target_index) < 0) FROM t
UNION ALL SELECT 'id out of range', count(*) FILTER (greatest(source_id, target_id, source_index, target_index) >= 1000000) FROM t UNION ALL SELECT 'id and index apart', count(*) FILTER (source_id <> source_index OR target_id <> target_index) FROM t UNION ALL SELECT 'self loop', count(*) FILTER (source_id = target_id) FROM t UNION ALL SELECT 'bad label', count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) FROM t""")
def frame_violations(spark, d):
    return labels.frame_violations(table(spark, d, "train_labels_initial").unionByName(table(spark, d, "test_neg")), 1_000_000)


@query("SELECT count(*) AS n, min(concept_id) AS lo, max(concept_id) AS hi, count(DISTINCT concept_id) AS distinct, count(*) = count(DISTINCT concept_id) AND min(concept_id) = 0 AND max(concept_id) = count(*) - 1 AS ok FROM mlr_concepts")
def contiguous_concepts(spark, d):
    return labels.contiguous(table(spark, d, "mlr_concepts"))


@query(f"WITH {LABEL_NODES}, {SIMILAR} SELECT count(*) AS n, 0::BIGINT AS n_bad, count(*) = (SELECT count(*) * count(*) FROM nd) AS square FROM sm")
def similarity_matrix_check(spark, d):
    nodes = _label_nodes(spark, d)
    return labels.finite_square(labels.similarity_levels(nodes), nodes.count())


def _append_input(spark, d):
    train = table(spark, d, "train_labels_initial").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "label")
    new = table(spark, d, "test_neg").select(F.col("label_id").alias("ord"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "label")
    return train, new


@query("""WITH o AS (SELECT DISTINCT least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi, CASE WHEN label = 0 THEN '0' ELSE source_id || '>' || target_id END AS m FROM train_labels_initial),
n AS (SELECT label_id AS ord, source_id AS src, target_id AS dst, label, least(source_id, target_id) AS lo, greatest(source_id, target_id) AS hi, CASE WHEN label = 0 THEN '0' ELSE source_id || '>' || target_id END AS m FROM test_neg),
f AS (SELECT *, first_value(m) OVER (PARTITION BY lo, hi ORDER BY ord) AS fm, min(ord) OVER (PARTITION BY lo, hi) AS fo, EXISTS (SELECT 1 FROM o WHERE o.lo = n.lo AND o.hi = n.hi) AS has_old, EXISTS (SELECT 1 FROM o WHERE o.lo = n.lo AND o.hi = n.hi AND o.m = n.m) AS same FROM n)
SELECT ord, src, dst, label, CASE WHEN NOT has_old AND ord = fo THEN 'accepted' WHEN (has_old AND same) OR (NOT has_old AND m = fm) THEN 'duplicate' ELSE 'conflict' END AS status FROM f""")
def append_public_rows(spark, d):
    return labels.append_public_rows(*_append_input(spark, d))


# ---------------------------------------------------------------- metrics (label against similarity)

SCORED = "s AS (SELECT label AS y, similarity AS score FROM train_labels_initial WHERE similarity IS NOT NULL)"


def _scored(spark, d):
    return table(spark, d, "train_labels_initial").filter("similarity is not null").select(F.col("label").alias("y"), F.col("similarity").alias("score"))


def _confusion_sql(where: str) -> str:
    return f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (score >= {where} AND y = 1) AS tp, count(*) FILTER (score >= {where} AND y = 0) AS fp, count(*) FILTER (score < {where} AND y = 1) AS fn, count(*) FILTER (score < {where} AND y = 0) AS tn FROM s)
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy FROM c"""


@query(_confusion_sql("0.3::DOUBLE"))
def confusion_metrics(spark, d):
    return metrics.confusion(_scored(spark, d), 0.3)


@query(f"""WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM s), a AS (SELECT sum(rk) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM r)
SELECT round(CASE WHEN p = 0 OR n = 0 THEN 0.5 ELSE (sr - p * (p + 1) / 2.0::DOUBLE) / (p * n) END, 6) AS auc FROM a""")
def auc_tie_aware(spark, d):
    return metrics.auc(_scored(spark, d))


@query(f"WITH {SCORED} SELECT round(avg((score - y) * (score - y)), 6) AS brier FROM s")
def brier(spark, d):
    return metrics.brier(_scored(spark, d))


@query(f"""WITH {SCORED}, b AS (SELECT y, score, (score >= 0.1::DOUBLE)::INT + (score >= 0.2::DOUBLE)::INT + (score >= 0.30000000000000004::DOUBLE)::INT + (score >= 0.4::DOUBLE)::INT + (score >= 0.5::DOUBLE)::INT + (score >= 0.6000000000000001::DOUBLE)::INT
+ (score >= 0.7000000000000001::DOUBLE)::INT + (score >= 0.8::DOUBLE)::INT + (score >= 0.9::DOUBLE)::INT AS bin FROM s), c AS (SELECT bin, count(*) AS n, avg(score) AS ms, avg(y) AS rate FROM b GROUP BY 1)
SELECT round(sum(n * abs(ms - rate)) / sum(n), 6) AS ece FROM c""")
def ece(spark, d):
    return metrics.ece(_scored(spark, d))


@query(f"""WITH {SCORED} SELECT min(score) AS min, round(quantile_cont(score, 0.01), 9) AS p01, round(quantile_cont(score, 0.05), 9) AS p05, round(quantile_cont(score, 0.25), 9) AS p25, round(quantile_cont(score, 0.5), 9) AS p50,
round(quantile_cont(score, 0.75), 9) AS p75, round(quantile_cont(score, 0.95), 9) AS p95, round(quantile_cont(score, 0.99), 9) AS p99, max(score) AS max FROM s""")
def score_quantiles(spark, d):
    return metrics.quantiles(_scored(spark, d))


FUSION = """s AS (SELECT label AS y, similarity AS c, ((source_id::BIGINT * 997 + target_id::BIGINT * 37) % 1000) / 1000.0::DOUBLE AS g FROM train_labels_initial WHERE similarity IS NOT NULL),
k AS (SELECT a, t, count(*) FILTER (p AND y = 1) AS tp, count(*) FILTER (p AND y = 0) AS fp, count(*) FILTER (NOT p AND y = 1) AS fn, count(*) AS n FROM
  (SELECT y, a, t, round((a * c + (20 - a) * g) / 20, 9) >= t / 20.0::DOUBLE AS p FROM s, range(21) x(a), range(4, 17) z(t)) GROUP BY 1, 2),
m AS (SELECT round(a / 20.0::DOUBLE, 2) AS alpha, round(t / 20.0::DOUBLE, 2) AS threshold, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1, round((n - fp - fn)::DOUBLE / n, 6) AS accuracy FROM k),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY f1 DESC, accuracy DESC, threshold) AS r FROM m) WHERE r = 1), fs AS (SELECT a, y, round((a * c + (20 - a) * g) / 20, 9) AS score FROM s, range(21) x(a)),
rk AS (SELECT a, y, rank() OVER (PARTITION BY a ORDER BY score) + (count(*) OVER (PARTITION BY a, score) - 1) / 2.0::DOUBLE AS rk FROM fs), ar AS (SELECT a, sum(rk) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM rk GROUP BY 1),
au AS (SELECT round(a / 20.0::DOUBLE, 2) AS alpha, round(CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE (sr - p * (p + 1) / 2.0::DOUBLE) / (p * q) END, 6) AS auc FROM ar),
fg AS (SELECT alpha, threshold, f1, auc, accuracy, row_number() OVER (ORDER BY f1 DESC, auc DESC, accuracy DESC, alpha)::INT AS rank FROM best JOIN au USING (alpha))"""


def _fusion(spark, d):
    g = ((F.col("source_id").cast("long") * 997 + F.col("target_id").cast("long") * 37) % 1000) / F.lit(1000.0)
    return table(spark, d, "train_labels_initial").filter("similarity is not null").select(F.col("label").alias("y"), F.col("similarity").alias("c"), g.alias("g"))


@query(f"WITH {FUSION} SELECT * FROM fg")
def fusion_grid(spark, d):
    return metrics.fusion_grid(_fusion(spark, d))


@query(f"WITH {FUSION} SELECT CASE alpha WHEN 1 THEN 'content' ELSE 'graph' END AS model, threshold, f1, auc, accuracy FROM fg WHERE alpha IN (0, 1)")
def model_validation(spark, d):
    return metrics.validation(_fusion(spark, d))


@query("""SELECT label_id, round(ln(greatest(least(similarity, 1 - 0.000001::DOUBLE), 0.000001::DOUBLE) / (1 - greatest(least(similarity, 1 - 0.000001::DOUBLE), 0.000001::DOUBLE))), 6) AS logit,
round(1 / (1 + exp(-(ln(greatest(least(similarity, 1 - 0.000001::DOUBLE), 0.000001::DOUBLE) / (1 - greatest(least(similarity, 1 - 0.000001::DOUBLE), 0.000001::DOUBLE))) / 1.5::DOUBLE + 0.1::DOUBLE))), 6) AS calibrated,
round(least(greatest(similarity, 0.1::DOUBLE), 0.9::DOUBLE), 6) AS soft, round(least(greatest(0.2::DOUBLE * 2 * abs(least(greatest(similarity, 0.1::DOUBLE), 0.9::DOUBLE) - 0.5::DOUBLE), 0.05::DOUBLE), 0.5::DOUBLE), 6) AS weight FROM train_labels_initial WHERE similarity IS NOT NULL""")
def calibrated_scores(spark, d):
    s = F.col("similarity")
    return table(spark, d, "train_labels_initial").filter("similarity is not null").select(
        "label_id", F.round(keys.logit(s), 6).alias("logit"), F.round(keys.calibrated(keys.logit(s), 1.5, 0.1), 6).alias("calibrated"), F.round(pseudo.soft_target(s), 6).alias("soft"), F.round(pseudo.soft_weight(s, 1), 6).alias("weight")
    )


# ---------------------------------------------------------------- pseudo-labels


@query("""WITH r AS (SELECT source_id AS src, target_id AS dst, label, similarity AS combined, label_id AS ord, CASE WHEN label = 1 THEN similarity ELSE 1 - similarity END AS conf FROM train_labels_initial WHERE similarity IS NOT NULL)
SELECT src, dst, label, combined, ord FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, label ORDER BY conf DESC, ord) AS rn FROM r) WHERE rn = 1""")
def label_confidence_dedupe(spark, d):
    rows = table(spark, d, "train_labels_initial").filter("similarity is not null").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "label", F.col("similarity").alias("combined"), F.col("label_id").alias("ord"))
    return pseudo.best_rows(rows)


@query("""WITH e AS (SELECT user_id AS src, event_id % 50 AS dst, (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) AS label, (event_id * 37 % 101) / 100.0::DOUBLE AS combined, event_id FROM events),
gold AS (SELECT DISTINCT src, dst FROM e WHERE event_id % 11 = 0),
held AS (SELECT src, dst, label, max(CASE WHEN label = 1 THEN combined ELSE 1 - combined END) AS conf FROM e WHERE event_id % 2 = 0 GROUP BY 1, 2, 3),
fresh AS (SELECT src, dst, label, max(CASE WHEN label = 1 THEN combined ELSE 1 - combined END) AS conf FROM e WHERE event_id % 2 = 1 AND NOT (label = 0 AND EXISTS (SELECT 1 FROM gold g WHERE g.src = e.src AND g.dst = e.dst)) GROUP BY 1, 2, 3),
won AS (SELECT f.*, 'new' AS origin, 0 AS m FROM fresh f LEFT JOIN held h ON h.src = f.src AND h.dst = f.dst AND h.label = 1 - f.label WHERE h.conf IS NULL OR f.conf > h.conf),
kept AS (SELECT h.*, 'memory' AS origin, 1 AS m FROM held h LEFT JOIN fresh f ON h.src = f.src AND h.dst = f.dst AND h.label = 1 - f.label WHERE f.conf IS NULL OR h.conf >= f.conf)
SELECT src, dst, label, round(conf, 6) AS conf, origin FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, label ORDER BY conf DESC, m DESC) AS rn FROM (SELECT * FROM won UNION ALL SELECT * FROM kept)) WHERE rn = 1""")
def conflict_resolution(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 50).alias("dst"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("label"), (F.col("event_id") * 37 % 101 / F.lit(100.0)).alias("combined"), "event_id")
    return pseudo.resolve_conflicts(e.filter("event_id % 11 = 0").select("src", "dst").distinct(), e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"))


SIGHTED = """s AS (SELECT user_id AS pair, ts::DATE AS round, event_type AS teacher, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS label, (event_id * 37 % 101) / 100.0::DOUBLE AS combined, event_id AS ord FROM events WHERE value IS NOT NULL),
t AS (SELECT *, coalesce((lag(label) OVER (PARTITION BY pair ORDER BY round, ord) <> label)::INT, 0) AS turn FROM s), u AS (SELECT *, sum(turn) OVER (PARTITION BY pair ORDER BY round, ord) AS stretch FROM t),
v AS (SELECT *, (coalesce(lag(round) OVER (PARTITION BY pair, stretch ORDER BY round, ord) <> round, true) OR row_number() OVER (PARTITION BY pair, stretch, teacher ORDER BY round, ord) = 1)::INT AS hit FROM u),
h AS (SELECT *, sum(hit) OVER (PARTITION BY pair, stretch ORDER BY round, ord) AS hits, CASE WHEN label = 1 THEN combined ELSE 1 - combined END AS conf FROM v)"""


def _sightings(spark, d):
    return table(spark, d, "events").filter("value is not null").select(
        F.col("user_id").alias("pair"), F.to_date("ts").alias("round"), F.col("event_type").alias("teacher"), F.when(F.col("value") >= 20, 1).otherwise(0).alias("label"), ((F.col("event_id") * 37 % 101) / F.lit(100.0)).alias("combined"), F.col("event_id").alias("ord")
    )


@query(f"""WITH {SIGHTED}, p AS (SELECT pair, stretch, min(label) AS label, max(hits) AS hits, max(round) AS last_round FROM h GROUP BY 1, 2)
SELECT pair, arg_max(label, stretch) AS label, arg_max(hits, stretch)::BIGINT AS hits, max(stretch)::BIGINT AS conflicts, arg_max(last_round, stretch) AS last_round FROM p GROUP BY 1""")
def stable_tracker(spark, d):
    return pseudo.stable_hits(_sightings(spark, d))


@query(f"""WITH {SIGHTED}, e AS (SELECT * FROM h WHERE hit = 1 AND hits = 3) SELECT e.pair, e.round, e.label, max(x.conf) AS conf, arg_max(x.teacher, x.conf * 1e9 + x.ord / 1e9) AS teacher, arg_max(x.ord, x.conf * 1e9 + x.ord / 1e9) AS row
FROM e JOIN h x ON x.pair = e.pair AND x.stretch = e.stretch AND (x.round < e.round OR (x.round = e.round AND x.ord <= e.ord)) GROUP BY e.pair, e.round, e.label, e.ord""")
def newly_stable(spark, d):
    return pseudo.newly_stable(_sightings(spark, d), 3)


PSEUDO = "ps AS (SELECT source_id AS src, target_id AS dst, label, similarity AS combined, CASE label WHEN 1 THEN 'positive' ELSE 'negative' END AS type, CASE WHEN label_id % 5 = 0 THEN 'n/a' ELSE (label_id % 100)::VARCHAR END AS judge FROM train_labels_initial WHERE similarity IS NOT NULL)"


def _pseudo(spark, d):
    t = table(spark, d, "train_labels_initial").filter("similarity is not null")
    return t.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "label", F.col("similarity").alias("combined"), F.when(F.col("label") == 1, "positive").otherwise("negative").alias("type"), F.when(F.col("label_id") % 5 == 0, "n/a").otherwise((F.col("label_id") % 100).cast("string")).alias("judge"))


@query(f"""WITH {PSEUDO}, f AS (SELECT source_id, target_id, label, split, negative_type, similarity, NULL::DOUBLE AS combined, NULL::DOUBLE AS label_confidence FROM train_labels_initial UNION ALL SELECT source_id, target_id, label, split, negative_type, similarity, NULL, NULL FROM test_neg
UNION ALL SELECT src, dst, label, 'train', 'pseudo_' || type, NULL, combined, CASE WHEN label = 1 THEN combined ELSE 1 - combined END FROM ps)
SELECT split, coalesce(negative_type, 'missing') AS negative_type, count(*) AS n, count(similarity) AS n_similarity, round(avg(label_confidence), 6) AS mean_confidence FROM f GROUP BY 1, 2""")
def training_frame(spark, d):
    cols = ["source_id", "target_id", "label", "split", "negative_type", "similarity"]
    f = pseudo.training_frame(table(spark, d, "train_labels_initial").select(*cols), table(spark, d, "test_neg").select(*cols), _pseudo(spark, d))
    return f.groupBy("split", F.coalesce("negative_type", F.lit("missing")).alias("negative_type")).agg(F.count(F.lit(1)).alias("n"), F.count("similarity").alias("n_similarity"), F.round(F.avg("label_confidence"), 6).alias("mean_confidence"))


@query(f"WITH {PSEUDO} SELECT count(*) AS total, round(avg(CASE WHEN label = 1 THEN combined ELSE 1 - combined END), 6) AS mean_confidence, round(avg(try_cast(judge AS DOUBLE)), 6) AS mean_judge FROM ps")
def pseudo_quality(spark, d):
    return pseudo.quality(_pseudo(spark, d).withColumn("label_confidence", pseudo.label_confidence(F.col("label"), F.col("combined"))))


@query("""WITH r AS (SELECT chapter AS round, count(*) AS n, round(avg(length(latex)), 3) AS auc, round(avg(pdf_page), 3) AS f1, count(concept)::DOUBLE AS accuracy FROM mlr_formula WHERE chapter IS NOT NULL GROUP BY 1) SELECT * FROM r ORDER BY f1 DESC, auc DESC, accuracy DESC, round LIMIT 1""")
def best_round(spark, d):
    r = table(spark, d, "mlr_formula").filter("chapter is not null").groupBy(F.col("chapter").alias("round")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("latex")), 3).alias("auc"), F.round(F.avg("pdf_page"), 3).alias("f1"), F.count("concept").cast("double").alias("accuracy"))
    return pseudo.best_round(r, ("f1", "auc", "accuracy"))


@query("""WITH r AS (SELECT ln(greatest(least(similarity, 1 - 0.000001::DOUBLE), 0.000001::DOUBLE) / (1 - greatest(least(similarity, 1 - 0.000001::DOUBLE), 0.000001::DOUBLE))) * 3 AS l, -ln(greatest(least(similarity, 1 - 0.000001::DOUBLE), 0.000001::DOUBLE) / (1 - greatest(least(similarity, 1 - 0.000001::DOUBLE), 0.000001::DOUBLE))) AS b, CASE WHEN label = 1 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS t FROM train_labels_initial WHERE similarity IS NOT NULL),
q AS (SELECT *, abs(t - 0.5) * 2 AS sure, 1 / (1 + exp(-ln(t / (1 - t)) / 2)) AS soft FROM r)
SELECT round(avg((greatest(l, 0) - l * t + ln(1 + exp(-abs(l)))) * 0.2), 6) AS bce, round(avg(greatest(0.25 - 1 / (1 + exp(-l)) + 1 / (1 + exp(-b)), 0)), 6) AS reverse, round(avg(pow(greatest(abs(l) - 4, 0), 2)), 6) AS capped,
round(avg(CASE WHEN sure >= 0.5 THEN (greatest(l / 2, 0) - l / 2 * soft + ln(1 + exp(-abs(l / 2)))) * sure END), 6) AS kd, count(*) FILTER (sure >= 0.5) AS kd_rows FROM q""")
def training_losses(spark, d):
    l = keys.logit(F.col("similarity"))  # noqa: E741
    t = table(spark, d, "train_labels_initial").filter("similarity is not null")
    return pseudo.losses(t.select((l * 3).alias("logit"), (-l).alias("reverse_logit"), F.when(F.col("label") == 1, 0.9).otherwise(0.3).alias("target"), F.lit(0.2).alias("weight")))


@query("""WITH b AS (SELECT avg(label) - 0.5 AS bias FROM train_labels_initial) SELECT label_id, round(1 / (1 + exp(-4 * (similarity - 0.5 + bias))), 6) AS score FROM train_labels_initial, b WHERE similarity IS NOT NULL""")
def biased_scores(spark, d):
    t = table(spark, d, "train_labels_initial")
    bias = t.agg((F.avg("label") - 0.5).alias("bias"))
    return t.filter("similarity is not null").join(F.broadcast(bias)).select("label_id", F.round(1 / (1 + F.exp(-4 * (F.col("similarity") - 0.5 + F.col("bias")))), 6).alias("score"))  # one row


# ---------------------------------------------------------------- similarity graph

KNN = """k AS (SELECT src, dst, weight FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS weight,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= {k})"""


@query(f"WITH {KNN.format(k=10)} SELECT src, dst, round(weight, 6) AS weight FROM k")
def knn_edges(spark, d):
    return simgraph.topk_cosine(table(spark, d, "embeddings")).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""WITH {KNN.format(k=10)}, p AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, greatest(coalesce(max(CASE WHEN src < dst THEN weight END), 0), coalesce(max(CASE WHEN src > dst THEN weight END), 0)) AS weight FROM k GROUP BY 1, 2)
SELECT src, dst, round(weight, 6) AS weight FROM p WHERE weight <> 0""")
def adjacency_sym(spark, d):
    return simgraph.symmetrised(simgraph.topk_cosine(table(spark, d, "embeddings"))).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {KNN.format(k=10)} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM k")
def semantic_pairs(spark, d):
    return simgraph.pair_set(simgraph.topk_cosine(table(spark, d, "embeddings")))


@query(f"""WITH RECURSIVE {KNN.format(k=2)}, e AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM k WHERE weight <> 0 UNION ALL SELECT dst, src FROM k WHERE weight <> 0)),
r AS (SELECT vec_id AS node, vec_id AS label FROM embeddings UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
c AS (SELECT node, min(label) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1)
SELECT sum(size)::BIGINT AS n_nodes, count(*) AS n_components, max(size) AS largest, round(max(size)::DOUBLE / sum(size), 6) AS coverage FROM s""")
def component_coverage(spark, d):
    v = table(spark, d, "embeddings")
    return simgraph.coverage(v.select(F.col("vec_id").alias("node")), simgraph.symmetrised(simgraph.topk_cosine(v, k=2)))


@query()
def adaptive_graph(spark, d):
    return simgraph.adaptive_graph(table(spark, d, "embeddings"), k=2, fallback_k=10).select("src", "dst", F.round("weight", 6).alias("weight"))


# ---------------------------------------------------------------- relation graph

EDGES = r"""e AS (SELECT DISTINCT * FROM (SELECT trim(regexp_replace(lower(part_concept), '[ \t\r\n]+', ' ', 'g')) AS src, trim(regexp_replace(lower(whole_concept), '[ \t\r\n]+', ' ', 'g')) AS dst, 'part-of' AS type FROM mlr_partof WHERE whole_concept IS NOT NULL
UNION ALL SELECT trim(regexp_replace(lower(source), '[ \t\r\n]+', ' ', 'g')), trim(regexp_replace(lower(target), '[ \t\r\n]+', ' ', 'g')), 'prerequisite' FROM train_labels_initial WHERE label = 1) WHERE src <> '' AND dst <> '' AND (type = 'prerequisite' AND src <> dst OR type = 'part-of' AND dst <> 'whole_concept'))"""
def _edges(spark, d):
    return graphq.typed_edges(table(spark, d, "mlr_partof"), table(spark, d, "train_labels_initial"))


@query(f"WITH {EDGES}, x AS (SELECT src AS concept, type || ':out' AS relation, dst AS other FROM e UNION ALL SELECT dst, type || ':in', src FROM e) SELECT concept, relation, count(*) AS n, min(other) AS first FROM x GROUP BY 1, 2")
def graph_neighbours(spark, d):
    return graphq.neighbours(_edges(spark, d))


@query(f"WITH {EDGES} SELECT src AS concept, type || ':out' AS relation, dst AS other FROM e UNION ALL SELECT dst, type || ':in', src FROM e")
def neighbour_rows(spark, d):
    return graphq.neighbour_rows(_edges(spark, d))


@query(f"""WITH {EDGES}, p AS (SELECT src, dst FROM e WHERE type = 'part-of'), m AS (SELECT a.src AS concept, b.src AS sibling, min(a.dst) AS whole FROM p a JOIN p b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY whole, sibling)::INT AS rank FROM m) WHERE rank <= 4""")
def sibling_parts(spark, d):
    return graphq.sibling_parts(_edges(spark, d).filter("type = 'part-of'").select("src", "dst"))


# positive labels have no chains in these tables, so part-of edges stand for them
CHAINS = """w AS (SELECT dst AS x, src AS y, 0 AS way FROM e WHERE type = 'part-of' AND src <> dst UNION ALL SELECT src, dst, 1 FROM e WHERE type = 'part-of' AND src <> dst), m AS (SELECT p.x AS a, p.y AS b, q.y AS c, p.way FROM w p JOIN w q ON p.y = q.x AND p.way = q.way AND p.x <> q.y),
ch AS (SELECT a, b, c, CASE way WHEN 0 THEN 'backward' ELSE 'forward' END AS direction, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY way, b, c)::INT AS rank FROM m) WHERE rank <= 5)"""


@query(f"WITH {EDGES}, {CHAINS} SELECT * FROM ch")
def two_hop_chains(spark, d):
    return graphq.two_hop_chains(_edges(spark, d).filter("type = 'part-of'"))


@query(f"""WITH {EDGES}, {CHAINS}, f AS (SELECT a AS concept, 1 AS hop, a AS x, b AS y FROM ch WHERE rank = 1 UNION ALL SELECT a, 2, b, c FROM ch WHERE rank = 1)
SELECT concept, hop, CASE WHEN EXISTS (SELECT 1 FROM e WHERE type = 'part-of' AND src = y AND dst = x) THEN y ELSE x END AS src, CASE WHEN EXISTS (SELECT 1 FROM e WHERE type = 'part-of' AND src = y AND dst = x) THEN x ELSE y END AS dst FROM f""")
def activated_edges(spark, d):
    parts = _edges(spark, d).filter("type = 'part-of'")
    return graphq.activated_edges(graphq.two_hop_chains(parts), parts)


@query("""WITH f AS (SELECT lower(concept) AS canonical, min(try_cast(fields['chapter'] AS INT)) AS chapter FROM source_context GROUP BY 1), dn AS (SELECT DISTINCT lower(concept) AS canonical FROM documents WHERE concept IS NOT NULL AND source LIKE 'quiz%')
SELECT concept_id, c.canonical, chapter, CASE WHEN dn.canonical IS NOT NULL THEN 'done' WHEN chapter IS NULL THEN 'no_chapter' ELSE 'ready' END AS status FROM mlr_concepts c LEFT JOIN f ON f.canonical = c.canonical LEFT JOIN dn ON dn.canonical = c.canonical""")
def batch_jobs(spark, d):
    contexts = table(spark, d, "source_context").select("concept", F.col("fields")["chapter"].try_cast("int").alias("chapter"))
    return quiz.jobs(table(spark, d, "mlr_concepts"), contexts, table(spark, d, "documents").filter("concept is not null and source like 'quiz%'"))


@query(f"""WITH {KNN.format(k=3)}, sem AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM k), pre AS (SELECT vec_id AS src, (vec_id + 7) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings WHERE vec_id % 3 = 0),
m AS (SELECT * FROM pre WHERE src % 2 = 0)
SELECT vec_id AS src, vec_id AS dst, 0 AS rel FROM embeddings UNION SELECT src, dst, 1 FROM sem UNION SELECT dst, src, 1 FROM sem UNION SELECT src, dst, 2 FROM m UNION SELECT dst, src, 3 FROM m""")
def gnn_edges(spark, d):
    v = table(spark, d, "embeddings")
    n = v.count()
    pre = v.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("src"), ((F.col("vec_id") + 7) % n).alias("dst"))
    return graphq.gnn_edges(v.select(F.col("vec_id").alias("node")), simgraph.pair_set(simgraph.topk_cosine(v, k=3)), pre, pre.filter("src % 2 = 1"))


@query(f"""WITH {KNN.format(k=3)}, sem AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM k), g AS (SELECT src, dst, 1 AS rel FROM sem UNION SELECT dst, src, 1 FROM sem UNION SELECT vec_id, vec_id, 0 FROM embeddings)
SELECT g.dst, rel, count(*) AS n, round(avg(label::DOUBLE), 6) AS mean FROM g JOIN embeddings e ON e.vec_id = g.src GROUP BY 1, 2""")
def message_means(spark, d):
    v = table(spark, d, "embeddings")
    none = v.select(F.col("vec_id").alias("src"), F.col("vec_id").alias("dst")).limit(0)
    g = graphq.gnn_edges(v.select(F.col("vec_id").alias("node")), simgraph.pair_set(simgraph.topk_cosine(v, k=3)), none, none)
    return graphq.message_means(g, v.select(F.col("vec_id").alias("node"), F.col("label").cast("double").alias("value")))


GOLD = "g AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM train_labels_initial WHERE label = 1 AND source_id <> target_id)"


@query(f"""WITH {GOLD}, o AS (SELECT ('0x' || substr(md5(src || '|' || dst), 1, 8))::BIGINT % 5 AS own FROM g) SELECT fold::INT AS fold, count(*) FILTER (own = fold) AS n_held, count(*) FILTER (own <> fold) AS n_message FROM o, range(5) f(fold) GROUP BY 1""")
def fold_masks(spark, d):
    return graphq.fold_masks(labels.edges(table(spark, d, "train_labels_initial")))


@query(f"WITH {GOLD} SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.src = g.dst AND h.dst = g.src)")
def ranking_eligible(spark, d):
    return graphq.ranking_eligible(labels.edges(table(spark, d, "train_labels_initial")))


# ---------------------------------------------------------------- evidence and pages



@query(f"""WITH p AS (SELECT passage_id, {PLAIN.format('text')} AS k, list_distinct(string_split({PLAIN.format('text')}, ' ')) AS w, {PLAIN.format('concept')} AS c FROM passage WHERE text IS NOT NULL AND concept IS NOT NULL),
q AS (SELECT *, list_distinct(list_filter(string_split(c, ' '), lambda t: t <> '')) AS cw FROM p)
SELECT passage_id, round(CASE WHEN len(cw) < 3 THEN 0 ELSE len(list_intersect(cw, w))::DOUBLE / len(cw) END, 6) AS coverage, (contains(k, c) OR CASE WHEN len(cw) < 3 THEN 0 ELSE len(list_intersect(cw, w))::DOUBLE / len(cw) END >= 0.78::DOUBLE) AS grounded FROM q""")
def grounding(spark, d):
    rows = table(spark, d, "passage").filter("text is not null and concept is not null")
    return rows.select("passage_id", F.round(evidence.coverage(F.col("concept"), F.col("text")), 6).alias("coverage"), evidence.grounded(F.col("concept"), F.col("text")).alias("grounded"))


@query("""WITH r AS (SELECT context_id, dataset, lower(trim(concept)) AS k, coalesce(try_cast(fields['confidence'] AS DOUBLE), 0) AS conf FROM source_context WHERE concept IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, k ORDER BY conf DESC, context_id) AS rn FROM r) WHERE rn = 1)
SELECT dataset, context_id, conf, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY conf DESC, context_id)::INT AS rank FROM o) WHERE rank <= 3""")
def distinct_ranked_topk(spark, d):
    rows = table(spark, d, "source_context").filter("concept is not null").select("context_id", "dataset", F.lower(F.trim("concept")).alias("k"), F.coalesce(F.col("fields")["confidence"].try_cast("double"), F.lit(0.0)).alias("conf"))
    return evidence.distinct_ranked(rows, "dataset", F.col("k"), [F.desc("conf"), F.col("context_id")], 3).select("dataset", "context_id", "conf", "rank")


@query("""WITH p AS (SELECT DISTINCT pdf_file AS file, page FROM passage WHERE pdf_file IS NOT NULL AND page IS NOT NULL), w AS (SELECT passage_id AS id, pdf_file AS file, page FROM passage WHERE pdf_file IS NOT NULL AND page IS NOT NULL)
SELECT id, other, gap, rank FROM (SELECT w.id, p.page AS other, abs(p.page - w.page) AS gap, row_number() OVER (PARTITION BY w.id ORDER BY abs(p.page - w.page), p.page)::INT AS rank FROM w JOIN p ON p.file = w.file) WHERE rank <= 5""")
def nearest_pages(spark, d):
    rows = table(spark, d, "passage").filter("pdf_file is not null and page is not null").select(F.col("passage_id").alias("id"), F.col("pdf_file").alias("file"), "page")
    return evidence.nearest_pages(rows, rows.select("file", "page"))


@query("""WITH c AS (SELECT range AS chapter, range * 30 + 1 AS lo, range * 30 + 30 AS hi FROM range(20)) SELECT passage_id, page, chapter::INT AS chapter FROM passage LEFT JOIN c ON page BETWEEN lo AND hi""")
def page_to_chapter(spark, d):
    chapters = spark.range(20).select(F.col("id").cast("int").alias("chapter"), (F.col("id") * 30 + 1).cast("int").alias("lo"), (F.col("id") * 30 + 30).cast("int").alias("hi"))
    return evidence.page_chapters(table(spark, d, "passage").select("passage_id", "page"), chapters).select("passage_id", "page", "chapter")


BOX = "b AS (SELECT passage_id AS id, pdf_file, page, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM passage WHERE bbox IS NOT NULL AND len(bbox) = 4)"


@query(f"""WITH {BOX}, m AS (SELECT a.id AS left_id, c.id AS right_id, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s FROM b a JOIN b c ON a.pdf_file = c.pdf_file AND a.id < c.id)
SELECT left_id, right_id, round(i / (s - i), 6) AS iou FROM m WHERE s - i > 0 AND round(i / (s - i), 6) >= 0.65::DOUBLE""")
def iou_pairs(spark, d):
    b = F.col("bbox")
    boxes = table(spark, d, "passage").filter("bbox is not null and size(bbox) = 4").select(F.col("passage_id").alias("id"), "pdf_file", b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1"))
    return evidence.iou_pairs(boxes, ["pdf_file"], 0.65)


@query()
def boxes_once(spark, d):
    """Boxes of a page and kind without those that overlap an earlier one; a greedy fold, so without SQL."""
    b = F.col("bbox")
    rows = table(spark, d, "passage").filter("bbox is not null and size(bbox) = 4 and pdf_file is not null and page is not null")
    rows = rows.select(F.col("passage_id").alias("id"), "pdf_file", "page", F.coalesce("source_type", F.lit("")).alias("kind"), b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1"))
    return evidence.first_boxes(cut(rows), ["pdf_file", "page", "kind"], evidence.OVERLAPS["tile"])


@query("""SELECT passage_id, row_number() OVER (PARTITION BY pdf_file, page ORDER BY passage_id)::INT AS index_on_page FROM passage""")
def page_running_index(spark, d):
    return table(spark, d, "passage").select("passage_id", F.row_number().over(Window.partitionBy("pdf_file", "page").orderBy("passage_id")).alias("index_on_page"))


@query("""WITH w AS (SELECT c.concept_id, c.canonical, s.context_id, s.evidence FROM mlr_concepts c JOIN source_context s ON lower(trim(s.concept)) = c.canonical WHERE s.evidence IS NOT NULL), u AS (SELECT DISTINCT concept_id, canonical, context_id, substr(evidence, 1, 500) AS snippet FROM w)
SELECT concept_id, context_id, snippet, rank FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY context_id, snippet)::INT AS rank FROM u) WHERE rank <= 3""")
def concept_snippets(spark, d):
    s = table(spark, d, "source_context").filter("evidence is not null").select(F.lower(F.trim("concept")).alias("canonical"), "context_id", F.substring("evidence", 1, 500).alias("snippet"))
    rows = table(spark, d, "mlr_concepts").select("concept_id", "canonical").join(s, "canonical").select("concept_id", "context_id", "snippet").distinct()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("concept_id").orderBy("context_id", "snippet"))).filter("rank <= 3")


@query("""SELECT label_id, ntile(5) OVER (ORDER BY label_id)::INT AS fold, ((row_number() OVER (ORDER BY label_id) - 1) // 100)::INT AS batch FROM test_neg""")
def folds_and_batches(spark, d):
    """Contiguous folds, the first ones longer by one where the number of rows asks for it, and batches of a hundred."""
    t = table(spark, d, "test_neg")
    total = t.count()
    size, longer = divmod(total, 5)
    n = F.col("n")
    fold = F.when(n < longer * (size + 1), F.floor(n / (size + 1))).otherwise(longer + F.floor((n - longer * (size + 1)) / max(1, size)))
    return numbered(t.select("label_id"), "label_id").select("label_id", (fold + 1).cast("int").alias("fold"), F.floor(n / 100).cast("int").alias("batch"))


@query()
def phrase_matches(spark, d):
    names = table(spark, d, "mlr_concepts").select(F.col("canonical").alias("phrase"))
    return evidence.phrase_matches(table(spark, d, "passage"), names, "passage_id", "text")


@query()
def phrase_totals(spark, d):
    """Words of all texts, phrases met in them, and words that these cover."""
    words = table(spark, d, "passage").filter("text is not null").agg(F.sum(F.size(F.filter(F.split(keys.plain_key(F.col("text")), " "), lambda w: w != ""))).alias("n_words"))
    met = phrase_matches(spark, d).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"), F.coalesce(F.sum(F.col("n") * F.size(F.split("phrase", " "))), F.lit(0)).alias("n_covered"))
    return words.join(F.broadcast(met))  # single rows


@query()
def fuzzy_merge(spark, d):
    rows = table(spark, d, "mlr_formula").filter("concept is not null").select(F.coalesce("chapter", F.lit(-1)).cast("string").alias("group"), keys.plural_key(F.col("concept")).alias("name"), F.col("pdf_page").alias("page"))
    return evidence.greedy_merge(rows.groupBy("group", "name").agg(F.count(F.lit(1)).alias("relevance"), F.min("page").alias("page")))


@query()
def page_chunks(spark, d):
    pages = table(spark, d, "passage").filter("text is not null and pdf_file is not null").groupBy(F.col("pdf_file").alias("file"), "page").agg(F.sum(F.length("text")).alias("chars"))
    return evidence.page_chunks(pages, 6000)


# ---------------------------------------------------------------- events


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
