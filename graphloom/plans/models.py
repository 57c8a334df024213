"""Queries of model arithmetic and of what goes to and comes from a language model, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import keys
from graphloom.operators import graphq, models, simgraph
from graphloom.plans.catalogue import ALIAS_SQL, CLEAN, EDGES, KNN, _aliases, _edges, query
from graphloom.plans.extraction import PROFILE, _profiles
from graphloom.plans.questions import ALL, _Made
from graphloom.session import table


@query(f"""WITH {ALIAS_SQL}, t AS (SELECT array_to_string(regexp_extract_all(alias_key, '[a-z0-9]+(?:[-''][a-z0-9]+)?'), '_') AS tokens, concept_id, pos FROM aliases) SELECT tokens, arg_min(concept_id, concept_id * 10 + pos) AS concept_id FROM t WHERE tokens <> '' GROUP BY 1""")
def alias_tokens(spark, d):
    rows = _aliases(spark, d).select(F.array_join(keys.tokens(F.col("alias_key")), "_").alias("tokens"), "concept_id", "pos").filter("tokens <> ''")
    return rows.groupBy("tokens").agg(F.min(F.struct("concept_id", "pos")).alias("m")).select("tokens", "m.concept_id")


@query(f"""WITH {KNN.format(k=3)}, p AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM k) SELECT p.src, p.dst, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE * (1 + i / 100.0::DOUBLE))), 5) AS score FROM p JOIN embeddings a ON a.vec_id = p.src JOIN embeddings b ON b.vec_id = p.dst""")
def graph_scores(spark, d):
    v = table(spark, d, "embeddings")
    pairs = simgraph.pair_set(simgraph.topk_cosine(v, k=3))
    return models.bilinear_scores(pairs, v.select(F.col("vec_id").alias("node"), F.col("embedding").alias("v")), [1 + i / 100 for i in range(1, 65)]).withColumn("score", F.round("score", 5))


@query(f"""WITH {KNN.format(k=3)}, sem AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM k), g AS (SELECT src, dst, 1 AS rel FROM sem UNION SELECT dst, src, 1 FROM sem UNION SELECT vec_id, vec_id, 0 FROM embeddings)
SELECT * FROM g WHERE rel = 0 OR ('0x' || substr(md5('7|' || src || '|' || dst || '|' || rel), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.2::DOUBLE""")
def thinned_view(spark, d):
    v = table(spark, d, "embeddings")
    none = v.select(F.col("vec_id").alias("src"), F.col("vec_id").alias("dst")).limit(0)
    g = graphq.gnn_edges(v.select(F.col("vec_id").alias("node")), simgraph.pair_set(simgraph.topk_cosine(v, k=3)), none, none)
    return models.thinned_view(g, 0.2, 7)


@query()
def calibration_fit(spark, d):
    """Temperature and bias of the label rows' similarities; iterative, so without SQL."""
    t = table(spark, d, "train_labels_initial").filter("similarity is not null")
    temperature, bias = models.fit_calibration(t.select(keys.logit(F.col("similarity")).alias("logit"), F.col("label").alias("y")))
    return spark.createDataFrame([(round(temperature, 4), round(bias, 4))], "temperature double, bias double")


@query("SELECT source_id AS src, target_id AS dst, arg_max(CASE WHEN label = 1 THEN similarity ELSE 1 - similarity END, label_id) AS conf FROM train_labels_initial WHERE similarity IS NOT NULL GROUP BY 1, 2")
def pair_confidence(spark, d):
    t = table(spark, d, "train_labels_initial").filter("similarity is not null")
    return models.confidence_by_pair(t.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "label", F.col("similarity").alias("combined"), F.col("label_id").alias("ord")))


@query(f"""WITH {EDGES}, o AS (SELECT DISTINCT {CLEAN.format('source')} AS src, {CLEAN.format('target')} AS dst FROM test_neg) SELECT type, count(*) AS n, count(o.src) AS n_shared FROM e LEFT JOIN o USING (src, dst) GROUP BY 1""")
def relation_counts(spark, d):
    o = table(spark, d, "test_neg").select(keys.clean_field(F.col("source")).alias("src"), keys.clean_field(F.col("target")).alias("dst"))
    return models.relation_counts(_edges(spark, d), o)


@query("""SELECT source_id, count(*) AS n, to_json(list({'label_id': label_id, 'target': target} ORDER BY label_id, target))::VARCHAR AS payload FROM train_labels_initial WHERE target IS NOT NULL GROUP BY 1""")
def anchor_prompts(spark, d):
    return models.prompts(table(spark, d, "train_labels_initial").filter("target is not null"), "source_id", ["label_id", "target"])


@query(f"""WITH pf AS ({PROFILE.format("source LIKE 'profiles%'")}), n AS (SELECT canonical, substr(canonical, instr(canonical, ' ') + 1) AS rest FROM mlr_concepts WHERE contains(canonical, ' ')), w AS (SELECT canonical AS target, canonical AS concept, 0 AS ord FROM mlr_concepts UNION ALL SELECT target, concept, ord FROM (SELECT a.canonical AS target, b.canonical AS concept, row_number() OVER (PARTITION BY a.canonical ORDER BY b.canonical)::INT AS ord FROM n a JOIN n b ON a.rest = b.rest AND a.canonical <> b.canonical) WHERE ord <= 12),
x AS (SELECT DISTINCT lower(trim(concept)) AS concept, context_id AS id, evidence AS text FROM source_context WHERE concept IS NOT NULL AND evidence IS NOT NULL), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY id, text) AS k FROM x) WHERE k <= 3),
r AS (SELECT target, concept, ord, 0 AS k, 'profile' AS source, profile AS text FROM w JOIN pf USING (concept) UNION ALL SELECT target, concept, ord, k, id, text FROM w JOIN c USING (concept)) SELECT target, rank, concept, source, left(text, 800) AS text FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord, concept, k, source)::INT AS rank FROM r WHERE trim(text, ' ') <> '') WHERE rank <= 30""")
def source_excerpts(spark, d):
    c = table(spark, d, "mlr_concepts")
    w = c.select(F.col("canonical").alias("target"), F.col("canonical").alias("concept"), F.lit(0).alias("ord")).unionByName(graphq.confusable(c).select(F.col("src").alias("target"), F.col("dst").alias("concept"), F.col("rank").alias("ord")))
    x = table(spark, d, "source_context").filter("concept is not null and evidence is not null").select(F.lower(F.trim("concept")).alias("concept"), F.col("context_id").alias("id"), F.col("evidence").alias("text")).distinct()
    return models.excerpts(w, _profiles(spark, d, "source like 'profiles%'"), x)


@query(f"""WITH p AS ({PROFILE.format("source LIKE 'profiles%'")}) SELECT coalesce(canonical, p.concept) AS concept, coalesce(profile, '') AS definition, CASE WHEN canonical IS NULL THEN 'new' WHEN profile IS NULL THEN 'bare' ELSE 'known' END AS origin FROM mlr_concepts FULL JOIN p ON p.concept = canonical""")
def concept_definitions(spark, d):
    return models.definitions(table(spark, d, "mlr_concepts").select(F.col("canonical").alias("concept")), _profiles(spark, d, "source like 'profiles%'"))


@query(f"""WITH {ALL} SELECT wr.concept, wr.plan, rank, option || ' is locally related to ' || correct || ' in the graph or topic and may be confused by learners.' AS reason, option || ' is not the requested answer ' || correct || ' or its specified relation.' AS diff, 'Choosing ' || option || ' would conflict with the definition or graph relation for ' || correct || '.' AS exclusive FROM wr JOIN an ON an.concept = wr.concept AND an.plan = wr.plan""")
def distractor_records(spark, d):
    m = _Made(spark, d)
    r = m.wrong.join(m.answered.select("concept", "plan", "correct"), ["concept", "plan"])
    return r.select("concept", "plan", "rank", models.distractor_record(F.col("option"), F.col("correct")).alias("r")).select("concept", "plan", "rank", "r.*")
