"""Queries of validation, audit and publication steps, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import extraction, labels, publication
from graphloom.plans.catalogue import PLAIN, UNIVERSE, query
from graphloom.session import table


@query("""SELECT context_id, dataset, max((coalesce(conf >= CASE st WHEN 'printed' THEN 0.7::DOUBLE WHEN 'mixed' THEN 0.8::DOUBLE WHEN 'handwritten' THEN 0.9::DOUBLE END, false))::INT) AS concept, max((coalesce(conf >= CASE st WHEN 'printed' THEN 0.82::DOUBLE WHEN 'mixed' THEN 0.87::DOUBLE WHEN 'handwritten' THEN 0.92::DOUBLE END, false))::INT) AS formula, max((coalesce(conf >= CASE st WHEN 'printed' THEN 0.78::DOUBLE WHEN 'mixed' THEN 0.82::DOUBLE WHEN 'handwritten' THEN 0.9::DOUBLE END, false))::INT) AS visual FROM (SELECT context_id, dataset, try_cast(fields['confidence'] AS DOUBLE) AS conf, lower(trim(fields['source_type'])) AS st FROM source_context) GROUP BY 1, 2""")
def confidence_gate(spark, d):
    f = F.col("fields")
    gate = lambda what: F.max(publication.confidence_gate(what, f["source_type"], f["confidence"].try_cast("double")).cast("int")).alias(what)
    return table(spark, d, "source_context").groupBy("context_id", "dataset").agg(gate("concept"), gate("formula"), gate("visual"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN len(bbox) <> 4 THEN 'shape' WHEN bbox[1] >= bbox[3] OR bbox[2] >= bbox[4] THEN 'order' WHEN bbox[1] < 0 OR bbox[2] < 0 OR bbox[3] > 1000 OR bbox[4] > 1000 THEN 'range'
WHEN (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) / 1e6 < 0.002 THEN 'small' WHEN (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) / 1e6 > 0.68 THEN 'large' ELSE 'ok' END AS reason FROM passage WHERE bbox IS NOT NULL) GROUP BY 1""")
def box_validity(spark, d):
    return table(spark, d, "passage").filter("bbox is not null").groupBy(publication.box_reason(F.col("bbox")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH e AS ({UNIVERSE}), d AS (SELECT event_id % 200000 AS pair_id, count(*) AS k, max(CASE WHEN event_id % 7 - 1 IN (-1, 0, 1) THEN 0 ELSE 1 END) AS bad FROM events GROUP BY 1)
SELECT CASE WHEN k IS NULL THEN 'missing' WHEN e.pair_id IS NULL THEN 'unknown' WHEN k > 1 THEN 'repeated' WHEN bad = 1 THEN 'bad_label' ELSE 'ok' END AS status, count(*) AS n FROM e FULL JOIN d ON e.pair_id = d.pair_id GROUP BY 1""")
def decision_validation(spark, d):
    decisions = table(spark, d, "events").select((F.col("event_id") % 200_000).alias("pair_id"), (F.col("event_id") % 7 - 1).alias("label"))
    return publication.decision_report(labels.pair_universe(table(spark, d, "mlr_concepts"), "concept_id"), decisions)


@query("""WITH n AS (SELECT canonical AS name FROM mlr_concepts), q AS (SELECT DISTINCT array_to_string(string_split(canonical, ' ')[-2:], ' ') AS q FROM mlr_concepts UNION SELECT DISTINCT 'deep ' || string_split(canonical, ' ')[1] FROM mlr_concepts),
x AS (SELECT q, name, 1 AS tier, 0 AS score FROM q JOIN n ON q = name), r AS (SELECT * FROM q WHERE q NOT IN (SELECT q FROM x)),
m AS (SELECT q, name, len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(name, ' ')))) AS common FROM r JOIN n ON len(list_intersect(string_split(q, ' '), string_split(name, ' '))) > 0),
i AS (SELECT q, name, 2 AS tier, 0 AS score FROM r JOIN n ON contains(name, q)), l AS (SELECT q, name, 3 AS tier, -common AS score FROM m WHERE q NOT IN (SELECT q FROM i)),
u AS (SELECT * FROM x UNION ALL SELECT * FROM i UNION ALL SELECT * FROM l) SELECT q, name, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, score, length(name), name)::INT AS rank FROM u) WHERE rank <= 10""")
def concept_search(spark, d):
    c = table(spark, d, "mlr_concepts")
    asked = c.select(F.substring_index("canonical", " ", -2).alias("q")).union(c.select(F.concat(F.lit("deep "), F.substring_index("canonical", " ", 1)))).distinct()
    return publication.tiered_search(asked, c.select(F.col("canonical").alias("name")))


@query("SELECT dataset, round(avg(try_cast(fields['confidence'] AS DOUBLE)), 6) AS mean_confidence, count(try_cast(fields['confidence'] AS DOUBLE)) AS n FROM source_context GROUP BY 1")
def confidence_means(spark, d):
    c = F.col("fields")["confidence"].try_cast("double")
    return table(spark, d, "source_context").groupBy("dataset").agg(F.round(F.avg(c), 6).alias("mean_confidence"), F.count(c).alias("n"))


@query("SELECT split, round(count(*) FILTER (label = 0)::DOUBLE / nullif(count(*) FILTER (label = 1), 0), 6) AS weight FROM (SELECT * FROM train_labels_initial UNION ALL SELECT * FROM test_neg) GROUP BY 1")
def class_weights(spark, d):
    rows = table(spark, d, "train_labels_initial").unionByName(table(spark, d, "test_neg"))
    pos = F.count_if(F.col("label") == 1)
    return rows.groupBy("split").agg(F.round(F.when(pos > 0, F.count_if(F.col("label") == 0) / pos), 6).alias("weight"))


@query("""SELECT dataset, name FROM (SELECT DISTINCT 'mlr' AS dataset, 'mlr:' || lower(trim(concept)) AS name FROM source_context WHERE concept IS NOT NULL AND dataset = 'MLR' UNION ALL SELECT DISTINCT 'dgl', 'dgl:' || lower(trim(concept)) FROM source_context WHERE concept IS NOT NULL AND dataset = 'DGL')""")
def dataset_union(spark, d):
    s = table(spark, d, "source_context")
    return publication.prefixed_union({"mlr": s.filter("dataset = 'MLR'"), "dgl": s.filter("dataset = 'DGL'")}, "concept")


@query("""WITH p AS (""" + UNIVERSE + """),
d AS (SELECT *, CASE pair_id % 11 WHEN 0 THEN 1 WHEN 5 THEN -1 ELSE 0 END AS label FROM p), pos AS (SELECT pair_id, CASE WHEN label = 1 THEN left_id ELSE right_id END AS source, CASE WHEN label = 1 THEN right_id ELSE left_id END AS target, 1 AS label FROM d WHERE label <> 0)
SELECT * FROM pos UNION ALL SELECT pair_id, left_id, right_id, 0 FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || pair_id), pair_id) AS rn FROM d WHERE label = 0) WHERE rn <= 2 * (SELECT count(*) FROM pos)""")
def public_rows(spark, d):
    pairs = labels.pair_universe(table(spark, d, "mlr_concepts"), "concept_id")
    m = F.col("pair_id") % 11
    return publication.public_rows(pairs.withColumn("label", F.when(m == 0, 1).when(m == 5, -1).otherwise(0)))


@query(r"""WITH s AS (SELECT lecture, pdf_file, pdf_page, summary_id AS o, string_split_regex(trim(regexp_replace(summary, '([.!?])\s+', '\1' || chr(1), 'g')), chr(1)) AS l FROM dgl_page_summaries WHERE summary IS NOT NULL),
e AS (SELECT lecture, pdf_file, pdf_page, o, generate_subscripts(l, 1) AS p, unnest(l) AS s FROM s), f AS (SELECT lecture, pdf_file, pdf_page, s, min(o * 100000 + p) AS place FROM e WHERE s <> '' GROUP BY 1, 2, 3, 4)
SELECT lecture, pdf_file, pdf_page, string_agg(s, ' ' ORDER BY place) AS text, count(*)::INT AS n FROM f GROUP BY 1, 2, 3""")
def summary_union(spark, d):
    return publication.sentence_union(table(spark, d, "dgl_page_summaries"), ["lecture", "pdf_file", "pdf_page"], "summary", "summary_id")


@query(f"""WITH k AS (SELECT lower(concept) AS concept, {PLAIN.format('evidence')} AS k, min(context_id) AS id FROM source_context WHERE evidence IS NOT NULL AND concept IS NOT NULL GROUP BY 1, 2 HAVING {PLAIN.format('evidence')} <> '')
SELECT a.id, min(b.id) AS other FROM k a JOIN k b ON a.concept = b.concept AND a.id <> b.id AND contains(b.k, a.k) GROUP BY 1""")
def contained_evidence(spark, d):
    return publication.contained_evidence(table(spark, d, "source_context").filter("evidence is not null and concept is not null").select(F.col("context_id").alias("id"), F.lower("concept").alias("concept"), "evidence"))


@query("""SELECT pdf_file, page, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1, count(*) AS n FROM passage WHERE bbox IS NOT NULL AND len(bbox) = 4 GROUP BY 1, 2""")
def page_boxes(spark, d):
    b = F.col("bbox")
    return table(spark, d, "passage").filter("bbox is not null and size(bbox) = 4").groupBy("pdf_file", "page").agg(F.min(b[0]).alias("x0"), F.min(b[1]).alias("y0"), F.max(b[2]).alias("x1"), F.max(b[3]).alias("y1"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT DISTINCT lower(concept) AS concept, evidence FROM source_context WHERE evidence IS NOT NULL AND concept IS NOT NULL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY length(evidence) DESC, evidence) AS rn FROM r) WHERE rn <= 3)
SELECT concept, count(*) AS n, sha256(to_json({'concept': concept, 'evidence': list(evidence ORDER BY rn)})::VARCHAR) AS input_hash FROM k GROUP BY 1""")
def profile_inputs(spark, d):
    """The three longest texts of each concept, and the digest of concept and texts as JSON with its keys in order."""
    r = table(spark, d, "source_context").filter("evidence is not null and concept is not null").select(F.lower("concept").alias("concept"), "evidence").distinct()
    k = r.withColumn("rn", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc(F.length("evidence")), "evidence"))).filter("rn <= 3")
    one = k.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rn", "evidence"))).alias("l"))
    return one.select("concept", "n", extraction.input_hash(F.struct("concept", F.col("l.evidence").alias("evidence"))).alias("input_hash"))


