"""Registry of the core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import hierarchy, packed
from graphloom.plans import catalogue
from graphloom.plans import publication as _publication  # noqa: F401  (adds its queries to the catalogue)
from graphloom.plans import questions as _questions  # noqa: F401
from graphloom.plans import extraction as _extraction  # noqa: F401, I001  (after the questions, which it reads)
from graphloom.plans import models as _models  # noqa: F401
from graphloom.session import table

P6_SQL = """WITH RECURSIVE e AS (SELECT node, min(parent) AS parent FROM (
  SELECT trim(regexp_replace(lower(replace(part_concept, chr(65279), '')), '\\s+', ' ', 'g')) AS node, trim(regexp_replace(lower(whole_concept), '\\s+', ' ', 'g')) AS parent FROM mlr_partof)
  WHERE node <> '' AND parent <> '' AND NOT (node = 'part_concept' AND parent = 'whole_concept') GROUP BY 1),
d AS (SELECT DISTINCT parent AS name, parent AS root, 0 AS depth FROM e WHERE parent NOT IN (SELECT node FROM e)
  UNION ALL SELECT e.node, d.root, d.depth + 1 FROM d JOIN e ON e.parent = d.name)
SELECT e.node AS concept, coalesce(d.root, '') AS root_concept, coalesce(d.depth, -1)::INT AS depth FROM e LEFT JOIN d ON d.name = e.node"""

P6_EDGES = """x AS (SELECT DISTINCT trim(regexp_replace(lower(replace(part_concept, chr(65279), '')), '\\s+', ' ', 'g')) AS node, trim(regexp_replace(lower(whole_concept), '\\s+', ' ', 'g')) AS parent FROM mlr_partof), y AS (SELECT * FROM x WHERE node <> '' AND parent <> '' AND NOT (node = 'part_concept' AND parent = 'whole_concept')), e AS (SELECT node, min(parent) AS parent FROM y GROUP BY 1)"""
P6_WALK = "d AS (SELECT DISTINCT parent AS name, parent AS root, 0 AS depth, parent AS path FROM e WHERE parent NOT IN (SELECT node FROM e) UNION ALL SELECT e.node, d.root, d.depth + 1, d.path || ' > ' || e.node FROM d JOIN e ON e.parent = d.name)"
P6_MORE = {
    "p6_paths": f"WITH RECURSIVE {P6_EDGES}, {P6_WALK} SELECT e.node AS concept, coalesce(d.root, '') AS root_concept, coalesce(d.depth, -1)::INT AS depth, d.path FROM e LEFT JOIN d ON d.name = e.node",
    "p6_descendants": f"WITH RECURSIVE {P6_EDGES}, {P6_WALK}, u AS (SELECT node AS concept, parent AS ancestor, 1 AS distance FROM e WHERE node IN (SELECT name FROM d) UNION ALL SELECT u.concept, e.parent, u.distance + 1 FROM u JOIN e ON e.node = u.ancestor) SELECT ancestor, concept, distance::INT AS distance FROM u",
    "p6_conflicts": f"WITH {P6_EDGES} SELECT y.node, y.parent, c.n AS n_parents FROM y JOIN (SELECT node, count(*) AS n FROM y GROUP BY 1 HAVING count(*) > 1) c USING (node) JOIN e USING (node) WHERE y.parent <> e.parent",
    "p6_loops": f"WITH RECURSIVE {P6_EDGES}, {P6_WALK}, l AS (SELECT node, parent FROM e WHERE node NOT IN (SELECT name FROM d)), r AS (SELECT node, parent AS here FROM l UNION SELECT r.node, l.parent FROM r JOIN l ON l.node = r.here) SELECT DISTINCT node AS concept FROM r WHERE node = here",
}

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.unpack(table(spark, sf_dir, "dgl_page_summaries"))


def p2_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.topic_counts(table(spark, sf_dir, "dgl_page_summaries"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.found(table(spark, sf_dir, "mlr_partof"))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.paths(table(spark, sf_dir, "mlr_partof"))


def p6_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.loops(table(spark, sf_dir, "mlr_partof"))


def p6_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.conflicts(table(spark, sf_dir, "mlr_partof"))


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(table(spark, sf_dir, "mlr_partof"))


def queries() -> dict[str, Query]:
    return {
        "p2_found": p2_found,
        "p2_topics": p2_topics,
        "p6_found": p6_found,
        "p6_paths": p6_paths,
        "p6_descendants": p6_descendants,
        "p6_loops": p6_loops,
        "p6_conflicts": p6_conflicts,
        **catalogue.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL, **P6_MORE, **catalogue.SQL}
