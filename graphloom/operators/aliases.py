"""Alias dimensions and their conflict policies, and lookups of names in them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import clean_field


def alias_rows(concepts: DataFrame, id_col: str = "concept_id", canonical: str = "canonical") -> DataFrame:
    """(concept_id, pos, alias, alias_key): the canonical name at position 0 and each alias after it."""
    more = sorted(c for c in concepts.columns if c.startswith("alias_"))
    return (
        concepts.select(F.col(id_col).alias("concept_id"), F.posexplode(F.array(canonical, *more)).alias("pos", "alias"))
        .filter(F.col("alias").isNotNull())
        .withColumn("alias_key", clean_field(F.col("alias")))
        .filter("alias_key <> ''")
    )


def first_wins(aliases: DataFrame) -> DataFrame:
    """(alias_key, concept_id): the earliest concept, canonical names before aliases within one."""
    return aliases.groupBy("alias_key").agg(F.min_by("concept_id", F.struct("concept_id", "pos")).alias("concept_id"))


def unique_only(aliases: DataFrame) -> DataFrame:
    """(alias_key, concept_id): canonical names first; other aliases only if they mean one concept."""
    return aliases.groupBy("alias_key").agg(
        F.min(F.when(F.col("pos") == 0, F.col("concept_id"))).alias("canonical"), F.count_distinct("concept_id").alias("n"), F.min("concept_id").alias("any")
    ).select("alias_key", F.coalesce("canonical", F.when(F.col("n") == 1, F.col("any"))).alias("concept_id")).filter(F.col("concept_id").isNotNull())


def last_wins(aliases: DataFrame) -> DataFrame:
    """(alias_key, concept_id) of the sequential rule: a later concept whose canonical name is already known joins the
    earlier concept, and each alias belongs to whoever wrote it last.

    The rule is a fold in concept order; it runs in one task, over names only.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner: dict[str, int] = {}
        for batch in batches:
            for own, part in batch.groupby("concept_id", sort=True):
                part = part.sort_values("pos")
                head = part["alias_key"].iloc[0]
                target = owner.get(head, own)
                for key in part["alias_key"]:
                    owner[key] = target
        yield pd.DataFrame(sorted(owner.items()), columns=["alias_key", "concept_id"])

    return aliases.select("concept_id", "pos", "alias_key").repartition(1).sortWithinPartitions("concept_id", "pos").mapInPandas(fold, "alias_key string, concept_id int")


def ambiguous(aliases: DataFrame) -> DataFrame:
    """(alias_key, n_concepts): aliases of several concepts."""
    return aliases.groupBy("alias_key").agg(F.count_distinct("concept_id").alias("n_concepts")).filter("n_concepts > 1")


def resolve(rows: DataFrame, dimension: DataFrame, column: str, out: str) -> DataFrame:
    """`rows` with the concept of one name column, null where the dimension lacks it."""
    return rows.withColumn("_key", clean_field(F.col(column))).join(dimension.select(F.col("alias_key").alias("_key"), F.col("concept_id").alias(out)), "_key", "left").drop("_key")


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")
