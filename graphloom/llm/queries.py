"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import copies, encoding, entries, noise, overlap, packing, pii, truncation
from graphloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.found(table(spark, sf_dir, "passage"))


def p1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.repair(table(spark, sf_dir, "passage"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found(table(spark, sf_dir, "passage"), table(spark, sf_dir, "source_context"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(table(spark, sf_dir, "passage"), table(spark, sf_dir, "source_context"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.hidden_copies(table(spark, sf_dir, "mlr_formula"))


def p4_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapse(table(spark, sf_dir, "mlr_formula"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.map_entries(table(spark, sf_dir, "mlr_formula"), table(spark, sf_dir, "mlr_concepts"))


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.unmatched(table(spark, sf_dir, "mlr_formula"), table(spark, sf_dir, "mlr_concepts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found(table(spark, sf_dir, "train_labels_initial"), table(spark, sf_dir, "test_neg"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(table(spark, sf_dir, "train_labels_initial"), table(spark, sf_dir, "test_neg"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(encoding.token_counts(table(spark, sf_dir, "documents")))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p9_fill(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def p10_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_repair": p1_repair,
        "p3_found": p3_found,
        "p3_rates": p3_rates,
        "p4_found": p4_found,
        "p4_collapse": p4_collapse,
        "p5_found": p5_found,
        "p5_unmatched": p5_unmatched,
        "p7_found": p7_found,
        "p7_report": p7_report,
        "p8_ids": p8_ids,
        "p9_fill": p9_fill,
        "p9_report": p9_report,
        "p10_found": p10_found,
        "p10_mask": p10_mask,
    }


def oracle_sql() -> dict[str, str]:
    return {}
