"""Readers of the file formats of an educational knowledge graph. Schemas are explicit; bad rows are counted or fail."""

from __future__ import annotations

import csv
import glob
import io
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import clean_field
from graphloom.session import numbered

BOM = "﻿"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of a text file, numbered in file order from 0."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace(F.regexp_replace("value", f"^{BOM}", ""), "\n$", ""), "\r?\n")).alias("ord", "line"))


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """(ord, cells) of a CSV file whose rows differ in width; quoted cells may hold line ends, which become spaces."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                rows = [[re.sub(r"\s+", " ", c).strip() for c in r] for r in csv.reader(io.StringIO(text.lstrip(BOM)))]
                yield pd.DataFrame({"ord": range(len(rows)), "cells": rows})

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "ord int, cells array<string>")


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """(concept_id, canonical, aliases): from ragged CSV, or from text with `::;` between names.

    Names are cleaned, repeated ones of a row dropped, empty rows skipped; ids follow file order.
    """
    if path.endswith(".txt"):
        rows = _lines(spark, path).select("ord", F.split("line", "::;").alias("cells"))
    else:
        rows = csv_cells(spark, path)
    names = F.array_distinct(F.filter(F.transform("cells", clean_field), lambda c: c != ""))
    rows = rows.select("ord", names.alias("names")).filter(F.size("names") > 0)
    rest = F.slice("names", F.lit(2), F.greatest(F.size("names") - 1, F.lit(0)))
    return numbered(rows, "ord", name="concept_id").select("concept_id", F.col("names")[0].alias("canonical"), rest.alias("aliases"))


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ord, source, target, label, reason): three cells, label 0 or 1; reason says why a row is invalid."""
    c = csv_cells(spark, path)
    return c.select(
        "ord", clean_field(F.get("cells", F.lit(0))).alias("source"), clean_field(F.get("cells", F.lit(1))).alias("target"), F.get("cells", F.lit(2)).try_cast("int").alias("label"),
        F.when(F.size("cells") != 3, "width").when((F.trim(F.get("cells", F.lit(0))) == "") | (F.trim(F.get("cells", F.lit(1))) == ""), "missing_name").when(~F.get("cells", F.lit(2)).isin("0", "1"), "bad_label").alias("reason"),
    )


def labels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(ord, source, target, label): tab-separated; label `1-` is positive, `-1` positive the other way, `-` negative."""
    c = F.split("line", "\t+")
    a, b, mark = clean_field(c[0]), clean_field(c[1]), F.trim(c[2])
    turned = mark == "-1"
    return _lines(spark, path).filter(F.size(c) == 3).select(
        "ord", F.when(turned, b).otherwise(a).alias("source"), F.when(turned, a).otherwise(b).alias("target"), F.when(mark.isin("1-", "-1"), 1).when(mark == "-", 0).alias("label")
    )


def caption_jsonl(spark: SparkSession, path: str, schema: str = "title string, category string, text string") -> DataFrame:
    """Caption records; a line that is no record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def caption_csv(spark: SparkSession, path: str) -> DataFrame:
    """(text): title, category and text joined by spaces where the file has them, otherwise all columns."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    wanted = [c for c in ("title", "category", "text") if c in df.columns] or df.columns
    return df.select(F.concat_ws(" ", *[F.when(F.trim(c) != "", F.trim(c)) for c in wanted]).alias("text"))


def captions(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Texts of several caption files, and the number of texts of each; a missing file counts 0."""
    found = {p: glob.glob(p) for p in paths}
    parts = [(caption_csv if p.endswith(".csv") else caption_jsonl)(spark, p).select("text").withColumn("file", F.lit(p)) for p in paths if found[p]]
    if not parts:
        return spark.createDataFrame([], "text string, file string"), dict.fromkeys(paths, 0)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    counts = {r["file"]: r["count"] for r in rows.groupBy("file").count().collect()}  # one row per file
    return rows, {p: counts.get(p, 0) for p in paths}


def table_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header that must have the required columns."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip(BOM) for c in df.columns])
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {lacking}")
    return df


PROFILE = "concept_id int, concept_name string, aliases array<string>, profile string, model string, prompt_version string"


def profiles_strict(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Profiles, one for each known concept: unknown, repeated, misnamed, empty and missing ones are errors."""
    rows = spark.read.schema(PROFILE).option("mode", "FAILFAST").json(path).cache()
    k = known.select("concept_id", F.col("canonical").alias("_name"))
    faults = {
        "unknown": rows.join(k, "concept_id", "left_anti"),
        "repeated": rows.groupBy("concept_id").count().filter("count > 1"),
        "misnamed": rows.join(k, "concept_id").filter(clean_field(F.col("concept_name")) != clean_field(F.col("_name"))),
        "empty": rows.filter(F.coalesce(F.trim("profile"), F.lit("")) == ""),
        "missing": k.join(rows, "concept_id", "left_anti"),
    }
    bad = [name for name, part in faults.items() if not part.isEmpty()]
    if bad:
        raise ValueError(f"{path}: profiles are {', '.join(bad)}")
    return rows


def profiles_latest(spark: SparkSession, path: str, prompt_version: str | None = None) -> DataFrame:
    """The last profile of each concept in an append-only file, of one prompt version; bad lines are skipped."""
    rows = _lines(spark, path).select("ord", F.from_json("line", PROFILE).alias("r")).filter("r.concept_id is not null")
    if prompt_version:
        rows = rows.filter(F.col("r.prompt_version") == prompt_version)
    return rows.groupBy("r.concept_id").agg(F.max_by("r", "ord").alias("r")).select("r.*")


def relation_text(spark: SparkSession, path: str, mark: str = " part-of ") -> DataFrame:
    """(src, dst) of lines `a part-of b`, or with `mark` = ` :: ` of pairs."""
    c = F.split("line", re.escape(mark), 2)
    return _lines(spark, path).filter(F.size(c) == 2).select(clean_field(c[0]).alias("src"), clean_field(c[1]).alias("dst"))


def relation_csv(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a CSV of two names; a header row is left out."""
    rows = csv_cells(spark, path).filter(F.size("cells") >= 2).select(clean_field(F.col("cells")[0]).alias("src"), clean_field(F.col("cells")[1]).alias("dst"))
    return rows.filter(~(F.col("src").isin("part_concept", "concept_1", "source") & F.col("dst").isin("whole_concept", "concept_2", "target")) & (F.col("src") != "") & (F.col("dst") != ""))


def knn_csv(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, target_id, weight): a missing weight is 0, one that is no number null."""
    df = table_csv(spark, path, ["source_id", "target_id", "weight"])
    w = F.coalesce(F.when(F.trim("weight") == "", None).otherwise(F.col("weight")), F.lit("0"))
    return df.select(F.col("source_id").cast("int").alias("source_id"), F.col("target_id").cast("int").alias("target_id"), w.try_cast("double").alias("weight"))


def contexts(rows: DataFrame, dataset: str, *order: str, kind: str = "META") -> DataFrame:
    """Rows with ids like MLR-META-0001 by their order; `kind` FORMULA for formulas, whose own ids come first."""
    placed = numbered(rows, *order, name="_n")
    made = F.format_string(f"%s-{kind}-%04d", F.lit(dataset), F.col("_n") + 1)
    own = F.when(F.trim("formula_id") != "", F.col("formula_id")) if "formula_id" in rows.columns else F.lit(None).cast("string")
    return placed.withColumn("context_id", F.coalesce(own, made)).drop("_n")


def first_with_suffix(folder: str, suffix: str) -> str | None:
    """The first file of a folder, by name, that ends in a suffix."""
    return next((os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(suffix)), None)


def checkpoints(spark: SparkSession, folder: str, schema: str, key: str | None = None, exclude: str | None = None) -> DataFrame:
    """Rows of all JSON documents of a folder with the file they came from, by key; files whose name matches `exclude` are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("file", F.input_file_name())
    rows = rows if exclude is None else rows.filter(~F.element_at(F.split("file", "/"), -1).rlike(exclude))
    return rows if key is None else rows.orderBy(key)


def expand(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default} replaced from the environment."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m.group(1)) or (m.group(2) or ""), text)


def chapters(text: str, least: int = 1, most: int = 99) -> list[int]:
    """Sorted chapters of a selection like `1-3,5` or `1 3`; bad parts are errors."""
    out: set[int] = set()
    for part in re.split(r"[,\s]+", text.strip()):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m:
            raise ValueError(f"not a chapter: {part!r}")
        a, b = int(m.group(1)), int(m.group(2) or m.group(1))
        if not least <= a <= b <= most:
            raise ValueError(f"out of range: {part}")
        out |= set(range(a, b + 1))
    return sorted(out)


def bounded_phrase(text: Column, term: Column) -> Column:
    """Whether a lower-case term stands in a text as whole words."""
    return F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))
