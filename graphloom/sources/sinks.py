"""Sinks: CSV, atomic files, append-only records, graph files, publication only when complete."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; nulls are empty cells."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def atomic_write(path: str, data: bytes) -> bool:
    """Replace a file in one step; False if it holds these bytes already."""
    target = Path(path)
    if target.exists() and target.read_bytes() == data:
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise
    return True


def write_json(path: str, value: object) -> bool:
    """A summary as JSON with sorted keys, replaced in one step."""
    return atomic_write(path, (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())


def append_records(df: DataFrame, path: str) -> None:
    """Rows added as JSON lines; what is there stays."""
    df.write.mode("append").json(path)


def publish_if_complete(rows: DataFrame, expected: DataFrame, key: str, path: str) -> int:
    """Write rows as parquet only if every expected key is among them, and only if they differ from what is there; gives the number of missing keys."""
    missing = expected.select(key).distinct().join(rows, key, "left_anti").count()
    if missing:
        return missing
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path)
    except AnalysisException:
        there = None
    if there is not None and there.schema == rows.schema and there.exceptAll(rows).isEmpty() and rows.exceptAll(there).isEmpty():
        return 0
    rows.write.mode("overwrite").parquet(path)
    return 0


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Graph file of (id, label) and (src, dst, type, weight); an edge to an unknown node is an error.

    The format is one XML document, so the driver writes it, row by row as partitions arrive, and replaces the file at the end.
    """
    ends = edges.selectExpr("src as id").union(edges.selectExpr("dst as id")).distinct()
    if not ends.join(nodes, "id", "left_anti").isEmpty():
        raise ValueError("an edge ends at an unknown node")
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="label" for="node" attr.name="label" attr.type="string"/>', '<key id="type" for="edge" attr.name="type" attr.type="string"/>', '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>', '<graph edgedefault="directed">']
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write("\n".join(head) + "\n")
        for r in nodes.orderBy("id").toLocalIterator():
            f.write(f'<node id={quoteattr(str(r["id"]))}><data key="label">{escape(str(r["label"]))}</data></node>\n')
        for r in edges.orderBy("src", "dst", "type").toLocalIterator():
            weight = "" if r["weight"] is None else f'<data key="weight">{r["weight"]}</data>'
            f.write(f'<edge source={quoteattr(str(r["src"]))} target={quoteattr(str(r["dst"]))}><data key="type">{escape(r["type"])}</data>{weight}</edge>\n')
        f.write("</graph>\n</graphml>\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def store_asset(folder: str, data: bytes, suffix: str) -> str:
    """Name of a file with this content, written unless it is there."""
    name = hashlib.sha256(data).hexdigest()[:24] + suffix
    atomic_write(os.path.join(folder, name), data)
    return name


def drop_stale_assets(folder: str, before: list[str], now: list[str]) -> list[str]:
    """Delete the files of an earlier manifest that are no longer named; others are left alone."""
    gone = sorted(set(before) - set(now))
    for name in gone:
        Path(folder, name).unlink(missing_ok=True)
    return gone
