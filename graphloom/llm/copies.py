"""Hidden copies (problem 4): records that differ in dress only, collapsed and counted.

Method: recursive radix partitioning on canonical bytes. Each record is reduced to a canonical key, whose UTF-8 bytes
are used. A level counts the rows of the prefixes of four lengths at once; a row's bucket is its shortest prefix with at
most `limit` rows, and what is still oversized goes to the next level with longer prefixes. Each bucket is then counted
by a byte trie with terminal counters: a terminal holds the record ids of its key, so it gives the number of copies, the
record kept and its copies. A bucket of one key above the limit can't be split by bytes; it is spread over salts, each
with a trie of its own, and the counters of its terminals are added up.

Defined results: null in either field: the record is no case and no copy of any; records without an id take no part. Empty strings are values. Equal ids
count as one record. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, nonempty, width

#: LaTeX commands that only set space or bracket size, and delimiters of maths.
SPACING = [r"\,", r"\:", r"\;", r"\!", r"\ ", r"\>", r"\quad", r"\qquad", r"\left", r"\right", "~", "$", r"\(", r"\)", r"\[", r"\]", r"\thinspace", r"\displaystyle"]
SEP = "\u0001"
TOKEN = r"(?U)\\text\s*\{[^{}]*\}|\\[A-Za-z]+|\\\s|\\.|[^\s]"
MATHS = r"[\\=^{}<>]"


def canonical_name(name: Column) -> Column:
    """Letters and digits of a free name in lower case."""
    return F.regexp_replace(F.lower(name), r"(?U)[^\p{L}\p{N}\p{M}]+", "")


def canonical_latex(latex: Column) -> Column:
    """Tokens of a formula, without spacing, delimiters, sizing, closing punctuation and braces around one token."""
    tokens = F.regexp_extract_all(latex, F.lit(TOKEN), F.lit(0))
    tokens = F.transform(
        tokens,
        lambda t: F.when(t.startswith("\\text"), F.lower(F.regexp_replace(t, r"(?U)\s+|\\[,:;! ]|~", "")))
        .when(t.rlike(r"(?U)^\\\s$"), F.lit("\\ "))
        .otherwise(t),
    )
    tokens = F.filter(tokens, lambda t: ~t.isin(SPACING))
    out = F.array_join(tokens, SEP)
    out = F.regexp_replace(out, rf"({SEP}?[.,;:])+$", "")
    for _ in range(3):  # braces around a single token, also nested ones
        out = F.regexp_replace(out, rf"\{{{SEP}([^{SEP}{{}}]+){SEP}\}}", "$1")
    return out


def canonical_records(df: DataFrame, id_col: str = "formula_id", name: str = "concept", latex: str = "latex") -> DataFrame:
    """(rec_id, key) of every record with both values, whichever of the two fields holds which."""
    a, b = F.col(name), F.col(latex)
    swapped = F.regexp_count(a, F.lit(MATHS)) > F.regexp_count(b, F.lit(MATHS))
    return (
        df.filter(a.isNotNull() & b.isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("rec_id"), F.when(swapped, b).otherwise(a).alias("_n"), F.when(swapped, a).otherwise(b).alias("_l"))
        .select("rec_id", F.concat(canonical_name(F.col("_n")), F.lit("\u0002"), canonical_latex(F.col("_l"))).alias("key"))
    )


#: Oversized prefixes up to this number are broadcast (counted first), more are joined by shuffling.
FEW = 20_000


def radix_buckets(keyed: DataFrame, limit: int = 50_000) -> DataFrame:
    """(rec_id, key, bucket, salt, hot) of all rows of (rec_id, key): key and bucket in bytes, salts of buckets of one key.

    A level tries prefixes of 1, 2, 4 and 8 times its first length, which is 16 times that of the level before, so the
    number of levels is the logarithm of the longest key; a level reads only what is still oversized.
    """
    open_, done, first = keyed.select("rec_id", F.col("key").cast("binary").alias("key")), None, 1
    while True:
        lengths = [first, 2 * first, 4 * first, 8 * first]
        prefix = [F.struct(F.lit(n).alias("length"), F.substring("key", 1, n).alias("bucket")) for n in lengths]
        sizes = open_.select(F.xxhash64("key").alias("h"), F.explode(F.array(*prefix)).alias("p")).groupBy("p.length", "p.bucket").agg(
            F.count(F.lit(1)).alias("n"), (F.min("h") == F.max("h")).alias("single")
        )
        over = cut(sizes.filter(F.col("n") > limit).select("length", "bucket", F.when(F.col("single"), F.ceil(F.col("n") / limit).cast("int")).otherwise(0).alias("salts")))
        n_over = over.count()
        rows = open_.withColumns({"bucket": F.lit(None).cast("binary"), "salts": F.lit(0)})
        if not n_over:
            rows = rows.withColumn("bucket", F.substring("key", 1, first))
        for n in lengths if n_over else ():
            here = over.filter(F.col("length") == n).select(F.col("bucket").alias("_prefix"), F.col("salts").alias("_salts"))
            here = F.broadcast(here) if n_over <= FEW else here
            rows = rows.withColumn("_prefix", F.substring("key", 1, n)).join(here, "_prefix", "left")
            fits = F.col("bucket").isNull() & (F.col("_salts").isNull() | (F.col("_salts") > 0))
            rows = rows.select("rec_id", "key", F.when(fits, F.col("_prefix")).otherwise(F.col("bucket")).alias("bucket"), F.when(fits, F.coalesce("_salts", F.lit(0))).otherwise(F.col("salts")).alias("salts"))
        more = bool(over.filter((F.col("length") == lengths[-1]) & (F.col("salts") == 0)).count())
        rows = cut(rows) if more else rows
        closed = rows.filter(F.col("bucket").isNotNull()) if more else rows
        done = closed if done is None else done.unionByName(closed)
        if not more:
            hot = F.col("salts") > 0
            return done.select("rec_id", "key", "bucket", F.when(hot, F.pmod(F.xxhash64("rec_id"), F.col("salts")).cast("int")).otherwise(0).alias("salt"), hot.alias("hot"))
        open_, first = rows.filter(F.col("bucket").isNull()).select("rec_id", "key"), 16 * first


class Node:
    """Node of a byte trie whose edges hold runs of bytes; `ids` are the records that end here."""

    __slots__ = ("edges", "ids", "label")

    def __init__(self, label: bytes, ids: set[str] | None = None) -> None:
        self.label, self.ids, self.edges = label, ids, {}


class Trie:
    """Counts keys: a terminal is a node with ids."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def add(self, key: bytes, rec_id: str) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.edges.get(key[at])
            if child is None:
                node.edges[key[at]] = Node(key[at:], {rec_id})
                return
            label = child.label
            if not key.startswith(label, at):  # the edge is split where the keys part
                same, most = 1, min(len(label), len(key) - at)
                while same < most and label[same] == key[at + same]:
                    same += 1
                middle = Node(label[:same])
                child.label = label[same:]
                middle.edges[child.label[0]] = child
                node.edges[key[at]] = child = middle
            node = child
            at += len(child.label)
        if node.ids is None:
            node.ids = set()
        node.ids.add(rec_id)

    def terminals(self) -> Iterator[tuple[bytes, set[str]]]:
        """(key, ids) of every key."""
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            path += node.label
            if node.ids is not None:
                yield path, node.ids
            stack += [(path, child) for child in node.edges.values()]


def _tries(least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows in order of their buckets to one row per terminal with at least `least` ids; all of hot buckets."""

    @nonempty
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, now, hot, out = Trie(), None, False, []

        def leave() -> None:
            for key, ids in trie.terminals():
                if hot or len(ids) >= least:
                    keep = min(ids)
                    out.append((key if hot else None, keep, list(ids)))

        for batch in batches:
            for bucket, salt, is_hot, key, rec_id in zip(batch["bucket"], batch["salt"], batch["hot"], batch["key"], batch["rec_id"]):
                if (bucket, salt) != now:
                    leave()
                    trie, now, hot = Trie(), (bucket, salt), is_hot
                trie.add(key, rec_id)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["key", "keep_id", "ids"])
                out = []
        leave()
        yield pd.DataFrame(out, columns=["key", "keep_id", "ids"])

    return run


def copy_counts(keyed: DataFrame, limit: int = 50_000, least: int = 1) -> DataFrame:
    """(keep_id, ids): one row per canonical key with at least `least` records; `keyed` has (rec_id, key).

    The terminals of a hot key come in several rows, one per salt, with the same keep_id.
    """
    rows = radix_buckets(keyed, limit).repartition(width(keyed), "bucket", "salt").sortWithinPartitions("bucket", "salt")
    ends = cut(rows.select("bucket", "salt", "hot", "key", "rec_id").mapInPandas(_tries(least), "key binary, keep_id string, ids array<string>"))
    hot = ends.filter(F.col("key").isNotNull())  # one row per hot key and salt
    kept = hot.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum(F.size("ids")).alias("n")).filter(F.col("n") >= least)
    return ends.filter(F.col("key").isNull()).select("keep_id", "ids").unionByName(hot.drop("keep_id").join(kept, "key").select("keep_id", "ids"))


def hidden_copies(df: DataFrame, id_col: str = "formula_id", name: str = "concept", latex: str = "latex", limit: int = 50_000) -> DataFrame:
    """(keep_id, dup_id): one row per further record of each group of copies."""
    keyed = cut(canonical_records(df, id_col, name, latex))
    return copy_counts(keyed, limit, 2).select("keep_id", F.explode("ids").alias("dup_id")).filter("dup_id <> keep_id")


def collapse(df: DataFrame, id_col: str = "formula_id", name: str = "concept", latex: str = "latex", limit: int = 50_000) -> DataFrame:
    """(keep_id, copies): one row per formula with its number of records; records with a null value stand alone."""
    keyed = cut(canonical_records(df, id_col, name, latex))
    groups = copy_counts(keyed, limit).groupBy("keep_id").agg(F.sum(F.size("ids")).cast("long").alias("copies"))
    alone = df.filter((F.col(name).isNull() | F.col(latex).isNull()) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    return groups.unionByName(alone.distinct())
