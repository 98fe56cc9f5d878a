"""Exact deduplication by skew-safe combining of equal texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup, read

#: Salt groups that the copies of one text are spread over.
SALTS = 8


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, text, keep_id, group_size): one row for each different text.

    Three stages, each of which compares whole texts: the map side of the first aggregate removes copies within a
    task, its reduce side merges salted digest groups, and the second aggregate combines the winners of the salts.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("tinyint"))
    merged = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return merged.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts keep the row with the largest doc_id. A null text counts as empty; an empty text is a text like any
    other. Repeated rows of one doc_id are the same document and share ``kept``. Null doc_ids lose to all others; a
    group of null doc_ids only keeps them all. An empty table gives an empty result; other columns are ignored.
    Texts with equal digests but different content are told apart by content.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("digest", digest(F.col("text")))
    groups = exact_groups(rows, salts)
    by_digest = groups.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents"))
    known = cut(by_digest, "dedup-winners")
    ids = rows.select("doc_id", "digest")
    total = docs.count()
    clash = known.where("contents > 1").select("digest")
    plain = lookup(ids, known.where("contents = 1").drop("contents"), "digest", "group_size", total)
    if not clash.isEmpty():
        plain = plain.join(clash, "digest", "left_anti")
        doubtful = rows.join(clash, "digest", "left_semi")
        exact = exact_groups(doubtful, salts)
        plain = plain.unionByName(doubtful.join(exact, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size").unionByName(plain.limit(0)))
    shown = F.lower(F.hex("digest")) if digest is sha256 else F.col("digest").cast("string")
    return plain.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), shown.alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
"""
