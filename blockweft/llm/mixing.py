"""Mixing of sources to target weights by exponential keys and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Scratch, cut, read

#: Weights that the sources get in turn, the share of all words that the mix has, the most copies of a source,
#: and the quality weights of documents that are labelled good, not labelled, labelled bad.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
QUALITY = (2.0, 1.0, 0.5)
#: Bins of keys for each source; a bin that a budget ends in is sorted by one task.
BINS = 4096


def word_count(text: Column) -> Column:
    """The runs of other characters than white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with target: the share of all words dealt by weight, under a cap.

    Sources take the weights in turn, in code point order, null last. The water level L solves
    sum(min(most * size, L * weight)) = share * sum(size); sources in order of most * size / weight fill up first.
    """
    n = len(weights)
    # the window runs over the sources, not over the documents
    ordered = sizes.withColumn("_at", F.row_number().over(W.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % n + 1).cast("int"))
    ranked = ordered.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(most)).withColumn("_fill", F.col("_cap") / F.col("_w"))
    before = W.orderBy("_fill", "_at").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    budget = F.sum("source_size").over(every) * float(share)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("_level", level)
    # the level of the first source that does not fill up holds for it and all after it
    final = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_at", "_level"))).over(every)["_level"]
    return leveled.withColumn("_final", final).select("source", "source_size", F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_w"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, bins: int = BINS, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, epochs, chosen, taken,
    and the columns that ``carry`` names, as they are.

    Each source takes whole epochs while its target allows, then the documents of the smallest exponential keys
    -ln(u) / quality until their words come nearest to what is left: a document is chosen if its middle word lies
    within the budget. ``quality`` has a positive weight for a doc_id (the largest holds where it is repeated);
    without one it is 1. Null and empty texts have size 0 and are never chosen. Null sources form one source. Equal
    keys are ordered by doc_id; rows repeated under one doc_id are ordered by size and otherwise alike. The u is a
    hash of doc_id, so reruns agree. An empty table gives an empty result; texts of any length are counted whole; other
    columns are ignored.
    """
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry)
    if quality is not None:
        known = quality.select(F.col("doc_id"), F.col("weight").cast("double").alias("weight")).groupBy("doc_id").agg(F.max("weight").alias("weight"))
        base = base.join(known, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        base = base.withColumn("weight", F.lit(1.0))
    base = base.withColumn("key", -F.log(uniform(F.col("doc_id"))) / F.col("weight"))
    # keys to bins of like numbers, in order; bins don't change the result
    base = base.withColumn("bin", F.least(F.lit(bins - 1), F.floor((1 - F.exp(-F.col("key"))) * bins)).cast("int"))
    base = cut(base.select("doc_id", "source", "size", "key", "bin", *carry), "mix-sizes")

    by_bin = cut(base.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    targets = source_targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    # at most `bins` rows for each source
    prior = F.coalesce(F.sum("bin_size").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    named = targets.withColumnRenamed("source", "_source")
    dealt = by_bin.withColumn("prior", prior).join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "bin_size")
    dealt = cut(dealt, "mix-targets").withColumnRenamed("source", "_source").withColumnRenamed("bin", "_bin")
    # both columns are keys: even a source with a third of all rows is spread over its bins
    rows = base.join(dealt, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin"))).drop("_source", "_bin")
    inside = W.partitionBy("source", "bin").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("prior") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    chosen = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest")) & (F.col("epochs") < most)
    return rows.withColumn("chosen", chosen).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "chosen", (F.col("size") * (F.col("epochs") + F.col("chosen").cast("int"))).cast("long").alias("taken"), *carry
    )


def repeated(docs: DataFrame, quality: DataFrame | None = None, **how: float) -> DataFrame:
    """Each row of ``docs``, all columns, as often as the mix takes it; rows without doc_id, or with a repeated one, too.

    Rows of one doc_id, source and text are the same document several times; where a budget ends among them, one of
    them stands for as many copies as all of them are taken. Nulls, ties and empty tables are handled as in ``mix``.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    with Scratch() as held:
        taken = mix(docs.withColumn("_text", digest), quality, carry=("_text",), **how)
        times = F.col("epochs") + F.col("chosen").cast("int")
        by_row = taken.groupBy("doc_id", "source", "_text").agg(F.min(times).alias("low"), F.max(times).alias("high"), F.sum(times).alias("total"))
        by_row = cut(by_row.where("high > 0").withColumnsRenamed({"doc_id": "_id", "source": "_source"}), "mix-taken")
        held.keep(by_row)
    rows = docs.withColumn("_hash", digest)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_text"))
    out = rows.join(by_row.where("low = high"), same).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("low").cast("int")))).select(*docs.columns)
    ends = by_row.where("low < high")  # one group for each source at most
    if not ends.isEmpty():
        some = rows.join(F.broadcast(ends), same).dropDuplicates(["doc_id", "source", "_hash"])
        out = out.unionByName(some.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("total")))).select(*docs.columns))
    return out


def label_quality(labels: DataFrame) -> DataFrame:
    good, none, bad = QUALITY
    return labels.select("doc_id", F.when(F.col("quality") == 1, good).when(F.col("quality") == 0, bad).otherwise(none).alias("weight"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), label_quality(read(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)
           / coalesce(weight, 1.0) AS key
  FROM documents LEFT JOIN (
    SELECT doc_id AS label_id, max(CASE WHEN quality = 1 THEN 2.0 WHEN quality = 0 THEN 0.5 ELSE 1.0 END) AS weight
    FROM labels GROUP BY doc_id) ON doc_id = label_id),
sources AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
ranked AS (
  SELECT *, {float(MOST)} * source_size AS cap, {float(MOST)} * source_size / w AS fill,
         row_number() OVER (ORDER BY {float(MOST)} * source_size / w, source NULLS LAST) AS pos FROM sources),
leveled AS (
  SELECT *, ({SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ranked),
first_open AS (SELECT level AS final FROM leveled WHERE level <= fill ORDER BY pos LIMIT 1),
targets AS (SELECT source, source_size, least(cap, final * w) AS target FROM leveled CROSS JOIN first_open),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS epochs FROM targets),
ordered AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN parts ON sized.source IS NOT DISTINCT FROM parts.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN size > 0 AND before + size / 2.0 <= rest AND epochs < {MOST} THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""
