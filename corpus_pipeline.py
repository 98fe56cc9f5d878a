"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockweft.llm.common import Scratch, cut, read
from blockweft.llm.decontaminate import without_leaks
from blockweft.llm.jaccard import one_of_each
from blockweft.llm.language import keep_known
from blockweft.llm.mixing import label_quality, repeated
from blockweft.llm.sharding import place, shard_names

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go, and with them null and empty texts and texts without a letter.

    Repeated rows go or stay alike; an empty table stays empty; texts of any length are read whole; other columns go.
    """
    return keep_known(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word n-grams, the one of the smallest doc_id stays.

    Null and empty texts and rows without doc_id stay; rows that repeat a doc_id stay or go together; an empty table
    stays empty; texts of any length are read whole; other columns go.
    """
    return one_of_each(docs.select(*COLUMNS), words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items go.

    Null and empty texts and rows without doc_id stay; of rows that repeat a doc_id all go if one has an item; an empty
    table stays empty, and without a benchmark all stay; texts of any length are read whole; other columns go.
    """
    return without_leaks(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no words and are never taken; a null source is a source; rows without doc_id, or with a
    repeated one, are each taken or not; an empty table stays empty; texts of any length are counted whole; other
    columns go.
    """
    return repeated(docs.select(*COLUMNS), label_quality(read(spark, sf_dir, "labels")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A slot and a shard for each document by its doc_id alone: equal and null ones share a shard; an empty table stays empty."""
    return place(docs.select(*COLUMNS), shard_names())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the first two stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with Scratch() as held:
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        held.keep(docs)
    return docs
