"""Changes of the registries as table jobs: chains and monitors are small tables, a change is a join with a change set."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockweft.functions.abi import DESCRIPTOR, decode_by, descriptors, keys_by, parse_signature
from blockweft.functions.filters import STEP, passes, program, row_keys
from blockweft.operators import commitlog
from blockweft.operators.match import REGISTRY, selector

FILTER_VERSION = 1


def _error(message: Column) -> Column:
    return F.raise_error(message).cast("boolean")


def upserted_chains(chains: DataFrame, changes: DataFrame) -> DataFrame:
    """``chains`` (chain_id, rpc_url, enabled) after ``changes`` (op insert/update, chain_id, rpc_url, enabled).

    An insert needs a new id and an address, an update a known id and at least one value; a chain changes once in a
    set. Anything else is an error. Values that an update leaves out stay.
    """
    sums = changes.groupBy("chain_id").agg(F.count(F.lit(1)).alias("times"), F.first("op").alias("op"), F.first("rpc_url").alias("new_url"), F.first("enabled").alias("new_enabled"))
    both = chains.withColumn("known", F.lit(True)).join(sums, "chain_id", "full")
    name = F.concat(F.lit("chain "), F.col("chain_id").cast("string"))
    wrong = (
        F.when(F.col("times") > 1, F.concat(name, F.lit(" changes twice")))
        .when((F.col("op") == "insert") & F.col("known").isNotNull(), F.concat(name, F.lit(" exists")))
        .when((F.col("op") == "insert") & F.col("new_url").isNull(), F.concat(name, F.lit(" has no address")))
        .when((F.col("op") == "update") & F.col("known").isNull(), F.concat(name, F.lit(" is unknown")))
        .when((F.col("op") == "update") & F.col("new_url").isNull() & F.col("new_enabled").isNull(), F.concat(name, F.lit(" changes nothing")))
    )
    sound = both.where(F.when(wrong.isNotNull(), _error(wrong)).otherwise(F.lit(True)))
    return sound.select("chain_id", F.coalesce("new_url", "rpc_url").alias("rpc_url"), F.coalesce("new_enabled", "enabled", F.lit(True)).alias("enabled"))


def set_enabled(monitors: DataFrame, changes: DataFrame) -> DataFrame:
    """Pause and resume: ``changes`` has (id, enabled); cursors and results stay as they are."""
    new = changes.select("id", F.col("enabled").alias("_new"))
    return monitors.join(F.broadcast(new), "id", "left").withColumn("enabled", F.coalesce("_new", "enabled")).select(*monitors.columns)


DEFINITION = "chain_id long, address string, signature string, start_block long, end_block long, filter string, filter_version int"
COMPILED = f"{DEFINITION}, kind string, hash binary, layout string, params array<{DESCRIPTOR}>, program array<{STEP}>, problem string"
#: A registry as it is stored: what a monitor looks for as data, beside the texts that this was read from.
STORED = f"{REGISTRY}, signature string, filter string, filter_version int"


def compiled(definitions: DataFrame) -> DataFrame:
    """``definitions`` (chain_id, address hex, signature, start_block, end_block, and maybe filter and filter_version) with
    what their signatures and filters mean; problem tells what is wrong, if anything. Each different pair of a batch is
    read once, in the tasks."""

    def read(text: str | None, condition: str | None) -> tuple:
        try:
            target = parse_signature(text or "")
            steps = program(json.loads(condition) if condition is not None else None, target)
        except ValueError as error:  # JSON's and the filter's own errors are of this kind as well
            return None, None, None, None, None, str(error)
        return target.kind, target.hash, target.layout, [dict(zip(_names(DESCRIPTOR), d)) for d in descriptors(target)], [dict(zip(_names(STEP), t)) for t in steps], None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            seen: dict[tuple, tuple] = {}
            pairs = [(t, c if isinstance(c, str) else None) for t, c in zip(pdf["signature"], pdf["filter"])]
            for pair in pairs:
                if pair not in seen:
                    seen[pair] = read(*pair)
            more = pd.DataFrame([seen[p] for p in pairs], columns=["kind", "hash", "layout", "params", "program", "problem"], dtype=object, index=pdf.index)
            if len(pdf):
                yield pd.concat([pdf, more], axis=1)

    missing = {c: F.lit(None).cast(t) for c, t in (x.split() for x in DEFINITION.split(", ")) if c not in definitions.columns}
    rows = definitions.withColumns(missing).select(*[x.split()[0] for x in DEFINITION.split(", ")]).mapInPandas(run, COMPILED)
    bad_address = F.when(~F.coalesce(F.col("address").rlike("^[0-9a-fA-F]{40}$"), F.lit(False)), "an address has 20 bytes")
    whole = (F.col("filter").isNull() & F.col("filter_version").isNull()) | (F.col("filter").isNotNull() & F.coalesce(F.col("filter_version") == FILTER_VERSION, F.lit(False)))
    return rows.withColumn("problem", F.coalesce("problem", bad_address, F.when(~whole, "filter and filter_version don't belong together")))


def _names(struct: str) -> list[str]:
    return [field.split(":")[0].strip() for field in struct[len("struct<") : -1].split(",")]


def _kinds(struct: str) -> list[str]:
    return [field.split(":")[1].strip() for field in struct[len("struct<") : -1].split(",")]


def appended(monitors: DataFrame, definitions: DataFrame, chains: DataFrame, heads: DataFrame) -> DataFrame:
    """The registry after ``definitions`` are added with the next ids: all of them, or an error.

    A start that is not given is the finalized head of the chain. Equal targets are allowed.
    """
    here = chains.select("chain_id").join(heads.select("chain_id", "finalized_head"), "chain_id", "left").withColumn("known", F.lit(True))
    rows = compiled(definitions).join(here, "chain_id", "left").withColumn("start_block", F.coalesce("start_block", "finalized_head"))
    wrong = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("known").isNull(), F.concat(F.lit("unknown chain "), F.coalesce(F.col("chain_id").cast("string"), F.lit("null"))))
        .when(F.col("start_block").isNull(), F.lit("no finalized head to start from"))
        .when(F.col("end_block") < F.col("start_block"), F.lit("the end lies before the start"))
    )
    sound = rows.where(F.when(wrong.isNotNull(), _error(wrong)).otherwise(F.lit(True)))
    # a registry is a small table: its new rows are numbered in one partition
    place = F.row_number().over(W.orderBy("chain_id", "address", "signature", "filter", "start_block", "end_block"))
    top = monitors.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = sound.withColumn("place", place).join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("place"))
    new = numbered.withColumn("address", F.unhex("address")).withColumns({"cursor": F.lit(None).cast("long"), "enabled": F.lit(True), "completed": F.lit(False)})
    return monitors.unionByName(new.select(*[c for c in monitors.columns if c in new.columns]), allowMissingColumns=True)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions of a stored registry, each a whole table; one counts once its marker is there."""
    return [n for n in commitlog.numbers(spark, f"{root}/registry") if commitlog.numbers(spark, f"{root}/registry/{n}/done")]


def stored(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest version of the registry under ``root``, or a former one; without any, an empty table."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], STORED)
    chosen = known[-1] if version is None else version
    return spark.read.schema(STORED).parquet(f"{root}/registry/{chosen}/table")


def store(spark: SparkSession, root: str, monitors: DataFrame, after: int | None) -> int:
    """Write ``monitors`` as the version that follows ``after`` (none for the first) and return its number.

    An error if another driver has written that version meanwhile: its change must be read first.
    """
    number = 0 if after is None else after + 1
    if not commitlog.claim(spark, f"{root}/registry/{number}/claim", ""):
        raise ValueError(f"the registry has version {number} already")
    monitors.coalesce(1).write.mode("overwrite").parquet(f"{root}/registry/{number}/table")
    commitlog.claim(spark, f"{root}/registry/{number}/done/0", "")
    return number


def scan(monitors: DataFrame, chain_id: int | None = None) -> DataFrame:
    """The registry, or that of one chain, by id."""
    return (monitors if chain_id is None else monitors.where(F.col("chain_id") == chain_id)).orderBy("id")


def counted(monitors: DataFrame) -> DataFrame:
    """(chain_id, monitors): how many monitors each chain has."""
    return monitors.groupBy("chain_id").agg(F.count(F.lit(1)).alias("monitors"))


def without_chains(chains: DataFrame, monitors: DataFrame, results: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains, monitors and results after the chains of ``gone`` (chain_id) are deleted with all that is theirs."""
    ids = F.broadcast(gone.select("chain_id").distinct())
    return tuple(t.join(ids, "chain_id", "left_anti").select(*t.columns) for t in (chains, monitors, results))


def source_faults(chains: DataFrame, reports: DataFrame) -> DataFrame:
    """(chain_id, reason) of chains whose source doesn't answer, reports another chain, or has no finalized head.

    ``reports`` has (chain_id, reported, finalized_head): what the source registered for a chain says of itself.
    """
    told = reports.select("chain_id", F.lit(True).alias("answers"), "reported", "finalized_head")
    reason = (
        F.when(F.col("answers").isNull(), "no answer")
        .when(~F.coalesce(F.col("reported") == F.col("chain_id"), F.lit(False)), "source of another chain")
        .when(F.col("finalized_head").isNull(), "no finalized head")
    )
    return chains.select("chain_id").join(told, "chain_id", "left").select("chain_id", reason.alias("reason")).where("reason IS NOT NULL")


def monitor_view(monitors: DataFrame) -> DataFrame:
    """What is shown of monitors: a call has a selector, an event a topic0."""
    hash_text = F.concat(F.lit("0x"), F.lower(F.hex("hash")))
    return monitors.select("id", "chain_id", "kind", F.concat(F.lit("0x"), F.lower(F.hex("address"))).alias("address"), F.when(F.col("kind") == "call", hash_text).alias("selector"), F.when(F.col("kind") == "event", hash_text).alias("topic0"), "start_block", "end_block", "cursor", "enabled", "completed")


def chain_view(chains: DataFrame) -> DataFrame:
    """Chains without their addresses, which are never shown; by id."""
    return chains.drop("rpc_url").orderBy("chain_id")


def preview(samples: DataFrame, signature: str, expression: dict | None) -> DataFrame:
    """``samples`` with ok (of the signature and decodable) and matches (passes the filter), without any monitor.

    Samples are rows of transactions for a function, of logs for an event.
    """
    target = parse_signature(signature)
    literal = lambda kind, row: F.struct(*[F.lit(v).cast(t).alias(k) for k, t, v in zip(_names(kind), _kinds(kind), row)])
    params = F.array(*[literal(DESCRIPTOR, d) for d in descriptors(target)]).cast(f"array<{DESCRIPTOR}>")
    steps = F.array(*[literal(STEP, t) for t in program(expression, target)]).cast(f"array<{STEP}>")
    topics = None if target.kind == "call" else F.col("topics")
    mine = (selector(F.col("input")) if topics is None else F.try_element_at("topics", F.lit(1))) == F.lit(target.hash)
    read = decode_by(params, F.expr("substring(input, 5)") if topics is None else F.col("data"), topics)
    rows = samples.select("*", F.inline(F.array(F.struct(read["ok"].alias("_ok"), read["_values"].alias("_values")))))
    rows = rows.withColumn("ok", F.coalesce(mine, F.lit(False)) & F.col("_ok"))
    keys = row_keys({c: F.col(c) for c in samples.columns}, keys_by(params, F.col("_values")))
    return rows.select(*samples.columns, "ok", (F.col("ok") & passes(steps, keys)).alias("matches"))
