"""Results as tables: pages, sink payloads, identity checks, cascading deletes, typed views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweft.functions.abi import Param, Signature, hex0x

MOST_ROWS, USUAL_ROWS = 200, 50


def page(results: DataFrame, monitor_id: int, kind: str, limit: int = USUAL_ROWS, offset: int = 0) -> DataFrame:
    """A page of a monitor's results, newest first; the limit is held between 1 and MOST_ROWS."""
    order = F.desc("tx_hash") if kind == "call" else F.desc("log_index")
    rows = results.where((F.col("monitor_id") == monitor_id) & (F.col("kind") == kind)).orderBy(F.desc("block_number"), order)
    return rows.offset(max(0, offset)).limit(min(MOST_ROWS, max(1, limit)))


def identity(kind: str) -> list[str]:
    return ["monitor_id", "tx_hash"] + (["log_index"] if kind == "event" else [])


def duplicates(results: DataFrame, kind: str) -> DataFrame:
    """Identities that occur more than once, which would fail a commit."""
    return results.where(F.col("kind") == kind).groupBy(*identity(kind)).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def without(results: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """What is left of the results (or of the registry) when monitors or chains are deleted."""
    return results.join(F.broadcast(gone.select(key)), key, "left_anti").select(*results.columns)


def item(kind: Column) -> Column:
    """The JSON of a result: a call with its sender and recipient, an event with its emitter and log index; parameters as an object."""
    text = lambda name, value: F.concat(F.lit(f',"{name}":'), value)
    quoted = lambda name, value: text(name, F.concat(F.lit('"'), hex0x(value), F.lit('"')))
    head = F.concat(F.lit('{"kind":"'), kind, F.lit('","monitor_id":'), F.col("monitor_id").cast("string"), quoted("tx_hash", F.col("tx_hash")))
    call = F.concat(quoted("from", F.col("from_addr")), quoted("to", F.col("to_addr")))
    event = F.concat(quoted("emitter", F.col("address")), text("log_index", F.col("log_index").cast("string")))
    return F.concat(head, F.when(kind == "call", call).otherwise(event), text("params", F.col("params")), F.lit("}"))


def sink_batches(results: DataFrame, monitors: DataFrame) -> DataFrame:
    """(version, chain_id, block_number, n, results): a payload for each block that has results, as a JSON array.

    A result of an unknown monitor, of a monitor of another kind, or one that lacks a field is an error.
    """
    known = monitors.select(F.col("id").alias("monitor_id"), F.col("chain_id").alias("_chain"), F.col("kind").alias("_kind"))
    named = results.join(F.broadcast(known), "monitor_id", "left").withColumn("_item", item(F.col("kind")))
    name = F.concat(F.lit("result of monitor "), F.col("monitor_id").cast("string"))
    wrong = (
        F.when(F.col("_kind").isNull() | (F.col("_chain") != F.col("chain_id")), F.concat(name, F.lit(", which is unknown")))
        .when(F.col("_kind") != F.col("kind"), F.concat(name, F.lit(" is of another kind")))
        .when(F.col("_item").isNull(), F.concat(name, F.lit(" lacks a field")))
    )
    sound = named.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)))
    each = F.struct("kind", "tx_hash", "log_index", "monitor_id", F.col("_item").alias("text"))
    blocks = sound.groupBy("chain_id", "block_number").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(each)).alias("_items"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_items", lambda x: x["text"]), ","), F.lit("]"))
    return blocks.select(F.lit(1).alias("version"), "chain_id", "block_number", "n", text.alias("results"))


def tagged_view(results: DataFrame) -> DataFrame:
    """Results as they are shown: tagged by kind, hashes and addresses as hex, in order of block and log."""
    shown = results.select("monitor_id", "kind", "chain_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), hex0x(F.col("from_addr")).alias("from"), hex0x(F.col("to_addr")).alias("to"), hex0x(F.col("address")).alias("emitter"), F.col("log_index").cast("long").alias("log_index"), "params")
    return shown.sortWithinPartitions("block_number", "log_index")


RESERVED = {"call": ("block_number", "tx_hash"), "event": ("block_number", "tx_hash", "log_index")}


def column_names(signature: Signature) -> list[str]:
    """Result columns of the parameters; one that meets an identity column gets a suffix."""
    taken, out = set(RESERVED[signature.kind]), []
    for p in signature.params:
        name = p.name if p.name not in taken else f"{p.name}_param"
        base, k = name, 1
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name)
        out.append(name)
    return out


def typed_view(results: DataFrame, monitor_id: int, signature: Signature) -> DataFrame:
    """The results of one monitor with a column of its own type for each parameter."""
    rows = results.where(F.col("monitor_id") == monitor_id)

    def value(p: Param) -> Column:
        text = F.get_json_object("params", f"$['{p.name}']")
        if p.type == "bool":
            return text.cast("boolean")
        if p.type.startswith(("uint", "int")):
            bits = int(re.sub(r"\D", "", p.type))
            return text.try_cast("long") if bits < 64 else text.try_cast("decimal(38,0)") if bits <= 120 else text
        return text if p.type == "string" and not p.indexed else F.unhex(F.substring(text, F.lit(3), F.length(text)))

    return rows.select(*RESERVED[signature.kind], *[value(p).alias(c) for p, c in zip(signature.params, column_names(signature), strict=True)])
