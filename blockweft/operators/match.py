"""Matching of calls and logs to monitors, decoding by layout, and per-monitor filters."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweft.functions.abi import DESCRIPTOR, Signature, decode_by, descriptors, keys_by, parse_signature, text_by
from blockweft.functions.filters import STEP, passes, program, row_keys

read_signature = lru_cache(maxsize=10_000)(parse_signature)


@dataclass(frozen=True)
class Monitor:
    """A row of the registry: what to look for, from which block to which, and how far it has come."""

    id: int
    chain_id: int
    address: str  # hex digits
    signature: str
    start_block: int = 0
    end_block: int | None = None
    cursor: int | None = None
    enabled: bool = True
    completed: bool = False
    filter: dict | None = field(default=None, hash=False)

    def __post_init__(self) -> None:
        if self.id <= 0:
            raise ValueError("a monitor's id is positive")
        if not re.fullmatch("[0-9a-fA-F]{40}", self.address):
            raise ValueError("an address has 20 bytes")
        if self.end_block is not None and self.end_block < self.start_block:
            raise ValueError("the end lies before the start")

    @property
    def target(self) -> Signature:
        return read_signature(self.signature)


REGISTRY = f"id long, chain_id long, kind string, address binary, hash binary, layout string, params array<{DESCRIPTOR}>, program array<{STEP}>, start_block long, end_block long, cursor long, enabled boolean, completed boolean"


def registry(spark: SparkSession, monitors: list[Monitor]) -> DataFrame:
    """The registry as a small table; signatures and filters become data of their rows."""
    rows = []
    for m in monitors:
        t = m.target
        rows.append((m.id, m.chain_id, t.kind, bytes.fromhex(m.address), t.hash, t.layout, descriptors(t), program(m.filter, t), m.start_block, m.end_block, m.cursor, m.enabled, m.completed))
    return spark.createDataFrame(rows, REGISTRY)


#: Most rows of a registry that is sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000


#: Columns of a registry whose logs are fetched in windows (``plans.blocks.fetched``).
FETCHED = ("run_first", "window", "fetch_first", "fetch_last")
#: Marks of a sieve, as a power of two: 2^27 bits are 16 MB, whatever is sieved.
SIEVE_BITS = 27
CALL_KEY = ["chain_id", "block_number", "tx_hash"]


def sized(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table


def targets(monitors: DataFrame, kind: str) -> DataFrame:
    """(m_chain, m_address, m_hash, params, wanted): what active monitors of a kind look for, with those that share a target
    and the names of its parameters in ``wanted``."""
    known = watches(monitors, kind)
    return known.groupBy("m_chain", "m_address", "m_hash", "params").agg(F.collect_list("own").alias("wanted"))


#: Monitors are looked up by cells of blocks, whose widths are powers of four: each lies in one or two cells of its level,
#: the least one whose cells are as wide as its blocks. One without an end, or with more than 4^15 blocks, lies in the
#: one cell of the last level.
LAST_LEVEL = 16


def _cell(block: Column, level: Column) -> Column:
    return F.when(level == LAST_LEVEL, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", block, level * 2))


def watches(monitors: DataFrame, kind: str) -> DataFrame:
    """(m_chain, m_address, m_hash, params, own, m_first, m_last, m_level): the blocks (m_last null: no end) in which an
    active monitor of a kind can need anything, with the level of its cells; ``own`` has what is asked of it later."""
    first, last = F.greatest("start_block", F.col("cursor") + 1), F.col("end_block")
    if set(FETCHED) <= set(monitors.columns):
        first, last = F.least(first, F.col("fetch_first")), F.greatest(last, F.col("fetch_last"))
    own = F.struct("id", "start_block", "end_block", "cursor", "program", *[c for c in FETCHED if c in monitors.columns])
    rows = active(monitors).where(F.col("kind") == kind).select(F.col("chain_id").alias("m_chain"), F.col("address").alias("m_address"), F.col("hash").alias("m_hash"), "params", own.alias("own"), first.alias("m_first"), last.alias("m_last"))
    reach = F.col("m_last") - F.col("m_first")
    level = reduce(lambda a, b: a + b, [(reach >= 4**k).cast("int") for k in range(LAST_LEVEL)])
    return rows.withColumn("m_level", F.coalesce(level, F.lit(LAST_LEVEL))).where("m_last IS NULL OR m_first IS NULL OR m_first <= m_last")


def watched(rows: DataFrame, address: str, monitors: DataFrame, kind: str, small: bool) -> DataFrame:
    """``rows`` (with chain_id, block_number, hash and an address) with params and ``wanted``: the monitors of their target
    in the cells of their block, which the caller holds against the block itself.

    Monitors that share a target, names of parameters and a cell are one list, so a payload is decoded and shown once for
    all of them; a row meets one list for each level that monitors of its target have there. Lists are as long as
    monitors overlap, however many there are.
    """
    known = watches(monitors, kind)
    # which levels there are and where: by target, or by chain alone where targets may be too many to be sent to all executors
    by = {"m_chain": "chain_id", "m_address": address, "m_hash": "hash"} if small else {"m_chain": "chain_id"}
    ends = known.groupBy(*by).agg(F.collect_set("m_level").alias("_levels"), F.min("m_first").alias("_low"), F.max(F.coalesce("m_last", F.lit((1 << 63) - 1))).alias("_high"))
    block = F.col("block_number")
    near = reduce(lambda a, b: a & b, [F.col(c) == F.col(m) for m, c in by.items()]) & block.between(F.col("_low"), F.col("_high"))
    placed = rows.join(F.broadcast(ends), near).select(*rows.columns, F.explode("_levels").alias("_level"))
    placed = placed.withColumn("_cell", _cell(block, F.col("_level")))
    cells = F.array_distinct(F.array(_cell(F.col("m_first"), F.col("m_level")), _cell(F.col("m_last"), F.col("m_level"))))
    lists = known.select("m_chain", "m_address", "m_hash", "params", "own", "m_level", F.explode(cells).alias("m_cell")).groupBy("m_chain", "m_address", "m_hash", "m_level", "m_cell", "params").agg(F.collect_list("own").alias("wanted"))
    on = [F.col(c) == F.col(m) for m, c in {"m_chain": "chain_id", "m_address": address, "m_hash": "hash", "m_level": "_level", "m_cell": "_cell"}.items()]
    return placed.join(sized(lists, small), on).select(*rows.columns, "params", "wanted")


def needed(block: Column) -> Column:
    """Those of ``wanted`` that still need a block."""
    return F.filter("wanted", lambda w: _needs(w, block))


def _needs(w: Column, block: Column) -> Column:
    return (w["start_block"] <= block) & (w["end_block"].isNull() | (block <= w["end_block"])) & (w["cursor"].isNull() | (w["cursor"] < block))


def active(monitors: DataFrame) -> DataFrame:
    return monitors.where("enabled AND NOT completed")


def covers(block: Column) -> Column:
    return F.col("enabled") & ~F.col("completed") & (F.col("start_block") <= block) & (F.col("end_block").isNull() | (block <= F.col("end_block")))


def needs_block(block: Column) -> Column:
    return covers(block) & (F.col("cursor").isNull() | (F.col("cursor") < block))


def selector(data: Column) -> Column:
    return F.when(F.length(data) >= 4, F.substring(data, 1, 4))


def receipts_by_call(receipts: DataFrame) -> DataFrame:
    """One row a call (chain_id, block_number, tx_hash): succeeded, and copies, the number of its receipts."""
    return receipts.groupBy("chain_id", "block_number", "tx_hash").agg(F.max("succeeded").alias("succeeded"), F.count(F.lit(1)).alias("copies"))


def receipt_fault() -> Column:
    """What is wrong with the receipts of a call that was joined to ``receipts_by_call``."""
    return F.when(F.col("copies").isNull(), F.lit("no receipt")).when(F.col("copies") > 1, F.lit("several receipts")).when(F.col("succeeded").isNull(), F.lit("receipt without status"))


def call_candidates(txs: DataFrame, monitors: DataFrame) -> DataFrame:
    """Transactions that some active monitor needs; receipts are looked at for these only."""
    keyed = txs.where("to_addr IS NOT NULL").withColumn("hash", selector(F.col("input"))).where("hash IS NOT NULL")
    wanted = active(monitors).where("kind = 'call'").withColumnRenamed("chain_id", "m_chain").withColumnRenamed("hash", "m_hash").withColumnRenamed("address", "m_address")
    on = (F.col("chain_id") == F.col("m_chain")) & (F.col("to_addr") == F.col("m_address")) & (F.col("hash") == F.col("m_hash")) & needs_block(F.col("block_number"))
    return keyed.join(F.broadcast(wanted), on, "left_semi")


def called(txs: DataFrame, monitors: DataFrame, small: bool = True) -> DataFrame:
    """The candidates: transactions that call a target which monitors need, with those monitors in ``wanted``."""
    keyed = txs.where("to_addr IS NOT NULL").withColumn("hash", selector(F.col("input"))).where("hash IS NOT NULL")
    found = watched(keyed, "to_addr", monitors, "call", small).withColumn("wanted", needed(F.col("block_number"))).where(F.size("wanted") > 0)
    return found.select(*CALL_KEY, "tx_index", "from_addr", "to_addr", F.expr("substring(input, 5)").alias("body"), "params", "wanted")


def _mark() -> Column:
    return F.pmod(F.xxhash64(*CALL_KEY), F.lit(1 << SIEVE_BITS))


def sieved(receipts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Receipts whose mark is one of a candidate's: all of candidates and few others.

    The marks are bitmaps of 4 kB, 2^SIEVE_BITS / 32768 of them at most, so they can be sent to all executors however
    many candidates there are; with very many, more of the other receipts pass, and the join sorts them out.
    """
    marks = candidates.select(_mark().alias("_mark")).groupBy(F.bitmap_bucket_number("_mark").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_mark")).alias("_bits"))
    rows = receipts.withColumn("_mark", _mark()).withColumn("_bucket", F.bitmap_bucket_number("_mark")).withColumn("_bit", F.bitmap_bit_position("_mark"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright("_bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    power = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.col("_bit") % 8 + 1).cast("int"))
    return rows.join(F.broadcast(marks), "_bucket").where(byte.bitwiseAND(power) != 0).select(*receipts.columns)


def settled(candidates: DataFrame, receipts: DataFrame, strict: bool = True, count: int | None = None) -> DataFrame:
    """Candidates that succeeded; see ``matched_calls``.

    ``count`` tells how many candidates there are, where they are a written table. Then only their receipts are
    shuffled: a small set of candidates is sent to the receipts, of a larger one the marks are (``sieved``).
    """
    if count is not None:
        few = count <= BROADCAST_ROWS
        receipts = receipts.join(F.broadcast(candidates.select(*CALL_KEY)), CALL_KEY, "left_semi") if few else sieved(receipts, candidates)
    joined = candidates.join(receipts_by_call(receipts), CALL_KEY, "left")
    bad = receipt_fault()
    wrong = F.raise_error(F.concat(bad, F.lit(" for "), F.hex("tx_hash"))).cast("boolean") if strict else F.lit(True)
    found = joined.where(F.when(bad.isNotNull(), wrong).otherwise(F.col("succeeded")))
    return found.select("chain_id", "block_number", "tx_index", "tx_hash", "from_addr", "to_addr", "body", "params", "wanted", bad.alias("fault"))


def matched_calls(txs: DataFrame, receipts: DataFrame, monitors: DataFrame, strict: bool = True, small: bool = True) -> DataFrame:
    """One row for each successful transaction and list of monitors (``watched``) of which some need it, with those in ``wanted``.

    Each candidate has one receipt in its block. With ``strict`` anything else is an error; else such rows carry what is
    wrong in ``fault``. ``small`` tells that the registry has BROADCAST_ROWS rows at most.
    """
    return settled(called(txs, monitors, small), receipts, strict)


def receipt_faults(txs: DataFrame, receipts: DataFrame, monitors: DataFrame) -> DataFrame:
    """(chain_id, block_number, reason) of candidates without one receipt of a known status."""
    return _faults(matched_calls(txs, receipts, monitors, strict=False)).distinct()


def _faults(matched: DataFrame) -> DataFrame:
    return matched.where("fault IS NOT NULL").select("chain_id", "block_number", F.col("fault").alias("reason"))


def _strays(logs: DataFrame) -> Column:
    """Whether a log's block lies outside the range it was asked for (first_block, last_block), if the table has that."""
    if not {"first_block", "last_block"} <= set(logs.columns):
        return F.lit(False)
    return F.col("first_block").isNotNull() & ~F.coalesce(F.col("block_number").between(F.col("first_block"), F.col("last_block")), F.lit(False))


def fetch_fault(logs: DataFrame) -> Column:
    """What is wrong with a log that says the same of all that was fetched with it."""
    return F.when(F.col("removed"), F.lit("removed log")).when(_strays(logs), F.lit("log outside the range asked for"))


def log_fault(logs: DataFrame) -> Column:
    """What is wrong with a log of ``logs``."""
    own = F.when(F.col("tx_hash").isNull(), F.lit("log without transaction hash")).when(F.col("log_index").isNull(), F.lit("log without index"))
    return F.coalesce(fetch_fault(logs), own)


def matched_events(logs: DataFrame, monitors: DataFrame, strict: bool = True, small: bool = True) -> DataFrame:
    """One row for each log and list of monitors (``watched``) of which some need it, with those in ``wanted``. Logs without
    topics are passed over.

    Finalized logs carry all their fields, lie where they were asked for and are never removed. With ``strict`` anything
    else is an error; else such rows carry what is wrong in ``fault``. A log outside its range says nothing reliable about
    its block, so it counts for the first block of that range that a monitor still needs.

    Where the registry tells the windows that logs are fetched in (FETCHED), a removed or stray log counts for the
    start of its window, whichever block of the window a monitor of its target needs: all that came with it is in
    doubt. A log without hash or index is known to be of its block and counts for that.
    """
    keyed = logs.withColumn("hash", F.try_element_at("topics", F.lit(1))).where("hash IS NOT NULL")
    block, strays, bad, spoilt = F.col("block_number"), _strays(logs), log_fault(logs), fetch_fault(logs).isNotNull()
    ranged, windows = {"first_block", "last_block"} <= set(logs.columns), set(FETCHED) <= set(monitors.columns)

    def at(w: Column) -> Column:
        first = w["fetch_first"] if windows else F.coalesce(w["cursor"] + 1, w["start_block"])
        return F.when(strays, F.greatest(F.col("first_block"), first)).otherwise(block) if ranged else block

    def wants(w: Column) -> Column:
        needs = _needs(w, at(w))
        if windows:
            needs = F.when(spoilt, at(w).between(w["fetch_first"], w["fetch_last"])).otherwise(needs)
        return needs & (~strays | (at(w) <= F.col("last_block"))) if ranged else needs

    found = watched(keyed.where(~strays), "address", monitors, "event", small).withColumn("wanted", F.filter("wanted", wants)).where(F.size("wanted") > 0)
    if ranged:
        # a stray log has no block to be looked up by: it is held against each monitor of its target
        on = (F.col("chain_id") == F.col("m_chain")) & (F.col("address") == F.col("m_address")) & (F.col("hash") == F.col("m_hash"))
        lost = keyed.where(strays).withColumn("_row", F.monotonically_increasing_id())
        pairs = lost.join(sized(watches(monitors, "event"), small), on).where(wants(F.col("own")))
        found = found.unionByName(pairs.groupBy("_row", *keyed.columns, "params").agg(F.collect_list("own").alias("wanted")).drop("_row"))
    if strict:
        found = found.where(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True)))
    start = lambda w: at(w) - (at(w) - w["run_first"]) % w["window"] if windows else at(w)
    where = F.when(spoilt if windows else strays, F.array_min(F.transform("wanted", start))).otherwise(block)
    return found.select("chain_id", where.alias("block_number"), "log_index", "tx_hash", "address", "topics", "data", "params", "wanted", bad.alias("fault"))


def log_faults(logs: DataFrame, monitors: DataFrame) -> DataFrame:
    """(chain_id, block_number, reason) of faulty logs that some active monitor needs."""
    return _faults(matched_events(logs, monitors, strict=False)).distinct()


def decoded(matched: DataFrame) -> DataFrame:
    """``matched`` with a row for each monitor whose filter passes: monitor_id, ok (boolean) and params (canonical JSON).

    Rows that can't be decoded keep ok = false and no params, and filters apply to decoded rows only. Faulty rows keep
    their fault, of no monitor. Signatures, names and filters are data, so the plan is the same for any number of them.
    """
    is_call = "body" in matched.columns
    data, topics = (F.col("body"), None) if is_call else (F.col("data"), F.col("topics"))
    base = [c for c in matched.columns if c not in ("body", "topics", "data", "params", "wanted", "fault")]
    sound = F.col("fault").isNull()
    rows = matched.select(*base, "fault", "params", "wanted", F.inline(F.array(decode_by(F.col("params"), data, topics))))
    good = sound & F.col("ok")
    asked = F.exists("wanted", lambda w: F.size(w["program"]) > 0)
    keys = F.when(good & asked, row_keys({c: F.col(c) for c in base}, keys_by(F.col("params"), F.col("_values"))))
    # each of these is worked out once for a row, however many monitors want it; the text is a column beside, so that
    # readers who ask for none of it don't pay for it
    rows = rows.select(*base, "fault", "wanted", "params", "_values", F.inline(F.array(F.struct(good.alias("ok"), keys.alias("_keys")))))
    rows = rows.withColumn("params", F.when(F.col("ok"), text_by(F.col("params"), F.col("_values"))))
    fits = F.transform(F.filter("wanted", lambda w: ~F.col("ok") | passes(w["program"], F.col("_keys"))), lambda w: w["id"])
    ids = F.when(F.col("fault").isNull(), fits).otherwise(F.array(F.lit(None).cast("long")))
    return rows.select(*base, F.explode(ids).alias("monitor_id"), "ok", "params", "fault")


def outcomes(txs: DataFrame, receipts: DataFrame, logs: DataFrame, monitors: DataFrame, strict: bool = False, small: bool = True, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Decoded calls and events of all monitors, those that can't be decoded, and faults, in one pass over each table.

    ``keep`` writes a table under a name and gives it back. With it, matched events are written before anything is
    decoded, which tells each chain's first block with a faulty log: what lies behind it can't be committed, so neither
    calls nor events are decoded there, and of later faults none is told. The candidates of calls are written as well,
    and receipts are looked at for these only.
    """
    matched = matched_events(logs, monitors, strict, small)
    if keep:
        matched = keep("events", matched)
        first = matched.where("fault IS NOT NULL").groupBy("chain_id").agg(F.min("block_number").alias("bad")).collect()  # one row a chain
        useful = reduce(lambda a, b: a & b, [(F.col("chain_id") != r["chain_id"]) | (F.col("block_number") <= r["bad"]) for r in first], F.lit(True))
        txs, receipts, matched = txs.where(useful), receipts.where(useful), matched.where(useful)
    candidates = called(txs, monitors, small)
    stored = keep("calls", candidates) if keep else candidates
    calls = decoded(settled(stored, receipts, strict, stored.count() if keep else None))
    calls = calls.select("chain_id", "monitor_id", F.lit("call").alias("kind"), "block_number", "tx_hash", "from_addr", "to_addr", "ok", "params", "fault")
    events = decoded(matched)
    events = events.select("chain_id", "monitor_id", F.lit("event").alias("kind"), "block_number", "tx_hash", F.col("log_index").cast("long").alias("log_index"), "address", "ok", "params", "fault")
    return calls.unionByName(events, allowMissingColumns=True)


def indexed(txs: DataFrame, receipts: DataFrame, logs: DataFrame, monitors: list[Monitor]) -> DataFrame:
    """Decoded calls and events of all monitors in one table; rows that can't be decoded are left out."""
    table = registry(txs.sparkSession, monitors)
    return outcomes(txs, receipts, logs, table, strict=True, small=len(monitors) <= BROADCAST_ROWS).where("ok").drop("ok", "fault")
