"""JSON-RPC responses as tables: dumps of blocks, receipts and logs, and a ranged log reader that halves ranges.

A dump is text, one response a line (``{"request": ..., "result": ...}``). Rows that fail a check keep a reason and go
to a table of rejects; in strict mode they are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "request struct<chain_id: bigint, number: bigint>, result struct<number: string, transactions: array<struct<hash: string, `from`: string, `to`: string, input: string>>>"
RECEIPTS = "request struct<chain_id: bigint, number: bigint, hashes: array<string>>, result array<struct<transactionHash: string, status: string>>"
LOGS = "request struct<chain_id: bigint, from_block: bigint, to_block: bigint>, result array<struct<address: string, topics: array<string>, data: string, blockNumber: string, transactionHash: string, logIndex: string, removed: boolean>>"


def quantity(text: Column) -> Column:
    """A hex quantity as long; null if it is none or needs more than 63 bits."""
    good = text.rlike("^0x[0-9a-fA-F]{1,16}$")
    wide = F.conv(F.substring(text, 3, 16), 16, 10).cast("decimal(20,0)")
    return F.when(good, wide.try_cast("long"))


def data(text: Column, size: int | None = None) -> Column:
    """Hex data as binary, null if it is none or not of ``size`` bytes."""
    # a class is repeated, not a group
    whole = text.rlike("^0x[0-9a-fA-F]*$") & (F.length(text) % 2 == 0) if size is None else text.rlike(f"^0x[0-9a-fA-F]{{{2 * size}}}$")
    return F.when(whole, F.unhex(F.substring(text, F.lit(3), F.length(text))))


def parsed(dump: DataFrame, schema: str) -> DataFrame:
    """(request, result) of each line of ``dump`` (value string); both null where a line can't be read."""
    return dump.select(F.from_json("value", schema).alias("r")).select("r.request", "r.result")


def block_rejects(dump: DataFrame) -> DataFrame:
    """(chain_id, block_number, reason) of block responses that don't answer their request."""
    r = parsed(dump, BLOCK)
    return r.select(F.col("request.chain_id").alias("chain_id"), F.col("request.number").alias("block_number"), _block_reason().alias("reason")).where("reason IS NOT NULL")


def _block_reason() -> Column:
    hashes_only = F.exists("result.transactions", lambda t: t.isNull() | t["hash"].isNull() | t["input"].isNull())
    return (
        F.when(F.col("request.number").isNull(), "unreadable response")
        .when(F.col("result").isNull(), "no such block")
        .when(~F.coalesce(quantity(F.col("result.number")) == F.col("request.number"), F.lit(False)), "another block than asked for")
        .when(F.col("result.transactions").isNull() | F.coalesce(hashes_only, F.lit(False)), "transactions are not whole")
    )


def transactions_of(dump: DataFrame, strict: bool = False) -> DataFrame:
    """Transactions of block responses; contract creations are left out, and so are rejected blocks unless ``strict``."""
    reason = _block_reason()
    bad = F.raise_error(reason).cast("boolean") if strict else F.lit(False)
    sound = parsed(dump, BLOCK).where(F.when(reason.isNotNull(), bad).otherwise(F.lit(True)))
    each = sound.select(F.col("request.chain_id").alias("chain_id"), F.col("request.number").alias("block_number"), F.posexplode("result.transactions").alias("tx_index", "t"))
    return each.where("t.to IS NOT NULL").select("chain_id", "block_number", "tx_index", data(F.col("t.hash"), 32).alias("tx_hash"), data(F.col("t.from"), 20).alias("from_addr"), data(F.col("t.to"), 20).alias("to_addr"), data(F.col("t.input")).alias("input"))


ANSWERED = ["chain_id", "block_number", "tx_hash"]


def receipts_answered(dump: DataFrame, by_place: bool = False) -> DataFrame:
    """(chain_id, block_number, tx_hash, succeeded, reason): one row for each hash that a request asks for.

    ``by_place``: the answers are those of single requests, in the order of the hashes (null where there is none), so
    each must be of the hash at its place; a hash that is asked for twice has two rows. Otherwise an answer holds all
    receipts of a block in any order, of which the asked ones are taken; of two receipts of one hash the later counts.
    ``reason`` is null where an answer is sound. A line that can't be read is a row with nothing but its reason.
    """
    # a line is read once, and its answers go on as the rows of one array
    line = dump.select(F.inline(F.array(F.from_json("value", RECEIPTS))))
    told = line.select(F.col("request.chain_id").alias("chain_id"), F.col("request.number").alias("block_number"), F.col("request.hashes").alias("hashes"), "result", F.col("result").isNotNull().alias("answered"))
    unread = F.col("chain_id").isNull() | F.col("block_number").isNull() | F.col("hashes").isNull()
    status = F.when(F.col("succeeded").isNull(), "receipt without status")
    none = lambda kind: F.lit(None).cast(kind)
    entry = lambda asked, text, own, place, code, unread=False: F.struct(F.lit(unread).alias("unread"), asked.alias("asked"), text.alias("text"), own.alias("own"), place.alias("place"), code.alias("status"))
    lost = F.array(entry(F.lit(True), none("string"), none("string"), none("int"), none("string"), unread=True))
    if by_place:
        entries = F.transform("hashes", lambda h, k: entry(F.lit(True), h, F.get("result", k)["transactionHash"], F.when(F.get("result", k).isNotNull(), k), F.get("result", k)["status"]))
    else:
        # asked and told hashes meet in one group, so a block of any size is linear
        asked = F.transform("hashes", lambda h: entry(F.lit(True), h, none("string"), none("int"), none("string")))
        given = F.transform("result", lambda t, k: entry(F.lit(False), t["transactionHash"], none("string"), k, t["status"]))
        entries = F.when(F.col("answered"), F.concat(asked, given)).otherwise(asked)
    each = told.select("chain_id", "block_number", "answered", F.inline(F.when(unread, lost).otherwise(entries)))
    each = each.select("chain_id", "block_number", "answered", "unread", "asked", "place", data(F.col("text"), 32).alias("tx_hash"), data(F.col("own"), 32).alias("own"), (quantity(F.col("status")) == 1).alias("succeeded"))
    if by_place:
        found, right = F.col("place").isNotNull(), F.coalesce(F.col("own") == F.col("tx_hash"), F.lit(False))
        reason = F.when(~F.col("answered"), "no answer").when(~found, "no receipt").when(~right, "another receipt than asked for").otherwise(status)
    else:
        # the place and the status of a receipt as one number, as numbers are combined without a sort; lines that can't be read keep apart
        told_as = F.when(~F.col("asked"), F.col("place").cast("long") * 4 + F.when(F.col("succeeded").isNull(), 0).when(F.col("succeeded"), 2).otherwise(1))
        alone = F.when(F.col("unread"), F.monotonically_increasing_id())
        sums = each.withColumn("_alone", alone).groupBy(*ANSWERED, "_alone").agg(F.bool_or(F.when(F.col("asked"), F.col("answered"))).alias("answered"), F.max(told_as).alias("told"))
        each = sums.where("answered IS NOT NULL").withColumn("unread", F.col("_alone").isNotNull()).withColumn("succeeded", F.when(F.col("told") % 4 > 0, F.col("told") % 4 == 2))
        reason = F.when(~F.col("answered"), "no answer").when(F.col("told").isNull(), "no receipt").otherwise(status)
    rows = each.withColumn("reason", F.when(F.col("unread"), "unreadable response").when(F.col("tx_hash").isNull(), "no hash was asked for").otherwise(reason))
    return rows.select(*ANSWERED, F.when(F.col("reason").isNull(), F.col("succeeded")).alias("succeeded"), "reason")


def receipts_of(dump: DataFrame, by_place: bool = False, strict: bool = False) -> DataFrame:
    """Sound receipts of responses; others are left out (a candidate then has no receipt), or an error with ``strict``."""
    bad = F.raise_error(F.concat("reason", F.lit(": "), F.coalesce(F.hex("tx_hash"), F.lit("a line")))).cast("boolean") if strict else F.lit(False)
    return receipts_answered(dump, by_place).where(F.when(F.col("reason").isNotNull(), bad).otherwise(F.lit(True))).select(*ANSWERED, "succeeded")


def logs_of(dump: DataFrame) -> DataFrame:
    """Logs of responses, with the range asked for where a request tells it; number, hash and index stay null where a response lacks them."""
    each = parsed(dump, LOGS).select(F.col("request.chain_id").alias("chain_id"), F.col("request.from_block").alias("first_block"), F.col("request.to_block").alias("last_block"), F.explode("result").alias("t"))
    return each.select(
        "chain_id",
        "first_block",
        "last_block",
        quantity(F.col("t.blockNumber")).alias("block_number"),
        quantity(F.col("t.logIndex")).alias("log_index"),
        data(F.col("t.transactionHash"), 32).alias("tx_hash"),
        data(F.col("t.address"), 20).alias("address"),
        F.transform("t.topics", lambda t: data(t, 32)).alias("topics"),
        data(F.col("t.data")).alias("data"),
        F.coalesce("t.removed", F.lit(False)).alias("removed"),
    )


class RangeLimit(Exception):
    """The provider answers no range as long, or no result as large, as asked for."""


Fetch = Callable[[int, int, int, list[str], list[str]], list[str]]


def halved(fetch: Fetch, chain_id: int, low: int, high: int, addresses: list[str], topics: list[str]) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, response lines) in order of blocks; a range that meets a limit is halved, a single block that does is an error."""
    todo = [(low, high)]
    while todo:
        low, high = todo.pop()
        try:
            lines = fetch(chain_id, low, high, addresses, topics)
        except RangeLimit:
            if low == high:
                raise
            middle = (low + high) // 2
            todo += [(middle + 1, high), (low, middle)]
            continue
        yield low, high, lines


def fetched_logs(windows: DataFrame, groups: DataFrame, fetch: Fetch) -> DataFrame:
    """(value string): log responses for block windows (chain_id, from_block, to_block) and request groups.

    ``fetch(chain_id, from, to, addresses, topics)`` gives response lines or raises RangeLimit; then the range is
    halved and both halves are asked for, until single blocks, of which a limit is an error, like any other failure.
    Each request is a row, so requests are spread over tasks and repeated when an executor is lost.
    """
    asked = windows.join(F.broadcast(groups), "chain_id").select("chain_id", "from_block", "to_block", F.transform("addresses", lambda a: F.lower(F.hex(a))).alias("addresses"), F.transform("topics", lambda t: F.lower(F.hex(t))).alias("topics"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples():
                for _, _, lines in halved(fetch, int(row.chain_id), int(row.from_block), int(row.to_block), list(row.addresses), list(row.topics)):
                    if lines:  # an empty frame has no types
                        yield pd.DataFrame({"value": lines})

    return asked.repartition("chain_id", "from_block").mapInPandas(run, "value string")


def endpoint_list(entries: DataFrame) -> DataFrame:
    """(chain_id, name, tvl, urls, n_rpcs) of chain entries (chainId, networkId, name, tvl, rpc array of url structs, pos).

    Only http(s) addresses without placeholders for keys count, trimmed, each once in the order of the entry. Entries of
    test networks (a true isTestnet or testnet, where there are such columns), without a network id, without a positive
    chain id and without an address that counts are left out. Of entries of one chain that of the most addresses stays,
    the first (by pos) of equals. One without a name is called after its id, one without a value has 0.
    """
    trimmed = F.transform("rpc", lambda r: F.trim(r["url"]))
    usable = F.array_distinct(F.filter(trimmed, lambda u: u.rlike("^https?://") & ~u.contains("API_KEY") & ~u.contains("${")))
    test = F.lit(False)
    for flag in ("isTestnet", "testnet"):
        if flag in entries.columns:
            test = test | F.coalesce(F.col(flag), F.lit(False))
    chosen = entries.where(~test & F.col("networkId").isNotNull() & (F.col("chainId") > 0))
    name = F.when(F.col("name") != "", F.col("name")).otherwise(F.concat(F.lit("chain-"), F.col("chainId").cast("string")))
    rows = chosen.select(F.col("chainId").alias("chain_id"), name.alias("name"), F.coalesce("tvl", F.lit(0)).alias("tvl"), "pos", usable.alias("urls")).withColumn("n_rpcs", F.size("urls")).where("n_rpcs > 0")
    # one row a chain by a combining aggregate, not by a window that sorts all entries
    best = rows.groupBy("chain_id").agg(F.max_by(F.struct("name", "tvl", "urls", "n_rpcs"), F.struct("n_rpcs", (-F.col("pos")).alias("first"))).alias("b"))
    return best.select("chain_id", "b.*")
