"""Further registered queries: dumps, registries, previews, publication; they join those of ``queries``."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweft.functions.abi import decode_call, decode_event, hex0x, parse_signature
from blockweft.operators import match, publish, registry, reports, results
from blockweft.operators.match import Monitor
from blockweft.plans import blocks
from blockweft.queries import AMOUNT, CENTS, CHAIN_E, CHAIN_O, EVENT, HEAD, HIGH, LOW, MEDIUM, MONITORS, ORACLE_SQL, SOUND, TX, URGENT, USUAL, calls, contract, events, only, query, shown, transfers
from blockweft.sources import chain, reader, rpc
from blockweft.streaming.index import index_step

ANY = Monitor(1, 1, contract(URGENT), chain.TRANSFER)


def store(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; one of our own only where none is set and all run on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{where or tempfile.mkdtemp(prefix='blockweft-')}/{name}-{uuid.uuid4().hex}"


@query(f"""SELECT o_orderkey // 10 AS block_number, {TX} AS tx_hash FROM orders
  WHERE {CHAIN_O} = 1 AND o_orderpriority = '{URGENT}' AND {USUAL} AND o_orderstatus <> 'P'""")
def calls_reverted_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.matched_calls(chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), match.registry(spark, [ANY]))
    return found.select("block_number", hex0x(F.col("tx_hash")).alias("tx_hash"))


@query(f"SELECT {CHAIN_O} AS chain_id, {TX} AS tx_hash FROM orders WHERE o_orderkey % 97 <> 0 AND (o_orderkey % 101 = 0 OR o_orderkey % 103 = 1)")
def calls_short_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = chain.transactions(spark, sf_dir).where(F.col("to_addr").isNotNull() & match.selector(F.col("input")).isNull())
    return short.select("chain_id", hex0x(F.col("tx_hash")).alias("tx_hash"))


@query(f"SELECT {CHAIN_E} AS chain_id, {EVENT} FROM events WHERE event_type = 'view' AND event_id % 11 = 0")
def events_no_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.logs(spark, sf_dir).where(F.try_element_at("topics", F.lit(1)).isNull()).select("chain_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "log_index")


@query(transfers(f"{CENTS} < 17500000"))
def filter_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = Monitor(1, 1, contract(URGENT), chain.TRANSFER, filter={"not": {"field": "params.value", "op": "gte", "value": "17500000"}})
    return shown(calls(spark, sf_dir, [chosen]), "to", "value")


@query(transfers("o_orderkey // 10 >= 30 AND o_orderkey // 10 < 1000000 AND o_custkey > 0"))
def filter_meta_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = [{"field": "block.number", "op": "gte", "value": "30"}, {"field": "block.number", "op": "lt", "value": "1000000"}, {"field": "tx.from", "op": "ne", "value": "0x" + "00" * 20}, {"field": "tx.to", "op": "eq", "value": "0x" + contract(URGENT)}]
    return shown(calls(spark, sf_dir, [Monitor(1, 1, contract(URGENT), chain.TRANSFER, filter={"and": tests})]), "to", "value")


@query(f"""SELECT {TX} AS tx_hash, o_orderkey % 53 <> 0 AS ok, o_orderkey % 53 <> 0 AND {CENTS} >= 17500000 AS matches FROM orders
  WHERE o_orderpriority = '{URGENT}' AND {USUAL}""")
def filter_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = chain.transactions(spark, sf_dir).where(F.col("to_addr") == F.unhex(F.lit(contract(URGENT))))
    found = registry.preview(samples.where(match.selector(F.col("input")).isNotNull()), chain.TRANSFER, {"field": "params.value", "op": "gte", "value": "17500000"})
    return found.select(hex0x(F.col("tx_hash")).alias("tx_hash"), "ok", "matches")


_EACH = ("calls_transfer_gte", "calls_renamed_range", "filter_or", "filter_and_not", "calls_signed", "calls_bytes", "calls_after_cursor", "events_activity", "filter_and", "events_indexed_string")
_ALL = " UNION ALL ".join(f"SELECT monitor_id FROM ({ORACLE_SQL[n]})" for n in _EACH)


@query(f"""SELECT monitor_id, count(*) AS n FROM ({_ALL} UNION ALL
  SELECT CAST(15 AS BIGINT) FROM events WHERE {CHAIN_E} = 1 AND event_type = 'click' AND event_id % 37 <> 0) GROUP BY monitor_id""")
def results_all_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.indexed(chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), chain.logs(spark, sf_dir), MONITORS)
    return found.groupBy("monitor_id").agg(F.count(F.lit(1)).alias("n"))


def block_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block responses as a dump; of every 41st block the response is for another block."""
    t = chain.transactions(spark, sf_dir)
    tx = F.struct(*[hex0x(F.col(c)).alias(n) for n, c in (("hash", "tx_hash"), ("from", "from_addr"), ("to", "to_addr"), ("input", "input"))])
    blocks = t.groupBy("chain_id", "block_number").agg(F.collect_list(tx).alias("transactions"))
    told = F.concat(F.lit("0x"), F.lower(F.hex(F.col("block_number") + F.when(F.col("block_number") % 41 == 0, 1).otherwise(0))))
    request = F.struct("chain_id", F.col("block_number").alias("number"))
    return blocks.select(F.to_json(F.struct(request.alias("request"), F.struct(told.alias("number"), "transactions").alias("result"))).alias("value"))


@query(f"""SELECT CAST({CHAIN_O} AS BIGINT) AS chain_id, o_orderkey // 10 AS block_number, {TX} AS tx_hash, '0x' || left(sha256('contract:' || o_orderpriority), 40) AS to_addr
  FROM orders WHERE o_orderkey % 97 <> 0 AND (o_orderkey // 10) % 41 <> 0""")
def dump_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rpc.transactions_of(block_dump(spark, sf_dir))
    return found.select("chain_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), hex0x(F.col("to_addr")).alias("to_addr"))


@query(f"SELECT DISTINCT CAST({CHAIN_O} AS BIGINT) AS chain_id, o_orderkey // 10 AS block_number, 'another block than asked for' AS reason FROM orders WHERE (o_orderkey // 10) % 41 = 0")
def dump_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpc.block_rejects(block_dump(spark, sf_dir))


@query("""SELECT CAST(s_nationkey AS BIGINT) AS chain_id, arg_max(name, rank) AS name, arg_max(tvl, rank) AS tvl, CAST(max(n) AS INTEGER) AS n_rpcs, arg_max(urls, rank) AS urls FROM (
  SELECT *, n * 1000000000000 - s_suppkey AS rank FROM (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS n,
    CASE WHEN s_suppkey % 5 = 0 THEN 'chain-' || s_nationkey ELSE s_name END AS name, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE CAST(s_acctbal AS DOUBLE) END AS tvl,
    'https://a' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN ',http://b' || s_suppkey ELSE '' END AS urls FROM supplier
    WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 17 <> 0 AND s_suppkey % 19 <> 0 AND s_suppkey % 23 <> 0 AND s_nationkey > 0)) GROUP BY s_nationkey""")
def endpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of each chain; entries of test networks, without ids and without a usable address are left out."""
    s = chain.table(spark, sf_dir, "supplier")
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    url = lambda *parts: F.struct(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("url"))
    useless = [url("wss://c", key), url("https://d/${API_KEY}/", key), url("https://e/API_KEY/", key)]
    usual = F.array(url("https://a", key, " "), *useless, url("https://a", key))
    addresses = F.when(k % 23 == 0, F.array(*useless)).when(k % 3 == 0, F.concat(usual, F.array(url("http://b", key)))).otherwise(usual)
    number = F.col("s_nationkey").cast("long")
    entries = s.select(
        F.when(k % 19 == 0, -number).otherwise(number).alias("chainId"), F.when(k % 17 != 0, number).alias("networkId"), (k % 11 == 0).alias("isTestnet"), F.when(k % 13 == 0, True).alias("testnet"),
        F.when(k % 10 == 0, "").when(k % 5 != 0, F.col("s_name")).alias("name"), F.when(k % 7 != 0, F.col("s_acctbal").cast("double")).alias("tvl"), k.cast("long").alias("pos"), addresses.alias("rpc"),
    )
    return rpc.endpoint_list(entries).select("chain_id", "name", "tvl", "n_rpcs", F.array_join("urls", ",").alias("urls"))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS chain_id, CASE s_suppkey % 4 WHEN 2 THEN 'https://new' ELSE 'https://old' END || s_suppkey AS rpc_url,
  CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE s_nationkey % 2 = 0 END AS enabled FROM supplier""")
def registry_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chain.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("chain_id"), (F.col("s_nationkey") % 2 == 0).alias("on"), (F.col("s_suppkey") % 4).alias("part"))
    name = F.col("chain_id").cast("string")
    chains = s.where("part <> 0").select("chain_id", F.concat(F.lit("https://old"), name).alias("rpc_url"), F.col("on").alias("enabled"))
    op = F.when(F.col("part") == 0, "insert").otherwise("update")
    new_url = F.when(F.col("part") == 0, F.concat(F.lit("https://old"), name)).when(F.col("part") == 2, F.concat(F.lit("https://new"), name))
    changes = s.where("part < 3").select(op.alias("op"), "chain_id", new_url.alias("rpc_url"), F.when(F.col("part") == 1, False).alias("enabled"))
    return registry.upserted_chains(chains, changes)


@query(f"""SELECT monitor_id, count(*) AS n, max(block_number) AS last_block FROM (
  SELECT CAST(1 AS BIGINT) AS monitor_id, o_orderkey // 10 AS block_number FROM orders WHERE {CHAIN_O} = 1 AND o_orderpriority = '{URGENT}' AND {SOUND} AND {CENTS} >= 25000000
  UNION ALL SELECT CAST(9 AS BIGINT), event_id // 20 FROM events WHERE {CHAIN_E} = 1 AND event_type = 'purchase')
  WHERE block_number <= {HEAD} AND block_number < (SELECT coalesce(min(event_id // 20), 1000000000) FROM events WHERE {CHAIN_E} = 1 AND event_type = 'purchase' AND event_id % 501 >= 499)
  GROUP BY monitor_id""")
def published_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is visible after a step over all blocks, in which removed logs stop a chain."""
    logs = chain.logs(spark, sf_dir)
    logs = logs.withColumn("removed", (F.col("block_number") * 20 + F.col("log_index")) % 501 >= 499)
    root = store(spark, "published")
    publish.step(spark, root, 0, (chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), logs), only(1, 9), chain.heads(spark, sf_dir), 1 << 40)
    return publish.visible(spark, root).groupBy("monitor_id").agg(F.count(F.lit(1)).alias("n"), F.max("block_number").alias("last_block"))


_PURCHASE = f"FROM events WHERE {CHAIN_E} = 1 AND event_type = 'purchase'"
_BAD = f"(SELECT min(event_id // 20) {_PURCHASE} AND event_id % 501 >= 499 AND event_id // 20 <= {HEAD})"


@query(f"""SELECT CAST(1 AS BIGINT) AS chain_id, CAST({HEAD} AS BIGINT) AS finalized_head, (SELECT count(*) {_PURCHASE} AND event_id // 20 <= {HEAD} AND event_id // 20 < coalesce({_BAD}, 1000000000)) AS decoded,
  CASE WHEN {_BAD} IS NOT NULL THEN 'removed log' END AS error UNION ALL SELECT CAST(8453 AS BIGINT), CAST({HEAD} AS BIGINT), 0, NULL""")
def poll_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the step of a stream records of both chains, of which one has removed logs and one no monitor."""
    logs = chain.logs(spark, sf_dir)
    logs = logs.withColumn("removed", (F.col("block_number") * 20 + F.col("log_index")) % 501 >= 499)
    root = store(spark, "polls")
    index_step(root, lambda s: (chain.transactions(s, sf_dir), chain.receipts(s, sf_dir), logs), lambda: only(9), 1 << 40)(chain.heads(spark, sf_dir), 0)
    return publish.polls(spark, root).select("chain_id", "finalized_head", "decoded", "error")


@query(f"""SELECT CAST({CHAIN_E} AS BIGINT) AS chain_id, event_id // 20 // 8 * 8 AS block_number, 'log outside the range asked for' AS reason FROM events
  WHERE {CHAIN_E} = 1 AND event_type = 'purchase' AND event_id // 20 % 8 = 7 GROUP BY ALL""")
def stray_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of logs that were asked for by eights of blocks, where the answers hold one block less."""
    block = F.col("block_number")
    asked = chain.logs(spark, sf_dir).withColumns({"first_block": block - block % 8, "last_block": block - block % 8 + 6})
    return match.log_faults(asked, match.registry(spark, only(9)))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monitor for each supplier: of its nation's chain, of one of three signatures, some without a start."""
    s = chain.table(spark, sf_dir, "supplier")
    pick = F.element_at(F.array(F.lit(chain.TRANSFER), F.lit(chain.APPROVE), F.lit(chain.ACTIVITY)), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return s.select(F.col("s_nationkey").cast("long").alias("chain_id"), chain.contract(F.col("s_suppkey")).alias("address"), pick.alias("signature"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey").cast("long")).alias("start_block"), F.lit(None).cast("long").alias("end_block"))


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = chain.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("chain_id"))
    heads = nations.withColumn("finalized_head", 1000 + F.col("chain_id"))
    return registry.appended(match.registry(spark, MONITORS), definitions(spark, sf_dir), nations, heads)


_SIGNATURES = " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate((chain.TRANSFER, chain.APPROVE, chain.ACTIVITY)))
_HASHES = " ".join(f"WHEN {k} THEN '0x{parse_signature(t).hash.hex()}'" for k, t in enumerate((chain.TRANSFER, chain.APPROVE, chain.ACTIVITY)))
_NEW = f"""(SELECT {max(m.id for m in MONITORS)} + row_number() OVER (ORDER BY chain_id, address, signature) AS id, * FROM (
  SELECT CAST(s_nationkey AS BIGINT) AS chain_id, left(sha256('contract:' || s_suppkey), 40) AS address, CASE s_suppkey % 3 {_SIGNATURES} END AS signature, CASE s_suppkey % 3 {_HASHES} END AS hash,
  CASE WHEN s_suppkey % 3 = 2 THEN 'event' ELSE 'call' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN 1000 + s_nationkey ELSE s_suppkey END AS start_block FROM supplier))"""


@query(f"""SELECT id, chain_id, kind, '0x' || address AS address, CASE WHEN kind = 'call' THEN hash END AS selector, CASE WHEN kind = 'event' THEN hash END AS topic0, CAST(start_block AS BIGINT) AS start_block
  FROM {_NEW} WHERE chain_id <> 1""")
def registry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New monitors, as they are shown; chain 1 has older ones too."""
    found = registry.monitor_view(appended(spark, sf_dir)).where(F.col("id") > max(m.id for m in MONITORS))
    return found.where("chain_id <> 1").select("id", "chain_id", "kind", "address", "selector", "topic0", "start_block")


@query(f"SELECT id, address FROM (SELECT id, '0x' || address AS address FROM {_NEW} WHERE chain_id = 7) ORDER BY id")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.scan(registry.monitor_view(appended(spark, sf_dir)), 7).select("id", "address")


_OLD = ", ".join(f"({m.id}, {m.chain_id})" for m in MONITORS)


@query(f"""SELECT chain_id, count(*) AS monitors FROM (SELECT CAST(c AS BIGINT) AS chain_id FROM (VALUES {_OLD}) AS v(i, c) UNION ALL SELECT chain_id FROM {_NEW}) GROUP BY chain_id""")
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.counted(appended(spark, sf_dir))


@query(f"SELECT id, enabled FROM (SELECT id, id % 2 = 0 AS enabled FROM {_NEW})")
def registry_paused(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = appended(spark, sf_dir)
    odd = table.where("id % 2 = 1").select("id", F.lit(False).alias("enabled"))
    return registry.set_enabled(table, odd).where(F.col("id") > max(m.id for m in MONITORS)).select("id", "enabled")


@query(f"SELECT chain_id, CAST(min(start_block) AS BIGINT) AS min_next FROM {_NEW} WHERE chain_id NOT IN (1, 8453) GROUP BY chain_id")
def min_next_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.min_next_block(appended(spark, sf_dir)).where(~F.col("chain_id").isin(1, 8453))


@query(f"""SELECT chain_id, count(DISTINCT address) AS n_requests, count(*) AS n_pairs FROM (SELECT DISTINCT chain_id, address, hash FROM {_NEW} WHERE kind = 'event' AND chain_id NOT IN (1, 8453)) GROUP BY chain_id
  HAVING count(DISTINCT address) <= count(DISTINCT hash) UNION ALL SELECT chain_id, count(DISTINCT hash), count(*) FROM (SELECT DISTINCT chain_id, address, hash FROM {_NEW} WHERE kind = 'event' AND chain_id NOT IN (1, 8453)) GROUP BY chain_id
  HAVING count(DISTINCT address) > count(DISTINCT hash)""")
def log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = blocks.log_groups(blocks.log_targets(appended(spark, sf_dir))).where(~F.col("chain_id").isin(1, 8453))
    return groups.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_requests"), F.sum(F.size("addresses") * F.size("topics")).alias("n_pairs"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS chain_id, n_regionkey <> 2 AS enabled FROM nation ORDER BY chain_id")
def chain_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = chain.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("chain_id"), F.concat(F.lit("https://"), "n_name").alias("rpc_url"), (F.col("n_regionkey") != 2).alias("enabled"))
    return registry.chain_view(chains)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS chain_id, CASE WHEN n_nationkey % 5 = 0 THEN 'no answer' WHEN n_nationkey % 5 = 1 THEN 'source of another chain' ELSE 'no finalized head' END AS reason
  FROM nation WHERE n_nationkey % 5 < 3""")
def source_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = chain.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("chain_id"))
    k = F.col("chain_id") % 5
    reports = chains.where(k > 0).select("chain_id", F.when(k == 1, F.col("chain_id") + 1).otherwise(F.col("chain_id")).alias("reported"), F.when(k != 2, F.col("chain_id")).alias("finalized_head"))
    return registry.source_faults(chains, reports)


@query(f"SELECT CAST(9 AS BIGINT) AS monitor_id, count(*) AS n FROM events WHERE {CHAIN_E} = 1 AND event_type = 'purchase'")
def cascade_delete_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.indexed(chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), chain.logs(spark, sf_dir), only(8, 9))
    table, gone = match.registry(spark, only(8, 9)), spark.createDataFrame([(8453,)], "chain_id long")
    _, monitors, left = registry.without_chains(chain.heads(spark, sf_dir), table, found, gone)
    return left.join(F.broadcast(monitors.select(F.col("id").alias("monitor_id"))), "monitor_id", "left_semi").groupBy("monitor_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT o_orderkey // 10 AS block_number, {TX} AS tx_hash, '0x' || left(sha256('eoa:' || (o_custkey + 2)), 40) AS spender,
  CAST(CAST(18446744073709551616 AS HUGEINT) + {CENTS} AS VARCHAR) AS value FROM orders WHERE o_orderpriority = '{HIGH}' AND o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 1 AND o_orderkey % 53 <> 0""")
def decoded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every approval of the chain data, with its parameters, of whatever contract."""
    found = decode_call(chain.transactions(spark, sf_dir), chain.APPROVE).where("decoded IS NOT NULL")
    return found.select("block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), hex0x(F.col("decoded.spender")).alias("spender"), F.col("decoded.value").alias("value"))


@query(f"""SELECT {EVENT}, CAST(user_id AS VARCHAR) AS actor, CAST({AMOUNT} AS VARCHAR) AS amount, props FROM events
  WHERE event_type <> 'signup' AND NOT (event_type = 'view' AND event_id % 11 = 0) AND NOT (event_type = 'click' AND event_id % 37 = 0)""")
def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode_event(chain.logs(spark, sf_dir), chain.ACTIVITY).where("decoded IS NOT NULL")
    return found.select("block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "log_index", "decoded.actor", "decoded.amount", "decoded.props")


@query(f"""SELECT o_orderkey // 10 AS block_number, {TX} AS tx_hash, o_orderstatus || ':' || o_orderpriority AS status, o_custkey % 2 = 1 AS flag
  FROM orders WHERE {CHAIN_O} = 1 AND o_orderpriority = '{MEDIUM}' AND {SOUND} AND o_custkey % 2 = 1 AND o_orderstatus <> 'F'""")
def typed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.indexed(chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), chain.logs(spark, sf_dir), only(5))
    view = results.typed_view(found, 5, only(5)[0].target)
    return view.select("block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "status", "flag")


@query(f"""SELECT CAST(1 AS BIGINT) AS monitor_id, 'call' AS kind, o_orderkey // 10 AS block_number, {TX} AS tx_hash, '0x' || left(sha256('eoa:' || o_custkey), 40) AS "from", '0x{contract(URGENT)}' AS "to", NULL AS emitter
  FROM orders WHERE {CHAIN_O} = 1 AND o_orderpriority = '{URGENT}' AND {SOUND} AND {CENTS} >= 25000000
  UNION ALL SELECT CAST(9 AS BIGINT), 'event', event_id // 20, '0x' || sha256('etx:' || (event_id // 5)), NULL, NULL, '0x{contract("purchase")}' FROM events WHERE {CHAIN_E} = 1 AND event_type = 'purchase'""")
def results_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.indexed(chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), chain.logs(spark, sf_dir), only(1, 9))
    return results.tagged_view(found).select("monitor_id", "kind", "block_number", "tx_hash", "from", "to", "emitter")


_WORD = "sha256('wide:' || o_orderkey)"


def hex_of_decimal(text: Column) -> Column:
    """64 hex digits of a decimal text of up to 78 digits: its nines of digits are folded into eight 32-bit limbs."""
    padded = F.lpad(text, 81, "0")
    nines = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.substring(padded, k * 9 + 1, F.lit(9)).cast("long"))
    base = F.lit(1 << 32)

    def fold(limbs: Column, nine: Column) -> Column:
        # limbs run from the lowest; each step is limbs * 10^9 + nine with carries
        start = F.struct(nine.alias("carry"), F.expr("CAST(array() AS array<bigint>)").alias("out"))

        def step(acc: Column, limb: Column) -> Column:
            total = limb * 1_000_000_000 + acc["carry"]
            return F.struct(F.shiftrightunsigned(total, 32).cast("long").alias("carry"), F.concat(acc["out"], F.array(total.bitwiseAND(base - 1))).alias("out"))

        return F.aggregate(limbs, start, step, lambda acc: acc["out"])

    limbs = F.aggregate(nines, F.array_repeat(F.lit(0).cast("long"), 8), fold)
    return F.lower(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(F.hex(x), 8, "0")), ""))


@query(f"""WITH words AS (SELECT {TX} AS tx_hash, {_WORD} AS w FROM orders WHERE o_orderpriority = '{LOW}')
  SELECT tx_hash, w AS unsigned_hex, CASE WHEN substr(w, 1, 1) >= '8' THEN '-' ELSE '' END AS sign FROM words""")
def calls_wide_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all 256 bits, unsigned and signed, one of each call: from decimal text back to hex, and the sign."""
    sent = chain.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == LOW)
    wide = chain.digest("wide:", F.col("o_orderkey"))
    both = "function extremes(uint256 largest, int256 least)"
    rows = sent.select(F.unhex(chain.digest("tx:", F.col("o_orderkey"))).alias("tx_hash"), F.unhex(F.concat(F.lit(parse_signature(both).hash.hex()), wide, wide)).alias("input"))
    found = decode_call(rows, both)
    signed = F.when(F.col("decoded.least").startswith("-"), "-").otherwise("")
    return found.select(hex0x(F.col("tx_hash")).alias("tx_hash"), hex_of_decimal(F.col("decoded.largest")).alias("unsigned_hex"), signed.alias("sign"))


@query(f"SELECT {CHAIN_O} AS chain_id, o_orderkey // 10 AS block_number, {TX} AS tx_hash, CAST({CENTS} AS VARCHAR) AS value FROM orders WHERE o_orderpriority = '{URGENT}' AND {SOUND}")
def calls_decoded_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transfers of both chains, without a filter."""
    both = [Monitor(k, c, contract(URGENT), chain.TRANSFER) for k, c in ((1, 1), (2, 8453))]
    return calls(spark, sf_dir, both).select("chain_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), F.get_json_object("params", "$.value").alias("value"))


@query(f"SELECT {CHAIN_E} AS chain_id, {EVENT}, props FROM events WHERE event_type IN ('purchase', 'error')")
def events_decoded_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir, [Monitor(2 * k + j, c, contract(n), chain.ACTIVITY) for k, n in enumerate(("purchase", "error"), 1) for j, c in enumerate((1, 8453))])
    return found.select("chain_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "log_index", F.get_json_object("params", "$.props").alias("props"))


@query(transfers(f"({CENTS} >= 30000000 OR {CENTS} < 5000000) AND o_orderkey // 10 >= 20"))
def filter_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda op, n: {"field": "params.value", "op": op, "value": n}
    both = {"and": [{"or": [value("gte", "30000000"), value("lt", "5000000")]}, {"not": {"field": "block.number", "op": "lt", "value": "20"}}]}
    return shown(calls(spark, sf_dir, [Monitor(1, 1, contract(URGENT), chain.TRANSFER, filter=both)]), "to", "value")


@query(f"""SELECT monitor_id, count(*) AS n FROM (SELECT CAST(1 AS BIGINT) AS monitor_id FROM orders WHERE {CHAIN_O} = 1 AND o_orderpriority = '{URGENT}' AND {SOUND} AND o_orderkey // 10 <= {HEAD}
  UNION ALL SELECT CAST(2 AS BIGINT) FROM orders WHERE {CHAIN_O} = 8453 AND o_orderpriority = '{URGENT}' AND {SOUND} AND o_orderkey // 10 <= {HEAD}
  UNION ALL SELECT CAST(9 AS BIGINT) FROM events WHERE {CHAIN_E} = 1 AND event_type = 'purchase' AND event_id // 20 <= {HEAD}) GROUP BY monitor_id""")
def backfill_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of two chains from the first block to the head, published, and what is visible then."""
    monitors = [Monitor(1, 1, contract(URGENT), chain.TRANSFER), Monitor(2, 8453, contract(URGENT), chain.TRANSFER), *only(9)]
    root = store(spark, "backfill")
    publish.step(spark, root, 0, (chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), chain.logs(spark, sf_dir)), monitors, chain.heads(spark, sf_dir), 1 << 40)
    return publish.visible(spark, root).groupBy("monitor_id").agg(F.count(F.lit(1)).alias("n"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition for each supplier with a filter of its own: transfers and approvals, and activities of both chains."""
    k, cents = F.col("s_suppkey").cast("long"), (F.round(F.abs("s_acctbal") * 100).cast("long") * 20).cast("string")
    text = lambda c: c.cast("string")
    pick = lambda *values: F.when(k % 3 == 0, values[0]).when(k % 3 == 1, values[1]).otherwise(values[2])
    filters = pick(
        F.concat(F.lit('{"field": "params.value", "op": "gte", "value": "'), cents, F.lit('"}')),
        F.concat(F.lit('{"not": {"field": "block.number", "op": "lt", "value": "'), text(k + 5), F.lit('"}}')),
        F.concat(F.lit('{"or": [{"field": "params.amount", "op": "lt", "value": "'), text(k * 100), F.lit('"}, {"field": "event.log_index", "op": "gte", "value": "'), text(k % 20), F.lit('"}]}')),
    )
    chosen = [F.lit(contract(n)) for n in (URGENT, HIGH, "purchase")]
    return chain.table(spark, sf_dir, "supplier").select(
        F.when(k % 10 == 9, 7).when(k % 4 == 0, 8453).otherwise(1).cast("long").alias("chain_id"), pick(*chosen).alias("address"), pick(*[F.lit(t) for t in (chain.TRANSFER, chain.APPROVE, chain.ACTIVITY)]).alias("signature"),
        k.alias("start_block"), (k + 40).alias("end_block"), F.when(k % 8 != 0, filters).alias("filter"), F.when(k % 8 != 0, registry.FILTER_VERSION).alias("filter_version"),
    )


_CHAINS = "CASE WHEN s_suppkey % 10 = 9 THEN 7 WHEN s_suppkey % 4 = 0 THEN 8453 ELSE 1 END"
_FOUND = f"""(SELECT CAST(s_suppkey AS BIGINT) AS supplier, CAST({_CHAINS} AS BIGINT) AS chain_id, block_number, kind FROM supplier JOIN (
  SELECT 'call' AS kind, {CHAIN_O} AS chain, o_orderkey // 10 AS block_number, CASE o_orderpriority WHEN '{URGENT}' THEN 0 ELSE 1 END AS part, {CENTS} AS number, 0 AS place
  FROM orders WHERE {SOUND} AND o_orderpriority IN ('{URGENT}', '{HIGH}')
  UNION ALL SELECT 'event', {CHAIN_E}, event_id // 20, 2, {AMOUNT}, event_id % 20 FROM events WHERE event_type = 'purchase')
  ON chain = {_CHAINS} AND part = s_suppkey % 3 AND block_number BETWEEN s_suppkey AND s_suppkey + 40
  WHERE s_suppkey % 8 = 0 OR CASE s_suppkey % 3 WHEN 0 THEN number >= CAST(round(abs(s_acctbal) * 100) AS BIGINT) * 20 WHEN 1 THEN block_number >= s_suppkey + 5 ELSE number < s_suppkey * 100 OR place >= s_suppkey % 20 END)"""


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The chains of the generated definitions, and their heads."""
    heads = chain.heads(spark, sf_dir)
    third = heads.where("chain_id = 1").select(F.lit(7).cast("long").alias("chain_id"), "finalized_head")
    heads = heads.unionByName(third)
    return heads.select("chain_id"), heads


@query(f"SELECT supplier, chain_id, kind, count(*) AS n, sum(block_number) AS blocks FROM {_FOUND} GROUP BY ALL")
def results_generated_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results of a registry that is read from definitions with filters, by one plan for any number of monitors."""
    chains, heads = _places(spark, sf_dir)
    root = store(spark, "registry")
    registry.store(spark, root, registry.appended(registry.stored(spark, root), generated(spark, sf_dir), chains, heads), None)
    table = registry.stored(spark, root)
    found = match.outcomes(chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), chain.logs(spark, sf_dir), table, small=table.count() <= match.BROADCAST_ROWS).where("ok")
    named = found.join(table.select(F.col("id").alias("monitor_id"), F.col("start_block").alias("supplier")), "monitor_id")
    return named.groupBy("supplier", "chain_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("block_number").alias("blocks"))


def _driven(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A registry stored in three versions (some, all, some of them paused) drives one step over three chains: two have
    removed logs, the source of the third doesn't answer."""
    root = store(spark, "registry")
    chains, heads = _places(spark, sf_dir)
    rows = generated(spark, sf_dir)
    for even in (True, False):
        known = registry.versions(spark, root)
        more = rows.where((F.col("start_block") % 2 == 0) == F.lit(even))
        registry.store(spark, root, registry.appended(registry.stored(spark, root), more, chains, heads), known[-1] if known else None)
    now = registry.stored(spark, root)
    registry.store(spark, root, registry.set_enabled(now, now.where("start_block % 5 = 0").select("id", F.lit(False).alias("enabled"))), 1)
    logs = chain.logs(spark, sf_dir)
    logs = logs.withColumn("removed", (F.col("block_number") * 20 + F.col("log_index")) % 101 >= 99)
    told = heads.where("chain_id <> 7").select("chain_id", F.col("chain_id").alias("reported"), "finalized_head")
    index_step(root, lambda s: (chain.transactions(s, sf_dir), chain.receipts(s, sf_dir), logs), lambda: registry.stored(spark, root), 1 << 40, sources=lambda s: told)(heads, 0)
    return root, chains


_SICK = f"""(SELECT CAST({_CHAINS} AS BIGINT) AS chain_id, min(event_id // 20) AS bad FROM supplier JOIN events ON {CHAIN_E} = {_CHAINS} AND event_type = 'purchase' AND event_id % 101 >= 99
  AND event_id // 20 BETWEEN s_suppkey AND least(s_suppkey + 40, {HEAD}) WHERE s_suppkey % 3 = 2 AND s_suppkey % 5 <> 0 GROUP BY ALL)"""


@query(f"""SELECT supplier, chain_id, kind, count(*) AS n FROM {_FOUND} LEFT JOIN {_SICK} USING (chain_id)
  WHERE supplier % 5 <> 0 AND block_number <= {HEAD} AND (bad IS NULL OR block_number < bad) GROUP BY ALL""")
def registry_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From definitions to published results: what is visible after the step of a stored registry."""
    root, _ = _driven(spark, sf_dir)
    table = registry.stored(spark, root).select(F.col("id").alias("monitor_id"), F.col("start_block").alias("supplier"))
    return publish.visible(spark, root).join(table, "monitor_id").groupBy("supplier", "chain_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT chain_id, CASE WHEN chain_id = 7 OR bad IS NOT NULL THEN 'degraded' ELSE 'running' END AS state, CASE WHEN chain_id = 7 THEN 'no answer' WHEN bad IS NOT NULL THEN 'removed log' END AS last_error
  FROM (SELECT CAST(unnest([1, 7, 8453]) AS BIGINT) AS chain_id) LEFT JOIN {_SICK} USING (chain_id)""")
def registry_step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each chain after that step."""
    root, chains = _driven(spark, sf_dir)
    return reports.chain_status(publish.polls(spark, root), chains.withColumn("enabled", F.lit(True)), "batch_id").select("chain_id", "state", "last_error")


def receipt_dump(spark: SparkSession, sf_dir: str, by_place: bool) -> DataFrame:
    """Answers of a provider to requests for the receipts of each block's orders. Some are lost; of single requests some
    are of another hash; of blocks, some receipts come twice (first with the wrong status), and all in reverse order."""
    o = chain.table(spark, sf_dir, "orders").select(chain.chain_of(F.col("o_custkey")).alias("chain_id"), F.expr("o_orderkey div 10").alias("number"), F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") != "P").alias("good"))
    hashed = lambda k: F.concat(F.lit("0x"), chain.digest("tx:", k))
    status = lambda good: F.when(good, "0x1").otherwise("0x0")
    receipt = lambda k, good: F.struct(hashed(k).alias("transactionHash"), status(good).alias("status"))
    per_block = o.groupBy("chain_id", "number").agg(F.sort_array(F.collect_list(F.struct("key", "good"))).alias("rows"))
    there = F.filter("rows", lambda x: x["key"] % 13 != 0)
    if by_place:
        result = F.transform("rows", lambda x: F.when(x["key"] % 13 != 0, receipt(F.when(x["key"] % 19 == 0, x["key"] + 1).otherwise(x["key"]), x["good"])))
    else:
        result = F.concat(F.transform(F.filter(there, lambda x: x["key"] % 17 == 0), lambda x: receipt(x["key"], ~x["good"])), F.reverse(F.transform(there, lambda x: receipt(x["key"], x["good"]))))
    request = F.struct("chain_id", "number", F.transform("rows", lambda x: hashed(x["key"])).alias("hashes"))
    return per_block.select(F.to_json(F.struct(request.alias("request"), F.when(F.col("number") % 43 != 0, result).alias("result"))).alias("value"))


_ANSWERS = f"""SELECT {{place}} AS by_place, CAST({CHAIN_O} AS BIGINT) AS chain_id, o_orderkey // 10 AS block_number, {TX} AS tx_hash, CASE WHEN o_orderkey // 10 % 43 = 0 THEN 'no answer'
  WHEN o_orderkey % 13 = 0 THEN 'no receipt' WHEN {{place}} AND o_orderkey % 19 = 0 THEN 'another receipt than asked for' END AS reason, CASE WHEN reason IS NULL THEN o_orderstatus <> 'P' END AS succeeded FROM orders"""


@query(" UNION ALL ".join(_ANSWERS.format(place=p) for p in ("true", "false")))
def receipts_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was asked for and what came of it: answers at their places, and blocks in any order."""
    parts = [rpc.receipts_answered(receipt_dump(spark, sf_dir, p), p).withColumn("by_place", F.lit(p)) for p in (True, False)]
    return parts[0].unionByName(parts[1]).withColumn("tx_hash", hex0x(F.col("tx_hash")))


_KEPT = "o_orderkey // 10 % 43 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 19 <> 0"


@query(f"""SELECT block_number, {TX} AS tx_hash, CASE WHEN kept THEN NULL ELSE 'no receipt' END AS fault FROM (SELECT *, o_orderkey // 10 AS block_number, {_KEPT} AS kept FROM orders)
  WHERE {CHAIN_O} = 1 AND o_orderpriority = '{URGENT}' AND {USUAL} AND (NOT kept OR o_orderstatus <> 'P')""")
def calls_with_asked_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by receipts that were asked for one by one: those without a sound answer are faults."""
    told = rpc.receipts_of(receipt_dump(spark, sf_dir, True), True)
    found = match.matched_calls(chain.transactions(spark, sf_dir), told, match.registry(spark, [ANY]), strict=False)
    return found.select("block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "fault")


#: Monitors with two runs of planned blocks on chain 1: calls and purchases from 10 on, errors from 100 on.
WINDOWED = [
    Monitor(21, 1, contract(URGENT), chain.TRANSFER, start_block=10, end_block=60), Monitor(22, 1, contract("purchase"), chain.ACTIVITY, start_block=38, end_block=75), Monitor(23, 1, contract("error"), chain.ACTIVITY, start_block=100),
    Monitor(24, 8453, contract("purchase"), chain.ACTIVITY, start_block=3), Monitor(25, 8453, contract(URGENT), chain.TRANSFER),
]
_KINDS = {contract(URGENT): "call", contract("purchase"): "purchase", contract("error"): "error"}
_ROWS = ", ".join(f"({m.id}, {m.chain_id}, '{_KINDS[m.address]}', {m.start_block}, {m.end_block if m.end_block is not None else 'NULL'})" for m in WINDOWED)
_SPOILT, _HASHLESS = "(event_id % 229 = 77 AND event_id // 20 > 33)", "(event_id % 397 = 201)"
_WINDOWS = f"""WITH planned AS (SELECT * FROM (SELECT id, chain, kind, first, least(coalesce(stop, {HEAD}), {HEAD}) AS last FROM (VALUES {_ROWS}) AS v(id, chain, kind, first, stop)) WHERE last >= first),
  opens AS (SELECT *, CASE WHEN max(last) OVER (PARTITION BY chain ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= first THEN NULL ELSE first END AS opened FROM planned),
  runs AS (SELECT *, max(opened) OVER (PARTITION BY chain ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM opens),
  ends AS (SELECT *, max(last) OVER (PARTITION BY chain, run) AS run_last FROM runs),
  monitors AS (SELECT *, first - (first - run) % 7 AS low, least(last - (last - run) % 7 + 6, run_last) AS high FROM ends),
  logs AS (SELECT *, {CHAIN_E} AS chain, event_id // 20 AS block, {_SPOILT} AS spoilt, {_HASHLESS} AS hashless FROM events),
  faults AS (SELECT chain, block - (block - run) % 7 AS stop, 'removed log' AS reason FROM logs JOIN monitors USING (chain) WHERE event_type = kind AND spoilt AND block BETWEEN low AND high
    UNION ALL SELECT chain, block, 'log without transaction hash' FROM logs JOIN monitors USING (chain) WHERE event_type = kind AND hashless AND NOT spoilt AND block BETWEEN first AND last),
  bad AS (SELECT chain, stop, reason FROM faults QUALIFY row_number() OVER (PARTITION BY chain ORDER BY stop, reason) = 1),
  found AS (SELECT {CHAIN_O} AS chain, 'call' AS kind, o_orderkey // 10 AS block FROM orders WHERE o_orderpriority = '{URGENT}' AND {SOUND} UNION ALL SELECT chain, event_type, block FROM logs)"""


@query(f"""{_WINDOWS} SELECT CAST(m.id AS BIGINT) AS monitor_id, CAST(b.stop AS BIGINT) AS bad_block, b.reason AS error, CAST(CASE WHEN least(m.last, b.stop - 1) >= m.first THEN least(m.last, b.stop - 1) END AS BIGINT) AS cursor,
  (SELECT count(*) FROM found AS f WHERE f.chain = m.chain AND f.kind = m.kind AND f.block BETWEEN m.first AND least(m.last, coalesce(b.stop - 1, m.last))) AS n FROM monitors AS m LEFT JOIN bad AS b ON m.chain = b.chain""")
def voided_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step with logs in windows of seven blocks: removed logs void their window, logs without hash their block."""
    logs, event = chain.logs(spark, sf_dir), F.col("block_number") * 20 + F.col("log_index")
    logs = logs.withColumns({"removed": (event % 229 == 77) & (F.col("block_number") > 33), "tx_hash": F.when(event % 397 != 201, F.col("tx_hash"))})
    root = store(spark, "windows")
    publish.step(spark, root, 0, (chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), logs), WINDOWED, chain.heads(spark, sf_dir), 1 << 40, window=7)
    counts = publish.visible(spark, root).groupBy("monitor_id").agg(F.count(F.lit(1)).alias("n"))
    return publish.commits(spark, root).join(counts, "monitor_id", "left").select("monitor_id", "bad_block", "error", "cursor", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


#: Blocks of a chain that lie in one folder of the stored answers, and most logs of one answer.
FOLDER_BLOCKS, MOST_LOGS = 1024, 300


def stored_provider(folder: str) -> rpc.Fetch:
    """A transport that answers from a folder of logs, parted by chain and runs of blocks, with a limit on its answers."""

    def fetch(chain_id: int, low: int, high: int, addresses: list[str], topics: list[str]) -> list[str]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder)
        wanted = (pc.field("block_number") >= low) & (pc.field("block_number") <= high) & pc.field("emitter").isin(addresses) & pc.field("topic").isin(topics)
        found: list[str] = []
        for part in range(low // FOLDER_BLOCKS, high // FOLDER_BLOCKS + 1):
            where = f"{place}/chain_id={chain_id}/part={part}"
            if system.get_file_info(where).type == fs.FileType.Directory:
                found += ds.dataset(where, filesystem=system, format="parquet").to_table(columns=["log"], filter=wanted)["log"].to_pylist()
            if len(found) > MOST_LOGS:
                raise rpc.RangeLimit
        return [json.dumps({"result": [json.loads(x) for x in found]})]

    return fetch


@query(f"SELECT CAST({CHAIN_E} AS BIGINT) AS chain_id, {EVENT}, '0x' || left(sha256('contract:' || event_type), 40) AS emitter, true AS inside FROM events WHERE event_type IN ('purchase', 'error')")
def logs_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of four monitors by a data source that asks a provider for ranges and halves those with too many."""
    folder = store(spark, "provider")
    shown_log = F.struct(*[hex0x(F.col(c)).alias(n) for n, c in (("address", "address"), ("data", "data"), ("transactionHash", "tx_hash"))], F.transform("topics", hex0x).alias("topics"), "removed",
                         *[F.concat(F.lit("0x"), F.lower(F.hex(c))).alias(n) for n, c in (("blockNumber", "block_number"), ("logIndex", "log_index"))])
    told = chain.logs(spark, sf_dir).select("chain_id", "block_number", F.lower(F.hex("address")).alias("emitter"), F.lower(F.hex(F.try_element_at("topics", F.lit(1)))).alias("topic"), F.to_json(shown_log).alias("log"))
    told.withColumn("part", F.expr(f"block_number div {FOLDER_BLOCKS}")).hint("rebalance", "chain_id", "part").write.partitionBy("chain_id", "part").parquet(folder)
    last = spark.read.parquet(folder).groupBy(F.col("chain_id").cast("long").alias("chain_id")).agg(F.max("block_number").alias("last")).collect()  # one row a chain
    monitors = [Monitor(k, c, contract(n), chain.ACTIVITY) for k, (n, c) in enumerate(((n, c) for n in ("purchase", "error") for c in (1, 8453)), 1)]
    text = lambda c: F.transform(c, lambda x: F.lower(F.hex(x))).alias(c)
    groups = blocks.log_groups(blocks.log_targets(match.registry(spark, monitors))).select("chain_id", text("addresses"), text("topics")).collect()
    ranges = [{"chain_id": r["chain_id"], "from_block": 0, "to_block": r["last"]} for r in last]
    found = rpc.logs_of(reader.ranged_logs(spark, stored_provider(folder), ranges, [g.asDict() for g in groups]))
    inside = F.col("block_number").between(F.col("first_block"), F.col("last_block"))
    return found.select("chain_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "log_index", hex0x(F.col("address")).alias("emitter"), inside.alias("inside"))
