"""The registered queries of the engine, with their SQL equivalents over the given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweft.functions.abi import hex0x
from blockweft.operators import match, reports, results
from blockweft.operators.match import Monitor
from blockweft.plans import blocks
from blockweft.sources import chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def contract(name: str) -> str:
    return hashlib.sha256(f"contract:{name}".encode()).hexdigest()[:40]


URGENT, HIGH, MEDIUM, UNSPECIFIED, LOW = "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"
MONITORS = [
    Monitor(1, 1, contract(URGENT), chain.TRANSFER, filter={"field": "params.value", "op": "gte", "value": "25000000"}),
    Monitor(2, 1, contract(URGENT), "function transfer(address recipient, uint256 amount)", start_block=10, end_block=40),
    Monitor(4, 1, contract(HIGH), chain.APPROVE, filter={"or": [{"field": "params.value", "op": "gte", "value": str(1 << 64)}, {"field": "block.number", "op": "lt", "value": "20"}]}),
    Monitor(5, 1, contract(MEDIUM), chain.STATUS, filter={"and": [{"field": "params.flag", "op": "eq", "value": True}, {"not": {"field": "params.status", "op": "eq", "value": "F:3-MEDIUM"}}]}),
    Monitor(6, 1, contract(UNSPECIFIED), chain.ADJUST, filter={"field": "params.delta", "op": "lt", "value": "0"}),
    Monitor(7, 1, contract(LOW), chain.STORE, filter={"field": "params.arg2", "op": "lte", "value": "127"}),
    Monitor(8, 8453, contract(URGENT), chain.TRANSFER, cursor=20),
    Monitor(9, 1, contract("purchase"), chain.ACTIVITY),
    Monitor(10, 1, contract("error"), chain.ACTIVITY, filter={"and": [{"field": "params.amount", "op": "lt", "value": "0"}, {"field": "event.log_index", "op": "gte", "value": "5"}]}),
    Monitor(11, 8453, contract("signup"), chain.MESSAGE),
    Monitor(12, 1, contract(URGENT), chain.TRANSFER, enabled=False),
    Monitor(13, 1, contract(URGENT), chain.TRANSFER, end_block=5, cursor=5, completed=True),
    Monitor(14, 1, contract(URGENT), chain.TRANSFER, start_block=1_000_000_000),
    Monitor(15, 1, contract("click"), chain.ACTIVITY),
]

# --- what the oracle knows of the derived tables, recomputed from the original columns
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
CHAIN_O, CHAIN_E = "CASE WHEN o_custkey % 4 = 0 THEN 8453 ELSE 1 END", "CASE WHEN user_id % 4 = 0 THEN 8453 ELSE 1 END"
USUAL = "o_orderkey % 97 <> 0 AND o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 1"
SOUND_KEYS = f"{USUAL} AND o_orderkey % 53 <> 0"
SOUND = f"o_orderstatus <> 'P' AND {SOUND_KEYS}"
TX = "'0x' || sha256('tx:' || o_orderkey)"
AMOUNT = "CAST(round(value * 100) AS BIGINT) * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def calls(spark: SparkSession, sf_dir: str, monitors: list[Monitor], decoded_only: bool = True) -> DataFrame:
    table = match.registry(spark, monitors)
    found = match.decoded(match.matched_calls(chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), table))
    return found.where("ok") if decoded_only else found


def events(spark: SparkSession, sf_dir: str, monitors: list[Monitor], decoded_only: bool = True) -> DataFrame:
    found = match.decoded(match.matched_events(chain.logs(spark, sf_dir), match.registry(spark, monitors)))
    return found.where("ok") if decoded_only else found


def only(*ids: int) -> list[Monitor]:
    return [m for m in MONITORS if m.id in ids]


def shown(df: DataFrame, *names: str) -> DataFrame:
    return df.select("monitor_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), *[F.get_json_object("params", f"$['{n}']").alias(n) for n in names])


def transfers(where: str, monitor: int = 1, chain_id: int = 1, to: str = "to", value: str = "value") -> str:
    return f"""SELECT CAST({monitor} AS BIGINT) AS monitor_id, o_orderkey // 10 AS block_number, {TX} AS tx_hash,
      '0x' || left(sha256('eoa:' || (o_custkey + 1)), 40) AS "{to}", CAST({CENTS} AS VARCHAR) AS "{value}"
      FROM orders WHERE {CHAIN_O} = {chain_id} AND o_orderpriority = '{URGENT}' AND {SOUND} AND {where}"""


@query(transfers(f"{CENTS} >= 25000000"))
def calls_transfer_gte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calls(spark, sf_dir, only(1)), "to", "value")


@query(transfers("o_orderkey // 10 BETWEEN 10 AND 40", 2, to="recipient", value="amount"))
def calls_renamed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calls(spark, sf_dir, only(2)), "recipient", "amount")


@query(transfers("o_orderkey // 10 > 20", 8, 8453))
def calls_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calls(spark, sf_dir, only(8)), "to", "value")


for _op, _sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):

    def _filtered(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        # a value that occurs: the median of what was sent, by its place
        sent = chain.table(spark, sf_dir, "orders").where(F.expr(f"o_orderpriority = '{URGENT}' AND o_orderstatus <> 'P' AND o_custkey % 4 <> 0 AND {SOUND_KEYS}"))
        middle = sent.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT))")).first()[0]
        chosen = Monitor(1, 1, contract(URGENT), chain.TRANSFER, filter={"field": "params.value", "op": op, "value": str(int(middle))})
        return shown(calls(spark, sf_dir, [chosen]), "to", "value")

    _MIDDLE = f"(SELECT quantile_disc({CENTS}, 0.5) FROM orders WHERE {CHAIN_O} = 1 AND o_orderpriority = '{URGENT}' AND {SOUND})"
    QUERIES[f"filter_{_op}"], ORACLE_SQL[f"filter_{_op}"] = _filtered, transfers(f"{CENTS} {_sign} {_MIDDLE}")


@query(f"""SELECT CAST(4 AS BIGINT) AS monitor_id, o_orderkey // 10 AS block_number, {TX} AS tx_hash,
  '0x' || left(sha256('eoa:' || (o_custkey + 2)), 40) AS spender, CAST(CAST(18446744073709551616 AS HUGEINT) + {CENTS} AS VARCHAR) AS value
  FROM orders WHERE {CHAIN_O} = 1 AND o_orderpriority = '{HIGH}' AND {SOUND}""")
def filter_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calls(spark, sf_dir, only(4)), "spender", "value")


@query(f"""SELECT CAST(5 AS BIGINT) AS monitor_id, o_orderkey // 10 AS block_number, {TX} AS tx_hash,
  o_orderstatus || ':' || o_orderpriority AS status, 'true' AS flag
  FROM orders WHERE {CHAIN_O} = 1 AND o_orderpriority = '{MEDIUM}' AND {SOUND} AND o_custkey % 2 = 1 AND o_orderstatus <> 'F'""")
def filter_and_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calls(spark, sf_dir, only(5)), "status", "flag")


@query(f"""SELECT CAST(6 AS BIGINT) AS monitor_id, o_orderkey // 10 AS block_number, {TX} AS tx_hash,
  CAST({CENTS} - 25000000 AS VARCHAR) AS delta, '0x' || sha256('memo:' || o_orderkey) AS memo
  FROM orders WHERE {CHAIN_O} = 1 AND o_orderpriority = '{UNSPECIFIED}' AND {SOUND} AND {CENTS} < 25000000""")
def calls_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calls(spark, sf_dir, only(6)), "delta", "memo")


@query(f"""SELECT CAST(7 AS BIGINT) AS monitor_id, o_orderkey // 10 AS block_number, {TX} AS tx_hash,
  '0x' || lower(hex(repeat(o_orderpriority, CAST(1 + o_custkey % 8 AS BIGINT)))) AS arg0, '0x' || left(sha256('tag:' || o_custkey), 8) AS arg1, CAST(o_custkey % 256 AS VARCHAR) AS arg2
  FROM orders WHERE {CHAIN_O} = 1 AND o_orderpriority = '{LOW}' AND {SOUND} AND o_custkey % 256 <= 127""")
def calls_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(calls(spark, sf_dir, only(7)), "arg0", "arg1", "arg2")


@query(f"""SELECT o_orderkey // 10 AS block_number, {TX} AS tx_hash FROM orders
  WHERE {CHAIN_O} = 1 AND o_orderpriority = '{URGENT}' AND o_orderstatus <> 'P' AND {USUAL} AND o_orderkey % 53 = 0""")
def calls_decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls(spark, sf_dir, [Monitor(1, 1, contract(URGENT), chain.TRANSFER)], decoded_only=False).where("NOT ok")
    return found.select("block_number", hex0x(F.col("tx_hash")).alias("tx_hash"))


@query(f"""SELECT o_orderkey // 10 AS block_number, {TX} AS tx_hash FROM orders
  WHERE {CHAIN_O} = 1 AND o_orderpriority IN ('{URGENT}', '{HIGH}') AND {USUAL}""")
def candidates_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = match.registry(spark, only(1, 2, 4, 12))
    return match.call_candidates(chain.transactions(spark, sf_dir), table).select("block_number", hex0x(F.col("tx_hash")).alias("tx_hash"))


EVENT = "event_id // 20 AS block_number, '0x' || sha256('etx:' || (event_id // 5)) AS tx_hash, event_id % 20 AS log_index"


@query(f"""SELECT CAST(9 AS BIGINT) AS monitor_id, {EVENT}, CAST(user_id AS VARCHAR) AS actor, CAST({AMOUNT} AS VARCHAR) AS amount, props
  FROM events WHERE {CHAIN_E} = 1 AND event_type = 'purchase'""")
def events_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir, only(9))
    return found.select("monitor_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "log_index", *[F.get_json_object("params", f"$.{n}").alias(n) for n in ("actor", "amount", "props")])


@query(f"""SELECT CAST(10 AS BIGINT) AS monitor_id, {EVENT}, CAST({AMOUNT} AS VARCHAR) AS amount
  FROM events WHERE {CHAIN_E} = 1 AND event_type = 'error' AND {AMOUNT} < 0 AND event_id % 20 >= 5""")
def filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, only(10)).select("monitor_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "log_index", F.get_json_object("params", "$.amount").alias("amount"))


@query(f"""SELECT CAST(11 AS BIGINT) AS monitor_id, {EVENT}, '0x' || sha256('key:' || user_id) AS key, props AS value
  FROM events WHERE {CHAIN_E} = 8453 AND event_type = 'signup'""")
def events_indexed_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, only(11)).select("monitor_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "log_index", F.get_json_object("params", "$.who").alias("key"), F.get_json_object("params", "$.note").alias("value"))


@query(f"SELECT {EVENT} FROM events WHERE {CHAIN_E} = 1 AND event_type = 'click' AND event_id % 37 = 0")
def events_decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, only(15), decoded_only=False).where("NOT ok").select("block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "log_index")


@query(f"""SELECT {CHAIN_E} AS chain_id, {EVENT} FROM events
  WHERE ({CHAIN_E} = 1 AND event_type IN ('purchase', 'error', 'click')) OR ({CHAIN_E} = 8453 AND event_type = 'signup')""")
def events_pair_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = blocks.log_targets(match.registry(spark, MONITORS))
    return blocks.exact_pairs(chain.logs(spark, sf_dir), targets).select("chain_id", "block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "log_index")


HEAD = "(SELECT max(o_orderkey) // 10 - 10 FROM orders)"
ROWS = ", ".join(f"({m.id}, {m.chain_id}, '{m.target.kind}', {m.start_block}, {'NULL' if m.end_block is None else m.end_block}, {'NULL' if m.cursor is None else m.cursor})" for m in MONITORS if m.enabled and not m.completed)
ACTIVE = f"(SELECT CAST(id AS BIGINT) AS id, CAST(chain_id AS BIGINT) AS chain_id, start_block, CAST(end_block AS BIGINT) AS end_block, CAST(cursor AS BIGINT) AS cursor FROM (VALUES {ROWS}) AS v(id, chain_id, kind, start_block, end_block, cursor))"
GOAL = f"least({HEAD}, coalesce(end_block, {HEAD}))"
PLANNED = f"""(SELECT chain_id, id, unnest(generate_series(coalesce(cursor + 1, start_block), least({GOAL}, coalesce(cursor + 1, start_block) + 9))) AS block_number
  FROM {ACTIVE} WHERE coalesce(cursor + 1, start_block) <= {GOAL})"""


@query(f"SELECT chain_id, block_number, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS monitor_ids FROM {PLANNED} GROUP BY chain_id, block_number")
def plan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = blocks.plan_blocks(match.registry(spark, MONITORS), chain.heads(spark, sf_dir))
    return planned.withColumn("monitor_ids", F.array_join("monitor_ids", ","))


@query(f"""SELECT chain_id, min(block_number) AS from_block, max(block_number) AS to_block FROM (
  SELECT chain_id, block_number, run, (row_number() OVER (PARTITION BY chain_id, run ORDER BY block_number) - 1) // 3 AS part FROM (
    SELECT chain_id, block_number, block_number - row_number() OVER (PARTITION BY chain_id ORDER BY block_number) AS run
    FROM (SELECT DISTINCT chain_id, block_number FROM {PLANNED}))) GROUP BY chain_id, run, part""")
def plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.plan_windows(blocks.plan_blocks(match.registry(spark, MONITORS), chain.heads(spark, sf_dir)), 3)


@query(f"""SELECT chain_id, CAST(max(CASE WHEN cursor IS NOT NULL THEN greatest({GOAL} - cursor, 0) WHEN start_block <= {GOAL} THEN {GOAL} - start_block + 1 ELSE 0 END) AS BIGINT) AS lag
  FROM {ACTIVE} GROUP BY chain_id""")
def lag_by_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.lag_by_chain(match.registry(spark, MONITORS), chain.heads(spark, sf_dir))


@query(f"""SELECT id, max(block_number) AS cursor, coalesce(max(block_number) >= max(end_block), false) AS completed
  FROM {PLANNED} AS p JOIN (SELECT id AS mid, end_block FROM {ACTIVE}) ON id = mid GROUP BY id""")
def cursor_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = match.registry(spark, MONITORS)
    planned = blocks.plan_blocks(table, chain.heads(spark, sf_dir))
    after = blocks.advanced(table, planned)
    return after.join(planned.select(F.explode("monitor_ids").alias("id")).distinct(), "id", "left_semi").select("id", "cursor", "completed")


def _results(spark: SparkSession, sf_dir: str, *ids: int) -> DataFrame:
    return match.indexed(chain.transactions(spark, sf_dir), chain.receipts(spark, sf_dir), chain.logs(spark, sf_dir), only(*ids))


@query(f"""SELECT o_orderkey // 10 AS block_number, {TX} AS tx_hash FROM orders
  WHERE {CHAIN_O} = 1 AND o_orderpriority = '{URGENT}' AND {SOUND} AND {CENTS} >= 25000000 ORDER BY block_number DESC, tx_hash DESC LIMIT 50 OFFSET 10""")
def results_page_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.page(_results(spark, sf_dir, 1), 1, "call", 50, 10).select("block_number", hex0x(F.col("tx_hash")).alias("tx_hash"))


@query(f"SELECT {EVENT} FROM events WHERE {CHAIN_E} = 1 AND event_type = 'purchase' ORDER BY event_id DESC LIMIT 50")
def results_page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.page(_results(spark, sf_dir, 9), 9, "event").select("block_number", hex0x(F.col("tx_hash")).alias("tx_hash"), "log_index")


def _item(kind: str, monitor: int, tx: str, middle: str, params: str) -> str:
    return f"""'{{"kind":"{kind}","monitor_id":{monitor},"tx_hash":"' || {tx} || '",' || {middle} || ',"params":{{' || {params} || '}}}}'"""


_CALL = _item("call", 1, TX, f"""'"from":"0x' || left(sha256('eoa:' || o_custkey), 40) || '","to":"0x{contract(URGENT)}"'""", f"""'"to":"0x' || left(sha256('eoa:' || (o_custkey + 1)), 40) || '","value":"' || {CENTS} || '"'""")
_EVENT = _item("event", 9, "'0x' || sha256('etx:' || (event_id // 5))", f"""'"emitter":"0x{contract('purchase')}","log_index":' || (event_id % 20)""", f"""'"actor":"' || user_id || '","amount":"' || {AMOUNT} || '","props":' || to_json(props)""")


@query(f"""SELECT 1 AS version, chain_id, block_number, count(*) AS n, '[' || string_agg(item, ',' ORDER BY kind, tx_hash, log_index) || ']' AS results FROM (
  SELECT CAST(1 AS BIGINT) AS chain_id, o_orderkey // 10 AS block_number, 'call' AS kind, {TX} AS tx_hash, 0 AS log_index, {_CALL} AS item
  FROM orders WHERE {CHAIN_O} = 1 AND o_orderpriority = '{URGENT}' AND {SOUND} AND {CENTS} >= 25000000
  UNION ALL SELECT CAST(1 AS BIGINT), event_id // 20, 'event', '0x' || sha256('etx:' || (event_id // 5)), event_id % 20, {_EVENT}
  FROM events WHERE {CHAIN_E} = 1 AND event_type = 'purchase') GROUP BY chain_id, block_number""")
def sink_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.sink_batches(_results(spark, sf_dir, 1, 9), match.registry(spark, only(1, 9)))


COMMITS = f"""(SELECT chain_id, block_number, count(*) FILTER (o_orderstatus <> 'P') AS calls, count(*) FILTER (o_orderstatus = 'F') AS events,
  CASE WHEN block_number % 29 = 0 THEN 'error' ELSE 'success' END AS outcome, 0.001 * (1 + block_number % 97) AS elapsed_s
  FROM (SELECT CAST({CHAIN_O} AS BIGINT) AS chain_id, o_orderkey // 10 AS block_number, o_orderstatus FROM orders) GROUP BY chain_id, block_number)"""


@query(f"SELECT chain_id, count(*) AS blocks, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(events) AS BIGINT) AS events FROM {COMMITS} WHERE outcome = 'success' GROUP BY chain_id")
def commit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.commit_metrics(chain.commits(spark, sf_dir))


@query(f"""SELECT chain_id, outcome, CAST(le AS INTEGER) AS le_ms, count(*) FILTER (1 + block_number % 97 <= le) AS n
  FROM {COMMITS}, (SELECT unnest([1,2,4,8,16,32,64,128,256,512,1024,2048,4096,8192,16384,32768]) AS le) GROUP BY chain_id, outcome, le""")
def commit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.commit_histogram(chain.commits(spark, sf_dir)).select("chain_id", "outcome", F.round(F.col("le") * 1000).cast("int").alias("le_ms"), "n")


@query("""SELECT chain_id, url, height, latency_ms, position FROM (
  SELECT *, row_number() OVER w AS position, first_value(height) OVER w AS top, first_value(latency_ms) OVER w AS fast FROM (
    SELECT CAST(s_nationkey AS BIGINT) AS chain_id, 'https://rpc' || s_suppkey AS url, 1000 - s_suppkey % 7 AS height, CAST(trunc(abs(s_acctbal)) AS INTEGER) AS latency_ms
    FROM supplier WHERE s_suppkey % 13 <> 0) WINDOW w AS (PARTITION BY chain_id ORDER BY height DESC, latency_ms, url))
  WHERE top - height <= 3 AND latency_ms - fast <= 5000""")
def endpoint_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rank_endpoints(chain.endpoints(spark, sf_dir))


@query("""SELECT CAST(s_nationkey AS BIGINT) AS chain_id, round(max(s_acctbal), 2) AS tvl, count(*) AS n_rpcs FROM supplier
  GROUP BY s_nationkey ORDER BY tvl DESC, n_rpcs DESC, chain_id LIMIT 10""")
def chain_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_chains(chain.endpoints(spark, sf_dir), 10)


@query(f"""SELECT chain_id, CASE WHEN last_bad THEN 'degraded' ELSE 'running' END AS state, finalized_head, CASE WHEN last_bad THEN 'block source request failed' END AS last_error FROM (
  SELECT chain_id, arg_max(bad, place) AS last_bad, arg_max(event_id // 20, place) FILTER (NOT bad) AS finalized_head
  FROM (SELECT CAST({CHAIN_E} AS BIGINT) AS chain_id, event_id, event_type = 'error' AS bad, row_number() OVER (ORDER BY ts, event_id) AS place FROM events) GROUP BY chain_id)""")
def chain_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = chain.poll_log(spark, sf_dir)
    enabled = chain.heads(spark, sf_dir).select("chain_id", F.lit(True).alias("enabled"))
    return reports.chain_status(polls, enabled)


@query(f"""SELECT CAST(9 AS BIGINT) AS monitor_id, count(*) AS n FROM events WHERE {CHAIN_E} = 1 AND event_type = 'purchase'""")
def cascade_delete_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = results.without(_results(spark, sf_dir, 1, 9), match.registry(spark, only(1)).select(F.col("id").alias("monitor_id")), "monitor_id")
    return kept.groupBy("monitor_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT CAST(1 AS BIGINT) AS monitor_id, {TX} AS tx_hash, CAST(2 AS BIGINT) AS copies FROM orders
  WHERE {CHAIN_O} = 1 AND o_orderpriority = '{URGENT}' AND {SOUND} AND {CENTS} >= 25000000 AND (o_orderkey // 10) % 50 = 0""")
def identity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _results(spark, sf_dir, 1)
    again = found.unionByName(found.where("block_number % 50 = 0"))  # a batch that was delivered in part once before
    return results.duplicates(again, "call").select("monitor_id", hex0x(F.col("tx_hash")).alias("tx_hash"), "copies")
