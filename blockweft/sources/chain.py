"""Chain-shaped tables derived from the given ones: transactions, receipts, logs, heads, commits, polls, endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweft.functions.abi import encode_number, encode_text, parse_signature

TRANSFER = "function transfer(address to, uint256 value)"
APPROVE = "function approve(address spender, uint256 value)"
STATUS = "function setStatus(string status, bool flag)"
ADJUST = "function adjust(int256 delta, bytes32 memo)"
STORE = "function store(bytes, bytes4, uint8)"
ACTIVITY = "event Activity(uint256 indexed actor, int256 amount, string props)"
MESSAGE = "event Signup(string indexed who, string note)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: dict[str, Column], **columns: Column) -> DataFrame:
    """``key`` and ``columns`` of ``df``; ``columns`` are computed once for each row, not again in every expression that
    uses them, and only for rows that pass the filters on ``key``."""
    return df.select(*[v.alias(k) for k, v in key.items()], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"), 256)


def account(k: Column) -> Column:
    return F.substring(digest("eoa:", k), 1, 40)


def contract(n: Column | str) -> Column:
    return F.substring(digest("contract:", n), 1, 40)


def chain_of(k: Column) -> Column:
    return F.when(k % 4 == 0, F.lit(8453)).otherwise(F.lit(1)).cast("long")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    key, who, cents = F.col("o_orderkey"), F.col("o_custkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    pick = lambda sig: F.lit(parse_signature(sig).hash.hex())
    address = lambda h: F.lpad(h, 64, "0")
    big = F.lpad(F.concat(F.lit("1"), F.lpad(F.hex(cents), 16, "0")), 64, "0")
    normal = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(pick(TRANSFER), address(account(who + 1)), encode_number(cents)))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(pick(APPROVE), address(account(who + 2)), big))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(pick(STATUS), encode_number(F.lit(64)), encode_number(who % 2), encode_text(F.concat_ws(":", "o_orderstatus", "o_orderpriority"))))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(pick(ADJUST), encode_number(cents - 25_000_000), digest("memo:", key)))
        .otherwise(F.concat(pick(STORE), encode_number(F.lit(96)), F.rpad(F.substring(digest("tag:", who), 1, 8), 64, "0"), encode_number(who % 256), encode_text(F.repeat(F.col("o_orderpriority"), (1 + who % 8).cast("int")))))
    )
    body = F.when(key % 101 == 0, F.lit("")).when(key % 103 == 1, F.lit("a9059c")).when(key % 53 == 0, F.substring(normal, 1, 70)).otherwise(normal)
    return once(
        o,
        {"chain_id": chain_of(who), "block_number": F.expr("o_orderkey div 10"), "tx_index": (key % 10).cast("int")},
        tx_hash=F.unhex(digest("tx:", key)),
        from_addr=F.unhex(account(who)),
        to_addr=F.when(key % 97 != 0, F.unhex(contract(F.col("o_orderpriority")))),
        input=F.unhex(body),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(chain_of(F.col("o_custkey")).alias("chain_id"), F.expr("o_orderkey div 10").alias("block_number"), F.unhex(digest("tx:", F.col("o_orderkey"))).alias("tx_hash"), (F.col("o_orderstatus") != "P").alias("succeeded"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    kind, amount = F.col("event_type"), F.round(F.col("value") * 100).cast("long") * F.when(F.col("event_type") == "error", -1).otherwise(1)
    topic = lambda sig: F.unhex(F.lit(parse_signature(sig).hash.hex()))
    usual = F.array(topic(ACTIVITY), F.unhex(encode_number(F.col("user_id"))))
    topics = (
        F.when((kind == "view") & (F.col("event_id") % 11 == 0), F.expr("CAST(array() AS array<binary>)"))
        .when(kind == "signup", F.array(topic(MESSAGE), F.unhex(digest("key:", F.col("user_id")))))
        .when((kind == "click") & (F.col("event_id") % 37 == 0), F.concat(usual, F.array(F.unhex(F.lit("00" * 32)))))
        .otherwise(usual)
    )
    data = F.when(kind == "signup", F.concat(encode_number(F.lit(32)), encode_text(F.col("props")))).otherwise(F.concat(encode_number(amount), encode_number(F.lit(64)), encode_text(F.col("props"))))
    return once(
        e,
        {"chain_id": chain_of(F.col("user_id")), "block_number": F.expr("event_id div 20"), "log_index": F.col("event_id") % 20},
        tx_hash=F.unhex(digest("etx:", F.expr("event_id div 5"))),
        address=F.unhex(contract(kind)),
        topics=topics,
        data=F.unhex(data),
        removed=F.lit(False),
    )


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finalized head of both chains."""
    top = table(spark, sf_dir, "orders").agg(F.expr("max(o_orderkey) div 10 - 10").alias("finalized_head"))
    return top.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(8453).cast("long"))).alias("chain_id"), "finalized_head")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(chain_of(F.col("o_custkey")).alias("chain_id"), F.expr("o_orderkey div 10").alias("block_number"), "o_orderstatus")
    per_block = o.groupBy("chain_id", "block_number").agg(F.count_if(F.col("o_orderstatus") != "P").alias("calls"), F.count_if(F.col("o_orderstatus") == "F").alias("events"))
    return per_block.select("*", F.when(F.col("block_number") % 29 == 0, "error").otherwise("success").alias("outcome"), (0.001 * (1 + F.col("block_number") % 97)).alias("elapsed_s"))


def poll_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(chain_of(F.col("user_id")).alias("chain_id"), F.col("ts").alias("poll_ts"), F.when(~failed, F.expr("event_id div 20")).alias("finalized_head"), F.when(failed, "block source request failed").alias("error"), "event_id")


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    up = F.col("s_suppkey") % 13 != 0
    return s.select(F.col("s_nationkey").cast("long").alias("chain_id"), F.concat(F.lit("https://rpc"), F.col("s_suppkey").cast("string")).alias("url"), F.when(up, 1000 - F.col("s_suppkey") % 7).alias("height"), F.when(up, F.abs("s_acctbal").cast("int")).alias("latency_ms"), F.col("s_acctbal").alias("tvl"))
