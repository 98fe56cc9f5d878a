"""Reports: commit metrics, duration histogram, chain status, endpoint ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper ends of the duration buckets, in seconds.
BUCKETS = tuple(0.001 * 2**k for k in range(16))


def commit_metrics(commits: DataFrame) -> DataFrame:
    good = commits.where("outcome = 'success'")
    return good.groupBy("chain_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("calls").alias("calls"), F.sum("events").alias("events"))


def commit_histogram(commits: DataFrame) -> DataFrame:
    """(chain_id, outcome, le, n): cumulative counts of commits that took at most ``le`` seconds."""
    counts = commits.groupBy("chain_id", "outcome").agg(*[F.count_if(F.col("elapsed_s") <= le).alias(f"b{k}") for k, le in enumerate(BUCKETS)])
    cells = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"b{k}").alias("n")) for k, le in enumerate(BUCKETS)])
    return counts.select("chain_id", "outcome", F.inline(cells))


def chain_status(polls: DataFrame, enabled: DataFrame, then_by: str = "event_id") -> DataFrame:
    """State of each chain by its last poll (by poll_ts, then ``then_by``); an error keeps the head of the last success."""
    good = F.col("error").isNull()
    at = F.struct("poll_ts", then_by)
    last = polls.groupBy("chain_id").agg(
        F.max_by("finalized_head", F.when(good, at)).alias("finalized_head"), F.max(F.when(good, F.col("poll_ts"))).alias("last_success"), F.max_by("error", F.when(~good, at)).alias("last_error"), F.max_by(good, at).alias("fine")
    )
    joined = enabled.join(last, "chain_id", "left")
    state = F.when(~F.col("enabled"), "disabled").when(F.col("fine").isNull(), "starting").when(F.col("fine"), "running").otherwise("degraded")
    return joined.select("chain_id", state.alias("state"), "finalized_head", F.when(~F.col("fine"), F.col("last_error")).alias("last_error"))


def rank_endpoints(endpoints: DataFrame, behind: int = 3, slower: int = 5000) -> DataFrame:
    """Live endpoints by height and latency; those too far behind the first, or too slow, are dropped."""
    order = W.partitionBy("chain_id").orderBy(F.desc("height"), "latency_ms", "url")
    ranked = endpoints.where("height IS NOT NULL AND latency_ms IS NOT NULL").withColumn("position", F.row_number().over(order))
    ranked = ranked.withColumn("top", F.first("height").over(order)).withColumn("fast", F.first("latency_ms").over(order))
    return ranked.where((F.col("top") - F.col("height") <= behind) & (F.col("latency_ms") - F.col("fast") <= slower)).select("chain_id", "url", "height", "latency_ms", F.col("position").cast("long").alias("position"))


def top_chains(endpoints: DataFrame, n: int) -> DataFrame:
    """The n chains of the largest value, then most endpoints; 0 takes all; by id."""
    by_chain = endpoints.groupBy("chain_id").agg(F.round(F.max("tvl"), 2).alias("tvl"), F.count(F.lit(1)).alias("n_rpcs"))
    return (by_chain.orderBy(F.desc("tvl"), F.desc("n_rpcs"), "chain_id").limit(n) if n else by_chain).orderBy("chain_id")
