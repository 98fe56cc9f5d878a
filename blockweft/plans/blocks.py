"""Planning of blocks and windows, log targets, progress and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockweft.operators.match import active

BATCH = 10


def next_block() -> Column:
    return F.coalesce(F.col("cursor") + 1, F.col("start_block"))


def with_ranges(monitors: DataFrame, heads: DataFrame, batch: int = BATCH) -> DataFrame:
    """Monitors that have blocks up to the finalized head, with the next of them as first and last."""
    m = monitors.join(F.broadcast(heads), "chain_id").withColumn("first", next_block())
    last = F.least("finalized_head", F.coalesce("end_block", F.col("finalized_head")), F.col("first") + (batch - 1))
    return m.withColumn("last", last).where("last >= first").select(*monitors.columns, "first", "last")


def ranges(monitors: DataFrame, heads: DataFrame, batch: int = BATCH) -> DataFrame:
    """(id, chain_id, first, last): the next blocks of each monitor that has any up to the finalized head."""
    return with_ranges(monitors, heads, batch).select("id", "chain_id", "first", "last")


def plan_blocks(monitors: DataFrame, heads: DataFrame, batch: int = BATCH) -> DataFrame:
    """(chain_id, block_number, monitor_ids): the next blocks of each active monitor, never beyond the finalized head."""
    spread = ranges(active(monitors), heads, batch).select("chain_id", "id", F.explode(F.sequence("first", "last")).alias("block_number"))
    return spread.groupBy("chain_id", "block_number").agg(F.sort_array(F.collect_list("id")).alias("monitor_ids"))


def plan_windows(blocks: DataFrame, most: int = BATCH) -> DataFrame:
    """(chain_id, from_block, to_block): runs of consecutive planned blocks, of ``most`` blocks at most."""
    chain = W.partitionBy("chain_id").orderBy("block_number")
    runs = blocks.select("chain_id", "block_number").distinct().withColumn("run", F.col("block_number") - F.row_number().over(chain))
    place = F.row_number().over(W.partitionBy("chain_id", "run").orderBy("block_number")) - 1
    cut = runs.withColumn("part", F.floor(place / most))
    return cut.groupBy("chain_id", "run", "part").agg(F.min("block_number").alias("from_block"), F.max("block_number").alias("to_block")).drop("run", "part")


def fetched(planned: DataFrame, most: int = BATCH) -> DataFrame:
    """``planned`` (id, chain_id, first, last) with the windows in which the logs of a monitor's blocks are fetched.

    A run of consecutive planned blocks of a chain is cut into windows of ``most`` blocks from its start (run_first);
    a monitor's windows reach from fetch_first to fetch_last. Ranges of one start are combined before they are sorted.
    """
    if most < 1:
        raise ValueError("a window has a block at least")
    starts = planned.groupBy("chain_id", "first").agg(F.max("last").alias("_last"))
    order = W.partitionBy("chain_id").orderBy("first")
    reached = F.max("_last").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = starts.withColumn("_opens", F.when(reached.isNull() | (F.col("first") > reached + 1), F.col("first")))
    runs = opens.withColumn("run_first", F.max("_opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = runs.withColumn("run_last", F.max("_last").over(W.partitionBy("chain_id", "run_first")))
    start = lambda block: block - (block - F.col("run_first")) % most
    rows = planned.join(ends.select("chain_id", "first", "run_first", "run_last"), ["chain_id", "first"])
    return rows.select(*planned.columns, "run_first", F.lit(most).cast("long").alias("window"), start(F.col("first")).alias("fetch_first"), F.least(start(F.col("last")) + (most - 1), "run_last").alias("fetch_last"))


def log_targets(monitors: DataFrame) -> DataFrame:
    return active(monitors).where("kind = 'event'").select("chain_id", "address", F.col("hash").alias("topic0")).distinct()


def log_groups(targets: DataFrame) -> DataFrame:
    """Requests of exact pairs: by address or by topic, whichever gives fewer for the chain (address if equal)."""
    by_address = targets.groupBy("chain_id", F.array("address").alias("addresses")).agg(F.sort_array(F.collect_list("topic0")).alias("topics"))
    by_topic = targets.groupBy("chain_id", F.array("topic0").alias("topics")).agg(F.sort_array(F.collect_list("address")).alias("addresses"))
    counts = targets.groupBy("chain_id").agg((F.count_distinct("address") <= F.count_distinct("topic0")).alias("use_address"))
    return by_address.join(counts.where("use_address"), "chain_id").select("chain_id", "addresses", "topics").unionByName(by_topic.join(counts.where("NOT use_address"), "chain_id").select("chain_id", "addresses", "topics"))


def exact_pairs(logs: DataFrame, targets: DataFrame) -> DataFrame:
    """Logs of the exact (address, topic0) pairs, never of the product of addresses and topics."""
    keyed = logs.withColumn("topic0", F.try_element_at("topics", F.lit(1)))
    return keyed.join(F.broadcast(targets), ["chain_id", "address", "topic0"], "left_semi")


def lag_by_chain(monitors: DataFrame, heads: DataFrame) -> DataFrame:
    """Blocks that the slowest active monitor of a chain is behind; 0 without monitors."""
    m = active(monitors).join(F.broadcast(heads), "chain_id")
    goal = F.least("finalized_head", F.coalesce("end_block", F.col("finalized_head")))
    behind = F.when(F.col("cursor").isNotNull(), F.greatest(goal - F.col("cursor"), F.lit(0))).when(F.col("start_block") <= goal, goal - F.col("start_block") + 1).otherwise(0)
    return heads.select("chain_id").join(m.groupBy("chain_id").agg(F.max(behind).alias("lag")), "chain_id", "left").select("chain_id", F.coalesce("lag", F.lit(0)).cast("long").alias("lag"))


def min_next_block(monitors: DataFrame) -> DataFrame:
    return active(monitors).groupBy("chain_id").agg(F.min(next_block()).alias("min_next"))


def advanced(monitors: DataFrame, blocks: DataFrame) -> DataFrame:
    """The registry after a batch: cursors at the last planned block, completed where the end is reached."""
    last = blocks.select("chain_id", "block_number", F.explode("monitor_ids").alias("id")).groupBy("id").agg(F.max("block_number").alias("done"))
    moved = monitors.join(F.broadcast(last), "id", "left").withColumn("cursor", F.coalesce("done", "cursor"))
    ended = F.coalesce(F.col("end_block") <= F.col("cursor"), F.lit(False))
    return moved.withColumn("completed", F.when(F.col("done").isNotNull(), ended).otherwise(F.col("completed"))).drop("done")
