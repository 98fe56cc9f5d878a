"""Publication of batches: data first, then one record that makes them visible together with the new cursors.

Under ``root`` lie ``results``, ``plans``, ``candidates`` and ``commits`` (each ``batch_id=N/attempt=X``), ``polls/batch_id=N``, and the log of
records (``commitlog``). A batch counts from the moment its record names an attempt; what no record names is never read,
so drivers that publish the same batch at once don't harm each other: the record of one of them counts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockweft.operators import commitlog
from blockweft.operators.match import BROADCAST_ROWS, Monitor, active, outcomes, registry
from blockweft.operators.results import identity
from blockweft.plans.blocks import fetched, with_ranges

COMMITS = "monitor_id long, chain_id long, cursor long, completed boolean, error string, bad_block long"
PLANNED = "id long, chain_id long, first long, last long"
RESULTS = "chain_id long, monitor_id long, kind string, block_number long, tx_hash binary, from_addr binary, to_addr binary, log_index long, address binary, params string"
OUTCOMES = RESULTS + ", ok boolean, fault string"
POLLS = "poll_ts timestamp, chain_id long, finalized_head long, decoded long, error string"
STATE = "monitor_id long, cursor long, completed boolean"
#: Most intervals of blocks that a scan is restricted to.
SPANS = 64


class CommitError(ValueError):
    """A batch that must not become visible."""


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """Each monitor's outcome in each batch that counts."""
    found = _stored(spark, f"{root}/commits", f"{COMMITS}, batch_id long, attempt string")
    return found.join(commitlog.records(spark, root), ["batch_id", "attempt"], "left_semi")


def visible(spark: SparkSession, root: str) -> DataFrame:
    """Results of the batches that count, below the first bad block of their chain."""
    ends = commits(spark, root).groupBy("batch_id", "attempt", "chain_id").agg(F.min("bad_block").alias("bad_block"))
    rows = _stored(spark, f"{root}/results", f"{OUTCOMES}, batch_id long, attempt string").where("ok AND fault IS NULL")
    return rows.join(ends, ["batch_id", "attempt", "chain_id"]).where("bad_block IS NULL OR block_number < bad_block").select(*[c.split()[0] for c in RESULTS.split(", ")], "batch_id")


def polls(spark: SparkSession, root: str) -> DataFrame:
    """One row for each chain of each batch that was tried: its head, the results that became visible, and what went wrong."""
    return _stored(spark, f"{root}/polls", POLLS + ", batch_id long")


def record_poll(spark: SparkSession, root: str, batch_id: int, heads: DataFrame, failure: str | None = None, sick: DataFrame | None = None) -> None:
    """Note the outcome of a batch for each chain of ``heads``; again for the same batch, the last outcome holds. ``sick``
    has (chain_id, reason) of chains that were left out."""
    mine = F.col("batch_id") == batch_id
    errors = commits(spark, root).where(mine).groupBy("chain_id").agg(F.max("error").alias("stopped"))  # one row a chain
    counts = visible(spark, root).where(mine).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    rows = heads.join(F.broadcast(errors), "chain_id", "left").join(F.broadcast(counts), "chain_id", "left").withColumn("reason", F.lit(None).cast("string"))
    if sick is not None:
        rows = rows.drop("reason").join(sick.groupBy("chain_id").agg(F.min("reason").alias("reason")), "chain_id", "full")
    rows = rows.select(F.current_timestamp().alias("poll_ts"), "chain_id", "finalized_head", F.coalesce("n", F.lit(0)).alias("decoded"), F.coalesce("reason", F.lit(failure).cast("string"), F.col("stopped")).alias("error"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/polls/batch_id={batch_id}")


def cursors(spark: SparkSession, root: str) -> DataFrame:
    """(monitor_id, cursor, completed) after the last batch of each monitor: the newest snapshot and the commits after it."""
    newest, later = commitlog.tail(spark, root)
    known = spark.read.schema(STATE).parquet(f"{root}/snapshots/{newest}/state") if newest >= 0 else spark.createDataFrame([], STATE)
    rows = known.withColumn("batch_id", F.lit(newest).cast("long"))
    if later:
        paths = [f"{root}/commits/batch_id={n}/attempt={a}" for n, a in later.items()]
        recent = spark.read.schema(f"{COMMITS}, batch_id long, attempt string").option("basePath", f"{root}/commits").parquet(*paths)
        rows = rows.unionByName(recent.select("monitor_id", "cursor", "completed", "batch_id"))
    return rows.groupBy("monitor_id").agg(F.max_by(F.struct("cursor", "completed"), "batch_id").alias("s")).select("monitor_id", "s.*")


def compact(spark: SparkSession, root: str) -> bool:
    """Write a snapshot if COMPACT records or more came after the last one; it counts once its marker is there."""
    newest, later = commitlog.tail(spark, root)
    if len(later) < commitlog.COMPACT:
        return False
    where = f"{root}/snapshots/{max(later)}"
    if max(later) in commitlog.numbers(spark, f"{root}/snapshots"):
        return False  # another driver is at it
    cursors(spark, root).coalesce(1).write.mode("overwrite").parquet(f"{where}/state")
    commitlog.records(spark, root).coalesce(1).write.mode("overwrite").parquet(f"{where}/records")
    return commitlog.claim(spark, f"{where}/_SUCCESS", "")


def progressed(spark: SparkSession, root: str, monitors: DataFrame) -> DataFrame:
    """The registry with the cursors of the commits."""
    last = cursors(spark, root).select(F.col("monitor_id").alias("id"), F.col("cursor").alias("_cursor"), F.col("completed").alias("_completed"), F.lit(True).alias("_known"))
    both = monitors.join(last, "id", "left")
    both = both.withColumn("cursor", F.when(F.col("_known"), F.col("_cursor")).otherwise(F.col("cursor"))).withColumn("completed", F.when(F.col("_known"), F.col("_completed")).otherwise(F.col("completed")))
    return both.select(*monitors.columns)


def spans(planned: DataFrame, most: int = SPANS) -> list[tuple[int, int, int]]:
    """(chain_id, first, last): intervals that hold all planned blocks, one a chain and ``most`` more at most.

    The widest gaps between the monitors' ranges are left out; only these, and the ends of each chain, come to the driver.
    """
    before = W.partitionBy("chain_id").orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    gaps = planned.select("chain_id", "first", F.max("last").over(before).alias("reached")).where("first > reached + 1")
    widest = gaps.distinct().orderBy(F.desc(F.col("first") - F.col("reached")), "chain_id", "first").limit(most).collect()
    out = []
    for r in planned.groupBy("chain_id").agg(F.min("first").alias("low"), F.max("last").alias("high")).orderBy("chain_id").collect():
        low = r["low"]
        for g in sorted((g for g in widest if g["chain_id"] == r["chain_id"]), key=lambda g: g["first"]):
            out.append((r["chain_id"], low, g["reached"]))
            low = g["first"]
        out.append((r["chain_id"], low, r["high"]))
    return out


def within(intervals: list[tuple[int, int, int]], first: str = "block_number", last: str = "block_number") -> Column:
    """Whether a row's blocks meet one of the intervals; plain comparisons, which reach the scan's row groups."""
    each = [(F.col("chain_id") == c) & (F.col(last) >= low) & (F.col(first) <= high) for c, low, high in intervals]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def publish(spark: SparkSession, root: str, batch_id: int, planned: DataFrame, monitors: DataFrame, results: DataFrame, faults: DataFrame) -> bool:
    """Commit a batch of results (RESULTS) and faults (chain_id, block_number, reason); see ``publish_outcomes``."""
    bad = faults.select("chain_id", "block_number", F.col("reason").alias("fault"))
    return publish_outcomes(spark, root, batch_id, planned, monitors, results.withColumn("ok", F.lit(True)).unionByName(bad, allowMissingColumns=True))


def publish_outcomes(spark: SparkSession, root: str, batch_id: int, planned: DataFrame, monitors: DataFrame, found: DataFrame, intervals: list[tuple[int, int, int]] | None = None) -> bool:
    """Commit a batch; false if it was committed before, or by another driver meanwhile.

    ``planned`` has the block range (id, chain_id, first, last) of each monitor, ``monitors`` is the registry, ``found``
    has results and faults (OUTCOMES), which are written in one pass. A chain with faults commits what lies below its
    first bad block and records the reason; other chains aren't touched by it. Blocks without results move cursors
    too. A monitor that is unknown or of another chain, and a repeated identity, fail the batch as a whole.
    """
    if commitlog.holds(spark, root, batch_id):
        return False
    strange = planned.select("id", "chain_id").join(monitors.select("id", "chain_id"), ["id", "chain_id"], "left_anti").orderBy("id").first()
    if strange:
        raise CommitError(f"monitor {strange['id']} is not registered for chain {strange['chain_id']}")
    attempt = uuid.uuid4().hex
    own = f"batch_id={batch_id}/attempt={attempt}"
    columns = [F.col(c).cast(t) if c in found.columns else F.lit(None).cast(t).alias(c) for c, t in (p.split() for p in OUTCOMES.split(", "))]
    # rows of a monitor lie together, so a page of its results reads few row groups
    found.select(*columns).sortWithinPartitions("monitor_id", "block_number").write.mode("overwrite").parquet(f"{root}/results/{own}")
    written = spark.read.schema(OUTCOMES).parquet(f"{root}/results/{own}")
    # one row a chain
    bad = written.where("fault IS NOT NULL").groupBy("chain_id").agg(F.min(F.struct("block_number", "fault")).alias("bad")).select("chain_id", F.col("bad.block_number").alias("bad_block"), F.col("bad.fault").alias("error"))
    ends = monitors.select("id", "end_block", F.col("cursor").alias("before"), F.col("completed").alias("was"))
    moved = planned.join(F.broadcast(bad), "chain_id", "left").join(ends, "id").withColumn("done", F.least("last", F.col("bad_block") - 1))
    far = F.col("done") >= F.col("first")
    moved.select(
        F.col("id").alias("monitor_id"),
        "chain_id",
        F.when(far, F.col("done")).otherwise(F.col("before")).alias("cursor"),
        F.when(far, F.coalesce(F.col("end_block") <= F.col("done"), F.lit(False))).otherwise(F.col("was")).alias("completed"),
        "error",
        "bad_block",
    ).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{own}")
    rows = written.where("ok AND fault IS NULL").join(F.broadcast(bad), "chain_id", "left").where("bad_block IS NULL OR block_number < bad_block")
    # an identity holds a block, so earlier results of the planned blocks are all that can meet it
    earlier = visible(spark, root).where(within(spans(planned) if intervals is None else intervals))
    for kind in ("call", "event"):
        key = identity(kind)
        mine = rows.where(F.col("kind") == kind).select(*key)
        twice = mine.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
        twice = twice or earlier.where(F.col("kind") == kind).select(*key).join(mine, key).first()
        if twice:
            raise CommitError(f"a {kind} of monitor {twice['monitor_id']} is repeated: {bytes(twice['tx_hash']).hex()}")
    return commitlog.record(spark, root, batch_id, attempt)


def step(spark: SparkSession, root: str, batch_id: int, tables: tuple[DataFrame, DataFrame, DataFrame], monitors: DataFrame | list[Monitor], heads: DataFrame, batch: int, sick: DataFrame | None = None, window: int | None = None) -> bool:
    """One incremental step over (transactions, receipts, logs): plan, scan, match, decode, filter, commit.

    ``monitors`` is the registry as a table (or as a list, which becomes one): nothing of it comes to the driver. Each
    monitor takes at most ``batch`` blocks from its cursor and never passes the finalized head. Nothing is planned for
    chains of ``sick`` (chain_id, reason). With ``window``, logs are taken as fetched in windows of that many blocks, of
    which a removed or stray log voids the whole (``match.matched_events``). Matched logs are written first; calls and
    logs behind a chain's first faulty log are not decoded. Candidates of calls are written before
    receipts are looked at, and receipts are shuffled for these only. False if there was nothing to do or the batch was committed before.
    """
    table = registry(spark, monitors) if isinstance(monitors, list) else monitors
    if commitlog.holds(spark, root, batch_id):
        return False
    able = heads if sick is None else heads.join(sick.select("chain_id").distinct(), "chain_id", "left_anti")
    now = progressed(spark, root, table)
    own = f"batch_id={batch_id}/attempt={uuid.uuid4().hex}"
    plan = f"{root}/plans/{own}"
    rows = with_ranges(active(now), able, batch)
    if window:
        rows = fetched(rows, window)
    # the monitors of this step are written once, with all that later parts ask of them
    rows.write.parquet(plan)
    stored = spark.read.schema(rows.schema).parquet(plan)
    count = stored.count()
    if not count:
        return False
    planned, known = stored.select("id", "chain_id", "first", "last"), stored.select(*now.columns)
    intervals = spans(planned)
    # for this step a monitor ends where its plan does
    mine = stored.withColumn("end_block", F.col("last")).drop("first", "last")

    def keep(name: str, candidates: DataFrame) -> DataFrame:
        candidates.write.parquet(f"{root}/candidates/{own}/{name}")
        return spark.read.schema(candidates.schema).parquet(f"{root}/candidates/{own}/{name}")

    txs, receipts, logs = tables
    inside = within(intervals)
    # logs that were asked for in a range are read by that too, as their own block may be wrong
    asked = inside | within(intervals, "first_block", "last_block") if {"first_block", "last_block"} <= set(logs.columns) else inside
    try:
        found = outcomes(txs.where(inside), receipts.where(inside), logs.where(asked), mine, small=count <= BROADCAST_ROWS, keep=keep)
        done = publish_outcomes(spark, root, batch_id, planned, known, found, intervals)
    finally:
        commitlog.discard(spark, f"{root}/candidates/{own}")
    if done:
        compact(spark, root)
    return done
