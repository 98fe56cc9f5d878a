"""Continuous indexing: micro-batches of finalized heads drive the same step as a batch run."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockweft.operators import publish, registry, results
from blockweft.operators.match import Monitor
from blockweft.operators.match import registry as listed

Step = Callable[[DataFrame, int], None]
Tables = Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]]


def index_step(root: str, tables: Tables, monitors: Callable[[], DataFrame | list[Monitor]], batch: int, sink: Step | None = None, sources: Callable[[SparkSession], DataFrame] | None = None, tries: int = 3, pause: float = 1.0, window: int | None = None) -> Step:
    """A step for ``run_stream`` over (chain_id, finalized_head) rows.

    Tables and monitors (a list or a stored registry) are asked for in every micro-batch, so new data and changes of the
    registry take effect with the next one. Chains go on from their cursors; a repeated batch id changes nothing. A
    batch that fails is tried again after a pause, without new heads, ``tries`` times in all; then it is recorded
    (``publish.polls``) and leaves cursors where they were, so the next one takes up its blocks.

    ``sources`` gives what each chain's source says of itself (``registry.source_faults``), anew for each try; nothing is
    planned for chains whose source is wrong. ``window`` has the blocks of a request for logs (``publish.step``). ``sink`` gets the payloads of a batch once it is committed, and again if
    the batch is repeated; what fails there is recorded and never takes back a commit.
    """

    def run(heads: DataFrame, batch_id: int) -> None:
        spark = heads.sparkSession
        newest = heads.groupBy("chain_id").agg(F.max("finalized_head").alias("finalized_head"))
        failure, now, sick = None, None, None
        for left in range(tries - 1, -1, -1):
            try:
                now = monitors()
                now = listed(spark, now) if isinstance(now, list) else now
                sick = registry.source_faults(newest, sources(spark)) if sources else None
                publish.step(spark, root, batch_id, tables(spark), now, newest, batch, sick, window)
                failure = None
                break
            except Exception as e:  # the stream outlives a failed batch, whatever made it fail
                failure = f"{type(e).__name__}: {e}".split("\n")[0]
                if left:
                    time.sleep(pause)
        if sink and not failure:
            try:
                done = publish.visible(spark, root).where(F.col("batch_id") == batch_id).drop("batch_id")
                sink(results.sink_batches(done, now), batch_id)
            except Exception as e:
                failure = f"publication: {type(e).__name__}: {e}".split("\n")[0]
        publish.record_poll(spark, root, batch_id, newest, failure, sick)

    return run


def run_stream(heads: DataFrame, step: Step, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Call ``step(new head rows, batch id)`` for each micro-batch; without an interval, until caught up.

    A batch may be repeated after a failure with the same id, so ``step`` must overwrite what it wrote for that id.
    """
    writer = heads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
