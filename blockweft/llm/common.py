"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space as the word contracts of the operators define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="blockweft-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].tables.append((spark, path, written))
    return written


class Scratch:
    """Within ``with Scratch() as held`` tables that ``cut`` writes are deleted at the end, but for those given to
    ``held.keep``. Delete only what is read no more: all that was made of it has to be written itself."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str, DataFrame]] = []
        self.kept: list[DataFrame] = []

    def keep(self, *tables: DataFrame) -> None:
        self.kept += tables

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        _open.pop()
        for spark, path, table in self.tables:
            if any(table is k for k in self.kept):
                if _open:
                    _open[-1].tables.append((spark, path, table))
            elif kind is None:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_open: list[Scratch] = []


def discard(table: DataFrame) -> None:
    """Delete a table of the innermost ``Scratch`` before its end."""
    for k, (spark, path, held) in enumerate(_open[-1].tables if _open else []):
        if held is table:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            del _open[-1].tables[k]
            return


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """What ``fit`` makes of a bounded sample of labelled rows, worked out in one task; only the result comes to the driver."""
    columns = sample.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        yield pd.DataFrame({"model": [cloudpickle.dumps(fit(pd.concat(held, ignore_index=True) if held else pd.DataFrame(columns=columns)))]})

    found = map_batches(sample.repartition(1), run, "model binary").collect()
    return cloudpickle.loads(bytes(found[0]["model"])) if found else fit(pd.DataFrame(columns=columns))


#: Bytes of the batches of rows that tasks hand to Python.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType) -> DataFrame:
    """``mapInPandas`` in batches of BATCH_BYTES, or of what the session has where that is less.

    Texts differ in length, so a count of rows alone doesn't bound a task's memory. The session keeps the lower bound.
    """
    return bounded_batches(df).mapInPandas(run, schema)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands rows to Python in batches of BATCH_BYTES at most."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", conf.get(name).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row.

    A plain column may be merged into the expressions that use it, and inside a lambda it is then computed again for
    each element. What a generator makes stays as it is.
    """
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


#: Most groups that ``lookup`` broadcasts.
HOT_GROUPS = 10_000


def lookup(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row a key, ``count`` rows each) that one huge group can't skew.

    Groups of at least total / HOT_GROUPS rows number HOT_GROUPS at most, so they are broadcast; all others are
    joined by shuffle, where no key is large. ``groups`` should be cheap to read twice.
    """
    least = max(1_000, -(-total // HOT_GROUPS))
    values = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(count) >= least).select(F.col(key), F.struct(*values).alias("_hot"))
    cold = groups.where(F.col(count) < least).select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    # a row that has met its hot group gets a key of its own that finds nothing
    own = F.unhex(F.concat(F.lit("ff"), F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in rows.columns if c != key]))))
    met = rows.join(F.broadcast(hot), key, "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(own))
    found = met.join(cold, "_key", "left").withColumn("_got", F.coalesce("_hot", "_cold"))
    return found.select(*rows.columns, *[F.col(f"_got.{v}").alias(v) for v in values])
