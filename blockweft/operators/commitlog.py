"""A log of numbered records: record n can be created once, by one writer, and readers see it whole or not at all.

Under ``root`` lie ``log/N`` (the attempt that won batch N, one small file) and, every COMPACT records, ``snapshots/N``: all
records up to N in one Parquet table, so that a reader opens one snapshot and the few records after it.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

COMPACT = 20
RECORDS = "batch_id long, attempt string"


def _place(spark: SparkSession, path: str):  # noqa: ANN202 - (file system, path) of the JVM
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that name what lies in a folder."""
    files, place = _place(spark, folder)
    found = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n) for n in found if n.isdigit())


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with ``text``; false if it exists. Of writers at the same time one succeeds.

    The text goes to a file of its own first, so that the claimed name never has half of it.
    """
    files, place = _place(spark, path)
    local = files.getScheme() == "file"
    if local:  # the file system's own creation is not exclusive here, a hard link is
        target = place.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        own = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(own, "x") as f:
            f.write(text)
        try:
            os.link(own, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    try:
        out = files.create(place, False)
    except Py4JJavaError as error:
        if files.exists(place):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def record(spark: SparkSession, root: str, number: int, attempt: str) -> bool:
    return claim(spark, f"{root}/log/{number}", attempt)


def tail(spark: SparkSession, root: str) -> tuple[int, dict[int, str]]:
    """(the newest snapshot's number or -1, attempts of the records after it); COMPACT of them at most, but for failures."""
    newest = max((n for n in numbers(spark, f"{root}/snapshots") if _place(spark, f"{root}/snapshots/{n}/_SUCCESS")[0].exists(_place(spark, f"{root}/snapshots/{n}/_SUCCESS")[1])), default=-1)
    after = [n for n in numbers(spark, f"{root}/log") if n > newest]
    return newest, {n: _text(spark, f"{root}/log/{n}") for n in after}


def _text(spark: SparkSession, path: str) -> str:
    files, place = _place(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def records(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, attempt) of all batches that count."""
    newest, later = tail(spark, root)
    rows = spark.createDataFrame(list(later.items()), RECORDS)
    return rows if newest < 0 else spark.read.parquet(f"{root}/snapshots/{newest}/records").unionByName(rows)


def holds(spark: SparkSession, root: str, number: int) -> bool:
    files, place = _place(spark, f"{root}/log/{number}")
    return files.exists(place)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of one's own that nothing will read."""
    files, place = _place(spark, path)
    files.delete(place, True)
