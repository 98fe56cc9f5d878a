"""What the exact clustering operators share: integer vectors as bytes, passes that also sum, and new centres."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

#: Components of a vector times the scale lie below this, so that squared distances fit 63 bits with room.
LARGEST = 1 << 27


def whole(vector: Column) -> Column:
    """Whether a vector has only finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integer_vectors(vectors: DataFrame, scale: int, *also: str) -> DataFrame:
    """(vec_id, *also, vec, width): rows whose embedding is whole, as floor(scale * x) in 32-bit integers, little-endian.

    A component too large for exact arithmetic is an error.
    """
    rows = vectors.where(whole(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), *also, F.col("embedding").cast("array<double>").alias("embedding"))
    schema = ", ".join([f"`{c}` {kind}" for c, kind in rows.dtypes if c != "embedding"] + ["vec binary", "width int"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            lists = batch.column("embedding")
            ends = lists.offsets.to_numpy()
            scaled = np.floor(lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] * scale)
            if len(scaled) and np.abs(scaled).max() >= LARGEST:
                raise ValueError(f"a component lies beyond {LARGEST} / {scale}")
            data = scaled.astype("<i4").tobytes()
            cuts = ((ends - ends[0]) * 4).tolist()
            vec = pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
            keep = [batch.column(c) for c in batch.schema.names if c != "embedding"]
            names = [c for c in batch.schema.names if c != "embedding"]
            yield pa.RecordBatch.from_arrays([*keep, vec, pa.array(np.diff(ends).astype(np.int32))], names=[*names, "vec", "width"])

    return bounded_batches(rows).mapInArrow(run, schema)


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A column of equally long byte strings as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def strings(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as byte strings."""
    data, size = np.ascontiguousarray(values).tobytes(), values.shape[1] * values.itemsize
    return pa.array([data[k * size : (k + 1) * size] for k in range(len(values))], pa.binary())


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``y``."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


#: Slack of distances as floating numbers: larger than all rounding of roots, sums and 32-bit bounds.
SLACK = 1e-6


def below(x: np.ndarray) -> np.ndarray:
    """Lower bounds in 32 bits."""
    return np.nextafter((x * (1 - SLACK) - SLACK).astype(np.float32), np.float32(-np.inf))


def above(x: np.ndarray) -> np.ndarray:
    """Upper bounds in 32 bits."""
    return np.nextafter((x * (1 + SLACK) + SLACK).astype(np.float32), np.float32(np.inf))


SUMS = "part int, entry int, n long, sums array<long>"


class Sums:
    """Sums by (part, entry), gathered in a task; they become rows beside those of the vectors."""

    def __init__(self) -> None:
        self.held: dict[tuple[int, int], list] = {}

    def add(self, part: int, entries: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(entries, kind="stable")
        found, starts, counts = np.unique(entries[order], return_index=True, return_counts=True)
        for e, n, total in zip(found.tolist(), counts.tolist(), np.add.reduceat(rows[order], starts, axis=0) if len(order) else []):
            old = self.held.setdefault((part, e), [0, np.zeros(rows.shape[1], np.int64)])
            old[0] += n
            old[1] += total

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        keys = list(self.held)
        own = {"part": [p for p, _ in keys], "entry": [e for _, e in keys], "n": [self.held[k][0] for k in keys], "sums": [self.held[k][1].tolist() for k in keys]}
        return pa.RecordBatch.from_arrays([pa.array(own.get(f.name, [None] * len(keys)), f.type) for f in schema], schema=schema)


def totals(table: DataFrame) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(n, sums) by (part, entry), added up over tasks; one row for each pair comes to the driver."""
    each = table.where("part IS NOT NULL").select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
    added = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rows = added.groupBy("part", "entry").agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "x"))).alias("xs"))
    return {(r["part"], r["entry"]): (r["n"], [x["x"] for x in r["xs"]]) for r in rows.collect()}


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


def passed(table: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """A pass over the rows of vectors of ``table``, written; its rows of sums have no vector."""
    rows = table.where("vec IS NOT NULL") if "part" in table.columns else table
    return cut(bounded_batches(rows).mapInArrow(run, schema), name)
