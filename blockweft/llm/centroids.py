"""Clustering of vectors around centroids by exact Lloyd rounds with bounds on the norm of summed displacements."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codebooks import updated
from .common import Scratch, discard, read
from .lloyd import SUMS, Sums, above, arrow_schema, below, integer_vectors, matrix, passed, squared, strings, totals

WIDTH, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64

STATE = "vec_id long, vec binary, near int, upper float, told int, low binary, since binary, " + SUMS
PLACED = "vec_id long, vec binary, cluster int, distance long, " + SUMS


def drifts(history: list[np.ndarray]) -> np.ndarray:
    """How far each centroid lies from where it was in each round: the norm of the displacements' sum, not the sum of norms."""
    return np.stack([np.sqrt(((history[-1] - old) ** 2).sum(axis=1)) for old in history])


def placed(x: np.ndarray, centres: np.ndarray, drift: np.ndarray, state: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, ...]:
    """(near, upper, told, low, since): the nearest centroid of each vector, and its bounds with the rounds they are of.

    A stored bound holds for the round it was computed in; now it is loosened by how far that centroid lies from where it
    was then. Where the bounds don't settle it, the distance to the assigned centroid is computed, and then to each whose
    lower bound is not above that; these are compared as integers, ties going to the smaller number.
    """
    now, n = len(drift) - 1, len(x)
    if state is None:
        exact = np.stack([squared(x, c) for c in centres], axis=1)
        near = exact.argmin(axis=1)
        return near, above(np.sqrt(exact.min(axis=1))), np.full(n, now), below(np.sqrt(exact)), np.full(exact.shape, now, np.uint8)
    near, upper, told, low, since = state
    every = np.arange(len(centres))
    high = above(upper.astype(np.float64) + drift[told, near])
    least = below(low.astype(np.float64) - drift[since, every])
    own = every == near[:, None]
    open_ = np.flatnonzero((~own & (least <= high[:, None])).any(axis=1))
    exact = squared(x[open_], centres[near[open_]])
    high[open_] = upper[open_] = above(np.sqrt(exact))
    told[open_] = now
    # the exact distance is a lower bound as well
    low[open_, near[open_]], since[open_, near[open_]] = below(np.sqrt(exact)), now
    best = exact.copy()
    for j in every:
        at = np.flatnonzero(~own[open_, j] & (least[open_, j] <= high[open_]))
        rows = open_[at]
        d = squared(x[rows], centres[j])
        low[rows, j], since[rows, j] = below(np.sqrt(d)), now
        closer = (d < best[at]) | ((d == best[at]) & (j < near[rows]))
        won = rows[closer]
        near[won], best[at[closer]] = j, d[closer]
        upper[won] = above(np.sqrt(d[closer]))
    return near, upper, told, low, since


def _round(history: list[np.ndarray], first: bool, last: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    centres, drift = history[-1], drifts(history)
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column("vec"), "<i4", width).astype(np.int64)
            old = None
            if not first:
                plain = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("near", "upper", "told")]
                old = (*plain, matrix(batch.column("low"), "<f4", k).copy(), matrix(batch.column("since"), "u1", k).copy())
            near, upper, told, low, since = placed(x, centres, drift, old)
            if last:
                distance = squared(x, centres[near])
                sums.add(0, near, distance[:, None])
                own = {"cluster": pa.array(near), "distance": pa.array(distance), "vec": pa.array([b""] * n)}
            else:
                sums.add(0, near, x)
                own = {"near": pa.array(near), "upper": pa.array(upper), "told": pa.array(told), "low": strings(low), "since": strings(since), "vec": batch.column("vec")}
            own["vec_id"] = batch.column("vec_id")
            yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)
        yield sums.batch(schema)

    return run


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """(table of vec_id, cluster, distance; centroids; inertia by cluster) of ``vectors`` (vec_id, embedding).

    Vectors of exactly ``width`` components, none null or non-finite, count; all others are left out. Centroids start as
    the vectors whose ``1:<vec_id>`` has the smallest SHA-256 (repeated ids by content; rows without vec_id come last); of
    fewer vectors, there are fewer. Ties go to the smaller number. An empty table gives an empty result without
    centroids; other columns are ignored. Components whose scaled value exceeds 27 bits are an error.

    A round reads the vectors with their bounds, and writes both anew with the sums of its tasks; the centroids of all
    rounds, of a fixed size, are on the driver. A lost executor's tasks read the last round's table again.
    """
    spark = vectors.sparkSession
    with Scratch() as held:
        rows = integer_vectors(vectors, scale).where(F.col("width") == width)
        named = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
        first = rows.select(named.alias("digest"), "vec").orderBy(F.asc_nulls_last("digest"), "vec").limit(k).collect()
        if not first:
            return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, width), np.int64), {}
        history, table = [np.stack([np.frombuffer(r["vec"], "<i4") for r in first]).astype(np.int64)], rows
        for n in range(rounds + 1):
            last = n == rounds
            before, schema = table, PLACED if last else STATE
            table = passed(before, _round(history, n == 0, last, arrow_schema(schema)), schema, f"centroids-{n}")
            discard(before)
            found = totals(table)
            if not last:
                history.append(updated(history[-1][None], found)[0])
        held.keep(table)
    return table.where("vec IS NOT NULL").select("vec_id", "cluster", "distance"), history[-1], {e: sums[0] for (_, e), (_, sums) in found.items()}


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres, inertia = clustered(read(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    per = F.array(*[F.struct(F.lit(inertia.get(j, 0)).cast("long").alias("i"), F.lit(d).alias("d")) for j, d in enumerate(digests)] or [F.struct(F.lit(0).cast("long").alias("i"), F.lit("").alias("d"))])
    own = F.get(per, F.col("cluster"))
    return rows.select("vec_id", "cluster", "distance", own["i"].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), own["d"].alias("centroid_sha256"))


def op13_sql(k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> str:
    """The same by plain rounds of full comparisons."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT v AS c, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS i FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds + 1):
        distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)])"
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, min(CAST({distance} AS HUGEINT) * 1000 + i) AS best FROM kept, c{n} GROUP BY vec_id)")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT i, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT i, list(CAST({floor} AS BIGINT) ORDER BY j) AS m FROM (
  SELECT CAST(best % 1000 AS BIGINT) AS i, j, sum(v[j]) AS s, count(*) AS n FROM a{n} JOIN kept USING (vec_id), range(1, {width} + 1) AS g(j) GROUP BY ALL) GROUP BY i) USING (i))""")
    steps.append(f"done AS (SELECT vec_id, CAST(best % 1000 AS INTEGER) AS cluster, CAST(best // 1000 AS BIGINT) AS distance FROM a{rounds})")
    return f"""WITH {", ".join(steps)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM done JOIN c{rounds} ON i = cluster"""
