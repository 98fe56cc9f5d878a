"""Compression of vectors to codes by a codebook a part, learned by exact Lloyd rounds with adaptive bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, discard, lookup, read
from .lloyd import SUMS, Sums, above, arrow_schema, below, integer_vectors, matrix, passed, squared, strings, totals

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Marks a place of a list of closest entries that is not filled.
NONE = 255
#: Counts how far down their lists searches went; stands beside the numbers of parts.
DEPTHS = -1
#: Share of searches that may go beyond the lists of the next round.
BEYOND = 1 / 16

STATE = "vec_id long, label string, vec binary, near binary, low binary, outer binary, upper binary, " + SUMS
CODED = "vec_id long, label string, vec binary, code string, error long, " + SUMS


def scanned(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """(near, low, outer, upper) from the exact distances to all entries: the b closest in order, and a bound for the others."""
    exact = np.stack([squared(x, c) for c in book], axis=1)
    order = np.argsort(exact, axis=1, kind="stable")  # of ties the lower index is first
    ranked = np.sqrt(np.take_along_axis(exact, order, axis=1))
    near, low = np.full((len(x), b), NONE, np.uint8), np.full((len(x), b), np.inf, np.float32)
    held = min(b, len(book))
    near[:, :held], low[:, :held] = order[:, :held], below(ranked[:, :held])
    outer = below(ranked[:, held]) if held < len(book) else np.full(len(x), np.inf, np.float32)
    return near, low, outer, above(ranked[:, 0])


def resized(near: np.ndarray, low: np.ndarray, outer: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """Lists cut to b places, whose rest the outer bound then covers, or filled up with empty places."""
    old = near.shape[1]
    if b < old:
        return near[:, :b], low[:, :b], np.minimum(outer, low[:, b:].min(axis=1))
    fill = ((0, 0), (0, b - old))
    return np.pad(near, fill, constant_values=NONE), np.pad(low, fill, constant_values=np.inf), outer


def moved_on(x: np.ndarray, book: np.ndarray, shift: np.ndarray, state: tuple[np.ndarray, ...], b: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The state of the last round brought to this one's entries, and how deep each search went.

    Upper bounds grow and lower bounds shrink by how far their entries moved, the outer bound by the furthest move. Where
    the assigned entry's bound stays below all others nothing is computed. Else its exact distance is; then those listed
    entries are compared as integers whose bounds still allow it, and where the outer bound allows an entry that is not
    listed, all are.
    """
    near, low, outer, upper = state
    upper = above(upper.astype(np.float64) + shift[near[:, 0]])
    low = below(low.astype(np.float64) - np.append(shift, np.zeros(NONE + 1 - len(shift)))[near])
    outer = below(outer.astype(np.float64) - shift.max())
    others = np.minimum(low[:, 1:].min(axis=1, initial=np.inf), outer)
    depth = np.zeros(len(x), np.int64)
    open_ = np.flatnonzero(upper >= others)
    exact = squared(x[open_], book[near[open_, 0]])
    upper[open_] = above(np.sqrt(exact))
    still = upper[open_] >= others[open_]
    open_, exact = open_[still], exact[still]
    beyond = upper[open_] >= outer[open_]
    depth[open_[beyond]] = near.shape[1] + 1
    listed, first = open_[~beyond], exact[~beyond]
    if len(listed):
        n, l = near[listed], low[listed]
        tried = (l <= upper[listed, None]) & (n != NONE)
        tried[:, 0] = True
        depth[listed] = n.shape[1] - np.argmax(tried[:, ::-1], axis=1)
        found = np.full(n.shape, np.iinfo(np.int64).max)
        found[:, 0] = first
        for k in range(1, n.shape[1]):
            rows = np.flatnonzero(tried[:, k])
            found[rows, k] = squared(x[listed[rows]], book[n[rows, k]])
        l = np.where(tried, below(np.sqrt(found.astype(np.float64))), l)
        best = found.min(axis=1)
        winner = np.where(found == best[:, None], n, NONE).min(axis=1)
        # the winner is first, the others follow by their bounds
        rank = np.where(n == winner[:, None], np.float32(-np.inf), l)
        order = np.argsort(rank, axis=1, kind="stable")
        near[listed], low[listed] = np.take_along_axis(n, order, axis=1), np.take_along_axis(l, order, axis=1)
        upper[listed] = above(np.sqrt(best))
    near, low, outer = (a.copy() for a in resized(near, low, outer, b))
    again = open_[beyond]
    if len(again):
        near[again], low[again], outer[again], upper[again] = scanned(x[again], book, b)
    return (near, low, outer, upper), depth


def _round(books: np.ndarray, shifts: np.ndarray | None, held: int, b: int, last: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass that assigns all parts; ``held`` places are in the lists read, ``b`` in those written."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column("vec"), "<i4", parts * width).reshape(n, parts, width).astype(np.int64)
            if shifts is not None:
                old = [matrix(batch.column(c), kind, parts * m).reshape(n, parts, m) for c, kind, m in (("near", "u1", held), ("low", "<f4", held), ("outer", "<f4", 1), ("upper", "<f4", 1))]
            new, error = [], np.zeros(n, np.int64)
            for p in range(parts):
                if shifts is None:
                    state, depth = scanned(x[:, p], books[p], b), np.zeros(n, np.int64)
                else:
                    state, depth = moved_on(x[:, p], books[p], shifts[p], (old[0][:, p].copy(), old[1][:, p], old[2][:, p, 0], old[3][:, p, 0]), b)
                new.append(state)
                sums.add(DEPTHS, depth, np.zeros((n, 1), np.int64))
                sums.add(p, state[0][:, 0].astype(np.int64), x[:, p])
                if last:
                    error += squared(x[:, p], books[p][state[0][:, 0]])
            if last:
                code = [bytes(r).hex() for r in np.stack([s[0][:, 0] for s in new], axis=1)]
                own = {"code": pa.array(code), "error": pa.array(error)}
            else:
                joined = [np.stack([s[k] for s in new], axis=1).reshape(n, -1) for k in range(4)]
                own = dict(zip(("near", "low", "outer", "upper"), map(strings, joined)))
            own |= {c: batch.column(c) for c in ("vec_id", "label")} | {"vec": batch.column("vec") if not last else pa.array([b""] * n)}
            yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)
        yield sums.batch(schema)

    return run


def next_length(depths: dict[int, int], b: int, entries: int) -> int:
    """Places of the next round's lists: as deep as all but a share of the searches went, more if too many went beyond."""
    total = max(1, sum(depths.values()))
    if depths.get(b + 1, 0) > BEYOND * total:
        return min(entries, 2 * b)
    deep = [d for d in range(b + 1) if sum(n for k, n in depths.items() if d < k <= b) <= BEYOND * total]
    return max(2, entries // 8, deep[0] if deep else b)


def updated(books: np.ndarray, found: dict[tuple[int, int], tuple[int, list[int]]]) -> np.ndarray:
    """Entries at the floor of the mean of what was assigned to them; unused ones stay."""
    new = books.copy()
    for (p, e), (n, sums) in found.items():
        if p != DEPTHS:
            new[p, e] = [s // n for s in sums]
    return new


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(table of vec_id, label, code, error; codebooks by part, entry and place) of ``vectors`` (vec_id, embedding, label).

    Rows whose embedding is null or has null or non-finite components are left out, and so are those whose length is not
    that of the smallest vec_id whose length is a multiple of ``parts``. Entries start as the parts of the ``entries``
    smallest vec_ids (of repeated ones by content; rows without vec_id come last); of fewer rows, there are fewer. Ties
    go to the lower index. An empty table gives an empty result without codebooks; other columns are ignored. Components
    whose scaled value exceeds 27 bits are an error.

    A round reads the vectors with their bounds, and writes both anew with the sums of its tasks; only the codebooks, of
    a fixed size, come to the driver. A lost executor's tasks read the last round's table again.
    """
    spark = vectors.sparkSession
    with Scratch() as held:
        rows = integer_vectors(vectors.withColumn("label", F.col("label").cast("string")), scale, "label").where((F.col("width") > 0) & (F.col("width") % parts == 0))
        first = rows.select("vec_id", "vec", "width").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()
        width = first[0]["width"] if first else 0
        first = [r for r in first if r["width"] == width]
        if 0 < len(first) < entries:
            first = rows.where(F.col("width") == width).select("vec_id", "vec").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()
        if not first:
            return spark.createDataFrame([], "vec_id long, label string, code string, error long"), np.zeros((parts, 0, 0), np.int64)
        books = np.stack([np.frombuffer(r["vec"], "<i4").reshape(parts, -1) for r in first], axis=1).astype(np.int64)
        table, shifts, had, b = rows.where(F.col("width") == width), None, 0, max(2, len(first) // 4)
        for k in range(rounds + 1):
            last = k == rounds
            before = table
            table = passed(before, _round(books, shifts, had, b, last, arrow_schema(CODED if last else STATE)), CODED if last else STATE, f"codebooks-{k}")
            discard(before)
            if not last:
                found = totals(table)
                new = updated(books, found)
                shifts, books = np.sqrt(((new - books) ** 2).sum(axis=2)), new
                had, b = b, next_length({e: n for (p, e), (n, _) in found.items() if p == DEPTHS}, b, len(first))
        held.keep(table)
    return table.where("vec IS NOT NULL").select("vec_id", "label", "code", "error"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(read(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    key = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")).cast("binary")
    rows = coded.select("vec_id", "code", "error", key.alias("key"))
    labels = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("members"))
    return lookup(rows, labels, "key", "members", rows.count()).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by plain rounds of full comparisons."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
        f"cuts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS w FROM kept, range({parts}) AS r(p))",
        f"c0 AS MATERIALIZED (SELECT p, i, w AS c FROM cuts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for k in range(rounds + 1):
        distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(w, c)])"
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, min(d * 1000 + i) AS best FROM (SELECT vec_id, p, i, CAST({distance} AS HUGEINT) AS d FROM cuts JOIN c{k} USING (p)) GROUP BY vec_id, p)")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT p, i, coalesce(m, c) AS c FROM c{k} LEFT JOIN (SELECT p, i, list(CAST({floor} AS BIGINT) ORDER BY j) AS m FROM (
  SELECT p, CAST(best % 1000 AS BIGINT) AS i, j, sum(w[j]) AS s, count(*) AS n FROM a{k} JOIN cuts USING (vec_id, p), range(1, 1000) AS g(j) WHERE j <= len(w) GROUP BY ALL) GROUP BY p, i) USING (p, i))""")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(best % 1000 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // 1000) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    books = f"(SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, i, j)) FROM (SELECT p, i, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM c{rounds}))"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {books} AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"
