"""Near-duplicates by SimHash fingerprints and an index of them in Gray order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, lookup, map_batches, read
from .jaccard import components

SEED = 42
#: Fingerprints of a chunk, the index's lowest distributed node, chunks of an upper node, and children of the nodes within a chunk.
CHUNK, UPPER, FAN = 1024, 64, 16
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int) -> int:
    """The bits that more than half of the shingles' hashes have; shingles count as often as they occur."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    span = min(words, len(found))
    starts = np.concatenate(([0], ends[: len(found) - span] + 1)).tolist()
    stops = ends[span - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of each row of ``docs`` (doc_id, text); fp is the fingerprint's 64 bits as a long."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = np.array([fingerprint(t, words) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": found.view(np.int64)})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def levels(x: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(value, mask) of the nodes over ``x``, from single fingerprints up: a node is a run of FAN nodes below, its mask
    the bits that all of its fingerprints share."""
    out, size = [(x, np.full(len(x), ONES))], FAN
    for _ in range(depth):
        starts = np.arange(0, len(x), size)
        value = x[starts]
        mixed = np.bitwise_or.reduceat(x ^ np.repeat(value, np.diff(np.append(starts, len(x)))), starts)
        out.append((value, ~mixed))
        size *= FAN
    return out


def near_pairs(a: np.ndarray, b: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``a``, in ``b``) of fingerprints that differ in ``most`` bits at most; within ``a`` if ``b`` is none.

    Both are in Gray order. The search goes down from the top nodes by pairs of nodes. A pair carries the differences of
    the bits that both nodes fix; a step down adds those of the bits fixed newly, and drops the pair with all below it
    once there are more than ``most``.
    """
    same, b = b is None, a if b is None else b
    depth = 0
    while FAN**depth < max(len(a), len(b)):
        depth += 1
    one = levels(a, depth)
    two = one if same else levels(b, depth)
    i = j = np.zeros(1, np.int64)
    fixed, acc = np.zeros(1, np.uint64), np.zeros(1, np.int16)
    for level in range(depth, -1, -1):
        (va, ma), (vb, mb) = one[level], two[level]
        if level < depth:
            step = np.arange(FAN)
            wide = (len(i), FAN, FAN)
            up = np.repeat(np.arange(len(i)), FAN * FAN)
            i = np.broadcast_to((i[:, None] * FAN + step)[:, :, None], wide).ravel()
            j = np.broadcast_to((j[:, None] * FAN + step)[:, None, :], wide).ravel()
            inside = (i < len(va)) & (j < len(vb))
            if same:
                inside &= (i < j) if level == 0 else (i <= j)
            i, j, fixed, acc = i[inside], j[inside], fixed[up[inside]], acc[up[inside]]
        both = ma[i] & mb[j]
        acc = acc + popcount((va[i] ^ vb[j]) & both & ~fixed)
        keep = acc <= most
        i, j, fixed, acc = i[keep], j[keep], both[keep], acc[keep]
    if depth == 0 and same:
        return i[:0], j[:0]
    return i, j


def rooted(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that links (i, j) reach, for each of n positions."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    return root


def blocks_for(n: int, most: int) -> int:
    """In how many blocks fingerprints are cut: with more, keys are longer and there are more tables. All give the same links."""
    blocks = most + 1
    while blocks < 64 and (64 // blocks) * (blocks - most) < 12 + max(0, n.bit_length() - 26):
        blocks += 1
    return blocks


def tables(blocks: int, most: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(fields in order, bits of the key) of each table: a choice of ``blocks - most`` blocks comes first, as its key.

    Two fingerprints that differ in ``most`` bits at most differ in as many blocks at most, so they agree in all the
    blocks of at least one choice.
    """
    ends = [64 * k // blocks for k in range(blocks + 1)]
    fields = [(ends[k], ends[k + 1] - ends[k]) for k in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), blocks - most):
        order = [fields[k] for k in chosen] + [fields[k] for k in range(blocks) if k not in chosen]
        out.append((order, sum(fields[k][1] for k in chosen)))
    return out


def gray_rank(word: np.ndarray) -> np.ndarray:
    """The place of words in Gray order: each bit is the parity of the bits from the top down to it."""
    for shift in (1, 2, 4, 8, 16, 32):
        word = word ^ (word >> np.uint64(shift))
    return word


def arranged(word: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Words with their bit fields (start, width) in another order, the first field on top."""
    out, top = np.zeros(len(word), np.uint64), 64
    for start, width in order:
        top -= width
        out |= ((word >> np.uint64(start)) & np.uint64((1 << width) - 1)) << np.uint64(top)
    return out


def _placed(layout: list[tuple[list[tuple[int, int]], int]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each fingerprint with its rank in each table."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for k, (order, _) in enumerate(layout):
                yield pd.DataFrame({"tbl": np.full(len(fp), k, np.int32), "rank": gray_rank(arranged(fp, order)).view(np.int64), "fp": pdf["fp"]})

    return run


def _pieces(parts: Iterator[pd.DataFrame], bits: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(table, key, ranks, fingerprints) of runs of one key, of CHUNK rows at most."""
    held: tuple[np.ndarray, ...] | None = None
    shifts = np.array([64 - b for b in bits], np.uint64)
    for pdf in parts:
        new = (pdf["tbl"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64).view(np.uint64), pdf["fp"].to_numpy(np.int64).view(np.uint64))
        t, rank, fp = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
        if not len(t):
            continue
        key = rank >> shifts[t]
        starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (t[1:] != t[:-1])) + 1))
        for s, e in zip(starts, np.append(starts[1:], len(t))):
            while e - s > CHUNK or (s < e < len(t)):
                cut_at = min(s + CHUNK, e)
                yield int(t[s]), int(key[s]), rank[s:cut_at], fp[s:cut_at]
                s = cut_at
        held = (t[s:], rank[s:], fp[s:])
    if held is not None and len(held[0]):
        t, rank, fp = held
        yield int(t[0]), int(rank[0] >> shifts[t[0]]), rank, fp


INDEX = "kind string, a long, b long, tbl int, part_key long, id string, up string, mask long, value long, fps binary, roots binary"


def _indexed(bits: list[int], most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links within chunks, chunks with their local roots, and upper nodes of UPPER chunks, of rows in order.

    A chunk whose key certainly has no other, as it neither begins nor ends the partition, has no more to meet.
    """
    signed = lambda x: int(np.uint64(x).view(np.int64))

    def frame(rows: list[tuple]) -> pd.DataFrame:
        kinds = {"long": "Int64", "int": "Int32"}  # a column of plain numbers with gaps would become floating
        columns = [c.split() for c in INDEX.split(", ")]
        return pd.DataFrame({name: pd.array(values, dtype=kinds.get(kind, object)) for (name, kind), values in zip(columns, zip(*rows))})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen, waiting, upper, out = None, 0, [], None, []

        def closed() -> list[tuple]:
            t, key, name, mask, value, _ = upper
            return [("upper", None, None, t, key, name, None, signed(mask), signed(value), None, None)]

        for t, key, rank, fp in _pieces(parts, bits):
            i, j = near_pairs(fp, None, most)
            root = rooted(len(fp), i, j)
            for k in np.flatnonzero(root != np.arange(len(fp))):
                out.append(("link", signed(fp[root[k]]), signed(fp[k]), None, None, None, None, None, None, None, None))
            if at != (t, key):
                if at is not None and (seen == 1 or not waiting):
                    out += waiting + closed()
                at, seen, waiting, upper = (t, key), seen + 1, [], None
                first = True
            else:
                first = False
                out, waiting = out + waiting, []
            name = f"{t}:{int(rank[0]):016x}"
            mask = ~np.bitwise_or.reduce(fp ^ fp[0])
            if upper is not None and upper[5] == UPPER:
                out += closed()
                upper = None
            # an upper node fixes the bits that its chunks fix alike
            upper = (t, key, name, mask, fp[0], 1) if upper is None else (t, key, upper[2], upper[3] & mask & ~(upper[4] ^ fp[0]), upper[4], upper[5] + 1)
            node = ("node", None, None, t, key, name, upper[2], signed(mask), signed(fp[0]), fp.tobytes(), root.astype(np.uint16).tobytes())
            (waiting if first else out).append(node)
            if len(out) > 4096:
                yield frame(out)
                out = []
        if at is not None:
            out += waiting + closed()
        if out:
            yield frame(out)

    return run


def _met(a: str, b: str, most: int) -> Column:
    """Whether two nodes may hold fingerprints near each other: by the differences in the bits that both fix."""
    both = F.col(f"{a}.mask").bitwiseAND(F.col(f"{b}.mask"))
    return F.bit_count(F.col(f"{a}.value").bitwiseXOR(F.col(f"{b}.value")).bitwiseAND(both)) <= most


def linked(words: DataFrame, n: int, most: int) -> DataFrame:
    """(a, b): links between the different fingerprints ``fp`` of ``words`` (n rows) that differ in ``most`` bits at most.

    Links span: two fingerprints that are that near are in one component, though not each pair is a row.

    Each table has all fingerprints in the Gray order of their rearranged bits, range-partitioned, so a frequent key is
    spread over tasks. Runs of that order are chunks, and runs of chunks upper nodes; each knows the bits that all below
    it share. Nodes of one key are searched downwards by pairs: upper nodes, then chunks, then within tasks the nodes of
    the chunks (``near_pairs``).
    """
    layout = tables(blocks_for(n, most), most)
    placed = map_batches(words.select("fp"), _placed(layout), "tbl int, rank long, fp long")
    rows = placed.repartitionByRange("tbl", "rank").sortWithinPartitions("tbl", "rank")
    index = cut(rows.mapInPandas(_indexed([bits for _, bits in layout], most), INDEX), "simhash-index")
    uppers = index.where("kind = 'upper'").select("tbl", "part_key", "id", "mask", "value")
    nodes = index.where("kind = 'node'").select("tbl", "part_key", "id", "up", "mask", "value")
    # only keys of several chunks have anything left to meet
    several = nodes.groupBy("tbl", "part_key").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1").select("tbl", "part_key")
    uppers = uppers.join(several, ["tbl", "part_key"], "left_semi")
    a, b = uppers.alias("a"), uppers.alias("b")
    high = a.join(b, (F.col("a.tbl") == F.col("b.tbl")) & (F.col("a.part_key") == F.col("b.part_key")) & (F.col("a.id") <= F.col("b.id")) & _met("a", "b", most)).select(F.col("a.id").alias("ua"), F.col("b.id").alias("ub"))
    c, d = nodes.select("id", "up", "mask", "value").alias("c"), nodes.select("id", "up", "mask", "value").alias("d")
    low = high.join(c, F.col("ua") == F.col("c.up")).join(d, (F.col("ub") == F.col("d.up")) & ((F.col("ua") != F.col("ub")) | (F.col("c.id") < F.col("d.id"))) & _met("c", "d", most))
    low = low.select(F.col("c.id").alias("ca"), F.col("d.id").alias("cb"))
    held = lambda side: index.where("kind = 'node'").select(F.col("id").alias(f"c{side}"), F.col("fps").alias(f"fps_{side}"), F.col("roots").alias(f"roots_{side}"))

    def across(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples():
                x, y = np.frombuffer(row.fps_a, np.uint64), np.frombuffer(row.fps_b, np.uint64)
                i, j = near_pairs(x, y, most)
                # what a chunk links within itself is known: one link between two local roots is enough
                ends = np.unique(np.frombuffer(row.roots_a, np.uint16)[i].astype(np.int64) * CHUNK + np.frombuffer(row.roots_b, np.uint16)[j])
                yield pd.DataFrame({"a": x[ends // CHUNK].view(np.int64), "b": y[ends % CHUNK].view(np.int64)})

    between = map_batches(low.join(held("a"), "ca").join(held("b"), "cb").select("fps_a", "roots_a", "fps_b", "roots_b"), across, "a long, b long")
    within = index.where("kind = 'link'").select("a", "b")
    return cut(within.unionByName(between).distinct(), "simhash-links")


def similar_texts(docs: DataFrame, words: int = 5, most: int = 4) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id, copies.

    The fingerprint is 16 hex digits; documents link when theirs differ in ``most`` bits at most, and component_id is
    the smallest doc_id that links reach. copies counts the rows of the same fingerprint. Texts are lower-cased (A-Z)
    and split at white space; shingles have ``words`` words, of fewer words all of them are one, and without words
    (null, empty) the fingerprint is zero and links like any other. Rows that repeat a doc_id are each fingerprinted. A
    row without doc_id gets its component's smallest doc_id, null if no row of the component has one. An empty table
    gives an empty result; texts of any length are read whole; other columns are ignored.
    """
    with Scratch() as held:
        each = cut(fingerprints(docs, words), "simhash-fingerprints")
        key = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
        distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-distinct")
        n, total = distinct.count(), each.count()
        roots = components(linked(distinct.select("fp"), n, most))
        placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", key(F.coalesce("root", "fp")).alias("root"))
        placed = cut(placed, "simhash-placed")
        tops = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
        tops = cut(tops, "simhash-tops")
        known = lookup(placed.select(key(F.col("fp")).alias("fp"), "copies", "root"), tops, "root", "members", n)
        known = cut(known.select("fp", "copies", "component_id"), "simhash-known")
        held.keep(each, known)
    out = lookup(each.select("doc_id", key(F.col("fp")).alias("fp")), known, "fp", "copies", total)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id", "copies")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(read(spark, sf_dir, "documents"), words=4, most=4).select("doc_id", "fingerprint", "component_id")
