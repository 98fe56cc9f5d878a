"""Similarity join of documents on word n-grams by parity sketches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, cut, lookup, map_batches, read
from .textnum import batches, mixed, shingles

#: Ratio of the sizes at the ends of a size band, and cells of a band's sketch for each cell that may differ.
BAND, SPARE = 1.9, 1.7
#: Most cell values that count as frequent; which they are affects speed alone.
FREQUENT = 200_000
#: 64-bit words of the sketches that pairs are tested by before their texts are fetched.
LONGS = 16
#: Rows of a frequent cell value are split in so many parts at least for the first round of comparisons, and into more
#: where a part would have more rows than this.
PARTS, PART_ROWS = 64, 20_000


class Sketch:
    """The cells of a document's parity sketch that others must meet, for sets of hashes and a least similarity.

    A set's hashes are dealt to the cells of its size band; a cell holds the XOR of its hashes. A hash that is in one of
    two sets only changes one cell, so the number of cells that differ is at most the symmetric difference, and of the
    pairs that are similar enough at most D = floor((100 - p) (a + b) / (100 + p)) cells differ. Of any order of all
    cell values, similar sets then share one of their first D + 1. The order puts frequent values last and full cells
    first, so boilerplate that fills a cell alone is hardly ever looked up. Sets near the end of a band also have the
    sketch of the next band.

    Empty cells are last in the order. A set that has them among its first D + 1 may share nothing else with a set that
    has them there too; both are looked up by hashes of their own as well: of any order of all hashes, similar sets
    share one of their first size - ceil(p size / 100) + 1. Unlike a key for an empty cell, these differ between sets.
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(int(self.lows[-1] * BAND) + 1)

    def apart(self, a: int, b: int) -> int:
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def furthest(self, size: int) -> int:
        """The largest symmetric difference with any partner."""
        return self.apart(size, size * 100 // self.percent)

    def bands(self, size: int) -> list[int]:
        band = int(np.searchsorted(self.lows, size, "right")) - 1
        return [band, band + 1] if size * 100 >= self.percent * self.lows[band + 1] else [band]

    def cells(self, hashes: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of the filled cells, with the number of hashes in each."""
        n = int(SPARE * (self.furthest(self.lows[band + 1] - 1) + 1)) + 1
        at = (hashes % np.uint64(n)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cell, first = np.unique(at[order], return_index=True)
        with np.errstate(over="ignore"):
            parity = np.bitwise_xor.reduceat(hashes[order], first)
            count = np.diff(np.append(first, len(hashes)))
            return mixed(parity + mixed(np.uint64(band) * np.uint64(1_000_003) + cell.astype(np.uint64)) + count.astype(np.uint64)), count

    def own(self, hashes: np.ndarray, band: int, filled: int) -> np.ndarray:
        """The set's hashes as values for a look-up, if it has fewer filled cells than it needs."""
        if filled > self.furthest(len(hashes)):
            return hashes[:0]
        with np.errstate(over="ignore"):
            return mixed(hashes + mixed(np.uint64(band) * np.uint64(1_000_003) + np.uint64(1 << 62)))

    def keys(self, hashes: np.ndarray, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The cell values that the document is looked up by, and its own hashes where these do not suffice."""
        out = []
        size = len(hashes)

        def ranked(values: np.ndarray) -> np.ndarray:
            if not len(frequent):
                return np.zeros(len(values), np.int64)
            at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
            return np.where(frequent[at] == values, often[at], 0)

        for band in self.bands(size):
            values, count = self.cells(hashes, band)
            out.append(values[np.lexsort((values, -count, ranked(values)))[: self.furthest(size) + 1]])
            own = self.own(hashes, band, len(values))
            out.append(own[np.lexsort((own, ranked(own)))[: size - -(-self.percent * size // 100) + 1]])
        return np.concatenate(out)


def _texts(pdf: pd.DataFrame, column: str = "text") -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in pdf[column].tolist()]


def _described(words: int, sketch: Sketch) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of two kinds: for each document its set's size and signature, and the cell values that the task met twice or more."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = _texts(pdf)
            for a, b in batches(texts):
                sets = shingles(texts[a:b], words)
                with np.errstate(over="ignore"):
                    sums = np.array([x.sum() if len(x) else 0 for x in sets], np.uint64)
                    twos = np.array([mixed(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() if len(x) else 0 for x in sets], np.uint64)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].to_numpy(), "n": [len(x) for x in sets], "sig": sums.view(np.int64), "sig2": twos.view(np.int64), "cell": None, "m": None})
                # equal sets of a batch count once
                different = {s: x for s, x in zip(sums.tolist(), sets, strict=True) if len(x)}
                cells = [sketch.cells(x, band)[0] for x in different.values() for band in sketch.bands(len(x))]
                cells += [sketch.own(x, band, len(v)) for (x, band), v in zip(((x, band) for x in different.values() for band in sketch.bands(len(x))), cells, strict=True)]
                if cells:
                    value, m = np.unique(np.concatenate(cells), return_counts=True)
                    yield pd.DataFrame({"doc_id": None, "n": None, "sig": None, "sig2": None, "cell": value[m > 1].view(np.int64), "m": m[m > 1]})

    return run


def _looked_up(words: int, sketch: Sketch, frequent: np.ndarray, often: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in parts:
            texts, ids = _texts(pdf), pdf["doc_id"].to_numpy()
            for a, b in batches(texts):
                keys, docs = [], []
                for k, x in enumerate(shingles(texts[a:b], words)):
                    with np.errstate(over="ignore"):
                        signature = hash((len(x), int(x.sum()))) if len(x) else None
                    # equal sets are one class whatever happens, so a task needs only one of them
                    if signature is None or signature in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(signature)
                    found = sketch.keys(x, frequent, often)
                    keys.append(found)
                    docs.append(np.full(len(found), ids[a + k]))
                if keys:
                    key = np.concatenate(keys)
                    at = np.searchsorted(frequent, key) if len(frequent) else np.zeros(len(key), np.int64)
                    at = np.minimum(at, len(frequent) - 1)
                    hot = frequent[at] == key if len(frequent) else np.zeros(len(key), bool)
                    doc = np.concatenate(docs)
                    parts_of = np.maximum(PARTS, often[at] // PART_ROWS if len(frequent) else 0).astype(np.uint64)
                    part = np.where(hot, mixed(doc.astype(np.uint64)) % parts_of + np.uint64(1), 0)
                    yield pd.DataFrame({"key": key.view(np.int64), "part": part.astype(np.int64), "doc_id": doc})

    return run


def _verified(words: int, percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            left, right = _texts(pdf, "text_a"), _texts(pdf, "text_b")
            good = np.zeros(len(pdf), bool)
            last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
            for a, b in batches(right):
                others = shingles(right[a:b], words)
                for k in range(a, b):
                    if left[k] != last[0]:
                        last = (left[k], shingles([left[k]], words)[0])
                    x, y = last[1], others[k - a]
                    both = np.concatenate((x, y))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    good[k] = 100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0
            yield pdf.loc[good, ["a", "b"]]

    return run


def _verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Pairs are sorted by a, so a hub's set is made once for many."""
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-ends")
    texts = cut(docs.join(ends, "doc_id", "left_semi"), "jaccard-texts")
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return map_batches(both, _verified(words, percent), both.select("a", "b").schema)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """LONGS words whose bits are the parities of the hashes that fall on them."""
    bits = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _sketched(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, s0, s1, ...): set size and parity sketch of the documents of ``ids``."""
    names = [f"s{k}" for k in range(LONGS)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, docs_ = _texts(pdf), pdf["doc_id"].to_numpy()
            for a, b in batches(texts):
                sets = shingles(texts[a:b], words)
                out = pd.DataFrame(np.array([_parity(x) for x in sets]), columns=names)
                out.insert(0, "n", [len(x) for x in sets])
                out.insert(0, "doc_id", docs_[a:b])
                yield out

    found = docs.join(cut(ids, "jaccard-ids"), "doc_id", "left_semi").select("doc_id", "text")
    schema = "doc_id long, n long, " + ", ".join(f"{n} long" for n in names)
    # rows that repeat a doc_id with other texts are each a sketch of that document
    return map_batches(found, run, schema).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of ``edges`` (a, b), for all nodes with an edge.

    Every round each node takes the smallest label among its neighbours', then that label's own label, until none
    changes; labels are written each round.
    """
    with Scratch() as held:
        labels = _labelled(edges)
        held.keep(labels)
    return labels.select("node", "root")


def _labelled(edges: DataFrame) -> DataFrame:
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = cut(step, "labels")
        jump = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        after = cut(step.join(jump, step["root"] == jump["_n"], "left").select("node", "old", F.least("root", F.coalesce("_r", "root")).alias("root")), "labels")
        if after.where("root <> old").isEmpty():
            return after
        labels = after.select("node", "root")


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id, n_links, component_id.

    Sets are the distinct ``words``-grams of the text's words (A-Z lower-cased, split at white space); of fewer words,
    all of them as one. Documents link when 100 * intersection >= ``percent`` * union. class_id is the smallest doc_id
    with an equal set, component_id the smallest that links reach. No link between different sets is lost: pairs that
    are not compared are already in one component, so n_links counts the links that were found, a spanning part of all. Null and empty texts have the empty set and link with nothing. Rows
    that repeat a doc_id are one node with all their links; rows without a doc_id have component null. An empty table
    gives an empty result; texts of any length are read whole; other columns are ignored.
    """
    with Scratch() as held:
        sets, described, n_rows = _described_classes(docs, words, percent, held)
    out = lookup(sets, described, "sig", "copies", n_rows)
    alone = F.col("class_id").isNull() | F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _described_classes(docs: DataFrame, words: int, percent: int, held: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """The sets of all documents (doc_id, n, sig), the classes of equal sets with their links and component, and the count of documents."""
    sketch = Sketch(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    read_out = cut(map_batches(rows, _described(words, sketch), "doc_id long, n long, sig long, sig2 long, cell long, m long"), "jaccard-sets")
    sets = read_out.where("n IS NOT NULL").select("doc_id", "n", F.concat(F.hex("sig"), F.lit("."), F.hex("sig2"), F.lit("."), F.hex("n")).alias("sig"))
    cells = read_out.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("m").alias("m"))
    # at least total / FREQUENT of all counted values, so FREQUENT rows at most
    total = read_out.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    often = cells.where(F.col("m") >= max(16, -(-total // FREQUENT))).toPandas()
    value, m = often["cell"].to_numpy(np.int64).view(np.uint64), often["m"].to_numpy(np.int64)
    order = np.argsort(value)
    nodes = rows.where("doc_id IS NOT NULL")
    keyed = map_batches(nodes, _looked_up(words, sketch, value[order], m[order]), "key long, part long, doc_id long")

    # every document of a key's part meets the part's smallest; the parts of a frequent key meet by their smallest
    group = W.partitionBy("key", "part")
    met = keyed.withColumn("least", F.min("doc_id").over(group)).withColumn("size", F.count(F.lit(1)).over(group))
    met = cut(met.where("size > 1 OR part > 0"), "jaccard-met")
    heads = met.where("part > 0").select("key", F.col("least").alias("doc_id")).distinct()
    heads = heads.withColumn("least", F.min("doc_id").over(W.partitionBy("key")))

    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes, "jaccard-classes")
    n_rows = docs.count()
    many = classes.where("copies > 1")
    members = cut(lookup(sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "sig"), many, "sig", "copies", n_rows).where("class_id IS NOT NULL AND class_id <> doc_id").select("doc_id", "class_id"), "jaccard-members")

    def by_class(pairs: DataFrame) -> DataFrame:
        """Different pairs of classes, in order."""
        for side in ("a", "b"):
            named = members.select(F.col("doc_id").alias(side), F.col("class_id").alias("_c"))
            pairs = pairs.join(named, side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    spokes = met.where("least <> doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    rims = heads.where("least <> doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    asked = cut(by_class(spokes.unionByName(rims)), "jaccard-asked")
    linked = cut(_verify(asked, nodes, words, percent), "jaccard-linked")
    failed = cut(asked.join(linked, ["a", "b"], "left_anti"), "jaccard-failed")
    roots = components(linked)

    if not failed.isEmpty():
        # a key some of whose documents are not yet in one component: all its pairs across components
        name = members.select("doc_id", "class_id")
        ids = met.select("key", "doc_id").distinct().join(name, "doc_id", "left").select("key", F.coalesce("class_id", "doc_id").alias("doc_id")).distinct()
        placed = ids.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        placed = cut(placed, "jaccard-placed")
        split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi AND size > 2").select("key")
        open_ = cut(placed.join(split, "key", "left_semi"), "jaccard-open")
        sketches = cut(_sketched(open_.select("doc_id").distinct(), nodes, words), "jaccard-sketches")
        able = cut(open_.join(sketches, "doc_id"), "jaccard-able")
        names = [f"s{k}" for k in range(LONGS)]

        def sides(one: DataFrame, two: DataFrame) -> DataFrame:
            """Pairs of a key's documents of different components whose sketches differ in no more bits than similar sets may."""
            one, two = (x.select("key", *[F.col(c).alias(f"{d}_{c}") for c in ("doc_id", "root", "n", *names)]) for d, x in (("a", one), ("b", two)))
            distance = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in names), F.lit(0))
            near = F.lit(100 + percent) * distance <= F.lit(100 - percent) * (F.col("a_n") + F.col("b_n"))
            met = one.join(two, (one["key"] == two["key"]) & (F.col("a_root") != F.col("b_root")) & near)
            found = met.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b")).distinct()
            return cut(found.join(asked, ["a", "b"], "left_anti"), "jaccard-pairs")

        # first each key's documents with one of them, which joins most components; then what is left between components
        for last in (False, True):
            hubs = able if last else able.groupBy("key").agg(F.min(F.struct("root", *[c for c in able.columns if c not in ("key", "root")])).alias("h")).select("key", "h.*")
            pairs = sides(able, hubs.where("true"))
            more = cut(_verify(pairs, nodes, words, percent), "jaccard-more")
            asked = asked.unionByName(pairs)
            if not more.isEmpty():
                linked = cut(linked.unionByName(more), "jaccard-linked")
                roots = components(linked)
                named = able.drop("root").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
                able = cut(named, "jaccard-able") if not last else able

    degree = linked.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    described = classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").join(degree, "class_id", "left")
    described = cut(described.select("sig", "copies", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "class_id").alias("component_id")), "jaccard-described")
    held.keep(read_out, described)
    return sets, described, n_rows


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents of the smallest doc_id of each component, all columns; rows without doc_id stay.

    Nulls, ties, repeated rows, empty tables and long texts are handled as in ``similar_groups``.
    """
    with Scratch() as held:
        groups = similar_groups(docs, words, percent)
        gone = cut(groups.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone")
        held.keep(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")
