"""Toxic spans and document scores by a conditional random field over words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitted, held_out, map_batches, read
from .crf import Model, tag, train, words_of
from .textnum import batches

#: The sample: most toxic and most other documents, and the most characters of such a document. Longer ones are not
#: learned from, the others whole.
TOXIC, OTHER, LONGEST = 1500, 2500, 40_000
#: Words of a training sequence.
WINDOW = 40
#: A word counts as toxic in training if its documents are toxic in this share, and it stands in so many different
#: surroundings there (copies of one text give one).
PURITY, SURROUNDINGS = 0.9, 6
#: Marginal from which a word is tagged, and score from which a document is called toxic.
TAGGED, CALLED = 0.5, 0.7


@dataclass
class Toxicity:
    model: Model
    #: Score of a document by its number of tagged words, 0, 1, 2 and more.
    scores: np.ndarray


def split(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes and, of the words of each text, starts, ends and hashes; worked out in batches, so memory stays bounded."""
    out = []
    for a, b in batches([t.encode("utf-8", "surrogatepass") for t in texts]):
        data, starts, ends, hashes, first, _ = words_of(texts[a:b])
        out += [(data, starts[x:y], ends[x:y], hashes[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
    return out


def token_labels(words: list[np.ndarray], toxic: list[bool]) -> set[int]:
    """Hashes of the words that mark toxic documents, from word hashes of documents and their labels."""
    good, bad = Counter(), Counter()
    for own, flag in zip(words, toxic, strict=True):
        (bad if flag else good).update(np.unique(own).tolist())
    n_good, n_bad = max(1, toxic.count(False)), max(1, toxic.count(True))
    around: dict[int, set[tuple[int, int]]] = {}
    for w, n in bad.items():
        # as if both kinds of document were equally many
        p, q = n / n_bad, (good[w] + 0.5) / n_good
        if p / (p + q) >= PURITY and n >= 5 * (good[w] + 0.2):
            around[w] = set()
    for own, flag in zip(words, toxic, strict=True):
        for k in np.flatnonzero(np.isin(own, np.fromiter(around, np.uint64, len(around)))) if flag else ():
            around[int(own[k])].add((int(own[k - 1]) if k else 0, int(own[k + 1]) if k + 1 < len(own) else 0))
    return {w for w, seen in around.items() if len(seen) >= SURROUNDINGS}


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, toxic, text) of the labelled documents of the smallest hashes that are not held out, and the share of
    toxic ones among all these labels. The largest label of a repeated doc_id holds, of its texts the first in order."""
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [marked.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, TOXIC), (0, OTHER))]
    chosen = ids[0].unionByName(ids[1])  # TOXIC + OTHER rows at most, so it is broadcast
    texts = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return texts, marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0


def learn(rows: pd.DataFrame, share: float) -> Toxicity:
    """Fit to the sample (doc_id, toxic, text), for documents of which ``share`` are toxic."""
    rows = rows.sort_values("doc_id", ignore_index=True)
    texts, toxic = rows["text"].tolist(), [v == 1 for v in rows["toxic"].tolist()]
    words = split(texts)
    bad = np.array(sorted(token_labels([h for *_, h in words], toxic)), np.uint64)
    rng = np.random.default_rng(11)
    sequences, gold = [], []

    def learn_from(k: int, x: int, y: int) -> None:
        data, starts, ends, hashes = words[k]
        sequences.append(" ".join(bytes(data[s:e]).decode("utf-8", "surrogatepass") for s, e in zip(starts[x:y], ends[x:y], strict=True)))
        gold.append((np.isin(hashes[x:y], bad) & toxic[k]).astype(np.int64))

    for k, flag in enumerate(toxic):
        n = len(words[k][3])
        found = np.flatnonzero(np.isin(words[k][3], bad)) if flag else np.zeros(0, np.int64)
        # around words to be tagged; of other documents a longer stretch anywhere
        for spot in found[:: max(1, len(found) // 3)][:3]:
            learn_from(k, max(0, int(spot) - int(rng.integers(WINDOW // 2))), min(n, int(spot) + WINDOW // 2))
        if not flag and n:
            x = int(rng.integers(n))
            learn_from(k, max(0, min(x, n - 3 * WINDOW)), min(n, x + 3 * WINDOW))
    model = train(sequences, gold, ["clean", "toxic"], least=2)
    # once more, with what was tagged wrongly in the other documents of the sample
    for t in tag(model, texts):
        for k in range(t.b - t.a):
            if not toxic[t.a + k]:
                x, y = int(t.first[k]), int(t.first[k + 1])
                for w in np.flatnonzero(t.gamma[x:y, 1] >= TAGGED / 2)[:5]:
                    learn_from(t.a + k, max(0, int(w) - 5), min(y - x, int(w) + 5))
    model = train(sequences, gold, ["clean", "toxic"], least=2)
    if not any(g.any() for g in gold):
        # nothing is known to be toxic, so nothing is tagged
        model.bias[:] = (10.0, -10.0)
    counts = np.zeros((4, 2))
    for t in tag(model, texts):
        hits = np.concatenate(([0], np.cumsum(t.gamma[:, 1] >= TAGGED)))
        for k, n in enumerate(hits[t.first[1:]] - hits[t.first[:-1]]):
            counts[min(3, n), int(toxic[t.a + k])] += 1
    # the sample has more toxic documents than the labels; the score is for documents as they come
    seen = max(1e-9, np.mean(toxic)) if toxic else 1.0
    weight = np.array([(1 - share) / max(1e-9, 1 - seen), share / seen])
    expected = (counts + 0.25) * weight
    scores = np.maximum.accumulate(expected[:, 1] / expected.sum(1).clip(1e-9))
    return Toxicity(model.small(), scores if any(toxic) else np.zeros(4))


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Learn from TOXIC + OTHER labelled documents at most."""
    rows, share = sample(docs, labels)
    return fitted(rows, lambda pdf: learn(pdf, share))


def scorer(made: Toxicity) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = ["" if t is None else t for t in pdf["text"].tolist()]
            for t in tag(made.model, texts):
                p, sizes = t.gamma[:, 1], np.diff(t.first)
                hit, full = p >= TAGGED, np.flatnonzero(sizes > 0)
                n, top = np.zeros(t.b - t.a, np.int64), np.zeros(t.b - t.a)
                if len(full):
                    n[full] = np.add.reduceat(hit.astype(np.int64), t.first[:-1][full])
                    top[full] = np.maximum.reduceat(p, t.first[:-1][full])
                # within a count, the surest word decides; steps stay in order
                base, above = made.scores[np.minimum(n, 3)], np.append(made.scores, max(1.0, made.scores[3]) if made.scores[3] else 0.0)[np.minimum(n, 3) + 1]
                score = (base + (above - base) * 0.2 * top).clip(0, 1)
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[t.a : t.b].to_numpy(),
                        "held_out": pdf["held_out"].iloc[t.a : t.b].to_numpy(),
                        "score": score,
                        "predicted": (score >= CALLED).astype(np.int32),
                        "n_words": n,
                        "spans": t.spans(np.where(hit, 1, -1)),
                    }
                )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, made: Toxicity | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, n_words, spans.

    Words are tagged by forward-backward marginals; n_words of them reach TAGGED, and their runs are listed in spans as
    start:end, code points of the text, end exclusive. The score is the share of toxic documents among those of as many
    tagged words, a little more where one is surer. Null and empty texts have no tagged word and the score of that.
    Repeated rows are alike, rows without doc_id too; an empty table gives an empty result; texts of any length are
    read whole; other columns are ignored. Without labels of toxic documents all scores are 0 and nothing is tagged.
    Learns from rows of ``labels`` (doc_id, toxic) that are not held out; the largest label of a repeated doc_id holds.
    """
    made = fit(docs, labels) if made is None else made
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = rows.select("doc_id", "held_out").schema.add("score", "double").add("predicted", "integer").add("n_words", "long").add("spans", "string")
    return map_batches(rows, scorer(made), schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
