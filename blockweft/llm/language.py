"""Language identification by a conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fitted, held_out, map_batches, read
from .crf import Model, code_points, tag, train, words_of

#: The sample: most languages, most documents of each, and the most characters of such a document. Longer ones are not
#: learned from, the others whole.
LANGUAGES, DOCS, LONGEST = 64, 80, 20_000
#: Words of the segments that training sequences are spliced from, so that switches are learned, and segments of one.
SEGMENT, SEGMENTS = (4, 24), 12
#: Least score of a document that the pipeline keeps.
LEAST = 0.3

LETTER = re.compile(r"[^\W\d_]")


def sample(docs: DataFrame) -> DataFrame:
    """(lang, at, doc_id, text): of each of the LANGUAGES most frequent languages the DOCS documents of the smallest hashes."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= LONGEST) & ~held_out(F.col("doc_id")))
    counted = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counted:
        return labelled.select("lang", F.lit(0).cast("long").alias("at"), "doc_id", "text").limit(0)
    # a share of the hashes that holds the sample for all but sure, so few rows are ordered
    shares = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, 1.5 * DOCS / r["count"] + 50 / r["count"]))])
    hashed = labelled.select("lang", F.xxhash64("doc_id", "text").alias("at"), "doc_id", "text")
    drawn = hashed.where(F.pmod("at", F.lit(1_000_003)) < F.element_at(shares, F.col("lang")) * 1_000_003)
    order = W.partitionBy("lang").orderBy("at", "doc_id")
    return drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= DOCS).drop("_n")


def learn(rows: pd.DataFrame, seed: int = 7) -> Model:
    """A model from the sample. Sequences splice segments of documents of one language or another, so switches within a
    text are learned like words are."""
    rows = rows.sort_values(["lang", "at", "doc_id", "text"], ignore_index=True)
    langs = sorted(rows["lang"].unique())
    if not langs:
        return train([], [], ["und"])
    pieces: list[tuple[int, str]] = []
    rng = np.random.default_rng(seed)
    for lang, text in zip(rows["lang"], rows["text"], strict=True):
        words, at = text.split(), 0
        while at < len(words):
            n = int(rng.integers(*SEGMENT))
            pieces.append((langs.index(lang), " ".join(words[at : at + n])))
            at += n
    rng.shuffle(pieces)
    sequences, gold = [], []
    for at in range(0, len(pieces), SEGMENTS):
        group = pieces[at : at + SEGMENTS]
        sequences.append(" \n ".join(t for _, t in group))
        sizes = np.diff(words_of([t for _, t in group])[4])
        gold.append(np.repeat([k for k, _ in group], sizes))
    return train(sequences, gold, langs).small()


def fit(docs: DataFrame) -> Model:
    """A model from a sample of ``docs`` (text, lang, doc_id) of at most DOCS * LANGUAGES documents."""
    return fitted(sample(docs), learn)


def predictor(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = ["" if t is None else t for t in pdf["text"].tolist()]
            for t in tag(model, texts):
                sums = np.zeros((t.b - t.a, len(model.labels)))
                sizes = np.diff(t.first)
                full = np.flatnonzero(sizes > 0)
                if len(full):
                    sums[full] = np.add.reduceat(t.gamma, t.first[:-1][full]) / sizes[full][:, None]
                letters = np.array([LETTER.search(x) is not None for x in texts[t.a : t.b]], bool)
                words = letters & (sizes > 0)
                spoken = t.gamma.argmax(1) if len(t.gamma) else np.zeros(0, np.int64)
                # words of a text without letters have no language
                spoken = np.where(np.repeat(words, sizes), spoken, -1)
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[t.a : t.b].to_numpy(),
                        "held_out": pdf["held_out"].iloc[t.a : t.b].to_numpy(),
                        "lang_pred": [model.labels[k] if ok else "und" for k, ok in zip(sums.argmax(1), letters, strict=True)],
                        "score": np.where(words, sums.max(1).clip(0, 1), 0.0),
                        "segments": t.spans(spoken, model.labels),
                    }
                )

    return run


def predict_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, segments.

    Every word gets marginals by forward-backward; the prediction is the language of the largest mean, the score that
    mean. ``segments`` lists the runs of words of one language, each word by its largest marginal, as lang:start:end
    (code points, end exclusive), so a text that switches shows where. A null text, or one without a letter, is `und`
    with score 0 and no segments. Without any labelled document all is `und`. Of equal means the first language by name
    is taken. Repeated rows are alike, rows without doc_id too; an empty table gives an empty result; texts of any
    length are read whole; other columns are ignored. The model learns from lang and text of the rows that are not held
    out, and predicts from the text alone.
    """
    model = fit(docs) if model is None else model
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, predictor(model), rows.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double").add("segments", "string"))


def keep_known(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents, all columns, whose language is known with a score of ``least`` or more; text decides alone.

    Without any labelled document no language can be rejected: all documents with a letter stay. Null and empty texts,
    and texts without a letter, go. Repeated rows are judged alike and all stay or go; an empty table stays empty.
    """
    model = fit(docs)
    run = predictor(model)
    schema = docs.schema

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            asked = pd.DataFrame({"doc_id": np.arange(len(pdf)), "held_out": False, "text": pdf["text"].to_numpy()})
            for out in run(iter([asked])):
                known = (out["lang_pred"] != "und") & (out["score"] >= least) if model.labels != ["und"] else out["score"] > 0
                yield pdf.iloc[out.loc[known, "doc_id"].to_numpy()]

    return map_batches(docs, keep, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(read(spark, sf_dir, "documents"))
