"""Operator 10, quality classifier: supervised word, word pair and character n-gram embeddings, averaged per document, softmax output.

Fitted in numpy on a bounded sample of labelled rows (about ``per_class`` rows a label, whole texts); a fifth of the
sample is set aside to turn logits into probabilities at the labels' true shares. Every text is scored whole.
Null and empty texts get the score of a text without features. Without rows of both labels the score is the
share of label 1, or 0.5 if there are no labels. Rows with equal texts get equal scores, whatever their ids, and a row
whose id has several labels keeps one of them. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, id_remainder
from .subword import Model, Shape, fit_logistic, train

#: Labelled rows of each class to fit on, about.
PER_CLASS = 2500
SHAPE = Shape(buckets=1 << 18, dim=16, grams=(1, 2, 3), lower=False, pairs=True)


@dataclass
class Scorer:
    model: Model | None
    weights: np.ndarray
    constant: float = 0.5

    def score(self, texts: list) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.constant)
        z = self.model.logits(texts)
        x = np.column_stack([z[:, 1] - z[:, 0], np.ones(len(z))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str, doc_id: str):
    """Bounded sample of (doc_id, text, label) as pandas, in a fixed order, and the number of rows of each label."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    picked = bounded_sample(known, "_y", F.col("_id"), per_class).dropDuplicates(["_id"])
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(picked), "_id")  # at most a few thousand ids
    return rows.toPandas().sort_values(["_id", "_text"], ignore_index=True), counts


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", per_class: int = PER_CLASS, text: str = "text", doc_id: str = "doc_id", shape: Shape = SHAPE) -> Scorer:
    """Fit on ``labels`` rows where ``learn`` holds (all, if None)."""
    sample, counts = labelled_texts(docs, labels if learn is None else labels.where(learn), label, per_class, text, doc_id)
    seen = sample["_y"].value_counts()
    if len(seen) < 2:
        total = sum(counts.values())
        return Scorer(None, np.zeros(2), counts.get(1, 0) / total if total else 0.5)
    aside = np.zeros(len(sample), bool)
    for y in (0, 1):
        at = np.flatnonzero(sample["_y"] == y)
        aside[at[4::5]] = True
    fitted = sample[~aside]
    if fitted["_y"].nunique() < 2 or sample[aside]["_y"].nunique() < 2:
        aside[:] = False
        fitted = sample
    model = train(list(fitted["_text"]), list(fitted["_y"]), shape)
    check = sample[aside] if aside.any() else sample
    z = model.logits(list(check["_text"]))
    y = check["_y"].to_numpy()
    share = np.array([counts[k] / max(1, (y == k).sum()) for k in (0, 1)])
    weight = share[y] / share[y].sum() * len(y)
    x = np.column_stack([z[:, 1] - z[:, 0], np.ones(len(z))])
    return Scorer(Model(model.shape, model.classes, model.table, model.bias), fit_logistic(x, y.astype(float), weight, ridge=1e-2))


def scores(docs: DataFrame, scorer: Scorer, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.score(b.column(1).to_pylist()))], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, scorer: Scorer, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns unchanged, in one pass without a shuffle."""

    def run(batches):
        for b in batches:
            keep = scorer.score(b.column(b.schema.names.index(text)).to_pylist()) >= threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return id_remainder(doc_id, 3) == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scores(docs, fit(docs, labels, ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
