"""Operator 2, language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

Fitted on a bounded sample of texts of known language (about ``per_class`` rows a language, whole texts). A fifth of the
sample sets the temperature of the softmax and the score below which a prediction is marked as rejected.
Texts that are null or have no letter get ``und`` with score 0. Without any known language every text does. Rows with equal
texts get equal predictions, whatever their ids; of languages with equal scores the first by name is taken. Empty tables
give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, id_remainder
from .subword import Model, Shape, softmax, train

PER_CLASS = 700
SHAPE = Shape(buckets=1 << 17, dim=16, grams=(1, 2, 3), lower=True)
#: Share of right answers wanted among the predictions that are not rejected.
ACCEPTED = 0.995
UNKNOWN = "und"


@dataclass
class Identifier:
    model: Model | None
    heat: float = 1.0
    least: float = 0.0

    def predict(self, texts: list) -> tuple[list, np.ndarray]:
        some = [t is not None and any(map(str.isalpha, t)) for t in texts]
        if self.model is None:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(self.model.logits([t if s else None for t, s in zip(texts, some)]) / self.heat)
        best = p.argmax(axis=1)
        return [self.model.classes[k] if s else UNKNOWN for k, s in zip(best, some)], np.where(some, p.max(axis=1), 0.0)


def fit(docs: DataFrame, learn: Column | None = None, lang: str = "lang", per_class: int = PER_CLASS, text: str = "text", doc_id: str = "doc_id", shape: Shape = SHAPE) -> Identifier:
    rows = docs if learn is None else docs.where(learn)
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    sample = bounded_sample(rows, "_lang", F.col("_id"), per_class).toPandas().sort_values(["_id", "_text"], ignore_index=True)
    if not len(sample):
        return Identifier(None)
    aside = (sample.groupby("_lang").cumcount() % 5 == 4).to_numpy()
    model = train(list(sample["_text"][~aside]), list(sample["_lang"][~aside]), shape, epochs=4)
    out = Identifier(Model(model.shape, model.classes, model.table, model.bias))
    check = sample[aside] if aside.any() else sample
    z = model.logits(list(check["_text"]))
    y = np.array([model.classes.index(v) for v in check["_lang"]])
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in heats]
    out.heat = float(heats[int(np.argmin(loss))])
    p = softmax(z / out.heat)
    order = np.argsort(-p.max(axis=1))
    right = np.cumsum((p.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= ACCEPTED)
    out.least = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return out


def identify(docs: DataFrame, identifier: Identifier, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""

    def run(batches):
        for b in batches:
            langs, score = identifier.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(score < identifier.least)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = id_remainder("doc_id", 4) == 2
    return identify(docs, fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
