"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled
text.  A text is cut into chunks of ``CHUNK`` bytes and each chunk compressed
with both: what the bad dictionary needs more than the good one, divided by
the text's bytes, says how much more the text is like the good ones.  Small
chunks keep the dictionaries, rather than the text's own repetitions, in
charge.  A logistic curve, fitted on labelled documents that neither
dictionary has seen and weighted to the classes' shares among all labels,
turns the difference into the probability of label 1.

Fitting reads a bounded sample: at most ``SAMPLE_DOCS`` labelled documents of
each class, whole, in the order of a seeded hash (of rows that share an id, one).
Scoring reads every text whole.  A null or empty text has difference 0.  Rows
of ``labels`` without doc_id or label are passed over; with no labels of one
of the classes every text scores the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold

SAMPLE_DOCS = 3000
DICTIONARY_BYTES = 32_768
CHUNK = 1024
#: Added to a text's bytes, so that a handful of bytes decides little.
EASE = 100
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def score(self, difference: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * difference + self.intercept))))


def _chunks(data: bytes) -> list[bytes]:
    return [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts' last bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [c for t in texts for c in _chunks(t)]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary),
                                    write_content_size=False, write_dict_id=False)


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    data = (text or "").encode()
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    return sum(len(by_bad(c)) - len(by_good(c)) for c in _chunks(data)) / (len(data) + EASE)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> tuple[float, float]:
    """Weighted logistic fit of one feature by Newton steps, with a light ridge on the slope."""
    a, b, scale = 0.0, math.log(prior / (1 - prior)), max(float(np.abs(x).max(initial=0)), 1e-9)
    z = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - y) * z).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          learn: Column | None = None, sample_docs: int = SAMPLE_DOCS, seed: int = 42) -> Model:
    """A model from ``labels`` (id and 0/1 label; ``learn`` restricts them) and their texts in ``df``."""
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if learn is not None:
        rows = rows.where(learn)
    shares = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    total, prior = sum(shares.values()), 0.5
    if total:
        prior = min(max(shares.get(1, 0) / total, 0.01), 0.99)
    flat = Model(b"", b"", 0.0, math.log(prior / (1 - prior)))
    if len(shares) < 2:
        return flat
    order = F.xxhash64(F.lit(seed), "doc_id")
    picked = [rows.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample_docs) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = (df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
             .join(F.broadcast(chosen), "doc_id")  # at most 2 * sample_docs ids
             # of rows that share an id one, so that there are no more texts than ids
             .where("length(text) > 0").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    got = sorted({(r.doc_id, r.label, r.text) for r in texts.collect() if r.text})
    fit = {k: [t.encode() for i, (_, label, t) in enumerate(g for g in got if g[1] == k) if i % 3] for k in (0, 1)}
    held = [(label, t) for k in (0, 1) for i, (_, label, t) in enumerate(g for g in got if g[1] == k) if i % 3 == 0]
    if not fit[0] or not fit[1]:
        return flat
    good, bad = _dictionary(fit[1]), _dictionary(fit[0])
    x = np.array([difference(t, good, bad) for _, t in held])
    y = np.array([float(label) for label, _ in held])
    weight = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
    slope, intercept = _logistic(x, y, weight, prior)
    return Model(good, bad, slope, intercept)


def score_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of a text column.  The model's two dictionaries, 64 KB, go with the tasks."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = sent.value
        return texts.map(lambda t: m.score(difference(t, m.good, m.bad) if t and m.good else 0.0)).astype(float)

    return score(text)


def quality_scores(df: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the labels of the other folds.  One scan, no shuffle."""
    model = train(df, labels, learn=fold(F.col("doc_id"), folds) != held)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held).alias("held_out"),
                     score_of(df.sparkSession, model, F.col("text")).alias("score")
                     ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(df: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """The rows of ``df`` that score at least ``threshold``."""
    model = train(df, labels, learn=fold(F.col("doc_id"), folds) != held)
    return df.where(score_of(df.sparkSession, model, F.col("text")) >= threshold)
