"""Quality: votes of the nearest labelled documents in a latent-semantic space.

A bounded sample of labelled documents is embedded by a truncated singular
value decomposition of weighted trigram counts (of character classes, with a
few measures of repetition). The vectors are broadcast; every document is
compared with all of them in blocks, exactly, and its nearest neighbours vote
with weights that follow their cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import crc_mod, id_text, ready
from churnlens.llm.features import Words, shape_counts
from churnlens.llm.labelled import order_of, picked

BUCKETS = 2048
LATENT = 48
NEIGHBOURS = 25
#: Weight of a neighbour: its cosine (0 if negative) to this power.
SHARPNESS = 4
#: At most so many labelled documents of each label are broadcast (48 numbers each).
SAMPLE_PER_LABEL = 2000
THRESHOLD = 0.3


def terms(text: str | None, words: Words) -> np.ndarray:
    """Unit vector of log counts, then shares of repeated words, of words like the one before, and of repeated lines."""
    text = text or ""
    c = np.log1p(shape_counts(text, BUCKETS))
    ids = words.ids(text)[:, 0]
    n = len(ids)
    lines = [x for x in text.split("\n") if x]
    more = [0.5 * (1 - len(np.unique(ids)) / n), float((ids[1:] == ids[:-1]).sum()) / n] if n else [0.0, 0.0]
    more.append(1 - len(set(lines)) / len(lines) if lines else 0.0)
    return np.concatenate([c / max(1e-9, np.linalg.norm(c)), more])


@dataclass
class QualityModel:
    mean: np.ndarray | None
    axes: np.ndarray | None
    vectors: np.ndarray | None
    labels: np.ndarray | None
    prior: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.axes
        return z / np.maximum(1e-12, np.linalg.norm(z, axis=1, keepdims=True))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Exact cosines with all labelled vectors, a block of documents at a time; equal ones (to 9 places) go to the vector first in order."""
        if self.axes is None:
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(x), 256):
            c = np.round(self.embed(x[lo:lo + 256]) @ self.vectors.T, 9)
            top = nearest(c, k)
            w = np.maximum(np.take_along_axis(c, top, axis=1), 0) ** SHARPNESS + 1e-9
            out[lo:lo + 256] = (w * self.labels[top]).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0, 1)


def nearest(c: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k largest values; of those equal to the last, the first in order."""
    if k >= c.shape[1]:
        return np.broadcast_to(np.arange(c.shape[1]), c.shape)
    least = np.partition(c, c.shape[1] - k, axis=1)[:, c.shape[1] - k, None]
    above, level = c > least, c == least
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level)[1].reshape(len(c), k)


def decompose(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """The first k right singular vectors of x, by subspace iteration."""
    g = np.random.default_rng(seed)
    k = min(k, *x.shape)
    y = x @ g.normal(size=(x.shape[1], min(k + 10, *x.shape))).astype(x.dtype)
    for _ in range(4):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE_PER_LABEL, mod: int = 5, held_out: int = 0,
        id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learn from at most ``per_label`` labelled documents of each label, held-out ids left out.

    Without rows of both labels every score is the share of label 1 among the
    labelled rows (0.5 without any).
    """
    label_of, counts = picked(docs, labels, label, per_label, mod, held_out, id_col)
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len(set(label_of.values())) < 2:
        return QualityModel(None, None, None, None, prior)
    ready(docs.sparkSession)

    def run(batches):
        words = Words(1 << 31)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [terms(t, words).astype(np.float32).tobytes() for t in b["text"]]})

    # the texts stay in the tasks: a row of BUCKETS + 3 numbers each reaches the driver
    d = id_text(docs, id_col, text_col).where(F.col("doc_id").isin(list(label_of))).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = d.mapInPandas(run, "doc_id long, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    order = order_of(pd.Series([r["doc_id"] for r in rows])).argsort(kind="stable")
    x = np.empty((len(rows), BUCKETS + 3), dtype=np.float32)
    for i, at in enumerate(order):
        x[i] = np.frombuffer(rows[at]["x"], dtype=np.float32)
    y = np.array([label_of[rows[at]["doc_id"]] for at in order], dtype=np.float64)
    del rows
    mean = x.mean(axis=0, dtype=np.float64)
    x -= mean.astype(np.float32)
    axes = decompose(x, LATENT).astype(np.float64)
    z = x @ axes
    return QualityModel(mean, axes, z / np.maximum(1e-12, np.linalg.norm(z, axis=1, keepdims=True)), y, prior)


def score(docs: DataFrame, model: QualityModel, mod: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher: better), ``predicted`` (score >= 0.3).

    Null and empty texts get the score of an empty text. Null ids are not held
    out. Repeated rows each get a row; other columns are ignored.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, words = shared.value, Words(1 << 31)
        for b in batches:
            s = m.scores(np.array([terms(t, words) for t in b["text"]]).reshape(len(b), -1))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": crc_mod(b["doc_id"], mod) == held_out, "score": s,
                                "predicted": (s >= THRESHOLD).astype(np.int32)})

    return id_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        words = Words(1 << 31)
        return pd.Series(shared.value.scores(np.array([terms(t, words) for t in texts]).reshape(len(texts), -1)) >= THRESHOLD)

    return docs.where(good(F.col(text_col).cast("string")))
