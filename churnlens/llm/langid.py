"""Language of a text: averaged embeddings of hashed subwords, a linear softmax, and a calibrated rejection.

Subwords are the runs of one to four letters of a word, with its edges marked.
Each is hashed to a row of an embedding table; a text is the mean of its
subwords' rows, and a linear layer turns it into one logit a language. Table
and layer are trained together by stochastic gradient descent. A part of the
sample is kept from training: on it the temperature of the softmax is set, and
for each language the score from which a prediction is to be trusted.

As the model is linear, a table of one logit a language and bucket is all that
prediction needs.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import crc_mod, crc_mod_sql, ready

BUCKETS = 1 << 13
SIZES = (1, 2, 3, 4)
WIDTH = 16
#: Learned from at most so many documents in all, and of each language; every language has one at least.
SAMPLE, PER_LANGUAGE = 2400, 600
EPOCHS, BATCH, RATE = 30, 32, 40.0
#: Every so many-th document of the sample calibrates; accepted predictions should be right with this share.
CALIBRATE, PRECISION = 5, 0.98
UNDETERMINED = "und"
#: Code points of a text that are looked at together.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _plane() -> np.ndarray:
    """Which code points of the first plane are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(65536)])


def _is_letter(p: np.ndarray) -> np.ndarray:
    out = _plane()[np.minimum(p, 65535)]
    for c in np.unique(p[p > 65535]):
        out[p == c] = unicodedata.category(chr(c))[0] == "L"
    return out


def subwords(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs among the subwords of the whole text."""
    out = np.zeros(buckets, dtype=np.int64)
    p = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    shift = np.uint64(65 - int(buckets).bit_length())
    most = max(SIZES)
    letters = np.zeros(len(p) + 2, dtype=np.uint64)  # 0 at the edges and for all but letters
    letters[1:-1] = np.where(_is_letter(p), p, 0)
    x = letters[(letters > 0) | np.concatenate([[True], letters[:-1] > 0])]  # one 0 between words
    for lo in range(0, len(x), BLOCK):
        b = x[lo:lo + BLOCK + most - 1]
        n = min(BLOCK, len(x) - lo)  # a run belongs to the block in which it starts
        h, inner = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        for size in range(1, most + 1):
            m = min(n, len(b) - size + 1)
            if m <= 0:
                break
            h, inner = h[:m], inner[:m]
            if size > 2:  # no edge inside
                inner = inner & (b[size - 2:size - 2 + m] > 0)
            h = (h + b[size - 1:size - 1 + m] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            if size in SIZES:
                ok = inner & (b[:m] > 0) if size == 1 else inner
                out += np.bincount((h[ok] >> shift).astype(np.int64), minlength=buckets)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray  # (buckets, WIDTH)
    layer: np.ndarray  # (WIDTH, languages)
    bias: np.ndarray
    temperature: float = 1.0
    #: Score from which a prediction of the language is accepted.
    accept: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def table(self) -> np.ndarray:
        return (self.embeddings @ self.layer).astype(np.float32)

    def scores(self, counts: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Probability of each language for each row of subword counts."""
        mean = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
        z = (mean.astype(np.float32) @ (self.table() if table is None else table) + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(counts: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> LanguageModel:
    """Stochastic gradient descent on the mean log loss, with a rate that falls to zero."""
    g = np.random.default_rng(seed)
    n, k = len(counts), len(languages)
    m = LanguageModel(languages, g.uniform(-1, 1, (counts.shape[1], WIDTH)).astype(np.float32) / WIDTH, g.normal(0, 0.1, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32))
    total = np.maximum(1, counts.sum(axis=1, keepdims=True))
    steps, t = epochs * -(-n // BATCH), 0
    for _ in range(epochs):
        order = g.permutation(n)
        for lo in range(0, n, BATCH):
            i = order[lo:lo + BATCH]
            x = (counts[i] / total[i]).astype(np.float32)
            hidden = x @ m.embeddings
            z = hidden @ m.layer + m.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p /= len(i)
            now = rate * (1 - t / steps)
            back = p @ m.layer.T
            m.layer -= now * 0.02 * (hidden.T @ p)
            m.bias -= now * 0.02 * p.sum(axis=0)
            m.embeddings -= now * (x.T @ back)
            t += 1
    return m


def calibrate(model: LanguageModel, counts: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> None:
    """Sets the temperature of least log loss, and for each language the least score that is right often enough.

    Among the rows for which a language is predicted with that score or more,
    at least ``precision`` have it; 1 where there is no such score, 0 for a
    language that is predicted for none of the rows.
    """
    if len(counts) and len(model.languages) > 1:
        # one row more, as likely of any language: else rows that are all right would have the scores grow without bound
        extra = 1 / (len(y) + 1) / len(model.languages)
        want = np.full((len(y), len(model.languages)), extra)
        want[np.arange(len(y)), y] += 1 - extra * len(model.languages)
        best = []
        for t in np.geomspace(0.1, 10, 41):
            model.temperature = float(t)
            best.append((-(want * np.log(np.maximum(1e-12, model.scores(counts)))).sum(axis=1).mean(), t))
        model.temperature = float(min(best)[1])
    p = model.scores(counts)
    at, score = (p.argmax(axis=1), p.max(axis=1)) if len(p) else (np.zeros(0, int), np.zeros(0))
    model.accept = np.zeros(len(model.languages))
    for k in range(len(model.languages)):
        own = at == k
        if own.any():
            s = np.sort(score[own])[::-1]
            right = (y[own] == k)[np.argsort(-score[own], kind="stable")]
            good = np.cumsum(right) / np.arange(1, len(s) + 1) >= precision
            last = np.append(s[1:] < s[:-1], True)  # rows of equal score are accepted together
            good &= last
            model.accept[k] = s[np.flatnonzero(good)[-1]] if good.any() else 1.0


def fit(docs: DataFrame, mod: int = 3, held_out: int = 1, size: int = SAMPLE, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> LanguageModel:
    """Learn from a sample of the documents that have a language, held-out ids left out.

    The sample has ``size`` documents at most, as many of each language, by a
    hash of the id (``per_language`` at most); their subwords are counted in
    the tasks that read them. More languages than ``size`` are an error.
    Without any language there is nothing to predict.
    """
    spark = docs.sparkSession
    ready(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.where((crc_mod_sql("doc_id", mod) != held_out) & F.col("lang").isNotNull())
    found = d.groupBy("lang").count().limit(size + 1).collect()
    if len(found) > size:
        raise ValueError(f"more than {size} languages")
    if not found:
        return LanguageModel([], np.zeros((BUCKETS, WIDTH), np.float32), np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    languages = sorted(r["lang"] for r in found)
    each = min(per_language, size // len(languages))
    # about twice as many by hash first, so that the ranking sees no more; the first ones are taken exactly
    share = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, (2 * each + 50) / r["count"])) for r in found], "lang string, share double"))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    d = d.join(share, "lang").where(u < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")))
    d = d.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "lang", "text")

    def count(batches):
        for b in batches:
            rows = [subwords(t) for t in b["text"]]
            at = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "at": [i.astype("<u2").tobytes() for i in at],
                                "n": [r[i].astype("<u4").tobytes() for r, i in zip(rows, at)]})

    rows = sorted(d.mapInPandas(count, "doc_id long, lang string, at binary, n binary").collect())  # size rows, BUCKETS counts each at most
    counts = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for x, r in zip(counts, rows):
        x[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
    y = np.array([languages.index(r["lang"]) for r in rows])
    ok = counts.sum(axis=1) > 0  # texts without a letter teach nothing
    apart = (np.arange(len(rows)) % CALIBRATE == CALIBRATE - 1) & ok
    model = train(counts[ok & ~apart], y[ok & ~apart], languages)
    calibrate(model, counts[apart], y[apart])
    return model


def predict(docs: DataFrame, model: LanguageModel, mod: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (its probability), ``accepted``.

    Null and empty texts, texts without a letter, and all texts if no language
    was learned are ``und``, with score 0, not accepted. Null ids are not held
    out. Repeated rows each get a row; other columns are ignored.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model.languages, UNDETERMINED], dtype=object)

    def run(batches):
        m = shared.value
        table = m.table()
        for b in batches:
            counts = np.stack([subwords(t) for t in b["text"]]) if len(b) else np.zeros((0, BUCKETS))
            known = (counts.sum(axis=1) > 0) & bool(m.languages)
            best, score = np.full(len(b), len(m.languages)), np.zeros(len(b))
            if known.any():
                p = m.scores(counts[known], table)
                best[known], score[known] = p.argmax(axis=1), p.max(axis=1)
            accepted = known & (score >= np.append(m.accept, 2.0)[best])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": crc_mod(b["doc_id"], mod) == held_out, "lang_pred": names[best],
                                "score": np.clip(score, 0, 1).astype(np.float64), "accepted": accepted})

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
