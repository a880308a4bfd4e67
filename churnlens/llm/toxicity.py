"""Toxicity: a convolutional text classifier in numpy.

Words and their stems are hashed into an embedding table (a word is the sum of
the two rows); filters of several widths run over the embedded words and the largest response of each filter over the whole
text feeds a logistic output. All labelled documents are learned from: counts
are summed over all of them, the network is trained by shards of bounded size
whose weights are averaged after each round, and the calibration and the
thresholds come from counts of the scores of all rows kept from training. The
model is broadcast; every document is scored where it lies.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import crc_mod, ready
from churnlens.llm.features import Words
from churnlens.llm.labelled import labelled
from churnlens.session import written

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 16, (1, 2, 3)
#: Documents and words that a shard of the training rows has, about, and rounds of training and averaging when there are several shards.
SHARD_ROWS, SHARD_WORDS, ROUNDS = 4096, 4_000_000, 2
#: Words of a text that are convolved at a time.
BLOCK = 8192
THRESHOLD = 0.3
PAD = BUCKETS  # a row of zeros


def _padded(ids: np.ndarray) -> np.ndarray:
    """``ids`` and so much padding that every filter has a place at every word, or at one place at least."""
    wide = max(WIDTHS)
    return np.concatenate([ids, np.full((wide - 1 if len(ids) else wide, 2), PAD, dtype=np.int64)])


@dataclass
class TextCNN:
    """Parameters by name: ``emb``, a filter bank ``w<k>`` and bias ``b<k>`` for each width, ``out`` and ``bias``."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, evidence: np.ndarray, seed: int = 0) -> TextCNN:
        """Small random weights; the first dimension of a bucket starts at its ``evidence``, which some filters look at."""
        g = np.random.default_rng(seed)
        p = {"emb": g.normal(0, 0.03, (BUCKETS + 1, DIM)).astype(np.float32), "out": g.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for k in WIDTHS:
            p[f"w{k}"] = g.normal(0, 1 / np.sqrt(k * DIM), (k, DIM, FILTERS)).astype(np.float32)
            p[f"b{k}"] = np.zeros(FILTERS, np.float32)
            p[f"w{k}"][:, 0, : FILTERS // 4] += 1
        p["emb"][:-1, 0] += evidence
        p["emb"][PAD] = 0
        return cls(p)

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        return self.p["emb"][ids[:, 0]] + self.p["emb"][ids[:, 1]]

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """Largest response of every filter over all words, block by block."""
        top = np.full((len(WIDTHS), FILTERS), -np.inf, dtype=np.float32)
        padded = _padded(ids)
        for lo in range(0, max(1, len(ids)), BLOCK):
            e = self.embedded(padded[lo:lo + BLOCK + max(WIDTHS) - 1])
            n = len(e) - max(WIDTHS) + 1
            for i, k in enumerate(WIDTHS):
                z = sum(e[j:j + n] @ self.p[f"w{k}"][j] for j in range(k))
                np.maximum(top[i], z.max(axis=0), out=top[i])
        return np.maximum(top + np.stack([self.p[f"b{k}"] for k in WIDTHS]), 0).ravel()

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        h = np.array([self.pooled(r) for r in rows], dtype=np.float32).reshape(len(rows), -1)
        return 1 / (1 + np.exp(-(h @ self.p["out"] + self.p["bias"]).astype(np.float64)))

    def step(self, rows: list[np.ndarray], y: np.ndarray, drop: np.ndarray, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over a batch, rows weighted; only the words at the maxima get one."""
        p, wide = self.p, max(WIDTHS)
        flat = np.concatenate([_padded(r) for r in rows])
        size = np.array([max(1, len(r)) for r in rows])
        start = np.concatenate([[0], np.cumsum(size + wide - 1)[:-1]])
        e = self.embedded(flat)
        n = len(flat) - wide + 1
        at = np.empty((len(rows), len(WIDTHS), FILTERS), dtype=np.int64)
        h = np.empty(at.shape, dtype=np.float32)
        for i, k in enumerate(WIDTHS):
            z = sum(e[j:j + n] @ p[f"w{k}"][j] for j in range(k)) + p[f"b{k}"]
            for r, (s, m) in enumerate(zip(start, size, strict=True)):
                at[r, i] = s + z[s:s + m].argmax(axis=0)
            h[:, i] = np.take_along_axis(z, at[:, i], axis=0)
        on = (h > 0) & drop
        hid = np.where(on, h, 0).reshape(len(rows), -1)
        d = (1 / (1 + np.exp(-(hid @ p["out"] + p["bias"]))) - y) * weight / len(rows)
        grad = {"out": hid.T @ d, "bias": d.sum(keepdims=True), "emb": np.zeros_like(p["emb"])}
        back = (d[:, None] * p["out"][None, :]).reshape(h.shape) * on
        for i, k in enumerate(WIDTHS):
            grad[f"b{k}"] = back[:, i].sum(axis=0)
            gw = np.empty_like(p[f"w{k}"])
            for j in range(k):
                gw[j] = np.einsum("rfd,rf->df", e[at[:, i] + j], back[:, i])
                up = back[:, i, :, None] * p[f"w{k}"][j].T[None]
                for c in (0, 1):
                    np.add.at(grad["emb"], flat[at[:, i] + j, c], up)
            grad[f"w{k}"] = gw
        grad["emb"][PAD] = 0
        return {a: g.astype(np.float32) for a, g in grad.items()}


def evidence(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Per bucket the log odds ratio of its presence in documents of label 1 (``a`` of ``na``) to that in others, in standard errors, scaled; rare buckets are near 0."""
    odds = np.log((a + 0.5) / (na - a + 0.5)) - np.log((b + 0.5) / (nb - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (na - a + 0.5) + 1 / (nb - b + 0.5))
    return (np.where(a + b > 0, np.clip(z, -6, 6), 0) / 3).astype(np.float32)


def train(net: TextCNN, rows: list[np.ndarray], y: np.ndarray, share: float, epochs: int, batch: int = 64, rate: float = 0.004, seed: int = 0) -> TextCNN:
    """``epochs`` of Adam; half of the filters are dropped at random in each step. ``share`` of label 1 among all rows: both labels weigh the same."""
    g = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t = 0
    for epoch in range(epochs):
        order = g.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            pick = order[lo:lo + batch]
            t += 1
            lr = rate * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            drop = g.random((1, len(WIDTHS), FILTERS)) < 0.5
            for k, x in net.step([rows[i] for i in pick], y[pick], drop, weight[pick]).items():
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.001 * (x * x - v[k])
                net.p[k] -= lr * m[k] / (np.sqrt(v[k]) + 1e-7)
    return net


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    cut = np.cumsum([like[k].size for k in sorted(like)])[:-1]
    return {k: x.reshape(like[k].shape).astype(np.float32) for k, x in zip(sorted(like), np.split(flat, cut), strict=True)}


def train_shards(rows: DataFrame, net: TextCNN, shards: int, share: float, steps: int = 240, batch: int = 64) -> TextCNN:
    """Each shard (``s``) trains on all of its rows, and the weights are averaged; so for some rounds.

    One shard makes about ``steps`` steps in one round, several a third of them a round; one pass at least.
    """
    n = rows.count()
    rounds = 1 if shards == 1 else ROUNDS
    epochs = max(1, round((steps if shards == 1 else steps / 3) * batch / max(1, n / shards)))
    for turn in range(rounds):
        net = _round(rows, net, shards, share, epochs, batch, turn)
    net.p["out"] *= 0.5  # all filters answer when scoring
    return net


#: Parts of the weights that are averaged, so that no task has all of every shard.
_PARTS = 64


def _round(rows: DataFrame, net: TextCNN, shards: int, share: float, epochs: int, batch: int, turn: int) -> TextCNN:
    shared = rows.sparkSession.sparkContext.broadcast(net.p)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(pdf["doc_id"].to_numpy(), kind="stable")]
        words, own = Words(BUCKETS), TextCNN({k: v.copy() for k, v in shared.value.items()})
        seed = int(pdf["s"].iloc[0]) + turn * shards
        own = train(own, [words.ids(t) for t in pdf["text"]], pdf["y"].to_numpy(), share, epochs, batch, 0.004 / (turn + 1), seed)
        flat = _flat(own.p).astype(np.float64)
        return pd.DataFrame({"part": range(_PARTS), "n": len(pdf), "w": [x * len(pdf) for x in np.array_split(flat, _PARTS)]})

    w = written(rows.repartition(shards, "s").groupBy("s").applyInPandas(run, "part int, n long, w array<double>"), "toxicity-weights")
    total = w.select("part", "n", F.posexplode("w").alias("i", "x")).groupBy("part", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    mean = total.orderBy("part", "i").select("x").toPandas()["x"].to_numpy()        # as many numbers as the network has
    return TextCNN(_shaped(mean, net.p))


def sharpen(scores: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: float) -> tuple[float, float]:
    """Slope and offset on the log odds that give calibrated scores on rows not learned from (Newton steps, ridge 0.01)."""
    x = np.stack([_log_odds(scores), np.ones(len(scores))], axis=1)
    w = weight / weight.sum() * rows
    c = np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ c))
        hess = (x * (w * q * (1 - q))[:, None]).T @ x + 0.01 * np.eye(2)
        c = c - np.clip(np.linalg.solve(hess, x.T @ (w * (q - y)) + 0.01 * (c - [1, 0])), -1, 1)
    return float(max(c[0], 0.1)), float(c[1])


def _log_odds(scores):
    s = np.clip(scores, 1e-9, 1 - 1e-9)
    return np.log(s / (1 - s))


def calibrate(counts: pd.DataFrame, least: int = 30) -> dict[str, float]:
    """Per language the threshold with the best F1, from ``lang``, ``cut`` (score), ``n1`` and ``n0`` (rows of each label); languages with few rows of either label keep the default."""
    out = {}
    for x, g in counts.groupby("lang"):
        g = g.sort_values("cut")
        if min(g["n1"].sum(), g["n0"].sum()) < least:
            continue
        cuts = g["cut"].to_numpy()
        right, all_ = (v.to_numpy()[::-1].cumsum()[::-1] for v in (g["n1"], g["n1"] + g["n0"]))
        best = int(np.argmax(2 * right / np.maximum(1, all_ + g["n1"].sum())))
        out[str(x)] = float(cuts[best] + (cuts[best - 1] if best else 0)) / 2  # midway to the next lower score
    return out


@dataclass
class ToxicityModel:
    net: TextCNN | None
    slope: float
    offset: float
    prior: float
    thresholds: dict[str, float]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if self.net is None:
            return np.full(len(rows), self.prior)
        return 1 / (1 + np.exp(-(self.slope * _log_odds(self.net.scores(rows)) + self.offset)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, held_out: int = 2,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> ToxicityModel:
    """Learn from all labelled documents, held-out ids left out.

    A quarter of them is kept from training; on it the scores are calibrated to
    the share of label 1 among all labelled rows, and a threshold is chosen for
    each language. Without rows of both labels every score is the share of label
    1 (0.5 without any label).
    """
    ready(docs.sparkSession)
    rows, counts = labelled(docs, labels, label, mod, held_out, id_col, text_col, lang_col)
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if set(counts) != {0, 1}:
        return ToxicityModel(None, 1.0, 0.0, prior, {})
    h = F.xxhash64("doc_id", F.lit(17))
    rows = written(rows.withColumn("rest", F.pmod(h, F.lit(4)) == 0).withColumn("h", F.shiftrightunsigned(h, 8)), "toxicity-rows")
    learn, rest = rows.where(~F.col("rest")), rows.where("rest")
    n = learn.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"), F.sum(F.length("text")).alias("chars")).first()
    if not n["n1"] or n["n1"] == n["n"]:
        return ToxicityModel(None, 1.0, 0.0, prior, {})

    def present(batches):
        words, c = Words(BUCKETS), np.zeros((2, BUCKETS), dtype=np.int64)
        for b in batches:
            for y, t in zip(b["y"], b["text"]):
                c[y][np.unique(words.ids(t))] += 1
        at = np.flatnonzero(c.any(axis=0))
        yield pd.DataFrame({"bucket": at, "n0": c[0, at], "n1": c[1, at]})

    seen = learn.select("y", "text").mapInPandas(present, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    a, b = np.zeros(BUCKETS), np.zeros(BUCKETS)
    a[seen["bucket"]], b[seen["bucket"]] = seen["n1"], seen["n0"]
    shards = max(1, -(-n["n"] // SHARD_ROWS), -(-(n["chars"] or 0) // (6 * SHARD_WORDS)))
    learn = learn.select("doc_id", "y", "text", F.pmod("h", F.lit(shards)).cast("int").alias("s"))
    net = train_shards(learn, TextCNN.fresh(evidence(a, b, n["n1"], n["n"] - n["n1"])), shards, n["n1"] / n["n"])
    return calibrated(net, rest, prior, lang_col is not None)


def calibrated(net: TextCNN, rest: DataFrame, prior: float, by_language: bool = True) -> ToxicityModel:
    """The network with slope, offset and thresholds from all rows of ``rest``, by counts of their scores."""
    shared = rest.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        words = Words(BUCKETS)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "lang": b["carry"], "odds": _log_odds(shared.value.scores([words.ids(t) for t in b["text"]]))})

    s = written(rest.select("y", "text", "carry").mapInPandas(run, "y int, lang string, odds double"), "toxicity-rest")
    c = s.groupBy("y", F.round("odds", 3).alias("odds")).agg(F.count(F.lit(1)).alias("n")).orderBy("odds", "y").toPandas()       # at most 83,000 rows
    t, n = c["y"].to_numpy(), c["n"].to_numpy(dtype=np.float64)
    share = min(max((t * n).sum() / max(1, n.sum()), 1e-3), 1 - 1e-3)
    at = 1 / (1 + np.exp(-c["odds"].to_numpy()))
    slope, offset = sharpen(at, t, n * np.where(t == 1, prior / share, (1 - prior) / (1 - share)), n.sum()) if len(c) else (1.0, 0.0)
    model = ToxicityModel(net, slope, offset, prior, {})
    if by_language:
        cut = F.round(1 / (1 + F.exp(-(F.lit(slope) * F.col("odds") + F.lit(offset)))), 3)
        few = s.where("lang is not null").groupBy("lang", cut.alias("cut")).agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
        known = few.groupBy("lang").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b")).where("a >= 30 and b >= 30").select("lang")
        model.thresholds = calibrate(few.join(known, "lang").toPandas())        # at most 1,001 rows a language with enough labels
    return model


def score(docs: DataFrame, model: ToxicityModel, mod: int = 4, held_out: int = 2,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted`` (score >= 0.3), ``by_language``.

    The score depends on the text alone; ``by_language`` compares it with the
    threshold of the row's language (the default where there is none). Null,
    empty and wordless texts get the score of an empty text. Null ids are not
    held out. Repeated rows each get a row; other columns are ignored.
    """
    ready(docs.sparkSession)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, words = shared.value, Words(BUCKETS)
        for b in batches:
            s = m.scores([words.ids(t) for t in b["text"]])
            cut = np.array([m.thresholds.get(x, THRESHOLD) for x in b["lang"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": crc_mod(b["doc_id"], mod) == held_out, "score": s,
                                "predicted": (s >= THRESHOLD).astype(np.int32), "by_language": (s >= cut).astype(np.int32)})

    return d.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, by_language int")
