"""Mixing documents to target weights with soft memberships.

A classifier learned from labelled documents (multinomial logistic regression
on hashed words) predicts how probably each document belongs to each domain.
Every document gets a nonnegative rate, its expected number of copies; the
expected tokens of a domain are the sum of rate x tokens x probability. The
rates minimise the squared distance of these totals from their targets by
projected gradient: each step moves a document's rate against the gradient
and cuts it at zero. Only the totals (one number a domain) meet in the driver;
a document's rate follows from its own probabilities and the steps so far.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import id_text, ready, written
from churnlens.llm.features import Words

BUCKETS = 1 << 12
#: At most so many labelled documents are learned from, as many of each domain; a domain has one at least.
SAMPLE = 3200
#: Steps of the projected gradient at most, in either metric, and the distance from the targets (share of all tokens) at which they end.
STEPS, CLOSE = 200, 1e-4
#: They also end where so many steps bring the totals no nearer than by this share: the targets cannot be met.
STALL, LEAST = 25, 1e-3


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # (buckets, domains)
    bias: np.ndarray

    def posteriors(self, rows: list[np.ndarray]) -> np.ndarray:
        """Softmax of the mean word weights of each document; without words, of the bias."""
        z = np.stack([self.weights[r].mean(axis=0) if len(r) else np.zeros(len(self.domains)) for r in rows]) if rows else np.zeros((0, len(self.domains)))
        z = z + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", size: int = SAMPLE, steps: int = 100,
                id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """Learn domains from rows of ``docs`` that the labelled table lists and whose domain is known.

    The sample has ``size`` documents at most, as many of each domain (domains
    are few), by a hash of the id; an id with several rows counts once. The bias starts at the
    domains' shares among all labelled rows. Without labelled rows there is
    one domain, the empty string. More domains than ``size`` are an error.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id")).dropna().distinct()
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(domain_col).cast("string").alias("domain")).dropna()
    known = written(d.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("domain").alias("domain")), "domains")
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().limit(size + 1).collect()}
    if len(counts) > size:
        raise ValueError(f"more than {size} domains")
    if not counts:
        return DomainModel([""], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    domains = sorted(counts)
    picked = {r["doc_id"]: r["domain"] for x in domains
              for r in known.where(F.col("domain") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, size // len(domains))).collect()}
    rows = id_text(docs, id_col, text_col).where(F.col("doc_id").isin(list(picked))).groupBy("doc_id").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values("doc_id")
    words = Words(BUCKETS)
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, t in enumerate(rows["text"]):
        r = words.ids(t)[:, 0]
        if len(r):
            x[i] = np.bincount(r, minlength=BUCKETS) / len(r)
    y = np.array([[picked[i] == k for k in domains] for i in rows["doc_id"]], dtype=np.float32)
    share = np.array([counts[k] for k in domains], dtype=np.float64)
    model = DomainModel(domains, np.zeros((BUCKETS, len(domains)), np.float32), np.log(share / share.sum()))
    scale = 1 / np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) + 1e-8)  # each word as if of unit size
    for _ in range(steps):  # gradient steps on the mean log loss
        z = x @ model.weights + model.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        model.weights -= (0.5 * (scale**2)[:, None].clip(0, 1e4) * (x.T @ ((p - y) / len(x)).astype(np.float32))).astype(np.float32)
    return model


def posteriors(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``n_tokens`` (words between white space), ``p`` (one probability a domain)."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words = Words(BUCKETS)
        for b in batches:
            p = shared.value.posteriors([words.ids(t)[:, 0] for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n_tokens": [len(t.split()) if t else 0 for t in b["text"]], "p": list(p)})

    d = id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return d.mapInPandas(run, "doc_id long, text_hash long, n_tokens long, p array<double>")


def rates_of(p: np.ndarray, history: np.ndarray, ahead: bool = False) -> np.ndarray:
    """Rates after the steps of ``history`` (one row of domain gradients each), from rate 1.

    Each step starts ahead of the last rates, by a share of the last change
    (Nesterov's momentum); ``ahead`` gives the start of the next step.
    """
    r = before = np.ones(len(p))
    for t, g in enumerate(history):
        start = r + t / (t + 3) * (r - before)
        before, r = r, np.maximum(start - p @ g, 0)
    return r + len(history) / (len(history) + 3) * (r - before) if ahead else r


def fit_rates(post: DataFrame, targets: np.ndarray, steps: int = STEPS, close: float = CLOSE) -> tuple[np.ndarray, np.ndarray]:
    """Steps (one row of domain gradients each) and the totals they reach, as shares of all tokens.

    ``targets``: share of all tokens for each domain. The step length is one
    over the largest eigenvalue of the token-weighted moments of the
    probabilities. Each step is one sum over all documents, of two numbers a
    domain: the totals reached, and those from which the next step starts.
    """
    k = len(targets)

    def sums(history: np.ndarray, moments: bool):
        def run(batches):
            out = np.zeros((k, k if moments else 2))
            for b in batches:
                p = np.array(b["p"].tolist(), dtype=np.float64).reshape(len(b), k)
                w = b["n_tokens"].to_numpy(dtype=np.float64)
                out += (p * w[:, None]).T @ (p if moments else np.stack([rates_of(p, history), rates_of(p, history, True)], axis=1))
            yield pd.DataFrame({"i": np.arange(out.size), "v": out.ravel()})

        rows = post.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # 2 k or k x k rows
        v = np.zeros(k * (k if moments else 2))
        for r in rows:
            v[r["i"]] = r["v"]
        return v.reshape(k, -1)

    moment = sums(np.zeros((0, k)), True)
    tokens = moment.sum()  # the probabilities of a document add up to 1
    if tokens <= 0:
        return np.zeros((0, k)), np.zeros(k)
    return descend(lambda history: (sums(history, False) / tokens).T, moment / tokens, targets, steps, close)


def descend(totals, moment: np.ndarray, targets: np.ndarray, steps: int, close: float) -> tuple[np.ndarray, np.ndarray]:
    """The steps and totals of ``fit_rates``; ``totals(history)`` gives the totals reached and those ahead."""
    best = None
    # first in the metric of the moments, in which a small domain moves as fast as a large one; if that ends too far off, anew in the plain one
    for scale in (np.linalg.pinv(moment, rcond=1e-6, hermitian=True), np.eye(len(targets)) / max(1e-12, np.linalg.eigvalsh(moment)[-1])):
        history, total = np.zeros((0, len(targets))), moment.sum(axis=1)
        start, least, since = total, np.inf, 0
        while np.abs(total - targets).max() > close and len(history) < steps and since < STALL:
            history = np.vstack([history, scale @ (start - targets)])
            total, start = totals(history)
            gap = max(0, (total - targets) @ scale @ (total - targets)) ** 0.5
            least, since = (gap, 0) if gap < least * (1 - LEAST) else (least, since + 1)
        if best is None or np.linalg.norm(total - targets) < np.linalg.norm(best[1] - targets):
            best = history, total
        if np.abs(total - targets).max() <= close:
            break
    return best


def rated(post: DataFrame, history: np.ndarray, domains: list[str]) -> DataFrame:
    """``post`` with ``rate``, ``n_copies`` and ``domain`` (the most probable; ties to the first).

    ``n_copies`` is the rate rounded down, plus one for a share of documents,
    by a hash of id and text, that follows the rest: on average it is the rate.
    """
    def run(batches):
        for b in batches:
            p = np.array(b["p"].tolist(), dtype=np.float64).reshape(len(b), len(domains))
            yield b.assign(rate=rates_of(p, history), domain=[domains[i] for i in p.argmax(axis=1)])

    out = post.mapInPandas(run, "doc_id long, text_hash long, n_tokens long, p array<double>, rate double, domain string")
    u = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 30)) / F.lit(1 << 30)
    return out.withColumn("n_copies", F.floor(F.col("rate") + u).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``n_tokens``, ``p``, ``rate``, ``domain``, ``n_copies``, ``reached``.

    ``reached`` has the expected tokens of each domain (in the order of ``p``)
    as shares of all tokens, the same in every row. Where they are further than
    ``CLOSE`` from the targets, there is a warning, too; the rates are then the
    nearest found. ``targets`` are weights by domain, scaled to the tokens there are; domains
    that it does not name have target 0. If it names none of the domains found,
    every rate is 1 and ``reached`` null. Null and empty texts have no tokens and the domains'
    shares as probabilities. Null ids stay. Rows with equal id and text have
    equal rates. An empty table gives no rows. Other columns are ignored.
    """
    ready(docs.sparkSession)
    model = fit_domains(docs, labels, domain_col, id_col=id_col, text_col=text_col)
    post = written(posteriors(docs, model, id_col, text_col), "posteriors")
    t = np.array([max(0.0, float(targets.get(d, 0))) for d in model.domains])
    if t.sum() <= 0:
        return rated(post, np.zeros((0, len(t))), model.domains).withColumn("reached", F.lit(None).cast("array<double>"))
    t = t / t.sum()
    history, total = fit_rates(post, t)
    if total.any() and np.abs(total - t).max() > CLOSE:
        warnings.warn("targets are not met: " + ", ".join(f"{d!r} has {x:.5f} of {y:.5f}" for d, x, y in zip(model.domains, total, t, strict=True)), stacklevel=2)
    return rated(post, history, model.domains).withColumn("reached", F.array(*[F.lit(float(x)) for x in total]))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``n_copies`` says."""
    m = mix(docs, labels, targets, domain_col, id_col, text_col)
    n = m.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("n_copies").alias("_n")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(n["_id"]) & (F.xxhash64(docs[text_col].cast("string")) == n["_hash"])
    copy = F.explode(F.sequence(F.lit(1).cast("long"), n["_n"])).alias("_copy")
    return docs.join(n, same).where(n["_n"] > 0).select(*[docs[c] for c in docs.columns], copy).select(*[docs[c] for c in docs.columns])
