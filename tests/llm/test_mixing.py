import numpy as np
import pandas as pd
import pytest

from churnlens.llm import mixing as M

SF = "/root/testdata/sf0.01"
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def mixed(tables):
    return M.mix(*tables, TARGETS).toPandas()


def test_targets_are_met(mixed, tables):
    p, n = np.stack(mixed["p"]), mixed["n_tokens"].to_numpy()
    text = dict(tables[0].select("doc_id", "text").toPandas().to_numpy())
    assert {i: len(t.split()) for i, t in text.items()} == dict(zip(mixed["doc_id"], n))
    share = (p * (n * mixed["rate"].to_numpy())[:, None]).sum(axis=0) / n.sum()
    assert np.abs(share - [0.2, 0.4, 0.2, 0.2]).max() <= 1e-4 and (mixed["rate"] >= 0).all()
    assert ((mixed["n_copies"] == np.floor(mixed["rate"])) | (mixed["n_copies"] == np.floor(mixed["rate"]) + 1)).all()
    assert abs(mixed["n_copies"].sum() / mixed["rate"].sum() - 1) < 0.05


def test_domains_are_recognised(mixed, tables):
    m = mixed.merge(tables[0].select("doc_id", "lang").toPandas(), on="doc_id")
    assert (m["domain"] == m["lang"]).mean() > 0.95
    assert np.allclose(np.stack(mixed["p"]).sum(axis=1), 1)


def slow_rates(p, n, targets, steps=20000):
    """Plain projected gradient, all rows in one array."""
    w = n / n.sum()
    length = 1 / np.linalg.eigvalsh((p * w[:, None]).T @ p)[-1]
    r = np.ones(len(n))
    for _ in range(steps):
        r = np.maximum(r - length * p @ (p.T @ (w * r) - targets), 0)
    return r, p.T @ (w * r)


@pytest.mark.parametrize("targets,slack", [([0.5, 0.3, 0.2], 1e-4), ([0.6, 0.15, 0.25], 1e-4), ([1.0, 0.0, 0.0], 0.05)])
def test_least_squares_optimum(spark, targets, slack):
    """As near to the targets as 20,000 plain steps come; where they cannot be reached, near that after the few steps."""
    g = np.random.default_rng(3)
    p = g.dirichlet([0.4, 0.7, 0.3], 300)
    n = g.integers(0, 500, 300)
    post = spark.createDataFrame(pd.DataFrame({"n_tokens": n, "p": [x.tolist() for x in p]}), "n_tokens long, p array<double>").repartition(4)
    history, total = M.fit_rates(post, np.array(targets))
    _, best = slow_rates(p, n.astype(float), np.array(targets))
    assert np.linalg.norm(total - targets) <= np.linalg.norm(best - targets) + slack
    r = M.rates_of(p, history)
    assert (r >= 0).all() and np.allclose(p.T @ (n / n.sum() * r), total)


@pytest.mark.parametrize("small", [0.01, 0.002, 0.0005])
def test_targets_are_met_on_skewed_sources(small):
    """A small domain must move as far as its target asks, however little it moves the totals."""
    g = np.random.default_rng(1)
    y = g.choice(4, 8000, p=[1 - 3 * small, small, small, small])
    p = np.stack([g.dirichlet(np.eye(4)[c] * 60 + 0.3) for c in y])
    w = g.integers(1, 500, len(y)).astype(float)
    w /= w.sum()
    targets = np.array([0.4, 0.2, 0.2, 0.2])
    totals = lambda h: (p.T @ (w * M.rates_of(p, h)), p.T @ (w * M.rates_of(p, h, True)))
    history, total = M.descend(totals, (p * w[:, None]).T @ p, targets, M.STEPS, M.CLOSE)
    assert np.abs(total - targets).max() <= M.CLOSE
    assert np.allclose(p.T @ (w * M.rates_of(p, history)), total)


def test_missed_targets_are_reported(spark):
    text = "the same words in both languages"
    docs = spark.createDataFrame([(i, text, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="targets are not met"):
        out = M.mix(docs, docs.select("doc_id"), {"en": 0.9, "de": 0.1})
    r = out.select("reached").distinct().collect()
    assert len(r) == 1 and abs(r[0].reached[0] - 0.1) > 0.1


def test_copies_as_rows(tables, mixed):
    out = M.mixed_documents(*tables, TARGETS)
    assert out.columns == tables[0].columns
    n = out.groupBy("doc_id").count().toPandas()
    want = {i: c for i, c in zip(mixed["doc_id"], mixed["n_copies"]) if c}
    assert dict(zip(n["doc_id"], n["count"])) == want


def test_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 6, 7, 9, 10, 4)] + [(None, 0)], "doc_id long, quality int")
    out = M.mix(edge_docs, labels, {"en": 1, "de": 1}).toPandas()
    assert len(out) == edge_docs.count() and out["rate"].notna().all() and (out["n_copies"] >= 0).all()
    assert set(out[out["doc_id"].isin([3, 4, 5])]["n_tokens"]) == {0}
    copies = M.mixed_documents(edge_docs, labels, {"en": 1, "de": 1})
    assert copies.columns == edge_docs.columns and copies.count() == out["n_copies"].sum()
    assert M.mix(empty_docs, labels, TARGETS).count() == 0
    assert set(M.mix(edge_docs, labels.where("false"), TARGETS).toPandas()["rate"]) == {1.0}
    assert set(M.mix(edge_docs, labels, {"xx": 1}).toPandas()["rate"]) == {1.0}
