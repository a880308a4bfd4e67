import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import quality, toxicity
from churnlens.llm.features import Words, shape_counts

SF = "/root/testdata/sf0.01"


def auc(y, s):
    above = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    return float(above)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def toxic_model(tables):
    return toxicity.fit(*tables)


@pytest.fixture(scope="module")
def quality_model(tables):
    return quality.fit(*tables)


def check_result(docs, out, mod, rest):
    rows = out.toPandas()
    assert len(rows) == docs.count()
    held = [False if i is None or i != i else zlib.crc32(str(int(i)).encode()) % mod == rest for i in rows["doc_id"]]
    assert list(rows["held_out"]) == held
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.3)).all()
    return rows


def test_toxicity_held_out(tables, toxic_model):
    docs, labels = tables
    rows = check_result(docs, toxicity.score(docs, toxic_model), 4, 2).merge(labels.toPandas(), on="doc_id")
    rows = rows[rows["held_out"]]
    assert auc(rows["toxic"].to_numpy(), rows["score"].to_numpy()) > 0.9


def test_quality_held_out(tables, quality_model):
    docs, labels = tables
    rows = check_result(docs, quality.score(docs, quality_model), 5, 0).merge(labels.toPandas(), on="doc_id")
    rows = rows[rows["held_out"]]
    assert auc(rows["quality"].to_numpy(), rows["score"].to_numpy()) > 0.98


def test_scores_depend_on_text_only(spark, tables, toxic_model, quality_model):
    docs, _ = tables
    few = docs.limit(40).toPandas()
    few["lang"], few["source"] = "xx", None
    few["doc_id"] += 10_000_000
    other = spark.createDataFrame(few, docs.schema)
    for mod, model in ((toxicity, toxic_model), (quality, quality_model)):
        a = {r.doc_id: r.score for r in mod.score(docs, model).collect()}
        for r in mod.score(other, model).collect():
            assert abs(a[r.doc_id - 10_000_000] - r.score) < 1e-6


def test_edges(edge_docs, empty_docs, tables, toxic_model, quality_model):
    labels = tables[1]
    for mod, model, m, rest in ((toxicity, toxic_model, 4, 2), (quality, quality_model, 5, 0)):
        check_result(edge_docs, mod.score(edge_docs, model, id_col="doc_id"), m, rest)
        assert mod.score(empty_docs, model).count() == 0
        bare = mod.fit(empty_docs, labels)
        assert bare.prior == 0.5 and {r.score for r in mod.score(edge_docs, bare).collect()} == {0.5}
    kept = quality.keep_good(edge_docs, quality_model)
    assert kept.columns == edge_docs.columns


def test_one_label_and_null_labels(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, None, None), (None, 0, 0), (7, 1, None)], "doc_id long, quality int, toxic int")
    for mod in (toxicity, quality):
        assert mod.fit(edge_docs, labels).prior == 1.0


def test_sample_is_bounded_and_held_out(tables):
    from churnlens.llm.labelled import sample
    rows, counts = sample(*tables, "toxic", 20, 4, 2)
    assert (rows.groupby("y").size() <= 20).all() and sum(counts.values()) > 40
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in rows["doc_id"])


def test_gradients():
    g = np.random.default_rng(0)
    net = toxicity.TextCNN.fresh(g.normal(size=toxicity.BUCKETS).astype(np.float32), 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = [g.integers(0, 50, (n, 2)) for n in (7, 1, 5, 12)]
    y = np.array([1, 0, 1, 0])
    drop = np.ones((1, len(toxicity.WIDTHS), toxicity.FILTERS), bool)

    def loss():
        s = net.scores(rows)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grad = net.step(rows, y, drop)
    for name, at in [("out", (3,)), ("bias", (0,)), ("w2", (1, 0, 2)), ("w3", (2, 4, 1)), ("b1", (2,)), ("emb", (int(rows[0][2, 0]), 0))]:
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - grad[name][at]) < 1e-3, name


def test_blocks_do_not_matter(monkeypatch, toxic_model):
    ids = np.random.default_rng(2).integers(0, 1000, (500, 2))
    whole = toxic_model.net.pooled(ids)
    monkeypatch.setattr(toxicity, "BLOCK", 37)
    assert np.allclose(whole, toxic_model.net.pooled(ids), atol=1e-5)


def test_shape_counts_in_blocks(monkeypatch):
    from churnlens.llm import features
    text = "Some Text!! 漢字 😀 12 | x\ny " * 50
    whole = shape_counts(text, 2048)
    assert whole.sum() == len(text) - 2
    monkeypatch.setattr(features, "BLOCK", 101)
    assert (shape_counts(text, 2048) == whole).all()


def test_votes_match_brute_force(quality_model, tables):
    m, w = quality_model, Words(1 << 31)
    texts = [r.text for r in tables[0].limit(20).collect()]
    x = np.array([quality.terms(t, w) for t in texts])
    got = m.scores(x)
    for row, s in zip(m.embed(x), got):
        c = np.array([float(row @ v) for v in m.vectors])
        top = np.argsort(-c, kind="stable")[:quality.NEIGHBOURS]
        wt = np.maximum(c[top], 0) ** quality.SHARPNESS + 1e-9
        assert abs((wt * m.labels[top]).sum() / wt.sum() - s) < 1e-6


def test_nearest_ties():
    """Of equal cosines the first vectors vote, whatever the order in which a selection would find them."""
    g = np.random.default_rng(5)
    c = np.round(g.normal(size=(50, 400)), 1)
    c[:, 100:300] = 0.5
    for k in (1, 25, 399, 400):
        want = [sorted(range(400), key=lambda j, r=r: (-r[j], j))[:k] for r in c]
        assert [sorted(x) for x in quality.nearest(c, k)] == [sorted(x) for x in want]
    axes = np.eye(4)[:, :2]
    vectors = np.tile([[1.0, 0.0]], (200, 1))
    labels = np.arange(200) < 10
    m = quality.QualityModel(np.zeros(4), axes, vectors, labels.astype(float), 0.5)
    assert m.scores(np.array([[2.0, 0, 0, 0]]))[0] == pytest.approx(10 / quality.NEIGHBOURS)


def test_toxicity_against_plain_forward(tables, toxic_model):
    """Filters slid over the embedded words one place at a time."""
    docs, _ = tables
    net, words = toxic_model.net, Words(toxicity.BUCKETS)
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxic_model).collect()}
    for d in docs.orderBy("doc_id").limit(12).collect():
        ids = words.ids(d.text).tolist()
        e = [net.p["emb"][a].astype(np.float64) + net.p["emb"][b] for a, b in ids] + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - (1 if ids else 0))
        pooled = []
        for k in toxicity.WIDTHS:
            w, b = net.p[f"w{k}"].astype(np.float64), net.p[f"b{k}"]
            places = range(max(1, len(ids)))
            for f in range(toxicity.FILTERS):
                pooled.append(max(0.0, max(sum(e[i + j] @ w[j, :, f] for j in range(k)) for i in places) + b[f]))
        z = np.array(pooled) @ net.p["out"] + net.p["bias"][0]
        odds = toxic_model.slope * np.clip(z, np.log(1e-9), -np.log(1e-9)) + toxic_model.offset
        assert got[d.doc_id] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-3)


def test_other_labels_are_refused(spark, tables):
    from pyspark.sql import functions as F
    docs, labels = tables
    other = labels.withColumn("quality", F.lit(2)).withColumn("toxic", F.lit(-1))
    with pytest.raises(ValueError):
        quality.fit(docs, other)
    with pytest.raises(ValueError):
        toxicity.fit(docs, other)


def test_toxicity_learns_from_all_labelled_rows(spark, tables, monkeypatch):
    from churnlens.llm.labelled import labelled
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("en").alias("lang"))
    rows, counts = labelled(docs, docs.select("doc_id", F.lit(0).alias("toxic")), "toxic", 4, 2)
    want = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(9000))
    assert rows.count() == want and counts == {0: want}
    shards, average = [], toxicity.train_shards
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    monkeypatch.setattr(toxicity, "train_shards", lambda d, net, n, *a: shards.append((n, d.count())) or average(d, net, n, *a))
    model = toxicity.fit(*tables)
    n_all = labelled(*tables, "toxic", 4, 2)[0].count()
    assert shards[0][0] == -(-shards[0][1] // 150) > 1 and shards[0][1] > 0.6 * n_all
    rows = toxicity.score(tables[0], model).toPandas().merge(tables[1].toPandas(), on="doc_id")
    rows = rows[rows["held_out"]]
    assert auc(rows["toxic"].to_numpy(), rows["score"].to_numpy()) > 0.8      # two shards with a dozen toxic documents each
