import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from churnlens.llm import langid as L

SF = "/root/testdata/sf0.01"
MASK = (1 << 64) - 1


def plain_subwords(text):
    """Buckets of all runs of 1 to 4 of a word's letters and edges, one after the other."""
    out = Counter()
    word = []
    words = []
    for c in (text or "").lower():
        if unicodedata.category(c)[0] == "L":
            word.append(ord(c))
        elif word:
            words.append(word)
            word = []
    words += [word] if word else []
    for w in words:
        marked = [0, *w, 0]
        for n in L.SIZES:
            for i in range(len(marked) - n + 1):
                run = marked[i:i + n]
                if n == 1 and run[0] == 0:
                    continue
                h = 0
                for k, x in enumerate(run):
                    h = (h + x + k + 1) * 0x9E3779B97F4A7C15 & MASK
                out[h >> (65 - L.BUCKETS.bit_length())] += 1
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs)


@pytest.mark.parametrize("text", ["", "a", "Ab c", "Straße, ÀÉ!! 42 x", "漢字 and 😀 𝔘𝔫𝔦 end", "  \n", "a b c d", "word " * 300])
def test_subwords(text):
    assert {i: int(n) for i, n in enumerate(L.subwords(text)) if n} == dict(plain_subwords(text))


def test_subwords_in_blocks(monkeypatch):
    text = "Der schnelle braune Fuchs springt über den faulen Hund. " * 5
    whole = L.subwords(text)
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(L, "BLOCK", block)
        assert (L.subwords(text) == whole).all()


def test_scores_against_plain_forward(docs, model):
    rows = {r.doc_id: r for r in L.predict(docs, model).collect()}
    for d in docs.limit(20).collect():
        c = plain_subwords(d.text)
        mean = sum(n * model.embeddings[i].astype(np.float64) for i, n in c.items()) / sum(c.values())
        z = (mean @ model.layer + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert rows[d.doc_id].lang_pred == model.languages[p.argmax()]
        assert rows[d.doc_id].score == pytest.approx(p.max(), abs=1e-3)


def test_held_out_accuracy_and_rejection(docs, model):
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.predict(docs, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(lang))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    taken = [r for r in held if r.accepted]
    assert len(taken) > 0.8 * len(held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in taken]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, docs, model):
    from pyspark.sql import functions as F
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    assert (L.fit(other).embeddings == model.embeddings).all()


def test_calibration():
    m = L.LanguageModel(["a", "b"], np.zeros((2, 2)), np.eye(2), np.zeros(2))
    m.embeddings = np.array([[3.0, 0], [0, 3.0]])
    counts = np.array([[9, 1]] * 40 + [[6, 4]] * 10 + [[1, 9]] * 30, dtype=np.float32)
    y = np.array([0] * 40 + [0, 1] * 5 + [1] * 30)
    L.calibrate(m, counts, y, precision=0.95)
    p = m.scores(counts)
    assert p[45].max() < m.accept[0] <= p[0].max()  # half of the close ones are wrong: rejected
    assert m.accept[1] <= p[60].max()
    L.calibrate(m, counts[:0], y[:0])
    assert m.accept.tolist() == [0, 0]


def test_gradient_descent_learns_and_one_language(docs):
    counts = np.zeros((40, L.BUCKETS), dtype=np.float32)
    counts[:20, 3] = 5
    counts[20:, 4] = 5
    y = np.array([0] * 20 + [1] * 20)
    m = L.train(counts, y, ["a", "b"], epochs=20)
    assert (m.scores(counts).argmax(axis=1) == y).all()
    one = L.train(counts, y * 0, ["a"], epochs=1)
    assert one.scores(counts).tolist() == [[1.0]] * 40


def test_sample_bounds(spark, docs):
    """At most so many of each language, whatever the copies of one row; too many languages are an error."""
    copies = docs.unionByName(docs.where("doc_id = 5").crossJoin(spark.range(300)).drop("id"))
    assert L.fit(copies, per_language=20).languages == ["de", "en", "es", "fr"]
    with pytest.raises(ValueError):
        L.fit(docs, size=3)


def test_edges(edge_docs, empty_docs, model):
    rows = L.predict(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    und = [r for r in rows if r.lang_pred == "und"]
    assert Counter(r.doc_id for r in und) == Counter([3, 4, 5, None])
    assert all(r.score == 0 and not r.accepted for r in und)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    fitted = L.fit(edge_docs)
    assert set(fitted.languages) <= {"en", "de", "fr"}
    assert L.predict(empty_docs, model).collect() == []
    nothing = L.fit(empty_docs)
    assert {r.lang_pred for r in L.predict(edge_docs, nothing).collect()} == {"und"}
