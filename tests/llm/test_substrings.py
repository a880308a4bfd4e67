import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from churnlens.llm import substrings as S

SF = "/root/testdata/sf0.001"


def slow(rows, k=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - k + 1):
                w = b[i:i + k]
                first[w] = min(first.get(w, d), d)
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        off = [False] * len(b)
        if d is not None:
            for i in range(len(b) - k + 1):
                if first[b[i:i + k]] < d:
                    off[i:i + k] = [True] * k
        spans = sum(o and (i == 0 or not off[i - 1]) for i, o in enumerate(off))
        kept = bytes(c for c, o in zip(b, off) if not o)
        out[d, len(b), sum(off), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow(rows_of(docs))
    assert sum(k[2] * n for k, n in want.items()) > 1000
    assert got(S.remove_repeats(docs)) == want


def test_edges(edge_docs, empty_docs):
    assert got(S.remove_repeats(edge_docs)) == slow(rows_of(edge_docs))
    assert S.remove_repeats(empty_docs).count() == 0


def planted(seed):
    """Shared pieces of 45 to 300 bytes at odd places, periodic texts, copies, ids in any order, several rows of an id."""
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abé ") for _ in range(g.randrange(1, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    shared = [text(g.randrange(10, 60)) for _ in range(8)] + ["a" * 120, "abc" * 60, "0123456789abcdefXYZ#" * 12]
    rows = []
    for i in range(60):
        t = "".join(x for _ in range(g.randrange(1, 5)) for x in (text(g.randrange(0, 30)), g.choice(shared)[g.randrange(0, 20):]))
        rows.append((g.randrange(0, 50), t))
    rows += rows[:5] + [(g.randrange(0, 50), rows[7][1]), (None, rows[7][1]), (3, "a" * 49), (4, "b" * 50), (5, "b" * 50), (-9, "b" * 51)]
    return rows


@pytest.mark.parametrize("hot", [None, 8])
def test_planted(spark, monkeypatch, hot):
    rows = planted(1)
    if hot:  # buckets of common strings are filed by single windows
        buckets = Counter(int(h) for _, t in rows for h in set(S.runs((t or "").encode(), 50, np.zeros(0, np.uint64))[0].tolist()))
        common = np.array([h for h, n in buckets.items() if n >= hot], dtype=np.uint64)
        assert len(common) > 3
        monkeypatch.setattr(S, "_hot_buckets", lambda *a: common)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(S.remove_repeats(df)) == slow(rows)


def test_hot_buckets_are_found(spark, monkeypatch):
    line = "This very common line stands in every one of these documents, as it is."
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest() + line + str(i)) for i in range(200)]
    monkeypatch.setattr(S, "HOT_ENTRIES", 100)
    monkeypatch.setattr(S, "SAMPLE_DOCS", 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(S._hot_buckets(df, 200, 50)) >= 1
    assert got(S.remove_repeats(df)) == slow(rows)


def test_blocks_do_not_matter(spark, monkeypatch):
    """Long texts are looked at in blocks; runs cut by a block's end still meet the same windows."""
    monkeypatch.setattr(S, "BLOCK", 64)
    monkeypatch.setattr(S, "FLUSH", 50)
    rows = planted(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    a, b = S._file_runs(50, 4, 3, np.zeros(0, np.uint64)), df.toPandas()
    kinds = Counter(int(k) for f in a([b[b["doc_id"].notna()].astype({"doc_id": "int64"})]) for k in f["kind"])
    assert kinds[0] and kinds[1]
    # in this process only: the executors' module has its own block size, so runs are compared here
    whole = {}
    for block in (64, 1 << 18):
        monkeypatch.setattr(S, "BLOCK", block)
        h, _, lo, n = S.runs(rows[0][1].encode(), 50, np.zeros(0, np.uint64))
        whole[block] = [x for s, c, k in zip(lo, n, h) for x in [(int(w), int(k)) for w in range(s, s + c)]]
    assert whole[64] == whole[1 << 18]


def test_texts_that_are_left(spark):
    rows = [(1, "é" * 30 + "x"), (2, "start " + "é" * 30 + " end"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in S.remove_repeats(df, texts=True).collect()}
    assert left == {1: rows[0][1], 2: "start  end", 3: None}


def test_pack_round_trip():
    g = np.random.default_rng(0)
    rows = {f: g.integers(0, 2 ** min(63, 8 * w), 50).astype(np.uint64) for f, w in S._FILED}
    rows["doc"] = g.integers(-5, 5, 50).view(np.uint64)
    back = S._unpack(S._FILED, [S._pack(S._FILED, rows, slice(0, 20)), S._pack(S._FILED, rows, slice(20, 50))])
    assert all((back[f] == rows[f]).all() for f in rows)


@pytest.mark.parametrize("length", [24, 37, 50])
def test_bucket_pointers_are_exact(length):
    """Windows get the same identifier if and only if their bytes are equal; windows of one document alone are left out."""
    g = np.random.default_rng(length)
    pool = g.integers(0, 2, (6, 84)).astype(np.uint8)
    b = pool[g.integers(0, 6, 300)].copy()
    flip = g.random(300) < 0.5
    b[flip, g.integers(0, 84, 300)[flip]] ^= 1
    doc = g.integers(0, 40, 300).astype(np.int64)
    windows = np.arange(35) < g.integers(1, 36, 300)[:, None]
    row, t, ident = S.bucket_pointers(b, windows, doc, length)
    by_bytes = {}
    for r, o in zip(*np.nonzero(windows)):
        by_bytes.setdefault(b[r, o:o + length].tobytes(), []).append((r, o))
    shared = {w: x for w, x in by_bytes.items() if len({doc[r] for r, _ in x}) > 1}
    assert sorted(zip(row.tolist(), t.tolist())) == sorted((int(r), int(o)) for x in shared.values() for r, o in x)
    found = {}
    for r, o, i in zip(row, t, ident):
        found.setdefault(i, set()).add(b[r, o:o + length].tobytes())
    assert len(found) == len(shared) and all(len(x) == 1 for x in found.values())
