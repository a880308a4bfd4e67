import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from churnlens.llm import simhash
from churnlens.llm.components import components

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(rows, bits=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    a = np.array(fps, dtype=np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits):
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = [find(i) for i in range(len(rows))]
    least = {}
    for g, (d, _) in zip(groups, rows):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return Counter((d, f"{f:016x}", least.get(g)) for (d, _), f, g in zip(rows, fps, groups))


def got(df):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(simhash.simhash_groups(docs)) == slow_groups(rows)


def test_edges(edge_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert got(simhash.simhash_groups(edge_docs)) == slow_groups(rows)
    assert simhash.simhash_groups(empty_docs).count() == 0


def edges_of(spark, fps, max_bits=4):
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    return simhash.links(df, len(fps), max_bits)


@pytest.mark.parametrize("blocks", [None, 6, 7, 8])
def test_links_join_what_all_pairs_join(spark, monkeypatch, blocks):
    """Planted neighbours at 1 to 5 bits, for every number of blocks."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for b in base[:100] for k in (1, 3, 4, 5)]
    fps = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64)]))
    if blocks:
        monkeypatch.setattr(simhash, "_plan", lambda n, bits: blocks)
    e = edges_of(spark, fps)
    pairs = e.toPandas().to_numpy().view(np.uint64)
    assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 4).all()
    root = {r.node: r.root for r in components(e).collect()}
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    signed = fps.view(np.int64)
    want = simple_components(signed, d <= 4)
    assert {int(x): root.get(int(x), int(x)) for x in signed} == want


def simple_components(names, linked):
    out, seen = {}, set()
    for s in range(len(names)):
        if s in seen:
            continue
        todo, comp = [s], {s}
        while todo:
            for j in np.flatnonzero(linked[todo.pop()]):
                if j not in comp:
                    comp.add(int(j))
                    todo.append(int(j))
        seen |= comp
        least = min(int(names[c]) for c in comp)
        out |= {int(names[c]): least for c in comp}
    return out


def test_dense_cluster_gives_a_forest(spark, monkeypatch):
    """Thousands of fingerprints within a few bits of one: tiles are split, edges stay linear."""
    monkeypatch.setattr(simhash, "TILE", 256)
    center = np.uint64(0x123456789ABCDEF0)
    fps = np.unique(np.array([center ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(40) for j in range(i)] + [center], dtype=np.uint64))
    e = edges_of(spark, fps)
    assert e.count() < 40 * len(fps)
    roots = {r.root for r in components(e).collect()}
    assert roots == {int(fps.view(np.int64).min())}


def test_components_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    root = {r.node: r.root for r in components(e).collect()}
    assert {root[i] for i in range(1, 61)} == {1} and root[101] == 100
    assert components(e.where("false")).count() == 0
