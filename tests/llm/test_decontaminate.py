import hashlib
import random
import re
from collections import Counter

import pytest

from churnlens.llm import decontaminate as D


def slow_words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(docs, items):
    wins = set()
    for i, t in items:
        w = slow_words(t)
        if w:
            wins |= {(i, tuple(w[a:a + 10])) for a in range(max(1, len(w) - 9))}
    out = Counter()
    for d, t in docs:
        w, hit, names = slow_words(t), set(), set()
        for i, x in wins:
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a:a + len(x)]) == x:
                    hit |= set(range(a, a + len(x)))
                    names |= {str(i)} if i is not None else set()
        out[d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the river bank today"), (10, "the LAZY dog"), (2, "one"), (3, None), (4, ""),
         (5, "... !!"), (None, "wörd ÀÉ 漢字 和"), (7, "a b a b a b a b a b a b a b a b"), (7, "quick brown fox jumps over the lazy dog near the river bank"),
         (8, "the quick brown fox jumps over the lazy dog near the river bank today")]


@pytest.mark.parametrize("limit", [None, 0])
def test_edges_match_brute_force(spark, edge_docs, monkeypatch, limit):
    """Short, null, empty, repeated and null-id items; also with the shuffled join."""
    if limit is not None:
        monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
    items = spark.createDataFrame([(*x, 1, "w") for x in ITEMS], "item_id long, text string, h long, words string")
    more = spark.createDataFrame([(50, "a b " * 30), (51, "x QUICK brown-fox jumps, over the lazy dog. Near the river bank"), (52, "wörd àé 漢字 和"), (53, "wörd ÀÉ 漢字 和")], "doc_id long, text string")
    docs = edge_docs.where("doc_id is null or doc_id not in (7, 8)").unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(D.decontaminate(docs, items)) == slow(rows, ITEMS)


def test_random_texts_of_few_words(spark):
    """Few distinct words: ties between hashes, overlapping and repeated windows."""
    g = random.Random(4)
    text = lambda n: " ".join(g.choice("abc") for _ in range(n))
    items = [(i, text(g.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)]
    docs = [(i, text(g.randrange(0, 200))) for i in range(40)]
    a = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(a) == slow(docs, items)


def test_empty_tables(spark, edge_docs, empty_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.decontaminate(empty_docs, items).count() == 0
    out = D.decontaminate(edge_docs, items.where("false")).collect()
    assert len(out) == edge_docs.count() and not any(r.n_hit or r.contaminated for r in out)
    kept = D.drop_contaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {None, 3, 4, 5, 7, 8, 9, 10, 11}


def test_no_python_in_the_plan(spark, edge_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = D.decontaminate(edge_docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", ""))


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("window, gram", [(6, 3), (4, 4), (3, 5), (1, 1)])
def test_other_windows_and_grams(spark, monkeypatch, window, gram, limit):
    """Windows of other lengths than the registered one, down to those of a single k-gram; also with the shuffled join."""
    if limit is not None:
        monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
    g = random.Random(window)
    text = lambda n: " ".join(g.choice("abcd") for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, window, window + 1, 9])]
    docs = [(i, text(g.randrange(0, 60))) for i in range(20)] + [(90, None), (91, "- a"), (92, items[3][1]), (93, items[5][1] + ".")]
    h = D.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window, gram).collect()
    expected = set()
    for _, t in items:
        w = slow_words(t)
        spans = {tuple(w[a:a + window]) for a in range(max(1, len(w) - window + 1))}
        for d, u in docs:
            v = slow_words(u)
            expected |= {(d, a + 1, len(x)) for x in spans for a in range(len(v) - len(x) + 1) if tuple(v[a:a + len(x)]) == x}
    found = [(r.doc_id, r.s, r.m) for r in h if r.m]
    assert set(found) == expected and len(found) == len(expected)
    assert {r.doc_id: r.s for r in h if not r.m} == {d: len(slow_words(t)) for d, t in docs}


@pytest.mark.parametrize("text", [None, "", " ", "a", "  Ab,cD ", "\n\tx-Y\x7f\x00z\n", "ÀÉ Z[é]漢字 和😀 1a", "a.", ".a", "é B c"])
def test_words_are_the_matches_of_the_pattern(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(D.words_of(D.F.col("t"))).first()[0] == slow_words(text)


def test_no_slice_for_each_place(spark, edge_docs):
    """The cost of a document's word: no match objects, and the one slice is of the words around a kept k-gram."""
    items = spark.createDataFrame([ITEMS[0]], "item_id long, text string")
    plan = D.hits(edge_docs, items)._jdf.queryExecution().optimizedPlan().toString()
    side = next(x for x in plan.splitlines() if "Generate explode" in x or "Project" in x and "array_distinct(" in x)
    assert "split(" in plan and "regexp_extract_all" not in plan
    assert "array_distinct(" in side and side.count("slice(") == 1
