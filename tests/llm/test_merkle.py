import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from churnlens.llm import merkle as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """All levels, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha(*x[i:i + 2]) for i in range(0, len(x), 2)])
    return levels


def way(levels, i):
    """(side, sibling) from leaf i to the root."""
    out = []
    for x in levels[:-1]:
        j = i ^ 1
        out.append(("-", "") if j >= len(x) else ("L" if j < i else "R", x[j]))
        i //= 2
    return out


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to Counter of result rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for rs in groups.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = Counter()
    for at, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = way(trees[g], i) + way(top, at)
            change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            x = leaf((*r[:3], r[3] + 1, r[4]) if change else r)
            for side, s in path:
                x = sha(s, x) if side == "L" else sha(x, s)
            root = top[-1][0]
            out[r[0], leaf(r), trees[g][-1][0], root, sha(*[s for _, s in path]), x, x == root] += 1
    return out


def result(docs):
    return Counter(tuple(r) for r in M.tampered_audit(docs).collect())


def rows_of(docs):
    return [tuple(r) for r in docs.select(*M.FIELDS).collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 13, 16, 31, 33])
def test_appender_against_whole_levels(n):
    nodes = [sha(str(i)) for i in range(n)]
    a, levels = M.Appender(), tree(nodes)
    for x in nodes:
        a.append(x)
    assert a.close(M.height_of(n, 10)) == levels[-1][0]
    for i in range(n):
        assert list(zip(a.sides[i], a.siblings[i])) == way(levels, i)


def test_open_subtrees_while_appending():
    """After 6 of 8 appends, members of the open subtrees have the siblings inside them; the last two add one level to all."""
    nodes = [sha(str(i)) for i in range(8)]
    a = M.Appender()
    for x in nodes[:6]:
        a.append(x)
    assert [h for h, x in enumerate(a.open) if x] == [1, 2]
    assert [len(s) for s in a.siblings] == [2, 2, 2, 2, 1, 1]
    for x in nodes[6:]:
        a.append(x)
    assert [len(s) for s in a.siblings] == [3] * 8


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = result(docs)
    assert got == brute(rows_of(docs))
    tampered = sum(n for r, n in got.items() if not r[-1])
    assert 0 < tampered < docs.count() / 3


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_small_blocks_give_the_same_tree(spark, levels):
    """Several rounds of block roots, also over many groups."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("l"), F.col("id") % 17)).alias("lang"),
                                   F.col("id").alias("n_chars"), F.concat(F.lit("é"), F.col("id")).alias("text"))
    want = {(r[0], r[1], r[2], r[3], r[4]) for r in brute(rows_of(docs))}
    proved = M.audit(M.manifest(docs, levels=levels), F.col("leaf"))
    assert {(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in proved.collect()} == want
    assert proved.where("not verified").count() == 0


def test_partition_count_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {tuple(r) for r in M.tampered_audit(docs.repartition(1)).collect()}
    assert one == {tuple(r) for r in M.tampered_audit(docs.repartition(13)).collect()}


def test_edges(spark, edge_docs, empty_docs):
    docs = edge_docs.withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.length("text"))).withColumn("n", F.lit(1)).withColumn("g", F.lit("x")).withColumn("node", F.lit(2)).withColumn("pos", F.lit(3))
    assert result(docs) == brute(rows_of(docs))
    assert result(docs.limit(1)) == brute(rows_of(docs.limit(1)))
    assert M.tampered_audit(docs.where("false")).collect() == []


def test_equal_rows_and_groups(spark):
    """Hundreds of copies of one row, and a row without an id, all in the group without a language."""
    docs = spark.createDataFrame([(7, "s", None, 3, "same")] * 500 + [(None, None, None, None, None), (8, "s", "", 0, "")], "doc_id long, source string, lang string, n_chars long, text string")
    assert result(docs) == brute(rows_of(docs))
