import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from churnlens.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[c][h:]
    return out


def brute(convs):
    """Rows of the trie of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = own + sum(saved[x] for x in children[k])
    out = Counter()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(k)))
        out[min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def result(df):
    return Counter(tuple(r) for r in df.collect())


def conversations(seed, n, depth=5, alphabet=3):
    g = random.Random(seed)
    rows = []
    for c in range(n):
        same = g.random()
        turns = ["hot"] * 3 if same < 0.4 else ["hot", "open", *(g.choice("abc") for _ in range(g.randrange(depth)))] if same < 0.6 else [str(g.randrange(alphabet)) for _ in range(g.randrange(1, depth + 2))]
        rows += [(c, t, g.choice(["user", "user", "assistant"]) if same >= 0.4 else "user", x * g.choice([1, 1, 2])) for t, x in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed, n", [(1, 60), (2, 400), (3, 7)])
def test_random_conversations(spark, seed, n):
    rows = conversations(seed, n)
    assert result(P.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuild(rows))


@pytest.mark.parametrize("shards", ["1", "3", "40"])
def test_any_number_of_shards(spark, shards):
    """More shards than groups of copies: shards end between copies, and skeleton nodes are met in many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        rows = conversations(5, 300)
        assert result(P.rebuilt_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rebuild(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_skeleton_and_chunks(spark, monkeypatch):
    """Long keys leave room for few shards; ids of copies travel in many rows."""
    monkeypatch.setattr(P, "SKELETON_BYTES", 400)
    monkeypatch.setattr(P, "CHUNK", 16)
    rows = conversations(6, 300, depth=9)
    assert result(P.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuild(rows))


def test_conversations_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert result(P.rebuilt_trie(df)) == brute(rebuild([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


def test_skeleton_numbers():
    turn = lambda s: b"".join(c.encode() * P.WIDTH for c in s)
    s = P.Skeleton.of([turn(x) for x in ("", "a", "abc", "abd", "abd", "b")])
    assert [s.along(j) for j in range(6)] == [[0], [0, 1], [0, 1, 2, 3], [0, 1, 2, 4], [0, 1, 2, 4], [0, 5]]
    n = s.nodes()
    assert n["parent"].tolist() == [-1, 0, 1, 2, 2, 0]
    assert n["last"].tolist() == [5, 4, 4, 3, 4, 5]
    assert n["inner"].tolist() == [2, 1, 2, 0, 0, 0]
    assert n["depth"].tolist() == [0, 1, 2, 3, 3, 1]


def test_edges(spark):
    long = "wörd " * 50_000
    rows = [(0, None, None, None), (0, 1, "user", ""), (1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "", "x"), (2, None, "", "first"), (-7, 0, "user", "minus"),
            (None, 0, "user", "no id"), (9, 0, None, "x"), (11, 0, "a", "bc"), (12, 0, "ab", "c"), (12, 2, "user", "gap")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("shard", F.lit("s")).withColumn("turns", F.lit(2)).withColumn("node", F.lit(0))
    assert result(P.rebuilt_trie(df)) == brute(rebuild(rows))
    assert P.rebuilt_trie(df.where("false")).collect() == []


def test_equal_turns_and_repeated_rows(spark):
    """Repeated rows are turns like any other; the order of equal turns follows their digest, so it is always the same."""
    rows = [(1, 0, "user", "a")] * 3 + [(2, 0, "user", "a"), (2, 0, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = result(P.trie(P.turns(df)))
    assert {(r[0], r[1]) for r in got} >= {(1, 0), (1, 3)}
    assert got == result(P.trie(P.turns(df.orderBy(F.desc("text")).repartition(3))))


def test_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (0, 5, 10) for t in range(400)] + [(5, 400, "user", "more")]
    assert result(P.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuild(rows))
