"""Prefix trie of conversations, built in sorted shards around a skeleton of splitters.

Every conversation becomes a key: the digests of its turns, one after the
other. The keys are dealt by ranges into sorted shards. The first keys of the
shards are the splitters, and the trie of their paths is the skeleton; it is
broadcast. A node that has members in two shards is a prefix of the splitter
between them, so it is in the skeleton: all other nodes are finished by one
pass over one sorted shard, which holds the open nodes of one path at a time.
For a node of the skeleton each shard gives a partial aggregate; these are
reduced by node, and the sums over subtrees are differences of running sums in
preorder. Copies of a conversation are ordered by id, so that a shard can end
between them and no group of copies is too large for one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import ready, shuffle_partitions, written
from churnlens.operators.rank import global_cumsum

#: Bytes of a turn's digest.
WIDTH = 16
#: Bytes of keys a shard should have about.
SHARD_BYTES = 64 << 20
#: All splitters together have no more bytes: there are fewer shards where keys are very long.
SKELETON_BYTES = 32 << 20
#: Characters of joined ids that travel in one row.
CHUNK = 1 << 16
_NODE = "kind int, node long, conv_id long, depth long, parent long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_bytes long, shard int, seq long, ends string"
_LOCAL, _PARTIAL, _ENDS = 0, 1, 2


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id`` and ``turns``, an array of (turn, digest, n_bytes) in order.

    Texts become digests before anything is shuffled. Null turns come first,
    equal turns are ordered by their digest; null roles and texts are empty.
    Rows without a conversation id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    both = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    d = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(
        F.col(turn_col).cast("long").alias("turn"), F.substring(both, 1, 2 * WIDTH).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).alias("t"))
    return d.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, span: int = 5, heads: int = 9, **cols: str) -> DataFrame:
    """``turns``, with the first h turns of each conversation c taken from conversation c - c % ``span``; h is crc32(c) % ``heads``.

    Where that conversation has fewer turns all are taken, where it is absent none.
    """
    own = written(turns(conversations, **cols), "trie-turns")
    base = own.select(F.col("conv_id").alias("base"), F.col("turns").alias("first"))
    d = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % span).join(base, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.coalesce(F.slice("first", F.lit(1), h), F.slice("turns", 1, 0))
    return d.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def keyed(conversations: DataFrame) -> DataFrame:
    """``key`` (the turns' digests one after the other), ``n_bytes`` (of each turn's text) and ``conv_id``."""
    return conversations.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.n_bytes").alias("n_bytes"))


def _common(a: bytes, b: bytes) -> int:
    """Whole turns that two keys have in common."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    lo = 0
    while a[lo * WIDTH:(lo + 1) * WIDTH] == b[lo * WIDTH:(lo + 1) * WIDTH]:
        lo += 1
    return lo


@dataclass
class Skeleton:
    """The trie of the splitters' paths. Nodes are numbered in preorder, the root is 0.

    ``paths`` are the sorted splitters; ``common`` has the depth to which each
    follows the one before it, and ``start`` the number of its first node below.
    """

    paths: list[bytes]
    common: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, paths: list[bytes]) -> Skeleton:
        common = np.array([_common(a, b) for a, b in zip([b"", *paths], paths)], dtype=np.int64)
        new = np.array([len(p) // WIDTH for p in paths], dtype=np.int64) - common
        return cls(paths, common, 1 + np.concatenate([[0], np.cumsum(new)]).astype(np.int64))

    def along(self, j: int) -> list[int]:
        """Numbers of the nodes on path j, the root first."""
        depth = len(self.paths[j]) // WIDTH
        out = [0] * (depth + 1)
        while depth > 0:
            for d in range(int(self.common[j]) + 1, depth + 1):
                out[d] = int(self.start[j]) + d - int(self.common[j]) - 1
            depth, j = min(depth, int(self.common[j])), j - 1
        return out

    def nodes(self) -> pd.DataFrame:
        """Every node with its parent, its depth, its number of children and the last node of its subtree."""
        n = int(self.start[-1])
        parent, depth, last = np.full(n, -1), np.zeros(n, np.int64), np.arange(n)
        open_: list[int] = [0]
        for j, path in enumerate(self.paths):
            at = int(self.common[j])
            for x in open_[at + 1:]:
                last[x] = self.start[j] - 1
            del open_[at + 1:]
            for d in range(at + 1, len(path) // WIDTH + 1):
                x = int(self.start[j]) + d - at - 1
                parent[x], depth[x] = open_[-1], d
                open_.append(x)
        last[open_] = n - 1
        children = np.bincount(parent[1:], minlength=n)
        return pd.DataFrame({"node": np.arange(n), "parent": parent, "depth": depth, "last": last, "inner": children})


class _Open:
    """A node whose members are being read. ``number`` is its number in the skeleton, -1 outside."""

    __slots__ = ("conv", "convs", "children", "leaves", "saved", "n_bytes", "number", "side", "rows", "hash", "held", "chars", "first", "seq")

    def __init__(self, n_bytes: int, number: int, side: int):
        self.conv, self.convs, self.children, self.leaves, self.saved, self.n_bytes = None, 0, 0, 0, 0, n_bytes
        self.number, self.side = number, side
        self.rows: list[tuple] = []  # finished children that wait for this node's smallest member
        self.hash, self.held, self.chars, self.first, self.seq = None, [], 0, True, 0


class ShardTrie:
    """The nodes of one sorted shard, from its rows one after the other; ``out`` has the finished ones."""

    def __init__(self, skeleton: Skeleton, shard: int, at: int):
        self.shard, self.key, self.out = shard, b"", []
        # all splitters that this shard's keys can follow: its own first key (path ``at``), and the next shard's
        near = [j for j in (at, at + 1) if j < len(skeleton.paths)]
        self.paths = [(skeleton.paths[j], skeleton.along(j)) for j in near]
        self.open = [_Open(0, 0, (1 << len(near)) - 1)]

    def add(self, key: bytes, n_bytes, conv: int) -> None:
        same = _common(self.key, key)
        while len(self.open) > same + 1:
            self._close()
        for d in range(same, len(key) // WIDTH):
            up, part = self.open[-1], key[d * WIDTH:(d + 1) * WIDTH]
            side, number = 0, -1
            for k, (path, numbers) in enumerate(self.paths):
                if up.side >> k & 1 and path[d * WIDTH:(d + 1) * WIDTH] == part:
                    side, number = side | 1 << k, numbers[d + 1]
            self.open.append(_Open(int(n_bytes[d]), number, side))
        self.key = key
        self._end(self.open[-1], conv)

    def _end(self, x: _Open, conv: int) -> None:
        """A member that ends at x: ids of equal keys ascend."""
        x.convs += 1
        x.conv = conv if x.conv is None else min(x.conv, conv)
        text = str(conv) if x.first else f",{conv}"
        x.first = False
        x.held.append(text)
        x.chars += len(text)
        if x.chars >= CHUNK:
            self._flush(x)

    def _flush(self, x: _Open) -> None:
        text = "".join(x.held)
        x.held, x.chars = [], 0
        if x.number < 0:
            x.hash = x.hash or hashlib.sha256()
            x.hash.update(text.encode())
        elif text:
            self.out.append((_ENDS, x.number, 0, 0, 0, None, 0, 0, 0, 0, 0, self.shard, x.seq, text.removeprefix(",")))
            x.seq += 1

    def _close(self) -> None:
        x, depth = self.open.pop(), len(self.open)
        self._flush(x)
        up = self.open[-1] if self.open else None
        if up is not None:
            up.convs += x.convs
            up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
        if x.number >= 0:  # its subtrees in the skeleton are added up later
            self.out.append((_PARTIAL, x.number, x.conv, depth, 0, None, x.convs, x.children, x.leaves, x.saved, x.n_bytes, self.shard, 0, None))
            return
        x.leaves += x.children == 0
        x.saved += (x.convs - 1) * x.n_bytes
        up.children += 1
        up.leaves += x.leaves
        up.saved += x.saved
        self.out += [(*r[:5], x.conv, *r[6:]) for r in x.rows]
        row = (_LOCAL, -1, x.conv, depth, up.number, None, x.convs, x.children, x.leaves, x.saved, x.n_bytes, self.shard, 0, x.hash.hexdigest())
        (up.rows if up.number < 0 else self.out).append(row)

    def finish(self) -> None:
        while self.open:
            self._close()


def _shards(keys: DataFrame) -> tuple[DataFrame, dict[int, bytes]]:
    """``keys`` with the number of their shard, and the smallest key of each shard that has any, in order."""
    size = keys.agg(F.sum(F.octet_length("key") + 8).alias("all"), F.max(F.octet_length("key")).alias("longest")).first()
    wanted = max(shuffle_partitions(keys.sparkSession), -(-(size["all"] or 0) // SHARD_BYTES))
    n = max(1, min(wanted, SKELETON_BYTES // max(1, size["longest"] or 0)))
    d = written(keys.repartitionByRange(n, "key", "conv_id").withColumn("shard", F.spark_partition_id()), "trie-keys")
    firsts = d.groupBy("shard").agg(F.min("key").alias("key")).collect()  # n keys, SKELETON_BYTES at most
    return d, {r["shard"]: bytes(r["key"]) for r in sorted(firsts)}


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conversations`` (``conv_id`` and ``turns``, as from :func:`turns` or :func:`rebuilt`).

    Every distinct sequence of first d turns is a node of depth d, from the
    root on (d = 0); conversations that start with it are its members. Per
    node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null
    for the root), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes in its subtree, itself included), ``saved_tokens`` (over
    its subtree: members but one, times the bytes of the last text) and
    ``ends_sha256`` (of the ids of members without further turns, ascending and
    comma-joined). Conversations without turns end at the root. Equal ids of
    several rows count as often. No conversations give no rows.
    """
    spark = conversations.sparkSession
    ready(spark)
    rows, firsts = _shards(keyed(conversations))
    if not firsts:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    skeleton = Skeleton.of(list(firsts.values()))
    shared = spark.sparkContext.broadcast((skeleton, {shard: i for i, shard in enumerate(firsts)}))

    def run(batches):
        skeleton, at = shared.value
        t, out = None, []
        for b in batches:
            for shard, key, n_bytes, conv in zip(b["shard"], b["key"], b["n_bytes"], b["conv_id"]):
                if t is None or t.shard != shard:
                    if t is not None:
                        t.finish()
                        out += t.out
                    t = ShardTrie(skeleton, shard, at[shard])
                t.add(key, n_bytes, conv)
            if t is not None:
                yield _frame(out + t.out)
                out, t.out = [], []
        if t is not None:
            t.finish()
            yield _frame(t.out)

    dealt = rows.repartitionById(max(firsts) + 1, "shard").sortWithinPartitions("key", "conv_id")
    parts = written(dealt.mapInPandas(run, _NODE), "trie-parts")

    # the skeleton: partial aggregates by node, then sums over subtrees as differences of running sums in preorder
    frame = spark.createDataFrame(pa.Table.from_pandas(skeleton.nodes(), preserve_index=False))
    agg = parts.where(F.col("kind") == _PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("n_bytes").alias("n_bytes"))
    s = frame.join(agg, "node").withColumn("n_children", F.col("n_children") + F.col("inner"))
    s = s.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
    s = written(s.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes")), "trie-skeleton")
    sums = written(global_cumsum(s, ["node"], ["n_leaves", "saved_tokens"]), "trie-sums")
    upto = sums.select(F.col("node").alias("last"), F.col("cum_n_leaves").alias("l"), F.col("cum_saved_tokens").alias("t"))
    s = sums.join(upto, "last").withColumn("n_leaves", F.col("l") - F.col("cum_n_leaves") + F.col("n_leaves"))
    s = s.withColumn("saved_tokens", F.col("t") - F.col("cum_saved_tokens") + F.col("saved_tokens"))

    def hashed(batches):
        node, h = None, None
        for b in batches:
            for x, text in zip(b["node"], b["ends"]):
                if x != node:
                    if node is not None:
                        yield pd.DataFrame({"node": [node], "ends": [h.hexdigest()]})
                    node, h = x, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
        if node is not None:
            yield pd.DataFrame({"node": [node], "ends": [h.hexdigest()]})

    # ids of copies in the order of the shards: a stream, not a group, however many there are
    chunks = parts.where(F.col("kind") == _ENDS).select("node", "shard", "seq", "ends")
    ends = chunks.repartition("node").sortWithinPartitions("node", "shard", "seq").mapInPandas(hashed, "node long, ends string")
    none = hashlib.sha256().hexdigest()
    s = s.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(none)))
    # one id a skeleton node, of which there are SKELETON_BYTES / WIDTH at most
    ids = F.broadcast(sums.select(F.col("node").alias("parent"), F.col("conv_id").alias("up")))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = s.join(ids, "parent", "left").withColumn("parent_conv_id", F.col("up")).select(names)
    local = parts.where(F.col("kind") == _LOCAL).withColumn("ends_sha256", F.col("ends")).join(ids, "parent", "left")
    return local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).select(names).unionByName(inner)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in _NODE.split(", ")])
    out["parent_conv_id"] = out["parent_conv_id"].astype("Int64")
    return out


def rebuilt_trie(conversations: DataFrame, span: int = 5, heads: int = 9, **cols: str) -> DataFrame:
    """The trie of the rebuilt conversations."""
    ready(conversations.sparkSession)
    return trie(rebuilt(conversations, span, heads, **cols))
