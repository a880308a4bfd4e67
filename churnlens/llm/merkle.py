"""Merkle manifest of a table, with a membership proof for every row.

The rows of a group (a language) are the leaves of a binary tree in id order;
the groups' roots are the leaves of one more tree. Proofs are incremental
witnesses: nodes are appended from left to right, every open subtree keeps the
partial witnesses of its members, and when its right sibling is complete, both
extend the witnesses of their members by each other's root and become one.

The appends are aligned so that they can be shared out: a block holds
``2 ** LEVELS`` consecutive nodes from a multiple of that number on, so its
root is a node of the tree. Blocks are appended in tasks of their own; their
roots are the nodes of the next round, appended in the same way, until each
group has one. On the way back every block extends the witnesses of its
members by its own. Only roots go up and only the roots' witnesses go down: no
witness of a leaf is ever shuffled, and no task holds more than some blocks.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import ready, shuffle_partitions, written

#: A block has 2 ** LEVELS nodes.
LEVELS = 10
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves that are ordered and numbered in one task, about.
ROWS_PER_TASK = 1_000_000


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields one after the other, each as its byte count, a colon and its text; ``-`` where it is null."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


class Appender:
    """Nodes appended one after the other, with a growing witness for each.

    ``open[h]`` is the complete subtree of height h that has no sibling yet:
    its root and its first member. ``sides`` and ``siblings`` are the members'
    witnesses: for each level on which side the sibling stands (``L``, ``R``,
    ``-`` for none) and the sibling ('' for none).
    """

    def __init__(self, witnesses: bool = True):
        self.open: list[tuple[str, int] | None] = []
        self.n, self.witnesses = 0, witnesses
        self.sides: list[list[str]] = []
        self.siblings: list[list[str]] = []

    def _extend(self, first: int, last: int, side: str, sibling: str) -> None:
        if self.witnesses:
            for m in range(first, last):
                self.sides[m].append(side)
                self.siblings[m].append(sibling)

    def _pair(self, left: str, right: str, first: int, mid: int, last: int) -> str:
        self._extend(first, mid, "R", right)
        self._extend(mid, last, "L", left)
        return digest(left, right)

    def append(self, node: str) -> None:
        first, self.n = self.n, self.n + 1
        if self.witnesses:
            self.sides.append([])
            self.siblings.append([])
        h = 0
        while h < len(self.open) and self.open[h] is not None:
            left, start = self.open[h]
            node, first, self.open[h] = self._pair(left, node, start, first, self.n), start, None
            h += 1
        if h == len(self.open):
            self.open.append(None)
        self.open[h] = node, first

    def close(self, height: int) -> str:
        """The root at ``height``: what is still open is paired, or hashed alone where it has no sibling."""
        last: tuple[str, int] | None = None  # the incomplete subtree at the right edge
        for h in range(height):
            here = self.open[h] if h < len(self.open) else None
            if here and last:
                last = self._pair(here[0], last[0], here[1], last[1], self.n), here[1]
            elif here or last:
                node, first = here or last
                self._extend(first, self.n, "-", "")
                last = digest(node), first
        return last[0] if last else self.open[height][0]


def height_of(n: int, levels: int) -> int:
    """Levels that a block of a group of n nodes climbs: all of its own, or as many as leave one node."""
    return levels if n > 1 << levels else max(0, n - 1).bit_length()


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 by ``keys`` within ``g``) and ``n`` (rows of ``g``), written to the shared folder.

    Rows are dealt by ranges of (g, keys) and numbered within their range; a
    range's start follows from the counts of the ranges before it. Equal rows
    are spread over ranges, too.
    """
    spark = rows.sparkSession
    parts = max(shuffle_partitions(spark), -(-rows.count() // ROWS_PER_TASK))
    d = rows.withColumn("spread", F.monotonically_increasing_id())
    d = d.repartitionByRange(parts, "g", *keys, "spread").sortWithinPartitions("g", *keys).drop("spread")

    def number(batches):
        p, last, i = TaskContext.get().partitionId(), None, 0
        for b in batches:
            g = b["g"].to_numpy()
            at = []
            for x in g:
                i = i + 1 if x == last else 0
                last = x
                at.append(i)
            yield b.assign(p=p, i=at)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    numbered = written(d.mapInPandas(number, f"{fields}, p int, i long"), "merkle-numbered")
    per = numbered.groupBy("g", "p").agg((F.max("i") + 1).alias("c"))
    own = Window.partitionBy("g")
    start = per.select("g", "p", (F.sum("c").over(own.orderBy("p")) - F.col("c")).alias("start"), F.sum("c").over(own).alias("n"))
    return written(numbered.join(start, ["g", "p"]).withColumn("pos", F.col("start") + F.col("i")).drop("p", "i", "start"), "merkle-placed")


def _block(levels: int) -> Column:
    return F.shiftright("pos", levels).alias("block")


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """One round up: the roots of all blocks, as nodes (``g``, ``pos``, ``n``, ``node``)."""
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("pos")
        n, a = int(b["n"].iloc[0]), Appender(witnesses=False)
        for x in b["node"]:
            a.append(x)
        return pd.DataFrame({"g": [b["g"].iloc[0]], "pos": [int(b["pos"].iloc[0]) >> levels], "n": [-(-n >> levels)], "node": [a.close(height_of(n, levels))]})

    out = nodes.select("g", "pos", "n", "node", _block(levels)).groupBy("g", "block").applyInPandas(run, "g string, pos long, n long, node string")
    return written(out, "merkle-roots")


def _witnessed(nodes: DataFrame, tops: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with the columns of ``tops``: ``sides`` and ``siblings`` up to the root, and whatever else its rows carry.

    ``tops`` has a row for each block: ``g``, ``block``, and the witness of its root.
    """
    more = [c for c in tops.columns if c not in ("g", "block", "sides", "siblings")]
    names = [*nodes.columns, "sides", "siblings", *more]
    types = {f.name: f.dataType.simpleString() for f in [*nodes.schema.fields, *tops.schema.fields]}

    def run(b: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("pos").reset_index(drop=True)
        a = Appender()
        for x in b["node"]:
            a.append(x)
        a.close(height_of(int(b["n"].iloc[0]), levels))
        top = top.iloc[0]
        up = list(top["siblings"])
        b["sides"] = ["".join(s) + top["sides"] for s in a.sides]
        b["siblings"] = [s + up for s in a.siblings]
        for c in more:
            b[c] = top[c]
        return b[names]

    left = nodes.select("*", _block(levels)).groupBy("g", "block")
    return left.cogroup(tops.groupBy("g", "block")).applyInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in names))


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes``, the roots of their blocks, the roots of these, and so on until every group has one node."""
    out = [nodes.select("g", "pos", "n", "node")]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(_roots(out[-1], levels))
    return out


def _down(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """Witnesses of the nodes of ``rounds[1]``, from those of the groups' roots (``tops``), by block of ``rounds[0]``."""
    for nodes in rounds[-2:0:-1]:
        tops = _witnessed(nodes, tops, levels).drop("n", "node").withColumnRenamed("pos", "block")
    return tops


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None,
             levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``sides``, ``siblings``, and the columns of ``carry``.

    ``leaf`` hashes ``fields``. Within each value of ``group_col`` the leaves
    ascend by id (null first; equal ids by their leaf); while several nodes
    remain, every two neighbours, or the last one alone, become their hash. The
    groups' roots, ordered by the group (null first, then by UTF-8 bytes), give
    ``root`` in the same way. ``siblings`` are the nodes that lead from the leaf
    to the root, one a level, '' where there is none; ``sides`` has a letter for
    each: ``L``, ``R`` or ``-``. Null ids, groups and texts, empty texts and
    repeated rows are leaves like any other. An empty table gives no rows.
    Columns that aren't named are ignored. ``carry`` adds expressions over
    ``docs`` by name.
    """
    ready(docs.sparkSession)
    carry = carry or {}
    group = docs[group_col].cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"), docs[id_col].cast("long").alias("doc_id"),
        leaf_hash([docs[f] for f in fields]).alias("node"), *[e.alias(f"carry_{k}") for k, e in carry.items()])
    leaves = placed(written(leaves, "merkle-leaves"), ["doc_id", "node"])  # texts are read and hashed once
    rounds = _rounds(leaves, levels)
    # the groups' roots are the leaves of one more tree
    groups = placed(rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "node"), ["of"])
    above = _rounds(groups, levels)
    top = above[-1].select("g", F.lit(0).cast("long").alias("block"), F.lit("").alias("sides"), F.array().cast("array<string>").alias("siblings"), F.col("node").alias("root"))
    top = _witnessed(groups, _down(above, top, levels), levels)
    top = top.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("block"), "sides", "siblings", F.col("node").alias("subroot"), "root")
    top = written(_down(rounds, written(top, "merkle-groups"), levels), "merkle-tops")
    out = _witnessed(leaves, top, levels)
    return out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "sides", "siblings", *[F.col(f"carry_{k}").alias(k) for k in carry])


def proof_hash(siblings: Column) -> Column:
    """SHA-256 of all siblings, from the leaf's level to the root's."""
    return F.sha2(F.array_join(siblings, ""), 256)


def folded(leaf: Column, sides: Column, siblings: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    steps = F.transform(siblings, lambda s, i: F.struct(F.substring(sides, i + 1, F.lit(1)).alias("side"), s.alias("s")))
    return F.aggregate(steps, leaf, lambda a, x: F.sha2(F.when(x["side"] == "L", F.concat(x["s"], a)).otherwise(F.concat(a, x["s"])), 256))


def audit(proved: DataFrame, claimed: Column) -> DataFrame:
    """``proved`` (rows of :func:`manifest`) with ``proof_sha256``, ``folded_root`` from the leaf that is ``claimed``, and ``verified``."""
    out = proved.withColumn("proof_sha256", proof_hash(F.col("siblings"))).withColumn("folded_root", folded(claimed, F.col("sides"), F.col("siblings")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_audit(docs: DataFrame, mod: int = 7) -> DataFrame:
    """The manifest of ``documents``, audited against leaves whose ``n_chars`` is one more where ``mod`` divides the id's crc32."""
    changed = F.when((F.crc32(docs["doc_id"].cast("string").cast("binary")) % mod == 0) & docs["n_chars"].isNotNull(),
                     leaf_hash([docs[f] + 1 if f == "n_chars" else docs[f] for f in FIELDS]))
    out = audit(manifest(docs, carry={"changed": changed}), F.coalesce("changed", "leaf"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
