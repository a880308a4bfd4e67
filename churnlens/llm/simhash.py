"""SimHash near-duplicates: fingerprints linked by Hamming distance, found with pivot distance tables.

Fingerprints are cut into blocks of bits. Two fingerprints that differ in at
most ``max_bits`` bits agree in at least ``blocks - max_bits`` blocks, so
every link shows up among the rows that agree in some choice of that many
blocks (one join key per choice). The number of blocks follows the number of
distinct fingerprints: keys have about as many bits as are needed to keep the
rows of a key few; the links found are the same for any choice.

The distances of every fingerprint to many reference fingerprints (pivots) are
computed once, before the keys are made, and travel with it. Rows of one key
are compared in tiles of bounded size. By the triangle inequality a pair whose
distances to any pivot differ by more than ``max_bits`` is no link; such pairs
are discarded, only survivors are verified with the exact distance. A tile returns the edges of a spanning forest of its
links, never all pairs, so a dense cluster gives no quadratic output and no
link between two clusters is lost.
"""

from __future__ import annotations

import itertools
import math
import re
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import fresh, id_text, n_partitions, ready, shuffle_partitions, written
from churnlens.llm.components import components

#: ASCII upper case only; white space as the word rule names it.
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TILE = 2048
PIVOTS = 16


def _pivots() -> list[int]:
    return [int(x) for x in np.random.default_rng(20).integers(0, 2**64, PIVOTS, dtype=np.uint64)]


def pivot_table(fp: Column) -> list[Column]:
    """The distances to all pivots, a byte each, eight to a number: columns ``d0``, ``d1`` and so on."""
    far = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long") for p in _pivots()]
    packed = [reduce(Column.bitwiseOR, [F.shiftleft(x, 8 * i) for i, x in enumerate(far[lo:lo + 8])]) for lo in range(0, PIVOTS, 8)]
    return [x.alias(f"d{i}") for i, x in enumerate(packed)]


def _apart(da: np.ndarray, db: np.ndarray) -> np.ndarray:
    """Largest difference of two rows of the pivot table."""
    return np.abs(da - db).max(axis=1)


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of one text; 0 without words."""
    return int(fingerprints([text], shingle)[0])


def fingerprints(texts, shingle: int) -> np.ndarray:
    """Bit i is 1 where over half of the shingle hashes (XXH64, seed 42, repeats included) have it.

    Texts are taken whole. The hashes of one text are counted in blocks of
    65,536, so a very long text needs no more memory than its words.
    """
    out = np.zeros(len(texts), dtype=np.uint64)
    for r, text in enumerate(texts):
        words = _WORD.findall(text.translate(_LOWER)) if text else []
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        ones = np.zeros(64, dtype=np.int64)
        for lo in range(0, n, 65536):
            part = words[lo:min(n, lo + 65536) + shingle - 1]
            grams = map(" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [" ".join(words)]
            h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[r] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def _with_fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield b[["doc_id", "k1", "k2"]].assign(fp=fingerprints(b["text"].tolist(), shingle).view(np.int64))

    return docs.mapInPandas(run, "doc_id long, k1 long, k2 long, fp long")


def _plan(n: int, max_bits: int) -> list[tuple[int, ...]]:
    """Blocks (as bit ranges) and choices of agreeing blocks with the least expected work for n fingerprints."""
    best = None
    for blocks in range(max_bits + 1, max_bits + 5):
        tables = math.comb(blocks, max_bits)
        bits = 64 * (blocks - max_bits) // blocks
        cost = tables * n * (40 + n / 2**bits)
        if best is None or cost < best[0]:
            best = cost, blocks
    return best[1]


def _masks(blocks: int, max_bits: int) -> list[int]:
    cut = [64 * i // blocks for i in range(blocks + 1)]
    ranges = [((1 << cut[i + 1]) - 1) & ~((1 << cut[i]) - 1) for i in range(blocks)]
    return [sum(ranges[i] for i in c) for c in itertools.combinations(range(blocks), blocks - max_bits)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _survivors(a, b, da, db, max_bits):
    """Index pairs (into a and b) that no pivot discards and that the exact distance confirms."""
    order = np.argsort(db[:, 0], kind="stable")
    first = db[order, 0].astype(np.int64)
    lo, hi = np.searchsorted(first, da[:, 0].astype(np.int64) - max_bits), np.searchsorted(first, da[:, 0].astype(np.int64) + max_bits, "right")
    step = max(1, 400_000 // max(1, len(b)))
    for s in range(0, len(a), step):
        n = hi[s:s + step] - lo[s:s + step]
        i = np.repeat(np.arange(s, s + len(n)), n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[s:s + step], n)]
        for p in range(1, da.shape[1]):
            if not len(i):
                break
            ok = np.abs(da[i, p] - db[j, p]) <= max_bits
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(a[i] ^ b[j]) <= max_bits
        yield i[ok], j[ok]


def _forest(a, b, da, db, max_bits):
    """Edges of a spanning forest of the links between a and b (may be the same array); da and db are their pivot distances."""
    nodes = np.concatenate([a, b])
    root = np.arange(len(nodes))
    out = []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in _survivors(a, b, da, db, max_bits):
        apart = a[i] != b[j]
        i, j = i[apart], j[apart] + len(a)
        while len(i):  # flatten, then join the first link between every two trees
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up
            ri, rj = root[i], root[j]
            open_ = ri != rj
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            if not len(i):
                break
            _, pick = np.unique(np.minimum(ri, rj) * len(nodes) + np.maximum(ri, rj), return_index=True)
            for k in pick:
                x, y = find(ri[k]), find(rj[k])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((nodes[i[k]], nodes[j[k]]))
    return out


def links(fps: DataFrame, n: int, max_bits: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that join all that are within ``max_bits``."""
    spark = fps.sparkSession
    masks = [_signed(m) for m in _masks(_plan(n, max_bits), max_bits)]
    table = [f"d{i}" for i in range(PIVOTS // 8)]
    keys = fps.select("fp", *pivot_table(F.col("fp"))).select("fp", *table, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    # tiles of a key: their number follows the rows of the key, which are counted with map-side sums
    many = keys.groupBy("t", "key").count().where(F.col("count") > 1)
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    keys = keys.join(many, ["t", "key"]).withColumn("tiles", tiles).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # tile pairs (i, j): a row goes to every pair that holds its own tile
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                       lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    rows = keys.select("fp", *table, "t", "key", "own", F.explode(pair).alias("p")).select("fp", *table, "t", "key", "own", "p.i", "p.j")
    parts = n_partitions(n * len(masks), 200_000, shuffle_partitions(spark))
    rows = rows.repartition(parts, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def compare(batches):
        left = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                left = b if left is None else pd.concat([left, b], ignore_index=True)
                if len(left) < 20_000:
                    continue
            if left is None or not len(left):
                return
            g = left[["t", "key", "i", "j"]].to_numpy()
            cut = np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1
            start = np.concatenate([[0], cut])
            end = np.append(cut, len(left))
            done = len(start) if b is None else len(start) - 1  # the last group may go on in the next batch
            fp, own = left["fp"].to_numpy().view(np.uint64), left["own"].to_numpy()
            dist = np.ascontiguousarray(left[table].to_numpy(dtype=np.int64)).view(np.int8).reshape(len(left), PIVOTS)
            start_, end_ = start[:done], end[:done]
            # keys of two rows, which are most, all at once; then each larger one
            s = start_[end_ - start_ == 2]
            s = s[_apart(dist[s], dist[s + 1]) <= max_bits] if len(s) else s
            s = s[(np.bitwise_count(fp[s] ^ fp[s + 1]) <= max_bits) & ((g[s, 2] == g[s, 3]) | (own[s] != own[s + 1]))]
            out = list(zip(fp[s], fp[s + 1]))
            for s, e in zip(start_, end_, strict=True):
                if e - s < 3:
                    continue
                if g[s, 2] == g[s, 3]:
                    out += _forest(fp[s:e], fp[s:e], dist[s:e], dist[s:e], max_bits)
                else:
                    mine = own[s:e] == g[s, 2]
                    out += _forest(fp[s:e][mine], fp[s:e][~mine], dist[s:e][mine], dist[s:e][~mine], max_bits)
            left = left.iloc[start[done]:].reset_index(drop=True) if done < len(start) else None
            if out:
                x = np.array(out, dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1]})

    return rows.mapInPandas(compare, "a long, b long")


def _row_keys(doc_id, text) -> list:
    """128 bits that name a row by its id and text; never null."""
    return [F.xxhash64(doc_id, text), F.xxhash64(F.lit("row"), text, doc_id)]


def _grouped(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``k1``, ``k2``, ``fp``, ``component_id`` of each row."""
    ready(docs.sparkSession)
    d = id_text(docs, id_col, text_col)
    k1, k2 = _row_keys(d["doc_id"], d["text"])
    fp = written(_with_fingerprint(d.withColumns({"k1": k1, "k2": k2}), shingle), "simhash")
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fp")
    n = distinct.count()
    root = components(links(distinct, n, max_bits))
    named = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fp.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Null and empty texts, and texts without words, have fingerprint zero and
    link like any other. Repeated rows each get a row. A null id is never the
    smallest of its component; a component of null ids has a null id. An empty
    table gives an empty result. Other columns of ``docs`` are ignored.
    """
    return _grouped(docs, shingle, max_bits, id_col, text_col).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which each group keeps one: that with the smallest id.

    Of several rows with that id one stays (of equal rows any one). A group
    whose ids are all null keeps one row.
    """
    g = _grouped(docs, shingle, max_bits, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # min of a struct is combined on the map side: one row a group is left, however large the group
    first = g.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2").distinct()
    a, b = fresh(docs, "_k1"), fresh(docs, "_k2")
    k1, k2 = _row_keys(docs[id_col].cast("long"), docs[text_col].cast("string"))
    rows = docs.withColumns({a: k1, b: k2})
    return rows.join(first, (rows[a] == first["k1"]) & (rows[b] == first["k2"]), "left_semi").dropDuplicates([a, b]).select(*docs.columns)
