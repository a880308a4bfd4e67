"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes over it also starts in a document
with a smaller id. To find equal strings, positions are put into buckets by
their first q = 16 bytes and buckets are refined by what they hold at later
offsets, as a suffix sorter does that sorts by bucket pointers: what begins with
q equal bytes is sorted by the bucket identifiers at i + q, the new buckets of
2q bytes by those at i + 2q, and so on to ``length`` bytes; each level reuses
the buckets that the last one has made. A bucket that holds one document only
is final and is not refined.

Only sampled positions are sorted. Each string (window) is filed under the
least identifier among its 16-byte buckets, and neighbouring windows filed
under the same bucket form a run of at most 35 windows, so there are some 18
times fewer runs than bytes. Equal windows are filed under the same bucket,
whatever is around them.

1. Runs are sorted by (bucket, identifiers at the run's ends). Equal runs hold
   equal windows: all but those of the smallest document are covered. What
   equals a smaller document's run within one task is never sent.
2. Buckets with several documents and several different runs stay open: the
   first document of each different run sends the bytes of the run, and the
   positions of a group of buckets are sorted: first by their bytes, then by
   the identifiers of later offsets, which are ranks in the last sort. Windows
   of one bucket at the full length are equal byte by byte.
3. Covered windows go back to their documents, in groups of documents of
   bounded size, and what is left is hashed.

In step 1, where a task has the texts of its own documents only, an
identifier is a hash of the identifiers of its parts (64 bits of the bucket, 48
of the run); in step 2 it is a rank, so windows are compared exactly.
A bucket that a good part of a large corpus shares (a common line) would be one
group of unbounded size. Such buckets are looked for in a sample of documents,
which steers the work but not the result: their windows are filed singly, under
their full identifier.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import id_text, n_partitions, ready, shuffle_partitions, written

GRAM = 16
#: Windows of a run at most; bytes of a text that are looked at together.
RUN, BLOCK = 35, 1 << 18
#: Entries that a task gathers before it sends them; entries of a bucket group and text bytes of a document group, about.
FLUSH, GROUP_ENTRIES, CHUNK_BYTES = 600_000, 250_000, 4 << 20
#: Documents of the sample, and the entries of one bucket beyond which its windows are filed singly.
SAMPLE_DOCS, HOT_ENTRIES = 5000, 250_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Identifier of two parts from theirs."""
    return _mix(x * _B + _mix(y + _A))


def _refined(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of 16 and of ``length`` bytes along the last axis, each level made from the one before."""
    v = sum(b[..., i:b.shape[-1] - 7 + i].astype(np.uint64) << np.uint64(8 * i) for i in range(8))
    at, size = _joined(v[..., :-8], v[..., 8:]), GRAM
    first = at
    while size < length:
        step = min(size, length - size)
        at = _joined(at[..., :-step], at[..., step:])
        size += step
    return first, at


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:len(x) - (width - k)], x[width - k:]) if width > k else x


def runs(data: bytes, length: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, identifier, first window, windows) of each run of a text."""
    out = []
    for lo in range(0, len(data) - length + 1, BLOCK):
        b = np.frombuffer(data, dtype=np.uint8, offset=lo, count=min(len(data) - lo, BLOCK + length - 1))
        gram, full = _refined(b, length)
        h = _sliding_least(_mix(gram + _A), length - GRAM + 1)
        new = np.flatnonzero(h[1:] != h[:-1]) + 1
        start = np.concatenate([[0], new])
        size = np.diff(np.append(start, len(h)))
        pieces = -(-size // RUN)  # long runs are cut
        start = np.repeat(start, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.diff(np.append(start, len(h)))
        key, ident = h[start], _joined(full[start], full[start + size - 1]) + size.astype(np.uint64)
        if len(hot):
            single = np.isin(key, hot)
            at = np.concatenate([np.arange(s, s + n) for s, n in zip(start[single], size[single], strict=True)] or [np.zeros(0, np.int64)])
            key, ident = np.append(key[~single], _mix(full[at])), np.append(ident[~single], full[at])
            start, size = np.append(start[~single], at), np.append(size[~single], np.ones(len(at), np.int64))
        out.append((key, ident & np.uint64(2**48 - 1), start + lo, size))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


#: Fields of packed entries and their bytes: a document is named by its id and three bytes of its text's crc32.
_DOC = (("doc", 8), ("tag", 3), ("lo", 4), ("n", 1))
_FILED = (*_DOC, ("h", 8), ("ident", 6))
_OPEN = (*_DOC, ("h", 8))


def _pack(fields, rows: dict[str, np.ndarray], pick=slice(None)) -> bytes:
    """Byte planes of the fields (equal high bytes compress to nothing)."""
    return b"".join(np.ascontiguousarray(rows[f][pick]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for f, w in fields)


def _unpack(fields, blobs) -> dict[str, np.ndarray]:
    width, out = sum(w for _, w in fields), {f: [] for f, _ in fields}
    for blob in blobs:
        n, at = len(blob) // width, 0
        raw = np.frombuffer(blob, dtype=np.uint8)
        for f, w in fields:
            x = np.zeros((n, 8), dtype=np.uint8)
            x[:, :w] = raw[at:at + n * w].reshape(w, n).T
            out[f].append(x.view("<u8")[:, 0])
            at += n * w
    return {f: np.concatenate(x) if x else np.zeros(0, np.uint64) for f, x in out.items()}


def _by(key: np.ndarray):
    """(value, indices) of each distinct value."""
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield key[part[0]], part


def _ids(rows) -> np.ndarray:
    return rows["doc"].view(np.int64)


def _chunk(doc: np.ndarray, tag: np.ndarray, chunks: int) -> np.ndarray:
    return (doc % chunks + tag.astype(np.int64)) % chunks


def _sent(kind: int, fields, rows, part: np.ndarray, pick: np.ndarray):
    """Rows (kind, part, blob), one for each part."""
    where = np.flatnonzero(pick)
    return [(kind, int(p), _pack(fields, rows, where[i])) for p, i in _by(part[where])]


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where the sorted keys change."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if len(new) > 1 else new[1:]
    return new


#: Kinds of packed rows: runs on their way to a bucket; covered windows and open runs on their way to their documents.
_TO_BUCKET, _COVERED, _STILL_OPEN = 0, 1, 2
_ROW = "kind int, part int, blob binary"


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "blob"]).astype({"kind": "int32", "part": "int32"})


def _file_runs(length: int, groups: int, chunks: int, hot: np.ndarray):
    """Runs of all texts of a task; what equals a run of a smaller document of the same task is known to be covered."""
    def flush(parts):
        rows = {f: np.concatenate([p[f] for p in parts]) for f, _ in _FILED}
        doc = _ids(rows)
        order = np.lexsort((doc, rows["ident"], rows["h"]))
        new = _first_of(rows["h"][order], rows["ident"][order])
        least = np.empty(len(order), dtype=np.int64)
        least[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        covered = doc > least
        yield _frame(_sent(_COVERED, _DOC, rows, _chunk(doc, rows["tag"], chunks), covered)
                     + _sent(_TO_BUCKET, _FILED, rows, (rows["h"] % np.uint64(groups)).astype(np.int64), ~covered))

    def run(batches):
        parts, n = [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                data = text.encode() if text else b""
                if len(data) < length:
                    continue
                h, ident, lo, size = runs(data, length, hot)
                full = lambda x: np.full(len(h), x, dtype=np.uint64)  # noqa: B023, E731
                parts.append({"doc": full(np.int64(doc).view(np.uint64)), "tag": full(zlib.crc32(data) & 0xFFFFFF), "lo": lo.astype(np.uint64), "n": size.astype(np.uint64), "h": h, "ident": ident})
                n += len(h)
                if n >= FLUSH:
                    yield from flush(parts)
                    parts, n = [], 0
        if parts:
            yield from flush(parts)

    return run


def _sort_runs(chunks: int):
    """One group of buckets: which runs are covered, and which buckets must be refined."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] != _TO_BUCKET:
            return pdf
        rows = _unpack(_FILED, pdf["blob"])
        doc = _ids(rows)
        order = np.lexsort((doc, rows["ident"], rows["h"]))
        rows, doc = {f: x[order] for f, x in rows.items()}, doc[order]
        bucket, run_ = _first_of(rows["h"]), _first_of(rows["h"], rows["ident"])
        least = doc[np.flatnonzero(run_)][np.cumsum(run_) - 1]
        at = np.cumsum(bucket) - 1
        starts = np.flatnonzero(bucket)
        several = (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)) & (np.add.reduceat(run_, starts) > 1)
        covered = doc > least
        where = _chunk(doc, rows["tag"], chunks)
        return _frame(_sent(_COVERED, _DOC, rows, where, covered) + _sent(_STILL_OPEN, _OPEN, rows, where, several[at] & ~covered))

    return run


def _texts(docs: pd.DataFrame) -> dict[tuple[int, int], bytes]:
    out = {}
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        data = text.encode() if text else b""
        out[doc, zlib.crc32(data) & 0xFFFFFF] = data
    return out


def _by_document(rows):
    """((doc, tag), rows) of each document."""
    if not len(rows["doc"]):
        return
    order = np.lexsort((rows["lo"], rows["tag"], _ids(rows)))
    rows = {f: x[order] for f, x in rows.items()}
    new = np.flatnonzero(_first_of(rows["doc"], rows["tag"]))
    for s, e in zip(new, np.append(new[1:], len(order)), strict=True):
        yield (int(_ids(rows)[s]), int(rows["tag"][s])), {f: x[s:e] for f, x in rows.items()}


def _open_bytes(length: int, groups: int):
    """The bytes of the open runs, on their way to their buckets."""
    wide = RUN + length - 1

    def run(key: tuple, docs: pd.DataFrame, open_: pd.DataFrame) -> pd.DataFrame:
        texts, out = _texts(docs), []
        rows, context = [], []
        for name, r in _by_document(_unpack(_OPEN, open_["blob"])):
            data = np.frombuffer(texts[name], dtype=np.uint8)
            at = r["lo"].astype(np.int64)[:, None] + np.arange(wide)
            inside = np.arange(wide) < r["n"].astype(np.int64)[:, None] + length - 1
            context.append(np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8))
            rows.append(r)
        if rows:
            rows, context = {f: np.concatenate([r[f] for r in rows]) for f, _ in _OPEN}, np.concatenate(context)
            for p, i in _by((rows["h"] % np.uint64(groups)).astype(np.int64)):
                out.append((int(p), _pack(_OPEN, rows, i), context[i].tobytes()))
        return pd.DataFrame(out, columns=["part", "blob", "context"]).astype({"part": "int32"})

    return run


def _ends(ident: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the smallest and the largest document of its bucket."""
    if not len(doc):
        return doc, doc
    order = np.lexsort((doc, ident))
    new = np.flatnonzero(_first_of(ident[order]))
    at = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    low, high = np.empty_like(doc), np.empty_like(doc)
    low[order], high[order] = doc[order][new][at], doc[order][np.append(new[1:], len(order)) - 1][at]
    return low, high


def bucket_pointers(b: np.ndarray, windows: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, identifier) of the windows of the rows of ``b`` that several documents may have, refined to ``length`` bytes.

    ``windows`` says at which offsets of a row a window starts, ``doc`` whose the
    row is. Identifiers are ranks: of the first bytes at first, then of pairs of
    identifiers, a position's own and that at a later offset. Only positions
    that an open window still needs are sorted again; the others keep none.
    """
    v = sum(b[:, i:b.shape[1] - 7 + i].astype(np.uint64) << np.uint64(8 * (7 - i)) for i in range(8))
    at = np.unique(v, return_inverse=True)[1].reshape(v.shape).astype(np.int64)
    size, (row, t) = 8, np.nonzero(windows)
    while size < length:
        step = min(size, length - size)
        n = at.shape[1] - step
        # the offsets at which later levels look this one's identifiers up
        need, later, reach = np.zeros((len(b), n), dtype=bool), size + step, {0}
        while later < length:
            on = min(later, length - later)
            reach, later = reach | {r + on for r in reach}, later + on
        for r in reach:
            need[row, t + r] = True
        i, j = np.nonzero(need)
        key = at[i, j] * (at.max() + 1) + at[i, j + step]
        up = np.full((len(b), n), -1, dtype=np.int64)
        up[i, j] = np.unique(key, return_inverse=True)[1]
        at, size = up, size + step
        low, high = _ends(at[row, t], doc[row])
        row, t = row[low < high], t[low < high]  # a bucket of one document is final
        if not len(row):
            break
    return row, t, at[row, t]


def _refine(length: int, chunks: int):
    """One group of open buckets, refined to the full length: windows that a smaller document has too."""
    wide = RUN + length - 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _unpack(_OPEN, pdf["blob"])
        b = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(-1, wide) for x in pdf["context"]])
        out = []
        for _, i in _by((rows["h"] >> np.uint64(32)) % np.uint64(max(1, len(b) // 20_000))):  # a part of the buckets at a time
            part = {f: x[i] for f, x in rows.items()}
            run_, t, ident = bucket_pointers(b[i], np.arange(RUN) < part["n"].astype(np.int64)[:, None], _ids(part), length)
            doc = _ids(part)[run_]
            covered = doc > _ends(ident, doc)[0]
            run_, t = run_[covered], t[covered]
            start = np.ones(len(t), dtype=bool)  # neighbours in a run go together
            start[1:] = (run_[1:] != run_[:-1]) | (t[1:] != t[:-1] + 1)
            first = np.flatnonzero(start)
            found = {"doc": part["doc"][run_[first]], "tag": part["tag"][run_[first]],
                     "lo": part["lo"][run_[first]] + t[first].astype(np.uint64), "n": np.diff(np.append(first, len(t))).astype(np.uint64)}
            out += _sent(_COVERED, _DOC, found, _chunk(_ids(found), found["tag"], chunks), np.ones(len(first), dtype=bool))
        return _frame(out)

    return run


_RESULT = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int, texts: bool):
    """What is left of each document of a group."""
    def run(key: tuple, docs: pd.DataFrame, covered: pd.DataFrame) -> pd.DataFrame:
        gone = dict(_by_document(_unpack(_DOC, covered["blob"])))
        out = []
        for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
            data = text.encode() if text else b""
            r = gone.get((doc, zlib.crc32(data) & 0xFFFFFF)) if len(data) >= length else None
            if r is None:
                out.append((doc, text if texts else None, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(edge, r["lo"].astype(np.int64), 1)
            np.add.at(edge, (r["lo"] + r["n"]).astype(np.int64) + length - 1, -1)
            off = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, dtype=np.uint8)[~off].tobytes()
            spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
            out.append((doc, kept.decode(errors="ignore") if texts else None, len(data), int(off.sum()), spans, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _hot_buckets(docs: DataFrame, n_docs: int, length: int) -> np.ndarray:
    """Buckets that more than ``HOT_ENTRIES`` documents can be expected to have, from a sample of documents.

    A sampled document has each bucket once, and only buckets of at least 32
    sampled documents and the expected number count, so the list is bounded by
    the sample's runs over 32.
    """
    step = max(1, n_docs // SAMPLE_DOCS)
    least = max(32, HOT_ENTRIES * SAMPLE_DOCS // max(n_docs, SAMPLE_DOCS))
    if least > SAMPLE_DOCS * 2:  # not even a bucket of all documents is that large
        return np.zeros(0, np.uint64)

    def run(batches):
        none = np.zeros(0, np.uint64)
        for b in batches:
            h = [np.unique(runs(t.encode(), length, none)[0]) for t in b["text"] if t]
            yield pd.DataFrame({"h": np.concatenate(h or [none]).view(np.int64)})

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    hot = sample.mapInPandas(run, "h long").groupBy("h").count().where(F.col("count") >= least).select("h").toPandas()
    return hot["h"].to_numpy(dtype=np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``text``, what is left, if ``texts``).

    Every byte goes that a string of ``length`` bytes covers which also starts
    in a document with a smaller id; all strings are judged on the input.
    ``length`` is 24 to 50. Null texts are empty. Documents with equal ids do
    not remove anything from each other, and repeated rows each get a row. A
    document with a null id is neither smaller nor larger than any: it stays
    whole. With ``texts``, a character of which a part is gone goes whole.
    Other columns are ignored.
    """
    if not GRAM + 8 <= length <= 50:
        raise ValueError("length must be 24 to 50")
    spark = docs.sparkSession
    ready(spark)
    every = id_text(docs, id_col, text_col)
    d = every.where("doc_id is not null")
    size = d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    least = shuffle_partitions(spark)
    groups = n_partitions(size["bytes"] / 18, GROUP_ENTRIES, least)
    chunks = n_partitions(size["bytes"], CHUNK_BYTES, least)
    hot = _hot_buckets(d, size["n"], length)

    filed = d.mapInPandas(_file_runs(length, groups, chunks, hot), _ROW)
    judged = written(filed.groupBy("kind", "part").applyInPandas(_sort_runs(chunks), _ROW), "substrings")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).bitwiseAND(F.lit(0xFFFFFF))
    chunked = d.withColumn("part", F.pmod(F.pmod("doc_id", F.lit(chunks)) + crc, F.lit(chunks)).cast("int"))
    covered, still = (judged.where(F.col("kind") == k).select("part", "blob") for k in (_COVERED, _STILL_OPEN))
    opened = chunked.groupBy("part").cogroup(still.groupBy("part")).applyInPandas(_open_bytes(length, groups), "part int, blob binary, context binary")
    more = opened.groupBy("part").applyInPandas(_refine(length, chunks), _ROW).select("part", "blob")
    out = chunked.groupBy("part").cogroup(covered.union(more).groupBy("part")).applyInPandas(_cut(length, texts), _RESULT)
    whole = every.where("doc_id is null").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    out = out.unionByName(whole)
    return out if texts else out.drop("text")
