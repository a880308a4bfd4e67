"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are dealt by ranges of their id, sorted, encoded in place and
written by Spark's ORC writer, so that file order and row order are id order.
ORC encodes the id lists with integer run-length encoding; every stripe has
minima, maxima and a Bloom filter of the document ids, by which a reader skips
stripes, and stripes are read in parallel.
"""

from __future__ import annotations

import itertools
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.common import id_text, n_partitions, ready, shared_path, shuffle_partitions

END_ID = 0
#: Words of letters of the Latin blocks alone.
LETTERS = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
#: Signs that end a word of letters and are one id each after it.
STOPS = (".", ",")
#: Text bytes a file should have about.
FILE_BYTES = 64 << 20
#: A space between white space (of any plane: more than the pattern's own is no harm).
SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}] [\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Bytes of pieces and their ids that a task remembers; beyond that it forgets them all and goes on.
REMEMBERED = 32 << 20
#: Bytes of texts, and pieces new to a task, that are encoded together.
TOGETHER, AT_ONCE = 3 << 20, 1_000


class _Pieces:
    """Ids of the pieces met so far, the space before them left out: their names, and where their ids are in the pool."""

    def __init__(self):
        self.names = pa.array([], pa.large_string())
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def bytes(self) -> int:
        return self.names.nbytes + self.pool.nbytes + self.start.nbytes + self.size.nbytes

    def numbers(self, pieces: pa.Array, encode) -> np.ndarray:
        """Number of each of some distinct pieces; what is new is encoded: ``encode`` gives all ids and how many each piece has."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.names), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        if len(new):
            at = at.copy()
            at[new] = len(self.names) + np.arange(len(new))
            names = pieces.take(pa.array(new))
            ids, size = encode(names)
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, ids])
            self.names = pa.concat_arrays([self.names, names])
        return at


class Encoder:
    """Ids of texts by the tokenizers library, each distinct piece encoded once.

    The pattern of a byte-level vocabulary cuts a text into words, over whose
    ends it never merges, and it cuts before every space that has something
    other than white space on one side at least. So the ids of a text are the
    ids of its pieces between such cuts, one after the other. A text with a
    space between white space, or with one of the vocabulary's special strings
    (these are cut out before the pattern applies), is given to the library
    whole. So is every text if the vocabulary is not plainly byte-level.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = t = Tokenizer.from_file(vocabulary)
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        p = t.pre_tokenizer
        self.plain = t.normalizer is None and isinstance(p, pre_tokenizers.ByteLevel) and not p.add_prefix_space and p.use_regex
        # the visible character that stands for each byte in a byte-level vocabulary
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.visible = {x: chr(256 + i) for i, x in enumerate(x for x in range(256) if x not in seen)}
        # ids that begin with a space: the first one of every piece with a space before it, and no other
        self.space = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(" ")[0][0]
        self.opens = np.zeros(t.get_vocab_size(), dtype=bool)
        self.opens[[i for x, i in t.get_vocab().items() if x.startswith(self.space)]] = True
        self.stop = [self.whole(x) for x in STOPS]
        self.plain &= all(len(x) == 1 for x in self.stop)
        self.pieces = _Pieces()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces with a space before each, one after the other, and how many each has.

        A word of Latin letters is one word of the pattern, with a stop after
        it, too: its letters are merged once.
        """
        last = pc.index_in(pc.utf8_slice_codeunits(pieces, -1), value_set=pa.array(STOPS, pa.large_string()))
        stop = pc.fill_null(last, -1).to_numpy().copy()
        stem = pc.if_else(pc.is_valid(last), pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        word = pc.match_substring_regex(stem, LETTERS)
        words = pc.dictionary_encode(stem.filter(word))
        at, alone = np.empty(len(pieces), dtype=np.int64), ~word.to_numpy(zero_copy_only=False)
        at[~alone] = words.indices.to_numpy()
        at[alone] = len(words.dictionary) + np.arange(alone.sum())
        stop[alone] = -1
        merge = self.tokenizer.model.tokenize
        found = [[t.id for t in merge(self.space + (w if w.isascii() else w.encode().decode("latin-1").translate(self.visible)))] for w in words.dictionary.to_pylist()]
        pool, size = self._others(pieces.filter(pc.invert(word)).to_pylist())
        pool = np.concatenate([np.fromiter(itertools.chain.from_iterable(found), np.int32), pool])
        size = np.concatenate([np.fromiter(map(len, found), np.int64, len(found)), size])
        start, n = (np.cumsum(size) - size)[at], size[at] + (stop >= 0)
        ids = np.append(pool, np.int32(END_ID))[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)]
        ids[(np.cumsum(n) - 1)[stop >= 0]] = np.array([x[0] for x in self.stop], dtype=np.int32)[stop[stop >= 0]]
        return ids, n

    def _others(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library. Many pieces are given to it as one text, and it cuts them.

        A piece that is empty or begins with white space could meet white space
        before it there: it is a text of its own.
        """
        joined = [i for i, x in enumerate(pieces) if x and not x[0].isspace()]
        rest = sorted(set(range(len(pieces))).difference(joined))
        groups = [joined[lo:lo + AT_ONCE] for lo in range(0, len(joined), AT_ONCE)] + [[i] for i in rest]
        texts = [" " + " ".join([pieces[i] for i in g]) for g in groups]
        size, start, out, upto = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [np.zeros(0, np.int32)], 0
        for g, text in zip(groups, texts, strict=True):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)
            first = np.flatnonzero(self.opens[ids]) if len(g) > 1 else np.zeros(1, np.int64)
            assert len(first) == len(g)
            start[g], size[g] = upto + first, np.diff(np.append(first, len(ids)))
            out.append(ids)
            upto += len(ids)
        ids = np.concatenate(out)
        return ids[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)], size

    def encoded(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text, then the end id. Arrow cuts the pieces and finds the distinct and the new ones of the batch."""
        if self.pieces.bytes() > REMEMBERED:
            self.pieces = _Pieces()
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, SPACES)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = odd.to_numpy(zero_copy_only=False) | (not self.plain)
        cut = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        end = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        values = cut.flatten()
        rest = np.ones(len(values), dtype=bool)
        rest[end[:-1]] = False  # the first piece of a text has no space before it
        first = values.filter(pa.array(~rest)).to_pylist()
        found = values.filter(pa.array(rest)).dictionary_encode()
        at = self.pieces.numbers(found.dictionary, self.spaced)[found.indices.to_numpy()]
        start, size, pool = self.pieces.start, self.pieces.size, self.pieces.pool
        n = size[at]
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = pool[np.arange(upto[-1]) + np.repeat(start[at] - upto[:-1], n)]
        bound = upto[end - np.arange(len(end))]  # ids of all texts before, first pieces left out
        stop = np.array([END_ID], dtype=np.int32)
        whole = iter(texts.filter(pa.array(odd)).to_pylist())
        plain = iter(zip(first, bound[:-1], bound[1:], strict=True))
        parts, length = [np.zeros(0, np.int32)], np.empty(len(texts), dtype=np.int64)
        for i, is_odd in enumerate(odd):
            if is_odd:
                own = [np.array(self.whole(next(whole)), dtype=np.int32), stop]
            else:
                head, lo, hi = next(plain)
                own = [np.array(self.whole(head), dtype=np.int32), ids[lo:hi], stop]
            length[i] = sum(map(len, own))
            parts += own
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [x.values.to_numpy() for x in self.encoded(pa.array(texts, pa.large_string()))]


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``doc_id`` and ``ids`` (with the end id) of every document to ORC files at ``path``, in id order.

    Null texts are empty (the end id alone). Null ids come first. Rows that
    share an id are ordered by the hash of their text; equal rows are each
    written. An empty table gives a folder without rows.
    """
    spark = docs.sparkSession
    ready(spark)
    d = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = n_partitions(size, FILE_BYTES, shuffle_partitions(spark))
    # the last key only spreads equal rows, which are alike in any order
    d = d.withColumn("spread", F.monotonically_increasing_id())
    d = d.repartitionByRange(files, "doc_id", "tie", "spread").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        enc = _encoder(vocabulary)
        held, size = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                size += b.nbytes
            if held and (b is None or size >= TOGETHER):
                rows = pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                for x in rows.to_batches():
                    ids = enc.encoded(pc.fill_null(x.column("text"), ""))
                    yield pa.RecordBatch.from_arrays([x.column("doc_id"), ids], ["doc_id", "ids"])

    (d.mapInArrow(run, "doc_id long, ids array<int>").write
     .option("compression", "zstd").option("orc.stripe.size", str(32 << 20)).option("orc.row.index.stride", "1000")
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ``doc_ids`` only these, by the stripes whose index and Bloom filter may hold them."""
    df = spark.read.schema("doc_id long, ids array<int>").orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per written document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Offsets come from two levels of sums: within a file, and over the files'
    totals (one row a file), so no task sees more than a file's documents.
    """
    ready(spark)

    @F.arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        at, data = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(), dtype="<u4")).cast("B")
        return pa.array([zlib.crc32(data[4 * lo:4 * hi]) for lo, hi in zip(at[:-1], at[1:])], pa.int64())

    # the file's number follows the range of ids it holds; within it, the row's own order breaks ties
    rows = read_tokens(spark, path).select(
        "doc_id", F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)-[^/]*$", 1).cast("long").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        F.size("ids").cast("long").alias("n_tokens"), crc("ids").alias("ids_crc32"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = files.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("block", "row")) - F.col("n_tokens")
    return (rows.withColumn("inside", inside).join(before, "file")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def token_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write ``docs`` to the shared folder, read the files back and return their digests."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, id_col, text_col)
    return token_digests(spark, path)
