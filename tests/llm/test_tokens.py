import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from churnlens.llm import tokens

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_round_trip(spark, edge_docs, tmp_path, where):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if where == "sf" else edge_docs
    path = f"{tmp_path}/ids"
    tokens.write_tokens(docs, path, VOCAB)
    library = Tokenizer.from_file(VOCAB)
    want = sorted(((r.doc_id is not None, r.doc_id or 0), library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.select("doc_id", "text").collect())
    rows = [((r.doc_id is not None, r.doc_id or 0), list(r.ids)) for r in tokens.read_tokens(spark, path).collect()]
    assert sorted(rows) == want
    digests = sorted(tokens.token_digests(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in digests] == [k for k, _ in want]
    at = 0
    for r in digests:
        assert r.start == at
        at += r.n_tokens
    crc = sorted((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in want)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in digests) == crc


def test_lookup_and_bloom_filter(spark, edge_docs, tmp_path):
    path = f"{tmp_path}/ids"
    tokens.write_tokens(edge_docs, path, VOCAB)
    assert sorted(r.doc_id for r in tokens.read_tokens(spark, path, [2, 7, 99]).collect()) == [2, 2, 7]
    plan = tokens.read_tokens(spark, path, [7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "doc_id" in plan.split("PushedFilters")[1]
    import pyarrow.orc as po
    import glob
    assert all(po.ORCFile(f).compression.upper() == "ZSTD" for f in glob.glob(f"{path}/*.orc"))


def test_empty(spark, empty_docs):
    assert tokens.token_table(empty_docs, VOCAB).count() == 0


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    enc = tokens.Encoder(VOCAB)
    texts = ["a b c d e f", "g  h\n\ni", "d'é 漢字's"]
    assert [list(x) for x in enc.batch(texts)] == [enc.whole(t) + [0] for t in texts]


def test_pieces_against_the_library(monkeypatch):
    """Texts put together at random from pieces that the encoder takes apart in different ways, with little memory and few at once."""
    import random
    library, g = Tokenizer.from_file(VOCAB), random.Random(3)
    parts = ["word", "Word.", "x,", "été", "naïve.", "12", "3.5", "a\nb", "\n", "\t x", "", " ", ".", ",", "..", "don't", "漢字", "😀,", "é.", "foo-bar", "<|endoftext|>", "end\n", " ", " z", "A" * 300, "ſ", "µ,"]
    texts = [g.choice(["", " "]).join(g.choice(parts) + g.choice([" ", " ", " ", "", "\n"]) for _ in range(g.randrange(12))) for _ in range(4000)]
    want = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    for remembered, at_once in ((48 << 20, 1000), (1, 3), (2000, 1)):
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        monkeypatch.setattr(tokens, "AT_ONCE", at_once)
        enc = tokens.Encoder(VOCAB)
        got = [x.tolist() for lo in range(0, len(texts), 37) for x in enc.batch(texts[lo:lo + 37])]
        assert got == want
