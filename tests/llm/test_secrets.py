import hashlib
import random
import re
import string
import subprocess
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest

from churnlens.llm import secrets

VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parents[2]


def slow_base(text):
    """The contract's patterns as they stand, dropping short matches afterwards."""
    t = text or ""
    both = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([both("password"), both("passwd"), both("secret"), both("token"), both("api") + "_?" + both("key")])
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    out.sort(key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in out)
    return [sum(k == w for k, _, _ in out) for w in ("assign", "access", "hex")] + [hashlib.sha256(joined.encode()).hexdigest()], joined


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_base_matches_brute_force(spark, edge_docs, where):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if where == "sf" else edge_docs
    want = Counter((r.doc_id, *slow_base(r.text)[0]) for r in docs.select("doc_id", "text").collect())
    rows = secrets.scan(docs, VOCAB).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want


def test_base_spans_stay_in_spans(edge_docs):
    texts = {r.doc_id: r.text for r in edge_docs.where("doc_id is not null").select("doc_id", "text").collect()}
    for r in secrets.scan(edge_docs, VOCAB).where("doc_id is not null").collect():
        base = [x for x in slow_base(texts[r.doc_id])[1].split(",") if x]
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == base


def test_random_strings_and_exclusions():
    enc = secrets._encoding(VOCAB)
    found = lambda t: [t[s:e] for s, e, _ in secrets.random_spans(t, secrets.base_spans(t), enc)]
    assert found("it is 9aK2xLq81ZtPvR7yWb3Q here") == ["9aK2xLq81ZtPvR7yWb3Q"]
    for plain in ("internationalization-of-everything", "550e8400-e29b-41d4-a716-446655440000", "2024-01-01_2025-12-31_000", "D41D8CD98F00B204E9800998ECF8427E", "path/to/some/longer/file_name"):
        assert found(f"see {plain} there") == []
    # inside a base span nothing is added
    t = "token = 9aK2xLq81ZtPvR7yWb3Q"
    assert found(t) == [] and len(secrets.base_spans(t)) == 1


@pytest.mark.parametrize("alphabet", [string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + "-_/+=", string.ascii_lowercase + "-_"])
def test_random_letters_are_found(alphabet):
    enc, g = secrets._encoding(VOCAB), random.Random(7)
    runs = ["".join(g.choices(alphabet, k=n)) for n in (20, 32, 64) for _ in range(200)]
    assert sum(secrets.random_spans(f"x {r} y", [], enc) == [(2, 2 + len(r), "random")] for r in runs) > 0.95 * len(runs)


def test_words_without_digits_are_identifiers():
    """The run as a whole has at most 2 characters a token; its parts, capitals as small letters, have more."""
    enc = secrets._encoding(VOCAB)
    run = "CONFIG_ARCH_HAS_DMA_SET_MASK"
    assert len(run) <= 2 * len(enc.encode_ordinary(run)) and secrets.random_spans(run, [], enc) == []


def test_long_runs_end():
    """Letters before a digit are matched in linear time: nested repeats would take 2^60 steps here."""
    code = ("import sys; from churnlens.llm import secrets; enc = secrets._encoding(sys.argv[1])\n"
            "for t in ('a' * 60 + '1', 'AAAA' * 5000 + '1', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', 'ab-' * 5000 + '1'):\n"
            "    secrets.random_spans(t, [], enc)")
    subprocess.run([sys.executable, "-c", code, VOCAB], cwd=ROOT, timeout=60, check=True)


def test_ascii_only_case():
    assert secrets.base_spans("TOKEN=abcdefghijkl") and not secrets.base_spans("toKen=abcdefghijkl") and not secrets.base_spans("paſſword=abcdefghijkl")


def test_redact(edge_docs, empty_docs):
    out = {r.doc_id: r.text for r in secrets.redact(edge_docs, VOCAB).where("doc_id in (3, 4, 9, 10)").collect()}
    assert out[3] is None and out[4] == ""
    assert out[9] == "Straße ÀÉ [SECRET]\" [SECRET] [SECRET] end"
    assert out[10] == "[SECRET] and Password='short' and [SECRET] done"
    assert secrets.scan(empty_docs, VOCAB).count() == 0 and secrets.redact(empty_docs, VOCAB).columns == empty_docs.columns
