"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary spends few tokens on text like the text it was made
from and many on random characters. Candidates are runs of credential
characters; a run is reported where its characters per token are few, unless
it is a known digest or identifier, or lies inside a span of a fixed pattern.
A run without digits is an identifier only if its parts are words to the
vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import id_text, ready

# The kinds and patterns of the contract, ASCII letters in either case.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: A random string has this many characters at least, and at most this many characters per token.
RANDOM_LEAST, RANDOM_RATIO = 20, 2.0
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 in hex) and identifiers: UUIDs, numbers and dates.
_KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+)")
#: Paths and words in parts are identifiers, too, if the vocabulary knows their parts.
_LETTERS = re.compile(r"[A-Za-z/+=_-]+")
_PART = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=4)
def _encoding(vocabulary: str):
    import tiktoken
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost, non-overlapping per kind, in code points.

    The two run patterns have their least length in the repeat: a run is
    maximal, so a shorter one could only be dropped, as it is here.
    """
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _words(run: str, encoding) -> bool:
    """Whether a run without digits is made of words: its parts between separators, capitals as small letters, compress well."""
    parts = [x.lower() if x.isupper() else x for x in _PART.findall(run)] if _LETTERS.fullmatch(run) else []
    return sum(map(len, parts)) > RANDOM_RATIO * sum(len(encoding.encode_ordinary(x)) for x in parts)


def random_spans(text: str, base, encoding) -> list[tuple[int, int, str]]:
    """Runs that the vocabulary compresses badly, without known digests and identifiers and without base spans."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0]
        if _KNOWN.fullmatch(run) or len(run) > RANDOM_RATIO * len(encoding.encode_ordinary(run)) or _words(run, encoding):
            continue
        if not any(s < m.end() and m.start() < e for s, e, _ in base):
            out.append((m.start(), m.end(), "random"))
    return out


def _joined(spans) -> str:
    rank = {k: i for i, k in enumerate((*KINDS, "random"))}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], rank[x[2]], x[1])))


def scan(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with counts and spans of the secrets of its whole text.

    ``vocabulary`` is the path of a tiktoken rank file. Columns: ``doc_id``,
    ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (of the joined base
    spans), ``spans`` (all of them), ``n_random``. A null text counts as empty
    and has no spans (``spans`` is then the empty string). Null ids and
    repeated rows stay, one row each; other columns are ignored.
    """
    ready(docs.sparkSession)

    def run(batches):
        enc = _encoding(vocabulary)
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                base = base_spans(text) if text else []
                extra = random_spans(text, base, enc) if text else []
                n = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((i, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + extra), len(extra)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return id_text(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by ``[SECRET]`` (overlapping spans by one); null texts stay null."""
    ready(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        enc = _encoding(vocabulary)
        out = []
        for text in texts:
            if text:
                base = base_spans(text)
                parts, at, end = [], 0, -1
                for s, e, _ in sorted(base + random_spans(text, base, enc)):
                    if s >= end:
                        parts += [text[at:s], "[SECRET]"]
                    at = end = max(end, e)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))
