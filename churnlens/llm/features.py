"""Text features for the classifiers: numpy on code points, no state beyond a word memory."""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np

_WORD = re.compile(r"[^\W\d_]+")
#: Words whose hash a task remembers; beyond that it forgets them all.
REMEMBERED = 500_000
#: Code points of a text that are looked at together, with the overlap that the trigrams need.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point of the first plane: letters by case, digits, spaces, each ASCII sign, other signs."""
    out = np.full(65536, 5, dtype=np.uint8)
    for c in range(65536):
        k = unicodedata.category(chr(c))
        out[c] = 1 if k in ("Ll", "Lo", "Lm") else 2 if k in ("Lu", "Lt") else 3 if k[0] == "N" else 4 if k[0] in "ZC" else 5
    for c in range(33, 127):
        if not chr(c).isalnum():
            out[c] = 6 + c % 48
    out[10] = 55
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def shape_counts(text: str, buckets: int) -> np.ndarray:
    """Counts of hashed character-class trigrams of the whole text; ``buckets`` is a power of two."""
    shift = 33 - int(buckets).bit_length()
    out = np.zeros(buckets, dtype=np.float64)
    p = points(text)
    table = _classes()
    for lo in range(0, max(1, len(p) - 2), BLOCK):
        c = table[np.minimum(p[lo:lo + BLOCK + 2], 65535)].astype(np.uint32)
        if len(c) >= 3:
            g = ((c[:-2] * np.uint32(64) + c[1:-1]) * np.uint32(64) + c[2:]) * np.uint32(2654435761)
            out += np.bincount(g >> np.uint32(shift), minlength=buckets)
    return out


class Words:
    """Two bucket numbers for each lower-cased word of a text: of the word, and of its first letters.

    The second lets inflected forms share what is learned about their stem.
    """

    STEM = 4

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def _bucket(self, s: str) -> int:
        return zlib.crc32(s.encode("utf-8", "surrogatepass")) % self.buckets

    def ids(self, text: str | None) -> np.ndarray:
        """Shape (words, 2)."""
        words = _WORD.findall(text.lower()) if text else []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        try:
            flat = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self._bucket(w) * self.buckets + self._bucket("^" + w[:self.STEM])
            flat = [known[w] for w in words]
        both = np.array(flat, dtype=np.int64)
        return np.stack([both // self.buckets, both % self.buckets], axis=1)
