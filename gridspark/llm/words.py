"""One cut of texts into words for all scripts: every character's part depends on itself and the one before it alone.

Letters, digits and their marks make words; all else (white space, punctuation, symbols, the underscore) separates them. In scripts
that write no blanks (Han, Kana, Thai, Lao, Burmese, Khmer) each character, with its marks, is a word.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Ranges of scripts without blanks between words.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
)
#: Parts that a character can have: none, of a word, a word of its own, mark of such a word.
NONE, PART, OWN, MARK = range(4)

_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if c < 128 and chr(c).isalnum() else 32 for c in range(256))


@lru_cache(1)
def parts() -> np.ndarray:
    """The part of each code point."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)), np.uint8, 0x110000)
    for a, b in UNSPACED:
        own = kinds[a : b + 1]
        own[own == PART] = OWN
        for c in range(a, min(b, 0xFFFF) + 1):
            if unicodedata.category(chr(c))[0] == "M":
                kinds[c] = MARK
    kinds[[0xAD, 0x200C, 0x200D]] = PART  # soft hyphen and joiners are inside words
    return kinds


def _points(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, their parts, and where words begin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = parts()[points]
    before = np.r_[np.uint8(NONE), kind[:-1]]
    return points, kind, (kind != NONE) & ((before == NONE) | (kind == OWN) | ((kind == PART) & (before >= OWN)))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words as UTF-8, composed (NFC)."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    points, kind, begins = _points(unicodedata.normalize("NFC", text.lower()))
    points = np.where(kind == NONE, np.uint32(32), points)
    if (kind >= OWN).any():
        points = np.insert(points, np.flatnonzero(begins), 32)
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass").split()


def word_spans(text: str | None) -> tuple[list[bytes], list[int], list[int]]:
    """The words as in words_of, and where each starts and ends in the text, in code points."""
    if not text:
        return [], [], []
    _, kind, begins = _points(text)
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero((kind != NONE) & np.r_[(kind[1:] == NONE) | begins[1:], True]) + 1
    spans = list(zip(starts.tolist(), ends.tolist()))
    words = [unicodedata.normalize("NFC", text[a:b].lower()).encode("utf-8", "surrogatepass") for a, b in spans]
    return words, starts.tolist(), ends.tolist()
