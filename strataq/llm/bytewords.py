"""Words of UTF-8 texts found by byte classes, and CRC-32 of joined strings from those of their parts.

All by numpy over a slice of texts at once; no word becomes a Python object but the distinct ones.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_WORD = _LETTER.copy()
_WORD[48:58] = _WORD[128:] = True
#: Lead byte of U+00C0 to U+00FF, whatever byte follows it.
_LEAD = 0xC3


def offsets_of(column: pa.Array) -> np.ndarray:
    """The n+1 offsets of a large binary column in its bytes."""
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts (null: none), A-Z lowered, and the n+1 borders of the texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = offsets_of(texts)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return _LOWER[data], ends - ends[0]


def _runs(data: np.ndarray, borders: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of marked bytes within the texts, and the n+1 borders of the texts among them."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = borders[:-1][borders[:-1] < len(data)]
    begins[first] |= inside[first]
    at = np.flatnonzero(begins)
    before = np.concatenate(([0], np.cumsum(inside)))  # marked bytes before each one
    offsets = np.append(before[at], before[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return words, np.searchsorted(at, borders)


def alphanumeric_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of ASCII digits and letters (lowered) and of all characters beyond ASCII; borders of the texts."""
    data, borders = _bytes_of(texts)
    return _runs(data, borders, _WORD[data])


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of ASCII letters (lowered) and of U+00C0 to U+00FF, as UTF-8; borders of the texts."""
    data, borders = _bytes_of(texts)
    wide = data == _LEAD
    inside = _LETTER[data] | wide
    inside[1:] |= wide[:-1]
    return _runs(data, borders, inside)


@lru_cache(1)
def _zeros() -> list[np.ndarray]:
    """For 1, 2, 4, ... appended bytes: what each of the four bytes of a CRC-32 becomes (4 x 256)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    first = np.stack([one, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * (i - 1)) for i in (1, 2, 3))])
    tables = [first]
    for _ in range(40):
        tables.append(_mapped(tables[-1], tables[-1].ravel()).reshape(4, 256))
    return tables


def _mapped(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return table[0][crcs & 255] ^ table[1][(crcs >> 8) & 255] ^ table[2][(crcs >> 16) & 255] ^ table[3][crcs >> 24]


def joined_crc(left: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """CRC-32 of left and right strings joined, from those of both and the byte lengths of the right ones."""
    out = left.astype(np.uint32)
    for bit in range(int(right_size.max(initial=0)).bit_length()):
        chosen = np.flatnonzero((right_size >> bit) & 1)
        out[chosen] = _mapped(_zeros()[bit], out[chosen])
    return out ^ right


def crcs_of(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.to_pylist()), np.uint32, len(words))
