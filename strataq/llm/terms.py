"""Codes of words, for operators that hash terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .substrings import words_of

_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¿¡"


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of all words without case and punctuation around them, and the n+1 borders of the
    texts. Words of punctuation alone have none. Each distinct word is coded once."""
    words, borders = words_of(texts)
    coded = words.dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=_PUNCTUATION).cast(pa.large_binary())
    hashed = xxhash.xxh32_intdigest
    table = np.fromiter((hashed(w) if w else -1 for w in plain.to_pylist()), np.int64, len(plain))
    codes = table[coded.indices.to_numpy(zero_copy_only=False)]
    full = codes >= 0
    if full.all():
        return codes, borders
    kept = np.concatenate(([0], np.cumsum(full)))
    return codes[full], kept[borders]
