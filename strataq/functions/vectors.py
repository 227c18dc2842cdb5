"""Vector expressions over array<float>."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters whose words are hashed at once.
HASHED = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def sign_hash(a: Column, bits: int = 63) -> Column:
    """A bit per dimension: set where the value is positive."""
    each = F.transform(F.slice(a, 1, bits), lambda x, i: F.when(x > 0, F.expr("shiftleft(1L, 0)")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s * 2 + x)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of vectors, scaled to length 1 (zeros stay)."""
    total = F.aggregate(F.slice(vectors, 2, 1 << 30), F.transform(vectors[0], lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(norm(total), F.lit(1e-12)))


def text_hash(c: Column) -> Column:
    """A 63-bit fingerprint of a text's words: bits set in over half of their hashes (0 without words)."""

    def hashes_of(texts: pd.Series) -> np.ndarray:
        split = texts.fillna("").str.lower().str.split()
        sizes = split.str.len().to_numpy(np.int64)
        flat = np.array([w for x in split for w in x], dtype=object)
        out = np.zeros(len(texts), np.int64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        hashes = pd.util.hash_array(flat, categorize=True) >> np.uint64(1)
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for bit in range(63):
            held = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int64), starts)
            out[full] |= (2 * held > sizes[full]).astype(np.int64) << bit
        return out

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        ends, at, out = np.cumsum(texts.str.len().fillna(0).to_numpy(np.int64)), 0, np.zeros(len(texts), np.int64)
        while at < len(texts):  # texts of about HASHED characters together, or one longer
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HASHED, side="right")))
            out[at:to] = hashes_of(texts.iloc[at:to])
            at = to
        return pd.Series(out)

    return run(c)
