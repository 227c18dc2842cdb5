"""Chunks of texts for retrieval, and vectors for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window and of its overlap; tokens of both; the version of the rules.
WORDS, OVERLAP = 500, 50
TOKENS, TOKEN_OVERLAP = 220, 40
RULES_VERSION = 2


def chunk_text(c: Column) -> Column:
    """Without replacement signs and rows of box lines, spaces collapsed."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("�"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[─-╿]{2,}", " "), r"\s+", " "))


def word_windows(df: DataFrame, key: str, text: str, size: int = WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, n_words, chunk): windows of words; the last one stops at the end."""
    step = size - overlap
    rows = df.select(key, F.split(chunk_text(F.col(text)), " ").alias("w")).filter("w[0] != ''")
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * step + 1, size))
    return rows.select(key, F.posexplode(windows).alias("chunk_index", "part")).select(key, "chunk_index", F.size("part").alias("n_words"), F.array_join("part", " ").alias("chunk"))


def token_windows(df: DataFrame, key: str, text: str, encode: Callable[[str], list[tuple[int, int]]], size: int = TOKENS, overlap: int = TOKEN_OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk): windows of tokens, cut at the tokens' offsets in the text.

    encode gives the (start, end) of each token of a text; any tokenizer's offsets do. A window that has more
    tokens by itself than in its text (as pieces join by what stands around them) is cut back at its end until
    it fits, so none has over size of them unless one token alone has.
    """
    overlap = max(0, min(overlap, size - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for k, t in zip(frame["key"], frame["text"]):
                spans, at, n = encode(t or ""), 0, 0
                while at < len(spans):
                    to = min(len(spans), at + size)
                    whole = at == 0 and to == len(spans)
                    piece = t.strip() if whole else t[spans[at][0] : spans[to - 1][1]].strip()
                    while not whole and to > at + 1 and (over := len(encode(piece)) - size) > 0:
                        to = max(at + 1, to - over)
                        piece = t[spans[at][0] : spans[to - 1][1]].strip()
                    if piece:
                        out.append((k, n, piece))
                        n += 1
                    if to == len(spans):
                        break
                    at = max(at + 1, to - overlap)
            yield pd.DataFrame(out, columns=["key", "chunk_index", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), chunk_text(F.col(text)).alias("text")).mapInPandas(run, f"key {kind}, chunk_index int, chunk string")
    return rows.withColumnRenamed("key", key)


def metadata_chunks(assets: DataFrame, metadata: DataFrame) -> DataFrame:
    """(id, chunk_index, chunk): a pseudo-document of an asset's name, title and metadata, at index -1."""
    pairs = metadata.groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", F.upper("key"), "value_text"))), "\n").alias("pairs"))
    joined = assets.join(pairs, F.col("id") == F.col("asset_id"), "left")
    lines = F.concat_ws("\n", F.concat(F.lit("DOSYA: "), F.col("file_name")), F.concat(F.lit("BAŞLIK: "), F.col("title")), F.col("pairs"))
    return joined.select("id", F.lit(-1).alias("chunk_index"), lines.alias("chunk"))


def pending_chunks(assets: DataFrame, chunks: DataFrame, skips: DataFrame, version: int = RULES_VERSION) -> DataFrame:
    """Assets without chunks of this version of the rules and not skipped."""
    done = chunks.filter(F.col("rules_version") >= version).select("asset_id")
    skipped = skips.filter("stage = 'chunk'").select("asset_id")
    return assets.join(done, F.col("id") == F.col("asset_id"), "left_anti").join(skipped, F.col("id") == F.col("asset_id"), "left_anti")


def display_order(chunks: DataFrame) -> DataFrame:
    """Metadata chunks first, by how far below 0, then the body's."""
    return chunks.orderBy(F.col("chunk_index") >= 0, F.abs("chunk_index"), "id")


def hash_embed(texts: pd.Series, dim: int = 64) -> np.ndarray:
    """A vector of unit length per text: signed hashes of its words. Stands in where no model is given."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        if words:
            h = pd.util.hash_array(np.array(words, dtype=object)).astype(np.uint64)
            np.add.at(out[i], (h % np.uint64(dim)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0))
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def embed(df: DataFrame, key: str, text: str, model: Callable[[pd.Series], np.ndarray] = hash_embed) -> DataFrame:
    """(key, embedding) by a model over batches of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"key": frame["key"], "embedding": list(model(frame["text"]))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)
