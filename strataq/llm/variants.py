"""Grouping of spelling variants: words of a corpus, their near words, and the frequent form they go back to.

Two words are near if one insertion, deletion or replacement of a character makes them equal. Such an error
lies in one half of a word and leaves the other as it is, so a word's near words share its first half or its
last one. Words meet in shards by such halves: each is dealt under the first characters of either length that a
near word may ask for, and likewise under its last ones. A shard builds a minimal acyclic automaton (forward,
or of the words read backward) with perfect-hash numbers; each of its own words goes its half exactly
and its rest with one error. A pair found backward counts only if it is not found forward, so each is counted once,
and only a word's number of near words and its best one leave the shard.

The number of shards follows the number of words, so a shard has about as many at every size; no pair is a row.
Roots come from doubling joins over the words that have a form: as a form has at least RATIO times its word's
count, a chain has at most the logarithm of the greatest count as steps.

Nulls, empty and long texts: a null text is an empty one, without words; a null id is hashed as an empty string.
Long texts and long words go whole. Repeated rows count each. Ties between near words of equal count go to the
first in code-point order. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, Words, near_words
from .bytewords import crcs_of, joined_crc, letter_words, offsets_of
from .common import materialize, slices

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One run in so many (by hash of id and run) loses a character.
DAMAGE = 31
#: Rows of a shard, on average; every word has four.
SHARD_ROWS = 16_384


def _word_rows(batches: Iterator[pa.RecordBatch], least: int, damage: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of a slice's words of enough characters, damaged ones as they are then."""
    for batch in slices(batches, "text"):
        words, borders = letter_words(batch.column("text"))
        coded = words.dictionary_encode()
        distinct, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        size = np.diff(offsets_of(distinct))
        wide = np.frombuffer(distinct.buffers()[2], np.uint8)[: size.sum()] == 0xC3
        marks = np.concatenate(([0], np.cumsum(wide)))
        length = size - np.diff(marks[offsets_of(distinct) - offsets_of(distinct)[0]])
        text = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        heads = np.array([zlib.crc32(b"%d:" % i if i is not None else b":") for i in batch.column("doc_id").to_pylist()], np.uint32)
        long = np.flatnonzero(length[ids] >= least)
        ids, text = ids[long], text[long]
        hashes = joined_crc(heads[text], crcs_of(distinct)[ids], size[ids]).astype(np.int64)
        hit = hashes % damage == 0
        count = np.bincount(ids[~hit], minlength=len(distinct))
        whole = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([distinct.take(pa.array(whole)).cast(pa.binary()).cast(pa.string()), pa.array(count[whole])], names=["word", "n"])
        ids, place = ids[hit], hashes[hit] % np.maximum(length[ids[hit]], 1)
        ids, place = ids[length[ids] > least], place[length[ids] > least]
        left: dict[str, int] = {}
        for word, at in zip(distinct.take(pa.array(ids)).to_pylist(), place.tolist()):
            word = word.decode()
            word = word[:at] + word[at + 1 :]
            left[word] = left.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(left), pa.string()), pa.array(list(left.values()), pa.int64())], names=["word", "n"])


def _near_in_shard(key: tuple, table: pa.Table) -> pa.Table:
    """(word, n_near, best) of a shard's own words that have near words in it; best: greatest n, first word."""
    backward = key[0].as_py() % 2 == 1
    rows: dict[bytes, tuple[int, bool]] = {}
    for word, n, own in zip(table["word"].to_pylist(), table["n"].to_pylist(), table["own"].to_pylist()):
        word = word.encode("latin-1")
        word = word[::-1] if backward else word
        rows[word] = (n, own or rows.get(word, (0, False))[1])
    every = sorted(rows)
    count = np.array([rows[w][0] for w in every])
    asking = np.array([i for i, w in enumerate(every) if rows[w][1]], np.int64)
    words = Words(every)
    queries = Words([every[i] for i in asking]) if len(asking) < len(every) else words
    half = queries.size // 2
    query, near = near_words(Automaton(words), queries, queries.size - half if backward else half)
    plain = [w[::-1] for w in every] if backward else every
    if backward:  # those that share the first half as well were found forward
        kept = np.array([not plain[v].startswith(plain[asking[q]][: len(plain[asking[q]]) // 2]) for q, v in zip(query.tolist(), near.tolist())], bool)
        query, near = query[kept], near[kept]
    place = np.empty(len(every), np.int64)
    place[sorted(range(len(every)), key=plain.__getitem__)] = np.arange(len(every))
    order = np.lexsort((place[near], -count[near], query))
    query, near = query[order], near[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
    best = near[first]
    columns = [pa.array([plain[asking[q]].decode("latin-1") for q in query[first]], pa.string()), pa.array(np.diff(np.append(first, len(query)))), pa.array(-count[best], pa.int64()), pa.array([plain[v].decode("latin-1") for v in best], pa.string())]
    return pa.Table.from_arrays(columns, names=["word", "n_near", "minus_n", "near"])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of all words of at least so many characters."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_word_rows, least=least, damage=damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _dealt(words: DataFrame, shards: int) -> DataFrame:
    """(word, n, shard, own): each word under the beginnings and ends that words of its length, one more or one
    less ask for; own where it asks itself. Even shards are read forward, odd ones backward."""
    keys = []
    for backward, part in ((0, F.left), (1, F.right)):
        size = F.char_length("word") + backward
        asks = F.floor(size / 2).cast("int")
        other = F.when(size % 2 == 0, asks - 1).otherwise(asks + 1)
        for length, own in ((asks, True), (other, False)):
            shard = 2 * F.pmod(F.xxhash64(part(F.col("word"), length)), F.lit(shards)) + backward
            keys.append(F.struct(shard.alias("shard"), F.lit(own).alias("own")))
    return words.select("word", "n", F.inline(F.array(*keys)))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form."""
    at = materialize(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        # Forms that have forms themselves are few words; both sides are hashed by the form.
        then = materialize(at.join(on, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "roots")
        if not then.filter("__moved").limit(1).count():
            return at
        at = then.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int = DAMAGE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word; least must be 3 or more, so that each half is a part."""
    words = materialize(count_words(docs, id_col, text_col, least, damage).filter(F.col("n") >= min_count), "words")
    shards = max(16, 2 * words.count() // SHARD_ROWS)
    parts = _dealt(words, shards).groupBy("shard").applyInArrow(_near_in_shard, "word string, n_near long, minus_n long, near string")
    none = F.lit(None)
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("struct<minus_n:bigint,near:string>").alias("best"))
    both = both.unionByName(parts.select("word", none.cast("long").alias("n"), "n_near", F.struct("minus_n", "near").alias("best")))
    rows = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    frequent = -F.col("best.minus_n") >= ratio * F.col("n")
    forms = materialize(rows.select("word", "n", "n_near", F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.minus_n")).alias("form_n")), "forms")
    return forms.join(_roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))
