"""Removal of repeated passages by seed and extend.

A window is WINDOW consecutive words. Its words go if the same window starts in a document of smaller
id. Seeds: winnowing picks, of every 9 consecutive 5-word grams, the one with the least hash, so two
documents that share a window share one of its seeds. Seeds that occur once anywhere are dropped.
Extension: from each remaining seed, both ways, by all windows that hold it; a window is shared if
some document has an equal one, and overlapping shared windows join up to maximal repeats.

Equal texts are found first, by hash: all but the one of smallest id lose every word (if they have a
window), and only that one goes on to the seeds. Hot passages never form pairs: of equal seeds or
windows a task sends on one, and settles the others itself (each has a partner in the task), so a seed
or window that a third of all documents hold has a row per task. Windows are compared by 96 bits of
hash, texts by 128. The three passes over texts join by document and share one shuffle of them.

Nulls, empty and long texts: a null text is an empty one, with no words; long texts go whole. A null
doc_id has no order: such a document keeps all its words and takes none from others. Rows of one
doc_id are one document's: they take nothing from each other. Their seeds are gathered by id alone, so
each text of the id is looked through at all of them that lie in it: more windows than needed, of which
the comparison keeps the shared ones. Equal windows of equal ids (ties) stay. An empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ranges, slices

WINDOW, GRAM = 13, 5
PICK = WINDOW - GRAM + 1
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # any odd numbers do


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (between ASCII white space) of some texts, and the n+1 borders of the texts."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, borders = split.flatten(), np.asarray(split.offsets, np.int64)
    borders = borders - borders[0]
    full = np.asarray(pc.binary_length(flat)) > 0  # no empty words beside leading or trailing space
    kept = np.concatenate(([0], np.cumsum(full)))
    return (flat if full.all() else flat.filter(pa.array(full))), kept[borders]


def _word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    coded = words.dictionary_encode()
    raw = b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()])
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return both[codes, 0], both[codes, 1]


def _rolled(hashes: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of every n consecutive words (empty if there are fewer)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:size].copy()
    for i in range(1, n):
        out *= base
        out += hashes[i : i + size]
    return out


def _starts(borders: np.ndarray) -> np.ndarray:
    """Positions at which a window lies in one text."""
    counts = np.maximum(np.diff(borders) - WINDOW + 1, 0)
    return ranges(borders[:-1], counts).astype(np.int64)


def _picks(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the least gram of each window is; the first of equal ones."""
    least, at = grams[starts], starts.copy()
    for i in range(1, PICK):
        other = grams[starts + i]
        less = other < least
        least[less], at[less] = other[less], starts[less] + i
    return at


def seeds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word position) of the winnowed seeds of some texts."""
    words, borders = words_of(texts)
    grams = _rolled(_word_hashes(words)[0], GRAM, _BASE[0])
    starts = _starts(borders)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    picked = np.unique(_picks(grams, starts))
    text = np.searchsorted(borders, picked, side="right") - 1
    return grams[picked], text, picked - borders[text]


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, doc_id, place): of equal seeds in a slice one is sent under its hash; the others are settled.

    place is twice the word position, plus 1 if the seed is settled; then k only spreads the rows.
    """
    for batch in slices(batches, "text"):
        hashes, text, position = seeds(batch.column("text"))
        order = np.argsort(hashes, kind="stable")
        hashes, text, position = hashes[order], text[order], position[order]
        again = np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(hashes) else np.empty(0, bool)
        sure = again.copy()
        sure[:-1] |= again[1:]
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[text]
        k = hashes.copy()
        k[again] = (doc[again].view(np.uint64) + position[again].astype(np.uint64)) * _BASE[1]
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(doc), pa.array(2 * position + sure)], names=["k", "doc_id", "place"])


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.empty(0, np.int64)


#: Stands for the check and start of a row that holds windows settled in the task.
SETTLED = -1


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, check, start, doc_id, text_key, more) of the windows whose seed is repeated.

    Windows equal to one of a smaller document in the slice are settled: a row per text holds their
    starts. Of the others, those of the smallest document are sent under their hash; more holds further
    starts of the same window in the text.
    """
    kinds = [("k", pa.int64()), ("check", pa.int32()), ("start", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int32()), ("more", pa.list_(pa.int32()))]
    for batch in slices(batches, "text"):
        words, borders = words_of(batch.column("text"))
        starts = _starts(borders)
        if not len(starts):
            continue
        one, two = _word_hashes(words)
        positions = batch.column("positions")
        counts = np.diff(np.asarray(positions.offsets, np.int64))
        place = positions.flatten().to_numpy(zero_copy_only=False) + np.repeat(borders[:-1], counts)
        repeated = np.zeros(len(words), bool)
        repeated[place[place < np.repeat(borders[1:], counts)]] = True  # an id's longer text has places beyond this one
        at = starts[repeated[_picks(_rolled(one, GRAM, _BASE[0]), starts)]]
        if not len(at):
            continue
        k = _rolled(one, WINDOW, _BASE[0])[at]
        check = (_rolled(two, WINDOW, _BASE[1])[at] >> np.uint64(33)).astype(np.int32)
        text = np.searchsorted(borders, at, side="right") - 1
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[text]
        start = (at - borders[text]).astype(np.int32)
        order = np.lexsort((start, text, doc, check, k))
        k, check, text, doc, start = k[order], check[order], text[order], doc[order], start[order]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (check[1:] != check[:-1])))
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
        goes = doc != doc[first]  # the smallest document of the group comes first
        keys = batch.column("text_key").to_numpy(zero_copy_only=False)
        # Settled windows: a row per text.
        gone = np.flatnonzero(goes)
        gone = gone[np.argsort(text[gone], kind="stable")]
        heads = _groups(text[gone])
        rows = text[gone][heads]
        docs = doc[gone][heads]
        spread = (docs.view(np.uint64) * _BASE[1]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(gone)).astype(np.int32)), pa.array(start[gone]))
        mark = pa.array(np.full(len(rows), SETTLED, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(spread), mark, mark, pa.array(docs), pa.array(keys[rows]), lists], schema=pa.schema(kinds))
        # Others: a row per window and text of the smallest document.
        held = np.flatnonzero(~goes)
        change = fresh[held] | np.concatenate(([True], text[held][1:] != text[held][:-1])) if len(held) else np.empty(0, bool)
        heads = np.flatnonzero(change)
        rows = held[heads]
        n = np.diff(np.append(heads, len(held)))
        further = np.ones(len(held), bool)
        further[heads] = False
        ends = np.concatenate(([0], np.cumsum(n - 1))).astype(np.int32)
        none = pa.array(np.append(n == 1, False))
        lists = pa.ListArray.from_arrays(pa.array(ends, mask=none.to_numpy(zero_copy_only=False)), pa.array(start[held][further]))
        yield pa.RecordBatch.from_arrays([pa.array(k[rows].view(np.int64)), pa.array(check[rows]), pa.array(start[rows]), pa.array(doc[rows]), pa.array(keys[text[rows]]), lists], schema=pa.schema(kinds))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept_text) from texts, their (text_key, starts) and whether they are copies."""
    for batch in slices(batches, "text", 4 << 20):
        total, removed, texts = [], [], []
        for text, key, found, copy in zip(*(batch.column(c).to_pylist() for c in ("text", "text_key", "removed", "is_copy"))):
            words = (text or "").encode("utf-8").split()
            starts = np.array([s for part in found or () if part["text_key"] == key for s in part["starts"]], np.int64)
            total.append(len(words))
            if copy and len(words) >= WINDOW:
                removed.append(len(words))
                texts.append(b"")
                continue
            if not len(starts):
                removed.append(0)
                texts.append(b" ".join(words))
                continue
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + WINDOW, -1)
            keep = (np.cumsum(steps)[:-1] == 0).tolist()
            removed.append(len(words) - sum(keep))
            texts.append(b" ".join([w for w, k in zip(words, keep) if k]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def copies_of(known: DataFrame) -> DataFrame:
    """(doc_id, copies): keys of a document's texts that a smaller document has whole."""
    rows = known.select("doc_id", "text_key", F.unhex(F.md5("text")).alias("digest"))
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    # Written first, so that both sides of the join are plain shuffles and a hot text is split.
    found = rows.join(materialize(classes, "text-classes"), "digest").filter("doc_id > first")
    return found.groupBy("doc_id").agg(F.collect_set("text_key").alias("copies"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row: its words that no repeated window covers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.hash("text"))
    known = rows.filter("doc_id is not null")
    copies = copies_of(known)
    firsts = known.join(copies, "doc_id", "left").filter("copies is null or not array_contains(copies, text_key)")
    found = firsts.select("doc_id", "text").mapInArrow(_seed_rows, "k long, doc_id long, place long")
    # A group has at most a row per slice of text.
    repeated = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))).filter("n > 1 or place % 2 = 1")
    positions = repeated.groupBy("doc_id").agg(F.collect_list((F.shiftright("place", 1)).cast("int")).alias("positions"))
    windows = known.join(positions, "doc_id").mapInArrow(_window_rows, "k long, check int, start int, doc_id long, text_key int, more array<int>")
    gone = windows.withColumn("least", F.min("doc_id").over(Window.partitionBy("k", "check"))).filter(f"check = {SETTLED} or doc_id > least")
    own = F.when(F.col("check") == SETTLED, F.col("more")).otherwise(F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<int>"))))
    removed = gone.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list(own)).alias("starts"))
    removed = removed.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "starts")).alias("removed"))
    done = known.join(removed, "doc_id", "left").join(copies, "doc_id", "left")
    none = rows.filter("doc_id is null").withColumns({"removed": F.lit(None).cast(removed.schema["removed"].dataType), "is_copy": F.lit(False)})
    done = done.withColumn("is_copy", F.coalesce(F.array_contains("copies", F.col("text_key")), F.lit(False)))
    wanted = ["doc_id", "text", "text_key", "removed", "is_copy"]
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return done.select(*wanted).mapInArrow(_kept, schema).unionByName(none.select(*wanted).mapInArrow(_kept, schema))
