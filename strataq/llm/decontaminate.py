"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms over all documents give the IDF weights.
2. Passages are cut into chunks of at most CHUNK words. A distributed randomised SVD of all chunks' unit
   TF-IDF rows gives one latent space of RANK dimensions, a third of the chunks at most: each task
   multiplies its chunks with a random matrix and back, Spark sums the parts, and two passes and a small
   factorisation give the basis. Words that stand in like passages lie close together there, so a
   paraphrase that keeps few rare words is found by its neighbours. Terms that no passage has weigh
   nothing.
3. Windows of several lengths over every document are searched by cosine in that space, relative to what
   a copy of the chunk has there, so that a chunk which the space holds in part is found as well as
   one that it holds in full. Windows with too small a part in benchmark terms are passed over without
   projecting them.
4. Around each candidate, the longest common subsequence of words with the whole passage, and the
   passage's answer (its last words, if the table has no answer column), decide.

Passages of fewer than MIN_WORDS words give no vector to speak of: they are searched as exact word
sequences. Benchmark chunks are broadcast in blocks of BLOCK_ROWS, each a pass over the documents.
Nothing of a document is shuffled.

Nulls, empty and long texts: a null or empty text or passage has no words and no match; long texts and
long passages are searched whole. A null item_id is an item of its own; repeated rows give repeated
results, on either side, and null doc_ids stay null; of equally good places in a document (ties) the
later one is given; empty tables on either side give none. Other columns pass the filter unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .terms import codes_of

TERMS = 1 << 16
RANK, OVERSAMPLE, SHARE = 64, 8, 3  # dimensions at most; a SHARE-th of the chunks at most
#: Words of a chunk at most; chunks that are broadcast together.
CHUNK, BLOCK_ROWS = 64, 16_384
SVD_BLOCK = 1024  # terms whose rows one group of the sums holds
#: Lengths of windows, each an even number of parts whose sums they share.
WINDOWS, PART = (16, 32, 64), 8
#: A window's least part in benchmark terms, its least cosine relative to a copy's, words of a vector.
MIN_OWN, MIN_COSINE, MIN_WORDS = 0.5, 0.5, 8
#: Shares of a passage's words in common order that decide alone, or with its answer.
MIN_LCS, MIN_LCS_ANSWER, ANSWER_WORDS = 0.8, 0.6, 5


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many rows have each hashed term, and the number of rows; the driver gets TERMS sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(TERMS + 1, np.int64), 0
        for batch in slices(batches, "text"):
            codes, borders = codes_of(batch.column("text"))
            text = np.repeat(np.arange(batch.num_rows), np.diff(borders))
            kind = np.uint32 if batch.num_rows * TERMS < 1 << 32 else np.int64
            pairs = np.sort(text.astype(kind) * kind(TERMS) + (codes & (TERMS - 1)).astype(kind))
            distinct = pairs[np.flatnonzero(np.diff(pairs, prepend=pairs[:1] + kind(1)))]
            found += np.bincount(distinct % TERMS, minlength=TERMS + 1)
            found[TERMS] += batch.num_rows
        full = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(found[full])], names=["term", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(TERMS + 1, np.int64)
    found[sums["term"]] = sums["n"]
    return found[:TERMS], int(found[TERMS])


def idf_of(frequencies: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (frequencies + 0.5)).clip(0.01).astype(np.float32)


def chunks_of(n: int) -> list[tuple[int, int]]:
    """Borders of the chunks of n words: as few as cover them, of nearly equal length."""
    edges = [round(i * n / -(-n // CHUNK)) for i in range(-(-n // CHUNK) + 1)] if n else []
    return list(zip(edges[:-1], edges[1:]))


def _row_of(codes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, TF-IDF weights of unit length) of some words."""
    terms, counts = np.unique(codes & (TERMS - 1), return_counts=True)
    weights = counts * idf[terms]
    return terms, weights / max(float(np.linalg.norm(weights)), 1e-9)


def _rows_of(texts: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, TF-IDF weights of unit length) of each chunk of each passage that has a vector."""
    codes, borders = codes_of(texts)
    spans = zip(borders[:-1], borders[1:])
    return [_row_of(codes[a + i : a + j], idf) for a, b in spans if b - a >= MIN_WORDS for i, j in chunks_of(int(b - a))]


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(terms, rows): a basis of the TF-IDF rows of the passages' chunks (column text), largest
    components first; a row for each term that some chunk has."""
    wide = rank + OVERSAMPLE
    schema = "block int, terms binary, part binary"

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SVD_BLOCK, wide))
        for batch in parts:  # in turn: a block's parts are never all held
            for terms, raw in zip(batch.column("terms").to_pylist(), batch.column("part").to_pylist()):
                total[np.frombuffer(terms, "<i4") % SVD_BLOCK] += np.frombuffer(raw, "<f4").reshape(-1, wide)
        used = np.flatnonzero(total.any(axis=1))
        block = key[0].as_py()
        yield _part(block, block * SVD_BLOCK + used, total[used])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = np.random.default_rng(seed).standard_normal((TERMS, wide), np.float32)  # alike in every task
        for batch in slices(batches, "text", 1 << 20):
            rows = _rows_of(batch.column("text"), idf)
            terms = np.unique(np.concatenate([t for t, _ in rows] or [np.empty(0, np.int64)]))
            out = np.zeros((len(terms), wide))
            for t, w in rows:
                out[np.searchsorted(terms, t)] += np.outer(w, w @ omega[t])
            for block in np.unique(terms // SVD_BLOCK):
                own = terms // SVD_BLOCK == block
                yield _part(int(block), terms[own], out[own])

    texts = passages.select("text")
    found = texts.mapInArrow(ranged, schema).groupBy("block").applyInArrow(add, schema).toPandas()
    if not len(found):
        return np.empty(0, np.int64), np.empty((0, rank), np.float32)
    terms = np.concatenate([np.frombuffer(t, "<i4") for t in found["terms"]]).astype(np.int64)
    rows = np.concatenate([np.frombuffer(r, "<f4").reshape(-1, wide) for r in found["part"]])
    order = np.argsort(terms)
    terms, q = terms[order], np.linalg.qr(rows[order].astype(np.float64))[0].astype(np.float32)
    deep = q.shape[1]

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            projected = np.array([w @ q[np.searchsorted(terms, t)] for t, w in _rows_of(batch.column("text"), idf)]).reshape(-1, deep)
            yield pa.RecordBatch.from_pydict({"part": [(projected.T @ projected).astype("<f8").tobytes()]})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((deep, deep))
        for batch in batches:
            for raw in batch.column("part").to_pylist():
                out += np.frombuffer(raw).reshape(deep, deep)
        yield pa.RecordBatch.from_pydict({"part": [out.tobytes()]})

    square = np.zeros((deep, deep))
    for row in texts.mapInArrow(squared, "part binary").repartition(8).mapInArrow(total, "part binary").collect():  # deep x deep numbers each
        square += np.frombuffer(row["part"]).reshape(deep, deep)
    vectors = np.linalg.eigh(square)[1][:, ::-1][:, :rank].astype(np.float32)
    return terms, q @ vectors


def _part(block: int, terms: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "terms": [terms.astype("<i4").tobytes()], "part": [rows.astype("<f4").tobytes()]})


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, by bits: one addition per word of b."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Space:
    """Weights of terms and the latent space of all chunks."""

    idf: np.ndarray
    slot: np.ndarray  # term -> row of vectors, 0 if no passage has it
    vectors: np.ndarray  # IDF times basis, for terms of the passages

    def place(self, codes: np.ndarray) -> np.ndarray:
        return self.vectors[self.slot[codes & (TERMS - 1)]].sum(axis=0)


@dataclass
class Index:
    """A block of benchmark passages in latent space."""

    space: Space
    items: list[int | None]
    codes: list[list[int]]
    answers: list[list[int]]
    item_of: np.ndarray  # of each chunk
    latent: np.ndarray  # rows of chunks, each divided by its squared length there
    short: dict[int, list[int]]  # first word -> passages of fewer than MIN_WORDS words

    def search(self, codes: np.ndarray, borders: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, passage, relative cosine, first word, end) of all windows near a passage."""
        terms = codes & (TERMS - 1)
        slots, energy = self.space.slot[terms], self.space.idf[terms].astype(np.float64) ** 2
        lengths = np.diff(borders)
        n_blocks = -(-lengths // PART)
        first = np.concatenate(([0], np.cumsum(n_blocks)))
        inner = np.arange(first[-1]) - np.repeat(first[:-1], n_blocks)
        begin = np.repeat(borders[:-1], n_blocks) + inner * PART
        end = np.minimum(begin + PART, np.repeat(borders[1:], n_blocks))
        edge = np.append(begin, len(codes))  # texts lie side by side, so a part ends where the next begins
        all_of = np.concatenate(([0.0], np.cumsum(energy)))[edge]
        own_of = np.concatenate(([0.0], np.cumsum(np.where(slots > 0, energy, 0.0))))[edge]
        found = []
        for size in WINDOWS:
            m = size // PART
            # Windows at each half length; the last one of a text ends with it.
            counts = np.where(n_blocks <= m, (n_blocks > 0) & (size == WINDOWS[0]), -(-(n_blocks - m) // (m // 2)) + 1)
            text = np.repeat(np.arange(len(lengths)), counts)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
            a = first[text] + nth * (m // 2)
            b = np.minimum(a + m, first[text + 1])
            whole = all_of[b] - all_of[a]
            near = np.flatnonzero(own_of[b] - own_of[a] >= MIN_OWN**2 * whole)
            for at in range(0, len(near), 16_384):
                part = near[at : at + 16_384]
                needed = np.unique((a[part][:, None] + np.arange(m)[None, :])[np.arange(m)[None, :] < (b - a)[part][:, None]])
                sums = self._sums(slots, begin[needed], end[needed])
                vectors = np.zeros((len(part), sums.shape[1]), np.float32)
                for j in range(m):
                    own = np.flatnonzero(a[part] + j < b[part])
                    vectors[own] += sums[np.searchsorted(needed, a[part][own] + j)]
                cosine = vectors @ self.latent.T / np.sqrt(np.maximum(whole[part], 1e-9))[:, None]
                i, j = np.nonzero(cosine >= MIN_COSINE)
                w = part[i]
                found += zip(text[w].tolist(), self.item_of[j].tolist(), cosine[i, j].tolist(), begin[a[w]].tolist(), end[b[w] - 1].tolist())
        return found

    def _sums(self, slots: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Summed latent vectors of parts of texts; only words that some passage has add to them."""
        out = np.zeros((len(begin), self.space.vectors.shape[1]), np.float32)
        for j in range(PART):
            own = np.flatnonzero(begin + j < end)
            rows = slots[begin[own] + j]
            full = rows > 0
            out[own[full]] += self.space.vectors[rows[full]]
        return out

    def exact(self, codes: np.ndarray, borders: np.ndarray) -> list[tuple]:
        """The first place of each short passage in each text."""
        if not self.short:
            return []
        firsts, found = np.sort(np.fromiter(self.short, np.int64)), {}
        at = np.flatnonzero(firsts[np.minimum(np.searchsorted(firsts, codes), len(firsts) - 1)] == codes)
        text = np.searchsorted(borders, at, side="right") - 1
        for i, t in zip(at.tolist(), text.tolist()):
            for j in self.short[int(codes[i])]:
                end = i + len(self.codes[j])
                if end <= borders[t + 1] and (t, j) not in found and codes[i:end].tolist() == self.codes[j]:
                    found[t, j] = (t, self.items[j], 1.0, 1.0, True, i - int(borders[t]), end - int(borders[t]))
        return list(found.values())

    def matches(self, codes: np.ndarray, borders: np.ndarray) -> list[tuple[int, int | None, float, float, bool, int, int]]:
        """(text, item, cosine, LCS share, answer found, first word, end) of each confirmed pair."""
        groups: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for text, j, cosine, a, b in self.search(codes, borders):
            groups.setdefault((text, j), []).append((cosine, a, b))
        out = self.exact(codes, borders)
        for (text, j), windows in groups.items():
            wanted, answer = self.codes[j], self.answers[j]
            first, end = int(borders[text]), int(borders[text + 1])
            regions: list[list[int]] = []
            for _, a, b in sorted(windows, key=lambda w: w[1]):
                a, b = max(first, a - len(wanted)), min(end, b + len(wanted))
                if regions and a <= regions[-1][1] and b - regions[-1][0] <= 6 * len(wanted) + 2 * WINDOWS[-1]:
                    regions[-1][1] = max(b, regions[-1][1])
                else:
                    regions.append([a, b])
            best = (-1.0, False, 0, 0)
            for a, b in regions:
                region = codes[a:b].tolist()
                share = lcs_length(wanted, region) / len(wanted)
                if share < MIN_LCS_ANSWER:
                    continue
                said = any(region[i : i + len(answer)] == answer for i in range(len(region) - len(answer) + 1)) if answer else False
                best = max(best, (share, said, a - first, b - first))
            share, said, a, b = best
            if share >= MIN_LCS or share >= MIN_LCS_ANSWER and said:
                out.append((text, self.items[j], min(1.0, max(w[0] for w in windows)), share, said, a, b))
        return out


def matches(index: Index, texts: pa.Array) -> list[tuple[int, int | None, float, float, bool, int, int]]:
    return sorted(index.matches(*codes_of(texts)), key=lambda m: m[:1])


def fit_space(passages: DataFrame, idf: np.ndarray) -> Space:
    """The latent space of all passages (column text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes = np.diff(codes_of(batch.column("text"))[1])
            yield pa.RecordBatch.from_pydict({"n": pa.array([int((-(-sizes[sizes >= MIN_WORDS] // CHUNK)).sum())], pa.int64())})

    n = passages.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    terms, basis = randomised_svd(passages, idf, min(RANK, max(1, n // SHARE)))
    slot = np.zeros(TERMS, np.int32)
    slot[terms] = np.arange(1, len(terms) + 1)
    vectors = np.zeros((len(terms) + 1, basis.shape[1]), np.float32)
    vectors[1:] = basis * idf[terms][:, None]
    return Space(idf, slot, vectors)


def index_of(space: Space, items: list[int | None], texts: list[str], answers: list[str | None]) -> Index:
    codes, borders = codes_of(pa.array(texts, pa.string()))
    spans = [codes[a:b] for a, b in zip(borders[:-1], borders[1:])]
    said = [codes_of(pa.array([x], pa.string()))[0].tolist() if isinstance(x, str) else s[-ANSWER_WORDS:].tolist() for s, x in zip(spans, answers)]
    short: dict[int, list[int]] = {}
    item_of, rows = [], []
    for j, s in enumerate(spans):
        if 0 < len(s) < MIN_WORDS:
            short.setdefault(int(s[0]), []).append(j)
        for a, b in chunks_of(len(s)) if len(s) >= MIN_WORDS else ():
            length = float(np.linalg.norm(space.idf[s[a:b] & (TERMS - 1)]))
            own = space.place(s[a:b]) / max(length, 1e-9)
            item_of.append(j)
            rows.append(own / max(float(own @ own), 1e-9))
    latent = np.array(rows, np.float32).reshape(-1, space.vectors.shape[1])
    return Index(space, items, [s.tolist() for s in spans], said, np.array(item_of, np.int64), latent, short)


def fit(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", passage_col: str = "text", answer_col: str | None = None) -> Iterator[Index]:
    """Indexes of all passages, a block at a time."""
    answer = F.col(f"`{answer_col}`") if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{passage_col}`").alias("text"), answer.alias("answer")).filter("text is not null")
    size = rows.agg(F.sum(F.ceil(F.char_length("text") / 256) + 1)).first()[0]  # about its chunks
    if not size:
        return
    frequencies, n = document_frequencies(docs, text_col)
    space = fit_space(rows, idf_of(frequencies, n))
    blocks = -(-size // BLOCK_ROWS)
    for k in range(blocks):
        frame = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()  # about BLOCK_ROWS chunks
        if frame:
            yield index_of(space, [r["item"] for r in frame], [r["text"] for r in frame], [r["answer"] for r in frame])


MATCH = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean, start_word long, end_word long"


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per document and benchmark passage that it holds, with where (words with letters or digits)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], MATCH)
    names = [x.split()[0] for x in MATCH.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
    for index in fit(docs, benchmark, text_col, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                found, ids = matches(shared.value, batch.column("text")), batch.column("doc_id").to_pylist()
                columns = list(zip(*((ids[f[0]], *f[1:]) for f in found))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        out = out.union(rows.mapInArrow(run, MATCH))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **columns) -> DataFrame:
    """The rows whose text holds no benchmark passage."""
    out, at = docs, docs.columns.index(text_col)
    for index in fit(docs, benchmark, text_col, **columns):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, at):
                hit = {f[0] for f in matches(shared.value, batch.column(at))}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
