"""Masked pseudo-likelihood scores of documents.

A small window network predicts every token from SIDE tokens on either side of it: their embeddings,
scaled by position, are summed and squashed, and a two-level softmax gives the token's class and its
place in the class. A document's score is the sum of these conditional log-probabilities.

Tokens are words without case. The HEAD most frequent of the whole corpus have ids of their own; the
other ids are groups of rarer words (bands of frequency for the KNOWN most frequent, hashes for the
rest), and a word of a group has the group's probability times its share of the group's count. So every
word of the corpus has a probability of its own, and these sum to one. Counts come from all documents.
The driver and the tasks hold KNOWN counts at most and one network; the counts of rarer words stay a table,
which grows with the corpus and meets the rarer words of the documents in a join by word.

The network starts as the corpus's unigram model and is trained in numpy, in ROUNDS rounds, on all
documents: every task trains on its own part, then Spark averages the networks, weighted by tokens,
over two levels of groups. Texts are coded once, into a table that all passes read.

Nulls, empty and long texts: a null or empty text has no tokens, log_prob 0 and no mean; long texts are
scored whole. Repeated rows get equal scores; words of equal counts (ties) have ids in order of their
codes; null doc_ids stay null; an empty table gives no rows. A word that the corpus lacks counts as half
a word. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .terms import codes_of

SIDE, DIM = 2, 16
CLASSES = MEMBERS = 100
#: Tokens; ids that stand for bands of the known words, and for hashes of the others; known words at most.
VOCAB, BANDS, HASHED, KNOWN = CLASSES * MEMBERS, 96, 32, 1 << 17
HEAD = VOCAB - BANDS - HASHED
ROUNDS, RATE = 1, 0.08
#: Batches grow with the tokens that a task has seen.
FIRST_BATCH, BATCH, GROWTH = 256, 8192, 16
#: Distinct words that a task counts before it sends them on; tokens scored at once.
COUNTED, PART = 1_000_000, 1 << 16
#: Bytes of text, and of codes, that a task holds decoded at once.
TEXTS, CODED = 4 << 20, 2 << 20
#: Tokens whose class logits fit in the processor's cache.
CACHED = 2048
BLOCK, LANES = 1 << 14, 32
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, codes) of every text, written: its words as little-endian 32-bit codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", TEXTS):
            codes, borders = codes_of(batch.column("text"))
            raw = codes.astype("<u4")
            found = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(4 * borders.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id"), found.cast(pa.binary())], names=["row", "doc_id", "codes"])
            row += batch.num_rows

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return materialize(rows.mapInArrow(run, "row long, doc_id long, codes binary"), "coded")


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, borders) of coded texts."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0]) if data is not None else np.empty(0, "<u4")), (offsets - offsets[0]) // 4


def word_counts(rows: DataFrame) -> DataFrame:
    """(code, n) of every distinct word of coded texts; tasks add up their own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        for batch in slices(batches, "codes", CODED):
            new, n = np.unique(_codes(batch.column("codes"))[0], return_counts=True)
            both, back = np.unique(np.concatenate((codes, new)), return_inverse=True)
            codes, counts = both, np.bincount(back, np.concatenate((counts, n)), len(both)).astype(np.int64)
            if len(codes) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])
                codes, counts = codes[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])

    return rows.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Network:
    head: int  # words with ids of their own
    codes: np.ndarray  # sorted codes of the known words
    ids: np.ndarray  # their token ids
    share: np.ndarray  # log of their share of their token's count
    rest: np.ndarray  # log counts of the HASHED tokens of all other words
    begin: np.ndarray  # codes below each 20-bit prefix
    embed: np.ndarray  # VOCAB + 1 rows; the last one, beyond a text's ends, stays zero
    place: np.ndarray  # scale of each position
    classes: np.ndarray  # CLASSES x DIM
    class_bias: np.ndarray
    members: np.ndarray  # CLASSES x MEMBERS x DIM
    member_bias: np.ndarray

    @property
    def params(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.classes, self.class_bias, self.members, self.member_bias]

    def with_params(self, params: list[np.ndarray]) -> Network:
        return Network(self.head, self.codes, self.ids, self.share, self.rest, self.begin, *params)

    def tokens(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and the places of words among the known ones (-1 for others)."""
        at = np.full(len(codes), -1, np.int32)
        if len(self.codes):
            prefix = codes >> np.uint32(12)
            look, end = self.begin[prefix], self.begin[prefix + np.uint32(1)]
            for i in range(int(np.diff(self.begin).max())):
                held = look + i < end
                held[held] = self.codes[look[held] + i] == codes[held]
                at[held] = look[held] + i
        ids = np.where(at >= 0, self.ids[at] if len(self.ids) else 0, self.head + BANDS + (codes % HASHED).astype(np.int32))
        return ids.astype(np.int32), at

    def hidden(self, around: list[np.ndarray]) -> np.ndarray:
        """From the embeddings of the tokens around."""
        total = around[0] * self.place[0]
        for rows, scale in zip(around[1:], self.place[1:]):
            total += rows * scale
        return np.tanh(total, out=total)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probabilities of tokens in their contexts."""
        order = np.argsort(target, kind="stable")  # so that a class's tokens lie side by side
        target = target[order]
        context = context[order]
        hidden = np.ascontiguousarray(self.hidden([self.embed[c] for c in context.T]).T)
        group, member = np.divmod(target, MEMBERS)
        at = np.arange(len(target))
        found = np.empty(len(target), np.float32)
        for a in range(0, len(target), CACHED):
            b = min(a + CACHED, len(target))
            found[a:b] = _log_share(self.classes @ hidden[:, a:b] + self.class_bias[:, None], group[a:b], at[: b - a])
        borders = np.searchsorted(group, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(borders)):
            a, b = borders[c], borders[c + 1]
            found[a:b] += _log_share(self.members[c] @ hidden[:, a:b] + self.member_bias[c][:, None], member[a:b], at[: b - a])
        out = np.empty_like(found)
        out[order] = found
        return out


def _log_share(logits: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log of the softmax down the columns; logits of a network stay far from where exp ends."""
    own = logits[row, column]
    np.exp(logits, out=logits)
    return own - np.log(logits.sum(axis=0))


def _errors(logits: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(errors of a softmax along rows times the sums of each row, the sums' inverses)."""
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    logits[np.arange(len(goal)), goal] -= total
    return logits, 1 / total


def start_network(codes: np.ndarray, counts: np.ndarray, rest: np.ndarray, head: int = HEAD, known: int = KNOWN) -> Network:
    """The unigram model of the known words, by falling count, and of the hashed tokens' counts."""
    rng = np.random.default_rng(1)
    ids = np.arange(len(codes), dtype=np.int64)
    ids[head:] = head + (ids[head:] - head) * BANDS // (known - head)
    n = np.bincount(ids, counts, VOCAB)
    share = np.log(counts / n[ids]) if len(ids) else np.empty(0)
    n[head + BANDS : head + BANDS + HASHED] = rest
    logs = np.log(n + 0.5).reshape(CLASSES, MEMBERS)
    order = np.argsort(codes)
    begin = np.searchsorted(codes[order], np.arange((1 << 20) + 1, dtype=np.int64) << 12).astype(np.int32)
    embed = rng.normal(0, 0.1, (VOCAB + 1, DIM)).astype(np.float32)
    embed[VOCAB] = 0
    top = np.log(np.exp(logs).sum(axis=1))
    return Network(
        head, codes[order].astype(np.uint32), ids[order].astype(np.int32), share[order], np.log(np.maximum(rest, 0.5)), begin,
        embed, np.ones((len(OFFSETS), DIM), np.float32), np.zeros((CLASSES, DIM), np.float32), (top - top.max()).astype(np.float32),
        np.zeros((CLASSES, MEMBERS, DIM), np.float32), (logs - top[:, None]).astype(np.float32),
    )


def contexts(tokens: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The tokens at OFFSETS around each token, VOCAB beyond the text's ends."""
    n = len(tokens)
    out = np.full((n, len(OFFSETS)), VOCAB, np.int32)
    left = np.arange(n, dtype=np.int32) - np.repeat(borders[:-1], np.diff(borders)).astype(np.int32)
    right = np.repeat(borders[1:], np.diff(borders)).astype(np.int32) - np.arange(n, dtype=np.int32) - 1
    for j, o in enumerate(OFFSETS):
        a, b = max(0, -o), max(0, min(n, n - o))
        if b > a:
            same = (left[a:b] >= -o) if o < 0 else (right[a:b] >= o)
            out[a:b, j] = np.where(same, tokens[a + o : b + o], VOCAB)
    return out


def train(net: Network, context: np.ndarray, target: np.ndarray, state: list[np.ndarray], seen: int = 0) -> None:
    """One pass of Adagrad over some tokens, in place; a batch's tokens are sorted by class."""
    at = 0
    while at < len(target):
        to = at + min(BATCH, FIRST_BATCH + (seen + at) // GROWTH)
        goal = target[at:to]
        order = np.argsort(goal)
        goal, ctx, n = goal[order], context[at:to][order], len(goal)
        at = to
        around = [net.embed[c] for c in ctx.T]
        hidden = net.hidden(around)
        group, member = np.divmod(goal, MEMBERS)
        grads = [np.zeros_like(p) for p in net.params]
        back = np.empty_like(hidden)
        for a in range(0, n, CACHED):
            own = hidden[a : a + CACHED]
            error, scale = _errors(own @ net.classes.T + net.class_bias, group[a : a + CACHED])
            grads[2] += error.T @ (own * scale[:, None])
            grads[3] += error.T @ scale
            back[a : a + CACHED] = (error @ net.classes) * scale[:, None]
        borders = np.searchsorted(group, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(borders)):
            a, b = borders[c], borders[c + 1]
            error, scale = _errors(hidden[a:b] @ net.members[c].T + net.member_bias[c], member[a:b])
            grads[4][c], grads[5][c] = error.T @ (hidden[a:b] * scale[:, None]), error.T @ scale
            back[a:b] += (error @ net.members[c]) * scale[:, None]
        back *= 1 - hidden**2
        flat = (ctx.astype(np.int64)[:, :, None] * DIM + np.arange(DIM)).ravel()
        parts = np.multiply(back[:, None, :], net.place, dtype=np.float64)
        grads[0] = np.bincount(flat, parts.ravel(), (VOCAB + 1) * DIM).astype(np.float32).reshape(-1, DIM)
        for j in range(len(OFFSETS)):
            grads[1][j] = np.einsum("ij,ij->j", back, around[j])
        grads[0][VOCAB] = 0
        for p, g, s in zip(net.params, grads, state):
            g /= n
            s += g * g
            p -= RATE * g / (np.sqrt(s) + 1e-4)


def fit_network(rows: DataFrame, counts: DataFrame, head: int = HEAD, known: int = KNOWN) -> Network:
    """Start from the counts, then train and average in rounds over all coded texts."""
    # The least count from which words are known: from the numbers of words of like counts, a few hundred.
    like = F.floor(16 * F.log2("n"))
    steps = counts.groupBy(like.alias("like")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("like")).collect()
    held, least = 0, None
    for step in steps:
        held += step["words"]
        if held > known:
            break
        least = step["least"]
    top = counts.filter(F.col("n") >= least).toPandas().sort_values(["n", "code"], ascending=[False, True]) if least else pd.DataFrame({"code": [], "n": []})
    codes, n = top["code"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    sums = counts.groupBy((F.col("code") % HASHED).alias("k")).agg(F.sum("n").alias("n")).collect()  # HASHED rows
    rest = -np.bincount(codes % HASHED, n, HASHED)
    for r in sums:
        rest[r["k"]] += r["n"]
    net = start_network(codes, n, rest, head, known)
    sizes = [p.size for p in net.params]
    schema = "block int, lane int, weight double, part binary"
    for _ in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            net = shared.value.with_params([p.copy() for p in shared.value.params])
            state, seen = [np.zeros_like(p) for p in net.params], 0
            for batch in slices(batches, "codes", CODED):
                codes, borders = _codes(batch.column("codes"))
                tokens = net.tokens(codes)[0]
                mixed = np.random.default_rng(seen).permutation(len(tokens))
                train(net, contexts(tokens, borders)[mixed], tokens[mixed], state, seen)
                seen += len(tokens)
            if seen:
                flat = np.concatenate([p.ravel() for p in net.params]).astype("<f8") * seen
                lane = TaskContext.get().partitionId() % LANES
                parts = [flat[i : i + BLOCK].astype("<f4").tobytes() for i in range(0, len(flat), BLOCK)]
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(parts)), pa.int32()), "lane": pa.array([lane] * len(parts), pa.int32()), "weight": [float(seen)] * len(parts), "part": parts})

        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight, block = None, 0.0, None
            for batch in parts:  # in turn: a group's parts are never all held
                for b, w, raw in zip(batch.column("block").to_pylist(), batch.column("weight").to_pylist(), batch.column("part").to_pylist()):
                    found = np.frombuffer(raw, "<f4").astype(np.float64)
                    total, weight, block = found if total is None else total + found, weight + w, b
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "lane": pa.array([0], pa.int32()), "weight": [weight], "part": [total.astype("<f4").tobytes()]})

        sums = rows.select("codes").mapInArrow(run, schema).groupBy("block", "lane").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).toPandas().sort_values("block")
        shared.unpersist()
        if not len(sums):
            break
        flat = np.concatenate([np.frombuffer(raw, "<f4") / w for raw, w in zip(sums["part"], sums["weight"])])
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        net = net.with_params([p.reshape(old.shape).astype(np.float32) for p, old in zip(parts, net.params)])
    return net


def score_coded(rows: DataFrame, net: Network, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_prob) of every coded text."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "codes", CODED):
            codes, borders = _codes(batch.column("codes"))
            tokens, at = net.tokens(codes)
            around = contexts(tokens, borders)
            logs = [net.log_probs(around[i : i + PART], tokens[i : i + PART]) for i in range(0, len(tokens), PART)]
            logs = np.concatenate(logs).astype(np.float64) if logs else np.empty(0)
            logs += np.where(at >= 0, net.share[at] if len(net.share) else 0.0, -net.rest[codes % HASHED])
            sums = np.concatenate(([0.0], np.cumsum(logs)))
            rare = at < 0
            ends = np.concatenate(([0], np.cumsum(rare)))[borders].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes[rare].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.diff(borders)), pa.array(sums[borders[1:]] - sums[borders[:-1]]), lists], names=["row", "doc_id", "n_tokens", "log_prob", "rare"])

    scored = materialize(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, log_prob double, rare array<long>"), "scores")
    # Words beyond the known ones: few to a text, and none of them hot.
    words = scored.select("row", F.explode("rare").alias("code")).groupBy("row", "code").agg(F.count(F.lit(1)).alias("times"))
    logs = words.join(counts, "code", "left").groupBy("row").agg(F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(0.5)))).alias("more"))
    return scored.join(logs, "row", "left").select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob"))


def score_documents(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob) of every row of docs, by a model of the corpus (docs itself if None)."""
    rows = coded(docs, id_col, text_col)
    known = rows if corpus is None else coded(corpus, id_col, text_col)
    counts = materialize(word_counts(known), "word-counts")  # read three times
    return score_coded(rows, fit_network(known, counts), counts)
