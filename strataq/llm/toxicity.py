"""Toxicity scores by a factorisation machine over hashed terms.

score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>), over the distinct terms of a text, so
that two terms together can weigh what neither does alone. Terms are 32-bit hashes of words without
case; the machine keeps the FEATURES that tell most (chi-square) in the sample it is fitted on.

Labels are learnt from at most SAMPLE_ROWS labelled rows, chosen by a hash of their ids; they are the
only bounded part. Their whole texts are coded in parallel and their terms counted by Spark; one task
fits the machine on the chosen terms alone. Every whole text is scored, in place, by a broadcast model
of fixed size.

Nulls, empty and long texts: a null or empty text has the bias alone; long texts are scored whole.
Labels other than 0 and 1 are ignored; repeated rows get equal scores, and each learns for itself if it
is labelled; of terms that tell equally much those of least code are chosen; a null doc_id stays null
and is not held out. Without labelled rows every score is 0.5. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .terms import codes_of

SAMPLE_ROWS, FEATURES, FACTORS = 18_000, 4096, 8
LEAST_ROWS = 6  # of the sample that have a feature
EPOCHS, STEPS, BATCH, RATE, DECAY = 30, 2000, 256, 0.02, 5e-5  # epochs, or more for so many steps at least
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Machine:
    bias: float
    terms: np.ndarray  # sorted codes
    weights: np.ndarray
    factors: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        codes, borders = codes_of(texts)
        logit = np.full(n, self.bias, np.float64)
        if len(self.terms) and len(codes):
            at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
            hit = np.flatnonzero(self.terms[at] == codes)
            text = np.searchsorted(borders, hit, side="right") - 1
            pairs = np.unique(text * len(self.terms) + at[hit])
            text, term = np.divmod(pairs, len(self.terms))
            heads = np.flatnonzero(np.diff(text, prepend=-1))
            if len(heads):
                logit[text[heads]] += _logits(term, heads, self.weights, self.factors)[0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _logits(term: np.ndarray, heads: np.ndarray, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits without bias, and summed factors, of rows whose terms begin at heads."""
    v = factors[term]
    summed = np.add.reduceat(v, heads, axis=0)
    pairs = 0.5 * ((summed**2).sum(axis=1) - np.add.reduceat((v**2).sum(axis=1), heads))
    return np.add.reduceat(weights[term], heads) + pairs, summed


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, seed: int = 3) -> Machine:
    """Fit on rows of distinct codes, all among some sorted terms, and labels 0 or 1."""
    n, positives = len(rows), float(labels.sum())
    bias = float(np.log((positives + 0.5) / (n - positives + 0.5)))
    if not n or positives in (0, n) or not len(terms):
        return Machine(bias, np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    sizes = np.array([len(r) for r in rows])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    term = np.searchsorted(terms, np.concatenate(rows))
    rng = np.random.default_rng(seed)
    b, w, v = np.array([bias]), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (b, w, v)]
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS // -(-n // BATCH)))):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            counts = begin[own + 1] - begin[own]
            some = own[counts > 0]
            logit = np.full(len(own), b[0])
            grads = [np.zeros(1), DECAY * w, DECAY * v]
            if len(some):
                counts_some = counts[counts > 0]
                heads = np.cumsum(counts_some) - counts_some
                places = np.repeat(begin[some] - heads, counts_some) + np.arange(counts_some.sum())
                idx = term[places]
                value, summed = _logits(idx, heads, w, v)
                logit[counts > 0] += value
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own]) / len(own)
            grads[0][0] = error.sum()
            if len(some):
                e = np.repeat(error[counts > 0], counts_some)
                np.add.at(grads[1], idx, e)
                np.add.at(grads[2], idx, e[:, None] * (np.repeat(summed, counts_some, axis=0) - v[idx]))
            step += 1
            for p, g, (m, s) in zip((b, w, v), grads, state):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(float(b[0]), terms, w, v)


def _row_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct codes of each text, as a list."""
    for batch in slices(batches, "text"):
        codes, borders = codes_of(batch.column("text"))
        found = [np.unique(codes[a:b]) for a, b in zip(borders[:-1], borders[1:])]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], names=["doc_id", "label", "codes"])


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, label, codes) of the texts of SAMPLE_ROWS labels at most, none of them held out, written."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    picked = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")  # SAMPLE_ROWS at most
    return materialize(rows.mapInArrow(_row_codes, "doc_id long, label int, codes array<long>"), "toxicity-sample")


def telling_terms(sample: DataFrame) -> DataFrame:
    """(code, have, both) of the FEATURES terms with the largest chi-square; of equal ones the least codes."""
    total = sample.agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("double").alias("positives")).first()
    n, positives = total["n"], total["positives"]
    if not n or positives in (0, n):
        return sample.sparkSession.createDataFrame([], "code long, have double, both double")
    terms = sample.select("label", F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).cast("double").alias("have"), F.sum("label").cast("double").alias("both"))
    chance = F.col("have") * (positives / n)
    chi = (F.col("both") - chance) ** 2 / chance + (F.col("both") - chance) ** 2 / (F.col("have") - chance)
    return terms.filter(F.col("have") >= LEAST_ROWS).withColumn("chi", chi).filter("chi > 0").orderBy(F.desc("chi"), "code").limit(FEATURES).drop("chi")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit a machine on labelled rows that are not held out.

    Texts are read and coded in parallel, terms are counted by Spark, and one task fits the machine on
    what the features leave of the sample: SAMPLE_ROWS rows of FEATURES codes at most.
    """
    sample = sample_rows(docs, labels, id_col, text_col, label_col)
    wanted = np.sort(telling_terms(sample).toPandas()["code"].to_numpy(np.int64))  # FEATURES at most

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("codes")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
            held = np.isin(flat, wanted)
            ends = np.concatenate(([0], np.cumsum(held)))[ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[held]))], names=["doc_id", "label", "codes"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((d, l, c) for b in batches for d, l, c in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), b.column("codes").to_pylist()))
        machine = fit_machine([np.array(c, np.int64) for _, _, c in seen], np.array([l for _, l, _ in seen], np.float64), wanted)
        yield pa.RecordBatch.from_pydict({"bias": [machine.bias], "terms": [machine.terms.tobytes()], "weights": [machine.weights.tobytes()], "factors": [machine.factors.tobytes()]})

    kept = sample.mapInArrow(keep, "doc_id long, label int, codes array<long>")
    # Repeated ids make more rows of so many labels; the top-k, in one task, keeps the bound.
    kept = kept.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("codes")).limit(SAMPLE_ROWS)
    found = kept.mapInArrow(fit, "bias double, terms binary, weights binary, factors binary").first()
    if found is None:
        return fit_machine([], np.empty(0), wanted)
    return Machine(found["bias"], np.frombuffer(found["terms"], np.int64), np.frombuffer(found["weights"]), np.frombuffer(found["factors"]).reshape(-1, FACTORS))


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(shared.value.score(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
