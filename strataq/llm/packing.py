"""Vector bin packing of examples into training sequences.

Every example has three demands: tokens, one segment, and loss-bearing tokens. A sequence has a limit
for each. An open sequence takes, among the examples that fit in all three, the one with the largest
dot product of its demands with the room left (each as a share of its limit). When none fits and
tokens are left, one example is cut to fill them; examples longer than a sequence are cut first.
Only sequences of the full length, or of a power of two, are closed: a sequence that a limit or the
last example of a task leaves short is trimmed to a power of two and its end goes into the next one,
so no sequence needs padding.

Each task packs its own partition, in groups bounded by rows and tokens; what a group leaves over goes
to the next, so nothing is shuffled and a lost task is packed alike again.

Nulls, empty and long texts: a null or empty text is an example of the end id alone; long texts are
cut. Of examples with equal dot products (ties) the first in the partition is taken. A repeated row is packed again; a null doc_id stays null. An empty table gives no rows. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import ENCODED_BYTES, encoder

#: Limits of one sequence, each of which binds on ordinary texts: a sequence of many short examples has its
#: segments full first, one of examples without much context its loss-bearing tokens.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 24, 3072
#: Where no prompt is given, the share of an example's ids, from its start, that are context without loss.
CONTEXT = 0.25
#: Examples and tokens that a task packs together.
GROUP_ROWS, GROUP_TOKENS = 2048, 2 << 20

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def pack_lengths(tokens: np.ndarray, loss: np.ndarray, caps: tuple[int, int, int], last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Place examples; an example's loss-bearing tokens are its last ones.

    Returns (sequences, left): a sequence lists pieces (example, start, length); left lists
    (example, start) of rests that the next group packs (none if last).
    """
    cap_t, cap_s, cap_l = caps
    if min(caps) < 1:
        raise ValueError("each limit of a sequence is 1 or more")
    length, bearing = tokens.astype(np.int64).copy(), loss.astype(np.int64).copy()
    start = np.zeros(len(length), np.int64)
    out: list[list[tuple[int, int, int]]] = []

    def cut(i: int, room_t: int, room_l: int) -> tuple[int, int]:
        """The longest prefix of rest i within both limits, and its loss-bearing tokens."""
        silent = int(length[i] - bearing[i])
        n = min(int(length[i]), room_t, silent + room_l)
        return n, max(0, n - silent)

    def take(i: int, n: int, borne: int) -> tuple[int, int, int]:
        piece = (i, int(start[i]), n)
        start[i] += n
        length[i] -= n
        bearing[i] -= borne
        return piece

    for i in np.flatnonzero(length > cap_t):
        while length[i] > cap_t:
            n, borne = cut(i, cap_t, cap_l)
            if n < cap_t:
                break
            out.append([take(int(i), n, borne)])
    while length.any():
        pieces: list[tuple[int, int, int]] = []
        borne_by: list[int] = []
        t, s, b = cap_t, cap_s, cap_l
        while t and s:
            fits = (length > 0) & (length <= t) & (bearing <= b)
            if fits.any():
                dot = length * (t / cap_t**2) + s / cap_s**2 + bearing * (b / cap_l**2)
                i = int(np.argmax(np.where(fits, dot, -1.0)))
                n, borne = int(length[i]), int(bearing[i])
            elif length.any():
                i = int(np.argmax(np.minimum(np.minimum(length, t), length - bearing + b)))
                n, borne = cut(i, t, b)
                if not n:
                    break
            else:
                break
            pieces.append(take(i, n, borne))
            borne_by.append(borne)
            t, s, b = t - n, s - 1, b - borne
        size = cap_t - t
        wanted = cap_t if not t else 1 << (size.bit_length() - 1)
        if t and not last and not length.any():
            wanted = 0  # the next group fills it
        while size > wanted:
            i, at, n = pieces.pop()
            borne = borne_by.pop()
            back = min(n, size - wanted)
            size -= back
            start[i] -= back
            length[i] += back
            bearing[i] += min(back, borne)
            if back < n:
                pieces.append((i, at, n - back))
                borne_by.append(borne - min(back, borne))
        if not wanted:
            break
        out.append(pieces)
    return out, [(int(i), int(start[i])) for i in np.flatnonzero(length)]


def pack_examples(docs: DataFrame, vocabulary: str, byte_level: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, context: float = CONTEXT) -> DataFrame:
    """Encode texts and pack them: one row per piece, with its ids (little-endian unsigned 32 bit).

    prompt_col: text put before text_col that bears no loss (instruction data); a null is empty.
    Without it the first share (context) of an example's ids is context that bears none.
    """
    caps = (max_tokens, max_segments, max_loss)
    if min(caps) < 1:
        raise ValueError("each limit of a sequence is 1 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, made = encoder(vocabulary, byte_level), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray, int, int]] = []  # id, ids, first bearing loss, start

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal made, held
            n = np.array([len(h[1]) - h[3] for h in held], np.int64)
            loss = np.array([len(h[1]) - max(h[2], h[3]) for h in held], np.int64)
            sequences, left = pack_lengths(n, loss, caps, last)
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset")}
            for sequence in sequences:
                offset = 0
                for i, at, size in sequence:
                    doc, ids, silent, base = held[i]
                    a = base + at
                    values = (doc, a, size, ids[a : a + size].tobytes(), len(ids), max(0, a + size - max(a, silent)), (part << 36) | made, offset)
                    for column, value in zip(rows.values(), values):
                        column.append(value)
                    offset += size
                made += 1
            held = [(*held[i][:3], held[i][3] + at) for i, at in left]
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.binary() if k == "ids" else pa.int64()) for k in rows]))

        tokens = 0
        for batch in slices(batches, "text", ENCODED_BYTES):
            ids, borders = enc.encode(batch.column("text"), end_id)
            firsts = (np.diff(borders) * context).astype(np.int64)
            if prompt_col:
                prompt, cuts = enc.encode(batch.column("prompt"), end_id)
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = ids[borders[k] : borders[k + 1]].astype("<u4")
                if prompt_col:
                    own = np.concatenate((prompt[cuts[k] : cuts[k + 1] - 1], own)).astype("<u4")
                    firsts[k] = cuts[k + 1] - cuts[k] - 1
                held.append((doc, own, int(firsts[k]), 0))
                tokens += len(own)
                if len(held) >= GROUP_ROWS or tokens >= GROUP_TOKENS:
                    yield flush(False)
                    tokens = sum(len(h[1]) - h[3] for h in held)
        if held:
            yield flush(True)

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    return docs.select(*columns, *([F.col(prompt_col).alias("prompt")] if prompt_col else [])).mapInArrow(run, SCHEMA)
