"""Token ids of whole texts by a public tokenizer file, with the encoder run once per distinct part.

A text is cut where either pre-tokenizer's pattern has a border whatever stands around it: at single spaces
between two non-space characters, and between runs of plain letters, of digits, of ASCII punctuation and single
line breaks. These parts repeat a lot, so each distinct one is encoded once and the ids are gathered with numpy;
the ids equal those of the whole text. What lies between two spaces stays one part if it has any other character
(an apostrophe, which the patterns join to letters; letters beyond Latin-1; marks) or more than single line breaks
within. Texts where a space touches other white space (where the pattern looks across the border) are encoded whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bytewords import offsets_of
from .common import ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
from tokenizers import Tokenizer  # noqa: E402

_W = r"[\s\v\x{85}\x{1c}-\x{1f}\p{Z}]"
_WHOLE = f"{_W} {_W}|{_W} $|  "
# Classes of bytes: a space, letters, digits, punctuation, line breaks, and all others.
_SPACE, _LETTER, _DIGIT, _STOP, _BREAK, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _STOP
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[32, 10, 39]] = _SPACE, _BREAK, _OTHER
#: Lead byte of U+00C0 to U+00FF, and the two of these that are signs.
_LEAD, _SIGNS = 0xC3, (0x97, 0xB7)
#: Text bytes that are encoded at once (one longer text still goes alone): cutting takes some thirty times as many.
ENCODED_BYTES = 2 << 20
#: Distinct parts that a Python worker keeps in each of two generations.
CACHE_PIECES = 120_000
#: Parts whose ids are gathered at once.
PART_PIECES = 1 << 18
#: Parts encoded as one text.
JOINED = 500


class PieceEncoder:
    def __init__(self, path: str, byte_level: bool):
        """byte_level: a space belongs to the piece after it; else space between words is dropped."""
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.byte_level = byte_level
        # A mark between joined pieces that always has an id of its own.
        self.mark, self.joint = ("\n", "\n") if byte_level else ("\u2022", " \u2022 ")
        (self.sign,) = self._plain([self.mark])[0]
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joins(self, piece: str) -> bool:
        """Whether a piece keeps its ids beside the mark."""
        return piece.split() == [piece.lstrip(" ")] if self.byte_level else self.mark not in piece

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of some texts (none null), and the n+1 borders of the texts among them."""
        ends = offsets_of(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
        borders = ends - ends[0]
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == _LEAD)
        lead = lead[~np.isin(data[lead + 1], _SIGNS)]
        kind[lead] = kind[lead + 1] = _LETTER
        if not self.byte_level:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)  # as the tokenizer does
        first = np.zeros(len(data) + 1, bool)
        first[borders[:-1]] = True
        first = first[:-1]
        space = kind == _SPACE
        opens = first | space  # a space belongs to what comes after it
        piece = np.cumsum(opens, dtype=np.int32 if len(data) < 1 << 31 else np.int64) - 1
        changed = np.ones(len(data), bool)
        changed[1:] = kind[1:] != kind[:-1]
        mixed = np.zeros(piece[-1] + 1 if len(data) else 0, bool)
        mixed[piece[kind == _OTHER]] = True
        at = np.flatnonzero(kind == _BREAK)
        if len(at):  # a break at an end of its piece, or beside another
            closes = np.append(opens[1:], True)
            before = opens[at] | space[at - 1]
            after = closes[at] | (kind[np.minimum(at + 1, len(kind) - 1)] == _BREAK)
            mixed[piece[at[before | after]]] = True
        whole = mixed[piece] if len(data) else np.empty(0, bool)
        head = np.zeros(len(data), bool)  # after a piece's space
        head[1:] = space[:-1] & ~opens[1:]
        starts = opens | (changed & ~whole & ~head)
        if not self.byte_level:  # spaces, and breaks within pieces, have no ids
            kept = ~space & (whole | (kind != _BREAK))
            starts |= head
            starts &= kept
        at = np.flatnonzero(starts)
        if self.byte_level:
            cuts = np.append(at, len(data)).astype(np.int64)
        else:
            before = np.concatenate(([0], np.cumsum(kept, dtype=piece.dtype)))
            cuts = np.append(before[at], before[-1]).astype(np.int64)
            data = data[kept]
        parts = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        return parts, np.searchsorted(at, borders)

    def _encode_parts(self, parts: list[str]) -> None:
        """Encode distinct parts, many in one text; the mark's ids show where each ends."""
        fit: list[str] = []
        others: list[str] = []
        for p in parts:
            (fit if self._joins(p) else others).append(p)
        groups = [fit[i : i + JOINED] for i in range(0, len(fit), JOINED)]
        for group, ids in zip(groups, self._plain([self.joint.join(g) for g in groups])):
            ids = np.array(ids, dtype="<u4")
            raw, cuts = ids.tobytes(), (np.flatnonzero(ids == self.sign) * 4).tolist()
            spans = zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])
            self.pieces.update(zip(group, (raw[a:b] for a, b in spans), strict=True))
        self.pieces.update(zip(others, (np.array(x, dtype="<u4").tobytes() for x in self._plain(others))))

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each of some distinct parts."""
        if len(self.pieces) > CACHE_PIECES:  # parts in use come back from the last generation
            self.pieces, self.before = {}, self.pieces
        cache, before = self.pieces, self.before
        missing = [p for p in parts if p not in cache]
        cache.update((p, before[p]) for p in missing if p in before)
        new = [p for p in missing if p not in before]
        for at in range(0, len(new), 20_000):
            self._encode_parts(new[at : at + 20_000])
        return [cache[p] for p in parts]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids of all texts (null: empty), each followed by end_id, and n+1 borders."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        whole = pc.match_substring_regex(texts, _WHOLE)
        parts, offsets = self._cut(pc.if_else(whole, "", texts))
        coded = parts.dictionary_encode()
        del parts
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        table = self._ids(coded.dictionary.to_pylist())
        del coded
        longs = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        codes = np.insert(codes, offsets[longs], len(table) + np.arange(len(longs), dtype=np.int32))
        offsets = offsets + np.concatenate(([0], np.cumsum(np.isin(np.arange(n), longs))))
        table += [np.array(x, dtype="<u4").tobytes() for x in self._plain([texts[int(i)].as_py() for i in longs])]
        table.append(np.array([end_id], dtype="<u4").tobytes())
        lens = np.fromiter(map(len, table), np.int32, len(table)) // 4
        starts = np.cumsum(lens, dtype=np.int64) - lens
        known = np.frombuffer(b"".join(table), "<u4")
        end = len(table) - 1
        del table
        pa.default_memory_pool().release_unused()
        found, borders, at = [], [np.zeros(1, np.int64)], 0
        while at < n:  # a part of the texts at a time, as the indexes are larger than the ids
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_PIECES, side="right")) - 1)
            own = offsets[at : to + 1] - offsets[at]
            part = np.insert(codes[offsets[at] : offsets[to]], own[1:], end)  # the end id closes each text
            sizes = lens[part]
            found.append(known[ranges(starts[part], sizes)])
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            borders.append(borders[-1][-1] + ends[own[1:] + np.arange(1, to - at + 1)])
            at = to
        return np.concatenate(found), np.concatenate(borders)


@lru_cache(maxsize=4)
def encoder(path: str, byte_level: bool) -> PieceEncoder:
    """One encoder for each Python worker: its cache lives from task to task."""
    return PieceEncoder(path, byte_level)
