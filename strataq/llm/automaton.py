"""Minimal acyclic automata of words with perfect-hash numbers, built and searched by numpy in batches.

Words are rows of bytes (Latin-1), so a word's number is its place in their sorted order. An edge knows
how many words come before those it leads to; the numbers of a path's edges add up to the word's number.
"""

from __future__ import annotations

import numpy as np

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # any odd numbers do


class Words:
    """Distinct byte strings in sorted order, as one buffer and their offsets."""

    def __init__(self, words: list[bytes]):
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size

    def at(self, which: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.data[self.start[which] + place]


class Automaton:
    """States 0 to n-1 (0 is the start); edges in order of (state, byte)."""

    def __init__(self, words: Words):
        n = len(words.size)
        depth_nodes = []  # per depth: (parent, byte, final) of the trie's nodes
        active, node = np.arange(n), np.zeros(n, np.int64)
        finals = [np.array([bool(n) and words.size[0] == 0])]
        depth = 0
        while True:
            longer = words.size[active] > depth
            active, node = active[longer], node[longer]
            if not len(active):
                break
            byte = words.at(active, depth)
            fresh = np.concatenate(([True], (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])))
            depth_nodes.append((node[fresh], byte[fresh]))
            node = np.cumsum(fresh) - 1
            depth += 1
            final = np.zeros(node[-1] + 1, bool)
            final[node[words.size[active] == depth]] = True
            finals.append(final)
        # Bottom up: states with equal endings (final, bytes, next states) become one.
        state_final, state_words, edges = [], [], []
        below, counts, made = np.empty(0, np.int64), np.empty(0, np.int64), 0
        known: dict[int, int] = {}  # state by the hash of its endings
        below_hash = np.empty(0, np.uint64)
        for depth in range(len(finals) - 1, -1, -1):
            final = finals[depth]
            own = np.where(final, _MIX[0], _MIX[1])
            count = final.astype(np.int64)
            parent, byte = depth_nodes[depth] if depth < len(depth_nodes) else (np.empty(0, np.int64), np.empty(0, np.uint8))
            mixed = (below_hash ^ ((byte.astype(np.uint64) + np.uint64(1)) * _MIX[1])) * _MIX[0]
            mixed ^= mixed >> np.uint64(29)
            np.add.at(own, parent, mixed * _MIX[1])
            np.add.at(count, parent, counts)
            own ^= own >> np.uint64(31)
            distinct, first, which = np.unique(own, return_index=True, return_inverse=True)
            state = np.fromiter((known.setdefault(h, len(known)) for h in distinct.tolist()), np.int64, len(distinct))
            fresh = np.flatnonzero(state >= made)
            made = len(known)
            state_final.append(final[first[fresh]])
            state_words.append(count[first[fresh]])
            # Edges of the new states: those of the node that stands for each.
            chosen = np.zeros(len(final), bool)
            chosen[first[fresh]] = True
            kept = chosen[parent]
            edges.append((state[which][parent[kept]], byte[kept], below[kept]))
            below, counts, below_hash = state[which], count, own
        self.start = int(below[0]) if len(below) else 0
        self.final, self.words = np.concatenate(state_final), np.concatenate(state_words)
        source, byte, target = (np.concatenate(x) for x in zip(*edges))
        order = np.lexsort((byte, source))
        self.byte, self.target = byte[order], target[order]
        self.key = source[order] * 256 + self.byte
        self.first = np.searchsorted(source[order], np.arange(made + 1))
        # Words before an edge's: of the state itself and of its lesser edges.
        before = np.cumsum(self.words[self.target]) - self.words[self.target]
        base = before[np.minimum(self.first[:-1], max(len(before) - 1, 0))] if len(before) else np.zeros(made, np.int64)
        origin = source[order]
        self.skip = before - base[origin] + self.final[origin]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The edge of each state by its byte, or -1."""
        if not len(self.key):
            return np.full(len(state), -1)
        key = state * 256 + byte
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def out(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of some states: index of the state in the argument, edge."""
        n = self.first[state + 1] - self.first[state]
        which = np.repeat(np.arange(len(state)), n)
        return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[state], n)


def near_words(automaton: Automaton, queries: Words, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word number), each once: the words whose first exact bytes are the query's and whose rest
    differs by one inserted, deleted or replaced byte."""
    query, state, number = np.arange(len(queries.size)), np.full(len(queries.size), automaton.start), np.zeros(len(queries.size), np.int64)
    place = 0
    near: list[tuple[np.ndarray, ...]] = [tuple(np.empty(0, np.int64) for _ in range(4))]
    found = []
    while len(query) or len(near[0][0]):
        # Paths with one error already: the query's next byte alone, or the end.
        q, s, p, num = (np.concatenate(x) for x in zip(*near))
        done = p == queries.size[q]
        hit = done & automaton.final[s]
        found.append((q[hit], num[hit]))
        q, s, p, num = q[~done], s[~done], p[~done], num[~done]
        edge = automaton.step(s, queries.at(q, p))
        live = edge >= 0
        near = [(q[live], automaton.target[edge[live]], p[live] + 1, num[live] + automaton.skip[edge[live]])]
        # Paths without an error, all at the same place of their queries.
        free = np.flatnonzero(exact[query] <= place)
        which, edge = automaton.out(state[free])
        which = free[which]
        q, target, num = query[which], automaton.target[edge], number[which] + automaton.skip[edge]
        near.append((q, target, np.full(len(q), place), num))  # inserted
        more = place < queries.size[q]
        more[more] = queries.at(q[more], np.full(more.sum(), place)) != automaton.byte[edge[more]]
        near.append((q[more], target[more], np.full(more.sum(), place + 1), num[more]))  # replaced
        free = free[queries.size[query[free]] > place]
        near.append((query[free], state[free], np.full(len(free), place + 1), number[free]))  # deleted
        on = queries.size[query] > place
        query, state, number = query[on], state[on], number[on]
        edge = automaton.step(state, queries.at(query, np.full(len(query), place)))
        live = edge >= 0
        query, state, number = query[live], automaton.target[edge[live]], number[live] + automaton.skip[edge[live]]
        place += 1
    q, num = (np.concatenate(x) for x in zip(*found))
    pairs = np.unique(np.stack((q, num), 1), axis=0) if len(q) else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]
