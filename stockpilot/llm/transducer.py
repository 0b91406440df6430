"""Weighted acyclic automata over words: a path spells an n-gram, the weight of
its last arc is the n-gram's count.

An automaton is built from sorted n-grams: a state is complete as soon as the
input leaves its prefix, and is then looked up in a register, so that states
with the same arcs (labels, weights, targets) exist once.  Words are labels
1, 2, ... in byte order; n-grams are rows of labels, padded with 0, so that a
prefix sorts before what it begins.  An arc of weight 0 ends no n-gram.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_KINDS = [np.uint8, np.uint16, np.uint32, np.int64]
#: Labels below this fit three to an integer.
_PACKED = 1 << 21


def row_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the rows of labels, and for each sorted row whether it differs from the one before."""
    if len(rows) and rows.shape[1] <= 3 and rows.max() < _PACKED:
        key = rows[:, 0].astype(np.int64)
        for d in range(1, rows.shape[1]):
            key = key << 21 | rows[:, d]
        order = np.argsort(key, kind="stable")
        key = key[order]
        return order, np.append(True, key[1:] != key[:-1])
    order = np.lexsort(rows.T[::-1])
    new = np.any(rows[order[1:]] != rows[order[:-1]], axis=1)
    return order, np.append(np.ones(min(1, len(rows)), bool), new)


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the sums of their counts."""
    if not len(rows):
        return rows, counts
    order, new = row_order(rows)
    starts = np.flatnonzero(new)
    return rows[order[starts]], np.add.reduceat(counts[order], starts)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) for each start, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _register(arcs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state of each node (nodes with the same arcs are one state, a node without arcs is state 0),
    and the states' arcs and numbers of arcs.  ``sizes``: the nodes' numbers of arcs, in order."""
    ends = np.cumsum(sizes)
    state = np.zeros(len(sizes), np.int64)
    kept, lengths = [np.empty((0, 3), np.int64)], [np.zeros(1, np.int64)]
    single = np.flatnonzero(sizes == 1) if arcs.size and arcs.max() < _PACKED else np.empty(0, np.int64)
    if len(single):  # most nodes: all at once
        some = arcs[ends[single] - 1]
        _, first, number = np.unique(some[:, 0] << 42 | some[:, 1] << 21 | some[:, 2], return_index=True, return_inverse=True)
        state[single] = number + 1
        kept.append(some[first])
        lengths.append(np.ones(len(first), np.int64))
    many = np.flatnonzero(sizes > 1) if len(single) else np.flatnonzero(sizes > 0)
    flat, register, base = arcs.tobytes(), {}, 1 + len(kept[-1])
    spans = zip((24 * (ends - sizes)[many]).tolist(), (24 * ends[many]).tolist())
    state[many] = [register.setdefault(flat[a:b], len(register)) + base for a, b in spans]
    kept.append(np.frombuffer(b"".join(register), np.int64).reshape(-1, 3))
    lengths.append(np.fromiter(map(len, register), np.int64, len(register)) // 24)
    return state, np.concatenate(kept), np.concatenate(lengths)


class Transducer:
    """labels: distinct words in byte order.  levels: for each depth the arcs of
    its states as (offsets of the states, labels, weights, target states)."""

    def __init__(self, labels: list[bytes], levels: list[tuple[np.ndarray, ...]]):
        self.labels, self.levels = labels, levels

    @classmethod
    def build(cls, labels: list[bytes], rows: np.ndarray, counts: np.ndarray) -> Transducer:
        """From sorted distinct rows of labels (1 is labels[0]) and their counts; unused labels are left out."""
        depth = rows.shape[1]
        used = np.unique(rows)
        used = used[used > 0]
        name = np.zeros(len(labels) + 1, np.int64)
        name[used] = np.arange(1, len(used) + 1)
        rows = name[rows]
        group, first, weight = [], [], []
        new = np.ones(len(rows), bool)
        changed = np.zeros(max(0, len(rows) - 1), bool)
        for d in range(depth):  # the distinct prefixes of d + 1 words, numbered in order
            changed |= rows[1:, d] != rows[:-1, d]
            new = np.append(np.ones(min(1, len(rows)), bool), changed) & (rows[:, d] > 0)
            first.append(np.flatnonzero(new))
            group.append(np.cumsum(new) - 1)
            whole = rows[:, d] > 0 if d + 1 == depth else (rows[:, d] > 0) & (rows[:, d + 1] == 0)
            weight.append(np.zeros(len(first[d]), np.int64))
            weight[d][group[d][whole]] = counts[whole]
        levels: list[tuple[np.ndarray, ...]] = []
        target = np.zeros(len(first[-1]), np.int64)
        for d in range(depth - 1, 0, -1):
            arcs = np.stack([rows[first[d], d], weight[d], target], axis=1)
            sizes = np.bincount(group[d - 1][first[d]], minlength=len(first[d - 1]))
            target, kept, lengths = _register(arcs, sizes)
            levels.append((np.append(0, np.cumsum(lengths)), *kept.T))
        levels.append((np.array([0, len(first[0])]), rows[first[0], 0], weight[0], target))
        return cls([labels[i - 1] for i in used], levels[::-1])

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows with a weight, sorted, their weights, and for each the arcs of its first and last step
        (of n-grams of one length up to two words they tell one from another)."""
        depth = len(self.levels)
        parts, state, head, prefix = [], np.zeros(1, np.int64), None, np.zeros((1, 0), np.int64)
        for d, (offsets, labels, weights, targets) in enumerate(self.levels):
            sizes = offsets[state + 1] - offsets[state]
            arc, parent = _spread(offsets[state], sizes), np.repeat(np.arange(len(state)), sizes)
            prefix = np.concatenate([prefix[parent], labels[arc][:, None]], axis=1)
            head = arc if head is None else head[parent]
            rows = np.zeros((len(arc), depth), np.int64)
            rows[:, : d + 1] = prefix
            parts.append((rows, weights[arc], head, arc))
            state = targets[arc]
        rows, weights, head, arc = (np.concatenate(x) for x in zip(*parts))
        keep = np.flatnonzero(weights > 0)
        order = keep[row_order(rows[keep])[0]]
        return rows[order], weights[order], head[order], arc[order]

    def compose(self, other: Transducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of this automaton's paths, in ``paths()`` order, the weight of the same n-gram in
        ``other`` (0 if none) and its first and last arc there: both are walked together, level by level."""
        place = {w: i for i, w in enumerate(other.labels, 1)}
        name = np.array([0, *(place.get(w, 0) for w in self.labels)], np.int64)
        depth = len(self.levels)
        mine, theirs, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, 0), np.int64)
        head, parts = None, []
        for d, ((offsets, labels, weights, targets), (their_offsets, their_labels, their_weights, their_targets)) in enumerate(zip(self.levels, other.levels)):
            sizes = offsets[mine + 1] - offsets[mine]
            arc, parent = _spread(offsets[mine], sizes), np.repeat(np.arange(len(mine)), sizes)
            prefix = np.concatenate([prefix[parent], labels[arc][:, None]], axis=1)
            owner = np.repeat(np.arange(len(their_offsets) - 1), np.diff(their_offsets))
            known = owner << 32 | their_labels
            want = np.where(theirs[parent] >= 0, theirs[parent] << 32 | name[labels[arc]], -1)
            at = np.searchsorted(known, want)
            hit = np.append(known, -2)[at] == want
            at = np.where(hit, at, 0)
            there = np.where(hit, np.append(their_weights, 0)[at], 0)
            head = at if head is None else head[parent]
            rows = np.zeros((len(arc), depth), np.int64)
            rows[:, : d + 1] = prefix
            parts.append((rows, weights[arc], there, head, at))
            mine, theirs = targets[arc], np.where(hit, np.append(their_targets, 0)[at], -1)
        rows, weights, there, head, at = (np.concatenate(x) for x in zip(*parts))
        keep = np.flatnonzero(weights > 0)
        order = keep[row_order(rows[keep])[0]]
        return there[order], head[order], at[order]

    def to_bytes(self) -> bytes:
        """All arrays in their narrowest kinds, compressed."""
        sizes = np.fromiter(map(len, self.labels), np.int64, len(self.labels))
        out = [struct.pack("<B", len(self.levels))]
        for a in [sizes, *(x for level in self.levels for x in level)]:
            kind = int(np.searchsorted([1 << 8, 1 << 16, 1 << 32], a.max() if len(a) else 0, side="right"))
            out += [struct.pack("<BQ", kind, len(a)), a.astype(_KINDS[kind]).tobytes()]
        plain = b"".join([*out, *self.labels])
        return struct.pack("<Q", len(plain)) + pa.compress(plain, codec="zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Transducer:
        (size,) = struct.unpack_from("<Q", blob)
        plain = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
        at, arrays = 1, []
        for _ in range(1 + 4 * plain[0]):
            kind, n = struct.unpack_from("<BQ", plain, at)
            arrays.append(np.frombuffer(plain, _KINDS[kind], n, at + 9).astype(np.int64))
            at += 9 + n * np.dtype(_KINDS[kind]).itemsize
        ends = at + np.cumsum(arrays[0])
        labels = [plain[a:b] for a, b in zip([at, *ends.tolist()], ends.tolist())]
        return cls(labels, [tuple(arrays[i : i + 4]) for i in range(1, len(arrays), 4)])


class Union:
    """Sums the n-grams of automata; equal n-grams are added up as soon as enough rows wait."""

    def __init__(self, waiting: int = 1 << 20):
        self.place: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size, self.least, self.waiting = 0, 0, waiting

    def add(self, automaton: Transducer) -> None:
        place = self.place
        name = np.array([0, *[place.setdefault(w, len(place) + 1) for w in automaton.labels]], np.int64)
        rows, counts, *_ = automaton.paths()
        self.rows.append(name[rows].astype(np.int32))
        self.counts.append(counts)
        self.size += len(rows)
        if self.size > self.least + self.waiting:
            rows, counts = summed(np.concatenate(self.rows), np.concatenate(self.counts))
            self.rows, self.counts, self.size, self.least = [rows], [counts], len(rows), len(rows)

    def result(self, least: int) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
        """Labels, sorted rows and counts of the n-grams that count at least ``least``, and the sum
        of the counts of all single words."""
        rows, counts = summed(np.concatenate(self.rows), np.concatenate(self.counts))
        single = int(counts[rows[:, 1] == 0].sum())
        rows, counts = rows[counts >= least], counts[counts >= least]
        words = list(self.place)
        used = [i for i in np.unique(rows).tolist() if i]
        used.sort(key=lambda i: words[i - 1])
        rank = np.zeros(len(words) + 1, np.int64)
        rank[used] = np.arange(1, len(used) + 1)
        rows = rank[rows]
        back = row_order(rows)[0]
        return [words[i - 1] for i in used], rows[back], counts[back], single
