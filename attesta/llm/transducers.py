"""Weighted acyclic automata over words: phrases and how often each occurs.

An arc reads a word and carries the weight of the phrase read so far, so a phrase of any length up to LONGEST has its
count on its last arc, and phrases share the arcs of a common beginning. Automata are built from sorted phrases, level by
level from the last words; states with the same arcs are one, which shares what follows. Two automata are united by
summing weights phrase by phrase, and composed by walking both at once.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa

LONGEST = 3
#: With at most this many words, a phrase of LONGEST words is one 64-bit number; beyond, its columns are sorted.
PACKED = 2_000_000


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and places of all entries of slices (start, size)."""
    rows = np.repeat(np.arange(len(starts)), sizes)
    before = np.cumsum(sizes) - sizes
    return rows, np.arange(len(rows)) - before[rows] + starts[rows]


def summed(grams: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases in order with the sums of their counts; ``grams`` has word number + 1, and 0 past the end."""
    if not len(grams):
        return grams, counts
    if words <= PACKED:
        base = np.int64(words + 1)
        key = (grams[:, 0].astype(np.int64) * base + grams[:, 1]) * base + grams[:, 2]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    else:
        order = np.lexsort(grams.T[::-1])
        some = grams[order]
        new = np.flatnonzero(np.concatenate([[True], (some[1:] != some[:-1]).any(axis=1)]))
    return grams[order[new]], np.add.reduceat(counts[order], new)


def _registered(label: np.ndarray, weight: np.ndarray, target: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of consecutive states stay (numbers), and for every state the place of its equal among those."""
    sizes = np.diff(np.append(starts, len(label)))
    with np.errstate(over="ignore"):
        mixed = (label.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ weight.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ target.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        mixed ^= mixed >> np.uint64(29)
        total = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts)
    order = np.lexsort((total, sizes))
    leads = np.concatenate([[True], (total[order][1:] != total[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])])
    leader = order[np.maximum.accumulate(np.where(leads, np.arange(len(order)), 0))]
    followers = np.flatnonzero(~leads)
    if len(followers):  # equal hashes are not taken for equal arcs
        mine, lead = order[followers], leader[followers]
        rows, a = _ragged(starts[mine], sizes[mine])
        _, b = _ragged(starts[lead], sizes[mine])
        differs = (label[a] != label[b]) | (weight[a] != weight[b]) | (target[a] != target[b])
        other = np.unique(rows[differs])
        leader[followers[other]] = mine[other]
    equal = np.empty(len(order), np.int64)
    equal[order] = leader
    kept, place = np.unique(equal, return_inverse=True)
    return kept, place


class Transducer:
    """``words`` in byte order; arcs of state s are first[s] to first[s + 1]; state 0 has none, the last one is the start."""

    __slots__ = ("words", "first", "label", "weight", "target")

    def __init__(self, words: list[bytes], first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
        self.words, self.first, self.label, self.weight, self.target = words, first, label, weight, target

    @classmethod
    def build(cls, words: list[bytes], grams: np.ndarray, counts: np.ndarray) -> Transducer:
        """From distinct phrases in order; only ``words`` that occur are kept."""
        used = np.unique(grams)
        used = used[used > 0]
        grams = np.where(grams > 0, np.searchsorted(used, grams) + 1, 0)
        words = [words[i - 1] for i in used]
        n, depth = grams.shape
        changed = np.ones((n, depth), bool)
        changed[1:] = grams[1:] != grams[:-1]
        changed = np.logical_or.accumulate(changed, axis=1)
        labels, weights, targets, sizes, states = [], [], [], [np.zeros(1, np.int64)], 1
        follow = np.zeros(0, np.int64)  # state that each arc of the level below leads to
        for k in reversed(range(depth)):
            rows = np.flatnonzero(changed[:, k] & (grams[:, k] > 0))
            label = grams[rows, k] - 1
            ends = grams[rows, k + 1] == 0 if k + 1 < depth else np.ones(len(rows), bool)
            weight = np.where(ends, counts[rows], 0)
            target = np.zeros(len(rows), np.int64)
            if k + 1 < depth and len(below):
                target[np.searchsorted(rows, below, "right") - 1] = follow
            # the states that these arcs leave: one for each different beginning
            begins = np.cumsum(changed[:, k - 1])[rows] if k else np.zeros(len(rows), np.int64)
            starts = np.flatnonzero(np.diff(begins, prepend=-1))
            below = rows[starts]
            if not len(rows):
                follow = np.zeros(0, np.int64)
                continue
            kept, place = _registered(label, weight, target, starts)
            follow = states + place
            length = np.diff(np.append(starts, len(rows)))[kept]
            _, arcs = _ragged(starts[kept], length)
            labels.append(label[arcs])
            weights.append(weight[arcs])
            targets.append(target[arcs])
            sizes.append(length)
            states += len(kept)
        if not n:
            sizes.append(np.zeros(1, np.int64))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return cls(words, first, join(labels, np.int64), join(weights, np.int64), join(targets, np.int64))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases with a weight, shorter ones first, in order within a length: word numbers + 1, and weights."""
        state = np.array([len(self.first) - 2])
        grams, found, weights = np.zeros((1, LONGEST), np.int32), [], []
        for k in range(LONGEST):
            rows, arcs = _ragged(self.first[state], self.first[state + 1] - self.first[state])
            grams = grams[rows]
            grams[:, k] = self.label[arcs] + 1
            counted = self.weight[arcs] > 0
            found.append(grams[counted])
            weights.append(self.weight[arcs][counted])
            state = self.target[arcs]
        return np.concatenate(found), np.concatenate(weights)

    def compose(self, other: Transducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that both weigh (by the words of this one), with the weights of this one and of the other."""
        where = {w: i for i, w in enumerate(other.words)}
        named = np.array([where.get(w, -1) for w in self.words], np.int64)
        base = max(len(other.words), 1)
        keys = np.repeat(np.arange(len(other.first) - 1), np.diff(other.first)) * base + other.label
        here, there = np.array([len(self.first) - 2]), np.array([len(other.first) - 2])
        grams, found, mine, theirs = np.zeros((1, LONGEST), np.int32), [], [], []
        for k in range(LONGEST):
            rows, arcs = _ragged(self.first[here], self.first[here + 1] - self.first[here])
            label = named[self.label[arcs]]
            wanted = there[rows] * base + label
            place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            same = (label >= 0) & (keys[place] == wanted) if len(keys) else np.zeros(len(label), bool)
            rows, arcs, place = rows[same], arcs[same], place[same]
            grams = grams[rows]
            grams[:, k] = self.label[arcs] + 1
            both = (self.weight[arcs] > 0) & (other.weight[place] > 0)
            found.append(grams[both])
            mine.append(self.weight[arcs][both])
            theirs.append(other.weight[place][both])
            here, there = self.target[arcs], other.target[place]
        return np.concatenate(found), np.concatenate(mine), np.concatenate(theirs)

    def phrases(self, grams: np.ndarray) -> list[bytes]:
        """Words joined by one space."""
        words = [b"", *self.words]
        return [b" ".join([words[i] for i in row if i]) for row in grams.tolist()]

    def dump(self) -> bytes:
        """As bytes, numbers as narrow as they may be."""
        narrow = [a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in (np.diff(self.first), self.label, self.weight, self.target)]
        return pickle.dumps((b" ".join(self.words), *narrow), protocol=5)

    @classmethod
    def load(cls, raw: bytes) -> Transducer:
        words, sizes, *arcs = pickle.loads(raw)
        first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return cls(words.split(b" ") if words else [], first, *(a.astype(np.int64) for a in arcs))


def united(parts: list[Transducer], least: int = 1) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, phrases in order, and sums of their weights of at least ``least``."""
    coded = pa.array([w for part in parts for w in part.words], pa.large_binary()).dictionary_encode()
    known = coded.dictionary.to_pylist()
    order = sorted(range(len(known)), key=known.__getitem__)
    rank = np.empty(len(known), np.int32)
    rank[order] = np.arange(1, len(known) + 1)
    number = rank[coded.indices.to_numpy()] if len(known) else rank
    grams, counts, at = [np.zeros((0, LONGEST), np.int32)], [np.zeros(0, np.int64)], 0
    for part in parts:
        names = np.concatenate([np.zeros(1, np.int32), number[at : at + len(part.words)]])
        at += len(part.words)
        found, weights = part.paths()
        grams.append(names[found])
        counts.append(weights)
    found, sums = summed(np.concatenate(grams), np.concatenate(counts), len(known))
    enough = sums >= least
    return [known[i] for i in order], found[enough], sums[enough]
