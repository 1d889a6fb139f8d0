"""A hierarchical index over 64-bit fingerprints in Gray order, and its self-join.

Sorted by Gray rank, neighbouring fingerprints differ in few bits, so a run of them shares a masked
bit pattern. Each upper node of the index keeps the bits that all fingerprints below it share; a
node's own part is what its parent doesn't have yet. A walk over pairs of nodes adds up the
differing bits, from each pair only on the bits that are newly fixed there; once the sum is over the
limit, no fingerprints below the two can link and the pair is dropped whole. Where even all bits
that are not fixed could not exceed the limit, everything below the pair links, and it is taken
whole, without looking at single pairs.
"""

from __future__ import annotations

import numpy as np

#: Children of a node, pairs of nodes that a walk holds at once, members from which neighbours are linked first.
FANOUT, HELD, MANY = 8, 1 << 14, 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Level:
    """Nodes of one level: the first member of each, shared pattern and mask, place of its children."""

    def __init__(self, ones: np.ndarray, zeros: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        self.ones, self.zeros, self.starts, self.first, self.last = ones, zeros, starts, first, last
        self.mask, self.pattern = ones | zeros, ones


def levels(codes: np.ndarray) -> list[Level]:
    """From single codes (sorted, distinct) up to one root."""
    n = np.arange(len(codes))
    made = [Level(codes, ~codes, n, n, n)]
    while len(made[-1].ones) > 1:
        below = made[-1]
        at = np.arange(0, len(below.ones), FANOUT)
        ends = np.minimum(at + FANOUT, len(below.ones)) - 1
        made.append(Level(np.bitwise_and.reduceat(below.ones, at), np.bitwise_and.reduceat(below.zeros, at), at, below.first[at], below.last[ends]))
    return made


class Labels:
    """Union-find over 0..n-1 that takes arrays of links; a label is the smallest member."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def flatten(self) -> None:
        while not np.array_equal(above := self.up[self.up], self.up):
            self.up = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            keep = a != b
            a, b = a[keep], b[keep]
            if not len(a):
                return
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            self.flatten()


def link_all(codes: np.ndarray, limit: int) -> np.ndarray:
    """For distinct codes in Gray order: the smallest index linked to each, directly or in turn, at `limit` or fewer differing bits."""
    labels = Labels(len(codes))
    if len(codes) < 2:
        return labels.up
    if len(codes) >= MANY:
        link_neighbours(labels, codes, limit)
    tree = levels(codes)
    top = len(tree) - 1
    # For each level, the least label of each node and whether it is its only one, as of some step of
    # the walk; labels only merge, so old ones prune less, never wrongly. They are made anew when as
    # many pairs as members have passed.
    state: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    passed = 0
    # Each entry: level, left nodes, right nodes, bits already compared, differences so far.
    zero = np.zeros(1, np.int64)
    work = [(top, zero, zero, np.zeros(1, np.uint64), np.zeros(1, np.uint8))]
    while work:
        k, left, right, seen, apart = work.pop()
        if len(left) > HELD:
            work += [(k, *(x[at : at + HELD] for x in (left, right, seen, apart))) for at in range(0, len(left), HELD)]
            continue
        level, passed = tree[k], passed + len(left)
        both = level.mask[left] & level.mask[right]
        apart = apart + np.bitwise_count((level.pattern[left] ^ level.pattern[right]) & both & ~seen)
        keep = (apart <= limit) & ((left != right) | (k > 0))
        if k:
            # Two nodes whose members are all of one component already have nothing to add.
            if k not in state or passed - state[k][2] >= len(codes):
                low = np.minimum.reduceat(labels.up, level.first)
                state[k] = (low, low == np.maximum.reduceat(labels.up, level.first), passed)
            least, one, _ = state[k]
            keep &= ~(one[left] & one[right] & (least[left] == least[right]))
        left, right, both, apart = left[keep], right[keep], both[keep], apart[keep]
        whole = apart + (64 - np.bitwise_count(both)) <= limit
        if whole.any():
            take_whole(labels, level, left[whole], right[whole])
            rest = ~whole
            left, right, both, apart = left[rest], right[rest], both[rest], apart[rest]
        if k == 0 or not len(left):
            continue
        below = tree[k - 1]
        size = len(below.ones)
        lc = np.repeat(level.starts[left][:, None] + np.arange(FANOUT), FANOUT, axis=1)
        rc = np.tile(level.starts[right][:, None] + np.arange(FANOUT), (1, FANOUT))
        fine = (lc < size) & (rc < size) & ((left != right)[:, None] | (lc <= rc))
        pair = np.repeat(np.arange(len(left)), FANOUT * FANOUT).reshape(fine.shape)[fine]
        work.append((k - 1, lc[fine], rc[fine], both[pair], apart[pair]))
    labels.flatten()
    return labels.up


def link_neighbours(labels: Labels, codes: np.ndarray, limit: int) -> None:
    """Link codes that are next to each other in Gray order under some rotation of their bits: this alone
    makes one component of most of a dense group, whose pairs of nodes the walk then drops at the top."""
    for turn in range(0, 64, 8):
        turned = codes if not turn else (codes << np.uint64(turn)) | (codes >> np.uint64(64 - turn))
        order = np.argsort(gray_rank(turned))
        a, b = order[:-1], order[1:]
        near = np.bitwise_count(codes[a] ^ codes[b]) <= limit
        labels.link(a[near], b[near])


def take_whole(labels: Labels, level: Level, left: np.ndarray, right: np.ndarray) -> None:
    """Link everything below each pair: all of a node's members to its first, and both firsts."""
    labels.link(level.first[left], level.first[right])
    for side in (left, right):
        nodes = np.unique(side)
        sizes = level.last[nodes] - level.first[nodes] + 1
        nodes, sizes = nodes[sizes > 1], sizes[sizes > 1]
        if len(nodes):
            start = np.repeat(level.first[nodes], sizes)
            member = start + np.arange(len(start)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            labels.link(start, member)
