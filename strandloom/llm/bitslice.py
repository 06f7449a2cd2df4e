"""Bit-sliced comparison of 64-bit fingerprints, in NumPy, for the rows of one task.

64 fingerprints form a block: plane b of a block is a word that holds bit b of each. A query's distances to all of a
block are counted at once, plane by plane, in carry-save counters, which are words too: the i-th holds bit i of the 64
counts. Every few planes, pairs of a query and a block of which all 64 counts exceed the radius are left.
"""

from __future__ import annotations

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)


def planes(fingerprints: np.ndarray, lane: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[64, blocks] planes; fingerprints of a block follow each other from its start, at the given lanes."""
    out = np.empty((64, len(starts)), np.uint64)
    for b in range(64):
        out[b] = np.add.reduceat(((fingerprints >> np.uint64(b)) & ONE) << lane, starts)
    return out


def beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Words of the lanes whose count exceeds radius; over holds lanes whose counters overflowed."""
    more, equal = np.zeros_like(over), np.full_like(over, ONES)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            more |= equal & counters[i]
            equal &= ~counters[i]
    return more | over


def near(sliced: np.ndarray, query: np.ndarray, block: np.ndarray, valid: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """For each pair of a query (a fingerprint) and a block, the word of valid lanes within radius."""
    result = np.zeros(len(query), np.uint64)
    at, over = np.arange(len(query)), np.zeros(len(query), np.uint64)
    counters = [np.zeros(len(query), np.uint64) for _ in range(max(1, radius.bit_length()))]
    for b in range(64):
        flip = np.uint64(0) - ((query >> np.uint64(b)) & ONE)
        carry = sliced[b][block] ^ flip
        for c in counters:
            c ^= carry
            carry &= ~c
        over |= carry
        if (b + 1) % step == 0 and b < 63:
            live = (~beyond(counters, over, radius) & valid) != 0
            if not live.all():
                at, query, block, valid, over = at[live], query[live], block[live], valid[live], over[live]
                counters = [c[live] for c in counters]
            if not len(at):
                return result
    result[at] = ~beyond(counters, over, radius) & valid
    return result


def lanes_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of word and lane of each bit set."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n rows reaches over links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    return label


def roots(fingerprints: np.ndarray, starts: np.ndarray, radius: int, agree) -> np.ndarray:
    """For each row the first row that it reaches in its group; groups begin at starts.

    agree(i, j): which pairs of rows, within radius already, are links; None if all are.
    """
    n = len(fingerprints)
    sizes = np.diff(np.append(starts, n))
    label = np.arange(n)
    small = (sizes > 1) & (sizes <= 64)
    if small.any():
        group = np.repeat(np.arange(len(starts)), sizes)
        rows = np.nonzero(small[group])[0]
        lane = (rows - starts[group[rows]]).astype(np.uint64)
        first = np.nonzero(lane == 0)[0]
        block = np.cumsum(lane == 0) - 1
        sliced = planes(fingerprints[rows], lane, first)
        earlier = (ONE << lane) - ONE  # each pair once
        words = near(sliced, fingerprints[rows], block, earlier, radius)
        q, other = lanes_of(words)
        a, b = rows[q], rows[first[block[q]]] + other
        if agree is not None and len(a):
            keep = agree(a, b)
            a, b = a[keep], b[keep]
        label = np.minimum(label, joined(n, a, b))
    for g in np.nonzero(sizes > 64)[0]:
        label[starts[g] : starts[g] + sizes[g]] = starts[g] + _large(fingerprints[starts[g] : starts[g] + sizes[g]], radius, agree, starts[g])
    return label


def _large(f: np.ndarray, radius: int, agree, offset: int, pairs: int = 1 << 19) -> np.ndarray:
    """roots() of one group: breadth-first search, so that members of a close group are compared with those outside it only."""
    n = len(f)
    n_blocks = -(-n // 64)
    lane = (np.arange(n) % 64).astype(np.uint64)
    sliced = planes(f, lane, np.arange(0, n, 64))
    full = np.full(n_blocks, ONES)
    if n % 64:
        full[-1] = (ONE << np.uint64(n % 64)) - ONE

    def found(query: np.ndarray, open_words: np.ndarray, out) -> None:
        """Calls out(rows of query, rows near them) over the lanes of open_words, some queries at a time."""
        blocks = np.nonzero(open_words)[0]
        step = max(1, pairs // max(1, len(blocks)))
        for k in range(0, len(query), step):
            q = query[k : k + step]
            at, block = np.repeat(q, len(blocks)), np.tile(blocks, len(q))
            out(at, block, near(sliced, f[at], block, open_words[block], radius))

    # rows that are near no other can't be in a group
    linked = np.zeros(n, bool)

    def mark(at, block, words):
        own = at // 64 == block
        words = words & ~np.where(own, ONE << lane[at], np.uint64(0))
        linked[at[words != 0]] = True

    found(np.arange(n), full, mark)
    label = np.arange(n)
    waiting = linked.copy()
    for seed in np.nonzero(linked)[0]:
        if not waiting[seed]:
            continue
        waiting[seed] = False
        front = np.array([seed])
        while len(front) and waiting.any():
            reached = []

            def reach(at, block, words):
                q, other = lanes_of(words)
                a, b = at[q], block[q] * 64 + other
                if agree is not None and len(a):
                    keep = agree(a + offset, b + offset)
                    b = b[keep]
                reached.append(np.unique(b))

            # a front's queries go a few at a time, and what they reach is no longer sought
            for k in range(0, len(front), 256):
                if not waiting.any():
                    break
                open_words = np.packbits(np.pad(waiting, (0, n_blocks * 64 - n)), bitorder="little").view("<u8").astype(np.uint64)
                before = len(reached)
                found(front[k : k + 256], open_words, reach)
                for b in reached[before:]:
                    waiting[b] = False
            front = np.unique(np.concatenate(reached)) if reached else np.array([], int)
            label[front] = seed
    return label
