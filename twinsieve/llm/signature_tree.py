"""Signature trees: OR-combined token bitmaps and size ranges, traversed in pairs."""

from __future__ import annotations

import numpy as np

from .common import mix

FANOUT = 16
#: Least and greatest width of a bitmap, as powers of two of bits.
LEAST, MOST = 7, 15


def width(sizes: np.ndarray) -> np.ndarray:
    """Power of two of bits for sets of these sizes: more than one bit an element, up to MOST."""
    return np.clip(np.ceil(np.log2(np.maximum(sizes, 1) + 1)).astype(np.int64), LEAST, MOST)


def signature(tokens: np.ndarray) -> bytes:
    """Bitmap with a bit for every token, of the width for their number."""
    w = int(width(np.array([len(tokens)]))[0])
    flags = np.zeros(1 << w, dtype=np.uint8)
    flags[(mix(tokens) >> np.uint64(64 - w)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def halved(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width: bits 2k and 2k + 1 become bit k."""
    flags = np.unpackbits(bits.view(np.uint8), axis=1)
    return np.packbits(flags.reshape(len(flags), -1, 2).max(axis=2), axis=1).view(np.uint64)


class Tree:
    """Levels of nodes over rows sorted by size and bitmap; level 0 holds the rows.

    A node keeps the OR and the AND of its rows' bitmaps and the range of their
    sizes. A row of node A that has a token whose bit no row of node B sets cannot
    share that token, so the bits that all rows of A set and no row of B sets count
    against the overlap of any pair below the two nodes.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.order = np.lexsort((bits[:, 1], bits[:, 0], sizes))
        some, every, low, high = bits[self.order], bits[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(some, every, low, high)]
        while len(low) > FANOUT:
            cut = np.arange(0, len(low), FANOUT)
            some, every = np.bitwise_or.reduceat(some, cut), np.bitwise_and.reduceat(every, cut)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((some, every, low, high))


def possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether nodes i of level x and j of level y can hold a pair with den * shared >= num * union."""
    xs, xa, xl, xh = (part[i] for part in x)
    ys, ya, yl, yh = (part[j] for part in y)
    only_x = np.bitwise_count(xa & ~ys).sum(axis=1, dtype=np.int64)
    only_y = np.bitwise_count(ya & ~xs).sum(axis=1, dtype=np.int64)
    most = np.minimum(xh - only_x, yh - only_y)
    # shared <= most, and union >= larger size + what the smaller has alone; sizes in the ranges
    least_union = np.maximum(xl + only_y, yl + only_x)
    most = np.minimum(most, np.minimum(xh, yh))
    return (most > 0) & (den * most >= num * np.maximum(least_union, np.maximum(xl, yl)))


def join(x: Tree, y: Tree | None, num: int, den: int, batch: int = 1 << 14):
    """Yield arrays of row pairs (of x and y, or of x alone) that no bound excludes."""
    other = y or x
    top = max(len(x.levels), len(other.levels)) - 1
    grid = np.indices((len(x.levels[min(top, len(x.levels) - 1)][2]), len(other.levels[min(top, len(other.levels) - 1)][2]))).reshape(2, -1)
    if y is None:
        grid = grid[:, grid[0] <= grid[1]]
    stack = [(len(x.levels) - 1, len(other.levels) - 1, grid[0], grid[1])]
    while stack:
        a, b, i, j = stack.pop()
        if len(i) > batch:
            stack.append((a, b, i[batch:], j[batch:]))
            i, j = i[:batch], j[:batch]
        ok = possible(x.levels[a], other.levels[b], i, j, num, den)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if a == b == 0:
            if y is None:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i):
                yield x.order[i], other.order[j]
            continue
        if a >= b:
            i, j = _down(i, j, len(x.levels[a - 1][2]))
            a -= 1
            if y is None and a == b:
                keep = i <= j
                i, j = i[keep], j[keep]
        else:
            j, i = _down(j, i, len(other.levels[b - 1][2]))
            b -= 1
            if y is None and a == b:
                keep = i <= j
                i, j = i[keep], j[keep]
        if len(i):
            stack.append((a, b, i, j))


def _down(i: np.ndarray, j: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace nodes i by their children, beside the same j."""
    child = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    j = np.repeat(j, FANOUT)
    ok = child < below
    return child[ok], j[ok]
