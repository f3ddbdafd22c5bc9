"""Signature tree over token sets: nodes hold the OR of their sets' bitmaps and the range of their sizes.

A dual traversal descends pairs of nodes and drops those whose greatest possible overlap is below what the
threshold asks for. Pairs of sets that survive are compared exactly, unless they are connected already.
"""

import numpy as np

#: Children of a node.
FANOUT = 8
_CHUNK_BYTES = 16 << 20


def needed(a, b, percent):
    """Least overlap of two sets of the given sizes that reaches the threshold: 100 * common >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def overlap(a, b):
    """Common values of two ascending arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class SignatureTree:
    """Levels of nodes, from single sets (level 0) to the root."""

    def __init__(self, sets, bits):
        self.sets = sets
        words = bits // 64
        signature = np.zeros((len(sets), words), dtype=np.uint64)
        for row, values in zip(signature, sets):
            mask = np.zeros(bits, dtype=bool)
            mask[(values >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
            row[:] = np.packbits(mask, bitorder="little").view(np.uint64)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        hidden = size - np.bitwise_count(signature).sum(axis=1).astype(np.int64)
        # Of every node: bitmap, least and greatest size, most values that share a bit of their own set.
        self.levels = [(signature, size, size, hidden)]
        while len(self.levels[-1][0]) > 1:
            bitmap, least, most, slack = self.levels[-1]
            cuts = np.arange(0, len(bitmap), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bitmap, cuts),
                    np.minimum.reduceat(least, cuts),
                    np.maximum.reduceat(most, cuts),
                    np.maximum.reduceat(slack, cuts),
                )
            )


def _possible(left, right, i, j, percent):
    """Pairs of nodes whose greatest possible overlap is enough."""
    bits_a, least_a, most_a, slack_a = left
    bits_b, least_b, most_b, slack_b = right
    fits = (100 * most_a[i] >= percent * least_b[j]) & (100 * most_b[j] >= percent * least_a[i])
    i, j = i[fits], j[fits]
    step = max(1, _CHUNK_BYTES // (8 * bits_a.shape[1]))
    common = [
        np.bitwise_count(bits_a[i[at : at + step]] & bits_b[j[at : at + step]]).sum(axis=1).astype(np.int64)
        for at in range(0, len(i), step)
    ]
    common = np.concatenate(common) if common else np.zeros(0, dtype=np.int64)
    most = np.minimum(common + np.minimum(slack_a[i], slack_b[j]), np.minimum(most_a[i], most_b[j]))
    keep = most >= needed(least_a[i], least_b[j], percent)
    return i[keep], j[keep]


def candidates(left, right, percent):
    """Index pairs of sets left by the dual traversal; of one tree with itself, pairs i < j."""
    same = left is right
    depth = max(len(left.levels), len(right.levels))
    level = [min(depth, len(t.levels)) - 1 for t in (left, right)]
    i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        i, j = _possible(left.levels[level[0]], right.levels[level[1]], i, j, percent)
        if not (level[0] or level[1]):
            break
        # The deeper tree goes down first, so that both reach their sets together.
        down = [level[0] >= level[1] and level[0] > 0, level[1] >= level[0] and level[1] > 0]
        for side, tree in ((0, left), (1, right)):
            if down[side]:
                level[side] -= 1
                parent = i if side == 0 else j
                child = (parent[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                other = np.repeat(j if side == 0 else i, FANOUT)
                real = child < len(tree.levels[level[side]][0])
                i, j = (child[real], other[real]) if side == 0 else (other[real], child[real])
        if same:
            upper = i <= j
            i, j = i[upper], j[upper]
    if same:
        upper = i < j
        i, j = i[upper], j[upper]
    order = np.lexsort((j, i))
    return i[order], j[order]


def links(sets, labels, percent, side=None):
    """Pairs (i, j) of sets that reach the threshold and connect what was not connected before them.

    labels: integers that are equal for sets known to be connected. With `side` (0 or 1 per set) only pairs of
    different sides are compared.
    """
    labels = np.unique(np.asarray(labels), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    bits = 512
    while bits < 4 * sizes.max() and bits < 1 << 16:
        bits *= 2
    first = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)
    order = np.lexsort((sizes, first))
    if side is None:
        index = [order, order]
        tree = SignatureTree([sets[k] for k in order], bits)
        i, j = candidates(tree, tree, percent)
    else:
        side = np.asarray(side)
        index = [order[side[order] == s] for s in (0, 1)]
        if not len(index[0]) or not len(index[1]):
            return []
        trees = [SignatureTree([sets[k] for k in part], bits) for part in index]
        i, j = candidates(*trees, percent)
    left, right = index[0][i], index[1][j]
    found = []
    starts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else []
    for begin, end in zip(starts, [*starts[1:], len(left)]):
        a = int(left[begin])
        others = right[begin:end]
        others = others[labels[others] != labels[a]]
        while len(others):
            b = int(others[0])
            if len(sets[a]) and len(sets[b]) and overlap(sets[a], sets[b]) >= needed(len(sets[a]), len(sets[b]), percent):
                found.append((a, b))
                labels[labels == labels[b]] = labels[a]
                others = others[labels[others] != labels[a]]
            else:
                others = others[1:]
    return found
