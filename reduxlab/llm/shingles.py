"""Distinct word shingles of whole texts as 64-bit hashes."""

import numpy as np

from .words import SPACES, slices, windows

WORDS = 5


def shingle_sets(column, words=WORDS, separators=SPACES):
    """The ascending distinct shingle hashes of each row; fewer words are one shingle, none are none."""
    for _, hashes, _, _, offsets in slices(column, separators):
        grams = windows(hashes, words)
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if end - begin >= words:
                yield np.unique(grams[begin : end - words + 1])
            elif end > begin:
                yield windows(hashes[begin:end], end - begin)
            else:
                yield hashes[:0]
