"""Words of whole texts as 64-bit hashes, read from the bytes of an Arrow batch without a Python loop.

A word is a maximal run of bytes that are no separator; A-Z hash like a-z. Bytes are hashed by a
polynomial over random byte codes, taken from running sums, so a batch costs a few NumPy passes.
"""

import numpy as np
import pyarrow as pa

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Everything in ASCII but digits and letters.
PUNCTUATION = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C17
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
# Texts are hashed in pieces of about so many bytes, which bounds the temporary arrays.
_PIECE = 1 << 20
_MADE = {}


def _tables(length):
    """Powers of the base and of its inverse, and a random code per byte."""
    if _MADE.get("length", 0) < length:
        size = max(length, _PIECE + 1)
        for name, base in (("power", _BASE), ("inverse", _BASE_INVERSE)):
            row = np.full(size, base & _MASK, dtype=np.uint64)
            row[0] = 1
            _MADE[name] = np.multiply.accumulate(row)
        codes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        codes[0x41:0x5B] = codes[0x61:0x7B]
        _MADE["codes"] = codes
        _MADE["length"] = size
    return _MADE["power"], _MADE["inverse"], _MADE["codes"]


def mixed(h):
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_bytes(column):
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data, offsets, is_word):
    """Cuts of the bytes that split no word: at row borders or separators."""
    begin, size = 0, len(data)
    while begin < size:
        end = min(begin + _PIECE, size)
        if end < size:
            row = offsets[np.searchsorted(offsets, end, side="right") - 1]
            if row > begin:
                end = int(row)
            else:
                gaps = np.flatnonzero(~is_word[data[begin + 1 : end]])
                if len(gaps):
                    end = begin + 1 + int(gaps[-1])
                else:
                    after = offsets[np.searchsorted(offsets, end, side="left")]
                    gaps = np.flatnonzero(~is_word[data[end:after]])
                    end = end + int(gaps[0]) if len(gaps) else int(after)
        yield begin, end
        begin = end


def word_hashes(column, separators=SPACES, prefixes=()):
    """(hash, first byte, byte after the last, words before each row) of all words of a string column.

    With `prefixes`, also one array per given number of bytes: the hash of so long a beginning, 0 for words that
    are no longer than that.
    """
    data, offsets = text_bytes(column)
    is_word = np.ones(256, dtype=bool)
    is_word[list(separators)] = False
    hashes, firsts, lasts, begins = [], [], [], []
    for begin, end in _pieces(data, offsets, is_word):
        piece = data[begin:end]
        inside = is_word[piece]
        border = np.zeros(len(piece) + 1, dtype=bool)
        cuts = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end, side="right")]
        border[cuts - begin] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | border[1:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | border[1:-1]
        first, last = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        power, inverse, codes = _tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(codes[piece] * power[: len(piece)], out=total[1:])
        hashes.append(mixed((total[last] - total[first]) * inverse[first]))
        begins.append(
            [
                np.where(last - first > k, mixed((total[np.minimum(first + k, len(piece))] - total[first]) * inverse[first]), np.uint64(0))
                for k in prefixes
            ]
        )
        firsts.append(first + begin)
        lasts.append(last + begin)
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        out = np.zeros(0, dtype=np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
        return (*out, [out[0] for _ in prefixes]) if prefixes else out
    first = np.concatenate(firsts)
    out = np.concatenate(hashes), first, np.concatenate(lasts), np.searchsorted(first, offsets)
    return (*out, [np.concatenate(row) for row in zip(*begins)]) if prefixes else out


def windows(hashes, length):
    """A hash for every `length` consecutive values."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:n].copy()
    for j in range(1, length):
        total *= np.uint64(_BASE)
        total += hashes[j : j + n]
    return mixed(total)


def slices(column, separators=SPACES, size=1 << 23, prefixes=()):
    """word_hashes over runs of rows of about `size` bytes, so a batch of long texts needs little memory.

    Yields (first row, hashes, first bytes, last bytes, words before each row of the run), and prefix hashes if wanted.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield (row, *word_hashes(column.slice(row, end - row), separators, prefixes))
        row = end
