"""Words and word windows of Arrow text columns as 64-bit hashes, in numpy, without a Python step per word.

A word's hash is a polynomial over a random value for each byte, taken as the difference of two running sums, so
all words of a piece of text are hashed at once. Texts are worked through in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once (a longer single word is not split).
PIECE = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 64, 256, dtype=np.uint64)
_MIXERS = np.random.Generator(np.random.PCG64(21)).integers(1, 1 << 64, 64, dtype=np.uint64) | _U(1)
_powers = [np.ones(1, _U), np.ones(1, _U)]

#: Byte tables: which bytes belong to words. Texts are UTF-8, so bytes from 0x80 are parts of longer characters.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
VISIBLE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: A-Z as a-z, all else as it is.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 1)
        for i, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def column(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def slices(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows with most bytes at most, or a single longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def _piece(data: np.ndarray, breaks: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of data; no word spans a break (sorted places)."""
    word = inside[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    cuts = breaks[(breaks > 0) & (breaks < len(data))]
    begins[cuts] = word[cuts]
    ends[cuts - 1] = word[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUES[FOLDED[data]] * power[: len(data)], out=sums[1:])
    return mixed((sums[last + 1] - sums[first]) * inverse[first]), first


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z folded, and the offsets of the rows' words among them."""
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, last in slices(offsets):
        start, stop = int(offsets[first]), int(offsets[last])
        while start < stop:
            end = stop
            if end - start > PIECE:  # one long row: cut it before a byte that no word holds
                end = start + PIECE
                gap = np.flatnonzero(~inside[data[start + 1 : end + 1]])
                while not len(gap) and end < stop:
                    gap = np.flatnonzero(~inside[data[end + 1 : min(end + 1 + PIECE, stop)]]) + (end - start)
                    end = min(end + PIECE, stop)
                end = start + 1 + int(gap[-1]) if len(gap) else stop
            hashes, places = _piece(data[start:end], offsets[first : last + 1] - start, inside)
            found.append(hashes)
            counts[first:last] += np.bincount(np.searchsorted(offsets[first : last + 1], places + start, "right") - 1, minlength=last - first)
            start = end
    return (np.concatenate(found) if found else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size words from each place on, rows' borders ignored; see whole()."""
    n = max(len(hashes) - size + 1, 0)
    out = np.zeros(n, _U)
    for i in range(size):
        out += hashes[i : i + n] * _MIXERS[i % 64]
    return mixed(out)


def whole(offsets: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the n places start a window of size words inside one row."""
    row_end = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + size <= row_end


def rows_hashed(rows: np.ndarray) -> np.ndarray:
    """What windows() gives for each row of word hashes (64 columns at most)."""
    return mixed((rows * _MIXERS[: rows.shape[1]]).sum(axis=1, dtype=_U))
