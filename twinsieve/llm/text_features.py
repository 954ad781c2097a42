"""Numbers of whole texts that the quality operators share, taken in numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix, text_bytes, words_of

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
STRUCTURE = ("log_words", "word_length", "upper", "digits", "symbols", "marks", "distinct", "repeated", "line_words", "dup_lines", "stops", "long_words")


def _flags(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[list(chars)] = 1
    return out


_UPPER, _DIGIT, _SYMBOL = _flags(range(65, 91)), _flags(range(48, 58)), _flags(SYMBOLS)
_MARK = _flags(b"!?")
_STOP = _flags(b".,;:")
#: Bytes that begin a character.
_CHAR = np.array([0 if 128 <= b < 192 else 1 for b in range(256)], dtype=np.uint8)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a small-valued array over the rows' ranges."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], dtype=np.int64)
    return out


def repeats(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries share key and row with another entry."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(key), dtype=bool)
    flag = np.zeros(len(key), dtype=bool)
    flag[1:] |= same
    flag[:-1] |= same
    out[order] = flag
    return out


def later(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries share key and row with an entry before them."""
    order = np.lexsort((np.arange(len(key)), key, row))
    k, r = key[order], row[order]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    return out


class Batch:
    """Words, lines and their counts for the texts of one batch; null text is empty."""

    def __init__(self, col: pa.Array, lower: bool = False):
        self.data, self.offsets = text_bytes(col)
        data, offsets = self.data, self.offsets
        self.rows = len(offsets) - 1
        self.hashes, self.starts, self.lengths = words_of(data, offsets, lower)
        self.cut = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.cut)
        self.word_row = np.repeat(np.arange(self.rows), self.n_words)

    def word_chars(self) -> np.ndarray:
        """Code points in words: all but the white space, which is one byte each."""
        spaces = per_row(_CHAR[self.data], self.offsets)
        solid = np.zeros(len(self.data) + 1, dtype=np.int8)
        np.add.at(solid, self.starts, 1)
        np.add.at(solid, self.starts + self.lengths, -1)
        inside = np.cumsum(solid[:-1], dtype=np.int8).astype(np.uint8)
        return per_row(_CHAR[self.data] * inside, self.offsets) if len(self.data) else spaces

    def count(self, flags: np.ndarray) -> np.ndarray:
        return per_row(flags[self.data], self.offsets)

    def n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL)

    def repeat_words(self) -> np.ndarray:
        """Words in windows of three that come at least twice in their text."""
        h, row = self.hashes, self.word_row
        out = np.zeros(self.rows, dtype=np.int64)
        if len(h) < 3:
            return out
        window = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        own = np.flatnonzero(row[:-2] == row[2:])
        if not len(own):
            return out
        hit = own[repeats(window[own], row[own])]
        covered = np.zeros(len(h), dtype=bool)
        for k in range(3):
            covered[hit + k] = True
        return np.bincount(row[covered], minlength=self.rows)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, start, end and whole-line hash of every line with a word."""
        data, offsets = self.data, self.offsets
        ends = np.flatnonzero(data == 10)
        bounds = np.union1d(ends + 1, offsets[:-1])
        bounds = bounds[bounds < len(data)]
        if not len(bounds):
            z = np.zeros(0, np.int64)
            return z, z, z, z.astype(np.uint64)
        stop = np.append(bounds[1:], len(data))
        row = np.searchsorted(offsets, bounds, side="right") - 1
        first = np.searchsorted(self.starts, bounds)
        has = np.searchsorted(self.starts, stop) > first
        bounds, stop, row = bounds[has], stop[has], row[has]
        stop = np.where(data[stop - 1] == 10, stop - 1, stop)
        # bytes, white space included, as one hash a line
        value = np.zeros(len(bounds), dtype=np.uint64)
        weight = _LINE_BYTE[data]
        for a in range(0, len(bounds), 4096):
            part = slice(a, a + 4096)
            s, e = bounds[part], stop[part]
            n = e - s
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            src = at + np.repeat(s, n)
            place = _LINE_PLACE[at & 65535]
            if n.max() > 65536:
                place = place * (mix((at >> 16).astype(np.uint64)) | np.uint64(1))  # by 1 up to place 65535
            value[part] = np.add.reduceat(weight[src] * place, np.cumsum(n) - n) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return row, bounds, stop, value

    def dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        row, _, _, value = self.lines()
        return np.bincount(row[later(value, row)], minlength=self.rows) if len(row) else np.zeros(self.rows, np.int64)

    def structure(self) -> np.ndarray:
        """A row of STRUCTURE for each text, in no unit larger than a few."""
        n = self.n_words.astype(np.float64)
        some = np.maximum(n, 1)
        chars = np.maximum(per_row(_CHAR[self.data], self.offsets), 1)
        key = self.hashes
        row, _, _, value = self.lines()
        n_lines = np.maximum(np.bincount(row, minlength=self.rows), 1) if len(row) else np.ones(self.rows)
        dup = np.bincount(row[later(value, row)], minlength=self.rows) if len(row) else np.zeros(self.rows)
        distinct = np.bincount(self.word_row[~later(key, self.word_row)], minlength=self.rows) if len(key) else np.zeros(self.rows)
        long_words = np.bincount(self.word_row[self.lengths > 20], minlength=self.rows) if len(key) else np.zeros(self.rows)
        columns = [
            np.log1p(n) / 4, np.log1p(self.word_chars() / some), 4 * self.count(_UPPER) / chars, 4 * self.count(_DIGIT) / chars, 8 * self.n_symbols() / chars, 8 * self.count(_MARK) / chars,
            distinct / some, self.repeat_words() / some, np.log1p(n / n_lines) / 3, dup / n_lines, 8 * self.count(_STOP) / chars, 4 * long_words / some,
        ]
        return np.stack(columns, axis=1)


_RNG = np.random.Generator(np.random.PCG64(77))
_LINE_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_LINE_PLACE = _RNG.integers(1, 1 << 63, size=65536, dtype=np.uint64) | np.uint64(1)


def buckets(hashes: np.ndarray, row: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) in order of rows."""
    key = (row.astype(np.int64) << bits) | (hashes >> np.uint64(64 - bits)).astype(np.int64)
    key = np.unique(key)
    return key >> bits, key & ((1 << bits) - 1)
