"""Words, hashes and n-grams of whole Arrow string columns, in numpy.

A word is a run of bytes outside [ \\t\\n\\v\\f\\r] of the UTF-8 text, which equals the regular
expression [^\\x20\\x09-\\x0D]+ on the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240501)
#: A random 64-bit value for each byte; blanks count nothing.
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
TABLE[BLANK] = 0
FOLDED = TABLE.copy()
FOLDED[65:91] = TABLE[97:123]
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Positions are counted in blocks of so many bytes.
BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (BASE, BASE_INV):
            t = np.full(BLOCK, base, U)
            t[0] = 1
            _powers.append(np.multiply.accumulate(t))
    return _powers


def _power(which: int, at: np.ndarray) -> np.ndarray:
    table = _power_tables()[which]
    if len(at) == 0 or int(at[-1]) < BLOCK:
        return table[at]
    block = pow(int(BASE if which == 0 else BASE_INV), BLOCK, 2**64)
    high = np.array([pow(block, int(k), 2**64) for k in range(int(at[-1]) // BLOCK + 1)], U)
    return table[at % BLOCK] * high[at // BLOCK]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of UTF-8 rows; bytes that are not UTF-8 become U+FFFD."""
    raw = data.tobytes()
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
    heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), heads[offsets]


def pieces(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """start, end: byte positions of each word in data; first: index of each row's first word, and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool):
        solid = ~np.take(BLANK, data, mode="clip")
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        start[inner] = solid[inner]
        inner = inner[inner > 0]
        end[inner - 1] = solid[inner - 1]
        self.data, self.start, self.end = data, np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        values = np.take(FOLDED if fold else TABLE, data, mode="clip")
        values *= _power_tables()[0][: len(data)] if len(data) <= BLOCK else _power(0, np.arange(len(data)))
        if len(self.start):
            raw = np.add.reduceat(values, self.start) * _power(1, self.start)
            self.hash = mix(raw + (self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93))
        else:
            self.hash = np.zeros(0, U)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row and place (word within row) of all n consecutive words of a row."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q = U(0xA0761D6478BD642F + 2 * salt)
        h = np.full(m, U(salt * 7 + n), U)
        for j in range(n):
            h *= q
            h += self.hash[j : j + m]
            if salt:
                h ^= h >> U(29)
        rows = self.rows()
        whole = np.flatnonzero(rows[:m] == rows[n - 1 :])
        rows = rows[whole]
        return mix(h[whole]), rows, whole - self.first[rows]


def scan(column: pa.Array, fold: bool, most: int = BLOCK) -> Iterator[tuple[int, int, Words]]:
    """Words of a column, a few rows at a time: from row, to row, words."""
    data, offsets = column_bytes(column)
    for i, j in pieces(offsets, most):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold)
