"""Hashes of the words of many texts at once, from the bytes of an Arrow column.

A word's hash is a polynomial over its bytes modulo the prime 2**61 - 1 at a fixed random place, taken from running sums
over the bytes, then mixed.  Modulo a prime two different words of n bytes meet at no more than n of all places, however
regular they are.  A-Z count as a-z.  Words are runs of bytes without white space; no byte of a longer UTF-8 sequence is
white space, so these are the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes whose words are hashed at once, and bytes of text in one piece of a batch.
WINDOW = 1 << 18
PIECE_BYTES = 4 << 20
_PRIME = (1 << 61) - 1
#: the place of the polynomial: a random number below the prime
_BASE = 0x0B4F2A6D93E1C587

_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_SOLID = np.ones(256, bool)
_SOLID[list(SPACES)] = False
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers, by multiplying and shifting."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - np.uint64(_PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 31 bits."""
    low, u = np.uint64((1 << 31) - 1), np.uint64
    a1, a0, b1, b0 = a >> u(31), a & low, b >> u(31), b & low
    middle = a1 * b0 + a0 * b1
    return reduced(u(2) * (a1 * b1) + (middle >> u(30)) + ((middle & u((1 << 30) - 1)) << u(31)) + a0 * b0)


def powers() -> list[np.ndarray]:
    """Upper 31 and lower 30 bits of the base's powers below ``WINDOW``, and the inverses of these powers."""
    if not _powers:
        both = []
        for base in (_BASE, pow(_BASE, -1, _PRIME)):
            out = np.ones(1, np.uint64)
            while len(out) <= WINDOW:
                out = np.concatenate([out, times(out, np.full(len(out), pow(base, len(out), _PRIME), np.uint64))])
            both.append(out[: WINDOW + 1])
        _powers[:] = [both[0] >> np.uint64(30), both[0] & np.uint64((1 << 30) - 1), both[1]]
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after the other, and where each text begins, with the end; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def word_bounds(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one byte of each word; a text's begin and end part words as well."""
    solid = _SOLID[flat]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = at[1:-1]
    inner = edges[(edges > 0) & (edges < len(flat))]
    start[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def window_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomials of spans that lie within ``WINDOW`` bytes."""
    upper, lower, inverse = powers()
    low, n = int(start[0]), int(end[-1] - start[0])
    value = _VALUE[flat[low : low + n]]
    s, e, parts = start - low, end - low, []
    for power in (upper, lower):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value * power[:n], out=sums[1:])
        parts.append(sums[e] - sums[s])
    high = parts[0]
    total = reduced((high >> np.uint64(31)) + ((high & np.uint64((1 << 31) - 1)) << np.uint64(30)) + parts[1])
    return times(total, inverse[s])


def span_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, which are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + WINDOW, "right")))
        if end[i] - start[i] > WINDOW:  # one long span, window by window
            cuts = np.arange(start[i], end[i], WINDOW)
            each = [int(window_hashes(flat, cuts[k : k + 1], np.minimum(cuts[k : k + 1] + WINDOW, end[i]))[0]) for k in range(len(cuts))]
            out[i] = sum(h * pow(_BASE, k * WINDOW, _PRIME) for k, h in enumerate(each)) % _PRIME
        else:
            out[i:j] = window_hashes(flat, start[i:j], end[i:j])
        i = j
    return mixed(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, lower-cased (A-Z), and how many each text has."""
    flat, at = text_bytes(column)
    start, end = word_bounds(flat, at)
    return span_hashes(flat, start, end), np.diff(np.searchsorted(start, at))


def pieces(batches: Iterator[pa.RecordBatch], most_rows: int = 2000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``most_rows`` rows and about ``PIECE_BYTES`` of text; a longer text is one by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        row = 0
        while row < batch.num_rows:
            upto = int(np.searchsorted(at, at[row] + PIECE_BYTES, "right")) - 1
            n = max(1, min(most_rows, upto - row))
            yield batch.slice(row, n)
            row += n


class Slots:
    """Numbers for 64-bit keys: the keys met, each with the next number, looked up many at a time.

    The table is open to ``2**bits`` keys at a third of its size; ``full`` tells when it should be cleared.
    """

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.numbers = np.full(1 << self.bits, -1, np.int32)
        self.n = 0

    @property
    def full(self) -> bool:
        return self.n > (1 << self.bits) // 3

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys``, -1 where a key is new."""
        mask = np.uint64((1 << self.bits) - 1)
        at = (keys & mask).astype(np.int64)
        out = self.numbers[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(mask)
            found = self.numbers[at[todo]]
            out[todo] = found
            todo = todo[(found >= 0) & (self.keys[at[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Gives the next numbers to distinct new ``keys``, in order."""
        mask = (1 << self.bits) - 1
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        at = (keys & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.numbers[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.numbers[at[placed]] = keys[placed], numbers[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & mask
        self.n += len(keys)
