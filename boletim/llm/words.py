"""Words of many texts at once, as numpy arrays of positions and 64-bit hashes.

A word is a longest run of bytes other than space and 0x09 to 0x0D, so a text in UTF-8 is
never cut inside a character. Equality of words, windows and lines is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit changes about half of the output bits."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_CODE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_LOWER = _CODE.copy()
_LOWER[0x41:0x5B] = _CODE[0x61:0x7B]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Odd multipliers for the places of a window.
PLACES = mix(np.arange(101, 117, dtype=_U)) | _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SEGMENT, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        up = np.full(size, _BASE, _U)
        down = np.full(size, _INVERSE, _U)
        up[0] = down[0] = 1
        pair = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > _SEGMENT:  # for one very long word; not kept
            return pair
        _POWERS[size] = pair
    return _POWERS[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each byte range; ranges are in order and don't overlap. Empty ranges hash alike."""
    code = _LOWER if lower else _CODE
    out = np.empty(len(starts), _U)
    i, n = 0, len(starts)
    while i < n:
        first = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, first + _SEGMENT, "right")))
        up, down = _powers(int(ends[j - 1]) - first + 1)
        part = code[data[first : int(ends[j - 1])]]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((sums[e] - sums[s]) * down[s])
        i = j
    return out


@dataclass
class Words:
    """Words of several texts in order: byte range in ``data``, number of the text, first word of each text."""

    data: np.ndarray
    text_start: np.ndarray
    text_end: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # one more entry than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, lower)


def split_words(texts: Sequence[bytes]) -> Words:
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_start = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else sizes
    edge = np.diff(SPACE[data].view(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    first = np.concatenate([np.searchsorted(start, text_start), [len(start)]])
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, text_start, text_start + sizes, start, end, text, first)


def window_hashes(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``width`` words inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = hashes[:n] * PLACES[0]
    for k in range(1, width):
        total += hashes[k : k + n] * PLACES[k]
    inside = np.flatnonzero(words.text[:n] == words.text[width - 1 :])
    return mix(total[inside]), inside


def rolling_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` hashes, from running sums; runs may reach over texts."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, _U)
    up, down = _powers(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def keyed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(hashes + (text.astype(_U) + _U(1)) * PLACES[15])


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=n)


def range_sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each range."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[end] - sums[start]
