"""Statistics of whole texts that the quality operators use."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from boletim.llm.words import keyed, range_sums, span_hashes, split_words, window_hashes

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8

#: Ratios and sizes a model reads; all come from the text alone.
FEATURES = (
    "log_words",
    "mean_word_chars",
    "symbol_ratio",
    "dup_line_ratio",
    "repeat_word_ratio",
    "upper_ratio",
    "digit_ratio",
    "punctuation_ratio",
    "other_ratio",
    "distinct_word_ratio",
    "words_per_line",
    "symbol_word_ratio",
    "capital_word_ratio",
    "long_word_ratio",
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _flags(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL = _flags(SYMBOLS)
_UPPER = _flags(range(0x41, 0x5B))
_DIGIT = _flags(range(0x30, 0x3A))
_POINT = _flags(b".,;:!?'\"()-")
_LETTER = _flags([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_LEAD = ~_flags(range(0x80, 0xC0))
_HIGH = _flags(range(0x80, 0x100))


def statistics(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (columns of ``BASE``) and features (columns of ``FEATURES``), a row per text."""
    w, n = split_words(texts), len(texts)
    base = np.zeros((n, len(BASE)), np.int64)
    data, counts = w.data, w.counts
    lead = _LEAD[data]
    word_length = range_sums(lead, w.start, w.end)
    base[:, 0] = counts
    base[:, 1] = np.bincount(w.text, weights=word_length, minlength=n)
    symbol = _SYMBOL[data]
    base[:, 2] = range_sums(symbol, w.text_start, w.text_end)
    hashes = w.hashes()

    # Lines that hold a word and equal an earlier line of their text.
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.union1d(w.text_start, breaks + 1)
    text_of = np.searchsorted(w.text_start, starts, "right") - 1
    ends = np.append(starts[1:] - 1, len(data) - 1)
    ends = np.minimum(ends, w.text_end[text_of]) if n else ends
    worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, text_of = starts[worded], ends[worded], text_of[worded]
    lines = np.bincount(text_of, minlength=n)
    key = keyed(span_hashes(data, starts, ends), text_of)
    _, at = np.unique(key, return_index=True)
    base[:, 3] = lines - np.bincount(text_of[at], minlength=n)

    # Words inside a window of eight words that occurs again in the same text.
    windows, first = window_hashes(w, hashes, REPEAT_WINDOW)
    if len(windows):
        key = keyed(windows, w.text[first])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, first[again], 1)
        np.add.at(cover, first[again] + REPEAT_WINDOW, -1)
        inside = np.cumsum(cover[:-1]) > 0
        base[:, 4] = np.bincount(w.text[inside], minlength=n)

    chars = np.maximum(base[:, 1], 1)
    total = np.maximum(counts, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return range_sums(flag[data], w.text_start, w.text_end) / chars

    _, distinct = np.unique(keyed(hashes, w.text), return_index=True)
    upper, letters = range_sums(_UPPER[data], w.start, w.end), range_sums(_LETTER[data], w.start, w.end)

    def words_with(flag: np.ndarray) -> np.ndarray:
        return np.bincount(w.text[flag], minlength=n) / total

    high = range_sums(_HIGH[data] & lead, w.text_start, w.text_end) / chars
    features = np.column_stack(
        [
            np.log1p(counts),
            base[:, 1] / total,
            base[:, 2] / chars,
            base[:, 3] / np.maximum(lines, 1),
            base[:, 4] / total,
            share(_UPPER),
            share(_DIGIT),
            share(_POINT),
            high,
            np.bincount(w.text[distinct], minlength=n) / total,
            counts / np.maximum(lines, 1),
            words_with(range_sums(symbol, w.start, w.end) > 0),
            words_with((upper == letters) & (letters > 1)),
            words_with(word_length > 12),
        ]
    )
    return base, features
