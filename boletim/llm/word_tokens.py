"""Token ids of whole texts by a tokenizer whose words don't depend on each other.

The tokenizer is a file of the tokenizers library that lower-cases, drops white space and marks word ends
(such as ``word_bpe_49k.json``). Its ids of a text are then the ids of the text's words one after another, so each
distinct word goes through the library once and is looked up afterwards. Text is cut at ASCII white space only;
words of common letters are cut further into the library's own pieces, so that a comma or a capital doesn't make
a new entry. Anything else goes to the library as it stands. All tables are bounded and start afresh when full.

Whole texts are looked up as arrays, a portion of their words at a time: a word of at most 15 bytes is two numbers, which
hold its bytes and its length, so numbers are equal exactly if words are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from itertools import chain
from pathlib import Path

import numpy as np
import regex
from tokenizers import Tokenizer

from boletim.llm.words import mix, split_words

#: Entries of the tables of words and of pieces.
WORDS = 900_000
PIECES = 700_000
#: Pieces that go through the library in one text, and texts in one call.
_TOGETHER = 64
_TEXTS = 64
#: Words that are looked up at a time.
_PORTION = 1 << 17
#: Bytes of a word that two numbers hold beside its length, and the bits of the first so many bytes.
_SHORT = 15
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Fixed values of the tokenizer file: its pieces (and the line feed put between words), and the mark of a word's last
#: token.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
_WORD_END = "</w>"
#: Letters whose class, lower case and composed form are the same in every version of Unicode.
_COMMON = regex.compile(r"[!-~¡-į\n]*")


def _numbers(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each word of at most ``_SHORT`` bytes: its bytes and its length; 16 bytes follow the last word."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    low = eight[start] & _FIRST[np.minimum(size, 8)]
    high = eight[start + 8] & _FIRST[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
    return low, high


class _Index:
    """Ids of words, found for many words at once. Entry 0 stands for a word that isn't there."""

    def __init__(self, dtype: np.dtype) -> None:
        self._ids, self.dtype = np.zeros(1 << 12, dtype), dtype
        self.clear()

    def clear(self) -> None:
        self.size, self._end = 1, 0
        # Low and high number, first id and number of ids of each entry; no word has the high number of entry 0.
        self._low, self._high = np.zeros(1 << 12, np.uint64), np.full(1 << 12, _FIRST[8])
        self._begin, self._n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._slots = np.zeros(1 << 13, np.int32)
        self.long: dict[bytes, int] = {}

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) & np.uint64(len(self._slots) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each word of at most ``_SHORT`` bytes."""
        slot = self._slot(low, high)
        out = self._slots[slot]
        rest = np.flatnonzero((out != 0) & ((self._low[out] != low) | (self._high[out] != high)))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self._slots) - 1)
            out[rest] = entry = self._slots[slot[rest]]
            rest = rest[(entry != 0) & ((self._low[entry] != low[rest]) | (self._high[entry] != high[rest]))]
        return out

    def _place(self, entries: np.ndarray) -> None:
        slot = self._slot(self._low[entries], self._high[entries])
        while len(entries):
            free = self._slots[slot] == 0
            self._slots[slot[free]] = entries[free]
            left = self._slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & (len(self._slots) - 1)

    def add(self, learnt: dict[bytes, bytes]) -> None:
        """Words that aren't there yet, with their ids as bytes."""
        words, old = sorted(learnt, key=len), self.size
        self.size += len(words)
        ids = np.frombuffer(b"".join(map(learnt.__getitem__, words)), self.dtype)
        if self._end + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids[: self._end], np.zeros(self._end + 2 * len(ids), self.dtype)])
        self._ids[self._end : self._end + len(ids)] = ids
        if self.size > len(self._low):
            more = self.size + len(words)
            for name in ("_low", "_high", "_begin", "_n"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held[:old], np.zeros(more, held.dtype)]))
        n = np.fromiter((len(learnt[w]) for w in words), np.int64, len(words)) // self.dtype.itemsize
        self._n[old : self.size], self._begin[old : self.size] = n, self._end + np.cumsum(n) - n
        self._end += len(ids)
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = int(np.searchsorted(size, _SHORT, "right"))
        data = np.frombuffer(b"".join(words[:short]) + bytes(16), np.uint8)
        start, size = np.cumsum(size[:short]) - size[:short], size[:short]
        self._low[old : old + short], self._high[old : old + short] = _numbers(data, start, size)
        self.long.update(zip(words[short:], range(old + short, self.size), strict=True))
        # An entry of a long word has no slot.
        self._high[old + short : self.size] = _FIRST[8]
        if 2 * self.size > len(self._slots):
            self._slots = np.zeros(1 << (4 * self.size).bit_length(), np.int32)
            held = np.arange(1, self.size, dtype=np.int32)
            self._place(held[self._high[1 : self.size] != _FIRST[8]])
        else:
            self._place(np.arange(old, old + short, dtype=np.int32))

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries one after another, and how many each has."""
        n = self._n[entries]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self._ids[np.repeat(self._begin[entries] - ends + n, n) + np.arange(total)], n


class WordTokens:
    def __init__(self, path: str, words: int = WORDS, pieces: int = PIECES) -> None:
        # Spark gives each core a task; the library needs no threads of its own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        size = max(self._library.get_vocab().values()) + 1
        self.tokens = [self._library.id_to_token(i) or "" for i in range(size)]
        self.dtype = np.dtype("<u2") if size < 1 << 16 else np.dtype("<u4")
        #: No token's id: it stands between two words while they are learnt.
        self._between = np.iinfo(self.dtype).max
        self._ends = np.array([t.endswith(_WORD_END) for t in self.tokens])
        self._words: dict[bytes, bytes] = {}
        self._pieces: dict[str, bytes] = {"\n": self.dtype.type(self._between).tobytes()}
        self._index = _Index(self.dtype)
        self._most = words, pieces

    def library_ids(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of each text as little-endian numbers of ``dtype``."""
        w = split_words(texts)
        data, counts, ids = np.concatenate([w.data, np.zeros(16, np.uint8)]), [], []
        for at in range(0, len(w.start), _PORTION):
            found, n = self._index.ids(self._entries(data, w.start[at : at + _PORTION], w.end[at : at + _PORTION]))
            ids.append(found.tobytes())
            counts.append(n)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        raw, cut = b"".join(ids), (self.dtype.itemsize * ends[w.first]).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Entry of each word in the index, all of them learnt."""
        size = end - start
        short, long = np.flatnonzero(size <= _SHORT), np.flatnonzero(size > _SHORT)
        low, high = _numbers(data, start[short], size[short])
        spelt = [data[a:b].tobytes() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]

        def missing(found: np.ndarray) -> set[bytes]:
            own = short[found == 0]
            base = int(start[own[0]]) if len(own) else 0
            raw = data[base : int(end[own[-1]])].tobytes() if len(own) else b""
            new = {raw[a:b] for a, b in zip((start[own] - base).tolist(), (end[own] - base).tolist(), strict=True)}
            return new.union(set(spelt).difference(self._index.long))

        found = self._index.find(low, high)
        new = missing(found)
        if self._index.size + len(new) > self._most[0] + 1:
            self._index.clear()
            found = np.zeros_like(found)
            new = missing(found)
        if new:
            self._index.add(self._learn(new))
            own = np.flatnonzero(found == 0)
            found[own] = self._index.find(low[own], high[own])
        out = np.empty(len(start), np.int32)
        out[short] = found
        out[long] = np.fromiter(map(self._index.long.__getitem__, spelt), np.int32, len(spelt))
        return out

    def each(self, texts: Sequence[bytes]) -> list[list[bytes]]:
        """Ids of each word of each text."""
        find, cut = self._words.__getitem__, self._cut(texts)
        return [list(map(find, words)) for words in cut]

    def _cut(self, texts: Sequence[bytes]) -> list[list[bytes]]:
        """The words of each text, all of them in the table."""
        cut = [text.split() for text in texts]
        missing = set(chain.from_iterable(cut)).difference(self._words)
        if len(self._words) + len(missing) > self._most[0]:
            self._words.clear()
            missing = set(chain.from_iterable(cut))
        if missing:
            self._words.update(self._learn(missing))
        return cut

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each word."""
        learnt: dict[bytes, bytes] = {}
        if len(self._pieces) > self._most[1]:
            self._pieces = {"\n": self._pieces["\n"]}
        known = list(words)
        text = b"\n".join(known).decode()
        if "<|" in text or not _COMMON.fullmatch(text):
            odd = [w for w in known if b"<|" in w or not _COMMON.fullmatch(w.decode())]
            learnt.update((word, self.library_ids(word.decode()).tobytes()) for word in odd)
            known = list(words.difference(odd))
            text = b"\n".join(known).decode()
        if not known:
            return learnt
        # One pass cuts all words; a line feed stands between two of them.
        found = _PIECE.findall(text.lower())
        missing = list(set(found).difference(self._pieces))
        for at in range(0, len(missing), _TOGETHER * _TEXTS):
            self._learn_pieces(missing[at : at + _TOGETHER * _TEXTS])
        raw = b"".join(map(self._pieces.__getitem__, found))
        ends = np.flatnonzero(np.frombuffer(raw, self.dtype) == self._between) * self.dtype.itemsize
        starts = [0, *(ends + self.dtype.itemsize).tolist()]
        own = [raw[a:b] for a, b in zip(starts, [*ends.tolist(), len(raw)], strict=True)]
        learnt.update(zip(known, own, strict=True))
        return learnt

    def _learn_pieces(self, pieces: list[str]) -> None:
        size = self.dtype.itemsize
        parts = [pieces[at : at + _TOGETHER] for at in range(0, len(pieces), _TOGETHER)]
        found = self._library.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False)
        for part, encoding in zip(parts, found, strict=True):
            ids = np.array(encoding.ids, self.dtype)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(part):
                self._pieces.update((p, self.library_ids(p).tobytes()) for p in part)
                continue
            raw, cut = ids.tobytes(), [0, *(size * ends).tolist()]
            self._pieces.update(zip(part, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))


def words_are_independent(path: str) -> bool:
    """If the file marks word ends and cuts at the pieces that this module knows."""
    file = json.loads(Path(path).read_text())
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = (steps[0].get("pattern") or {}).get("Regex", "")
    lowers = any(n.get("type") == "Lowercase" for n in (file.get("normalizer") or {}).get("normalizers", []))
    return file["model"].get("end_of_word_suffix") == _WORD_END and lowers and f"{pattern}|\\n" == _PIECE.pattern


_LOADED: dict[tuple[str, int, int], WordTokens] = {}


def loaded(path: str, words: int = WORDS, pieces: int = PIECES) -> WordTokens:
    """One per worker, file and size of the tables."""
    key = path, words, pieces
    if key not in _LOADED:
        _LOADED[key] = WordTokens(*key)
    return _LOADED[key]
