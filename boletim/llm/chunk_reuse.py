"""BPE encoding by content-defined chunks, and decoding.

A text is cut where a hash of the last bytes has its low bits zero, so equal passages are cut alike wherever
they stand. A chunk is encoded once, as if it were a text of its own, and kept for every later document of the worker that holds
it. Near a cut its ids are wrong. So the text around each join is encoded again, from a unit before it to a unit
after it, until this stretch agrees with what was kept on both sides: ``AGREE`` units running have the same place and ids in both,
and lie farther from the join than a token that is matched as a whole is long. There the kept ids go on in the stretch's and
these in the next chunk's. If they disagree the stretch grows; if it has outgrown a chunk, the chunks beside the join become one
that is encoded anew, at least twice as long each time, up to the whole text.

Why agreement is enough: merges by rank give a sequence of tokens exactly if they give each two adjacent ones, so sequences
that share a token may be joined at it. This holds for tokenizers whose cuts between pieces depend on the text
nearby only, as those of the usual patterns do.

A unit is the least part whose place in the text is known: for any file of the tokenizers library that has a token for every
character, a token, or the tokens of one character (``LibraryUnits``). Files whose words don't depend on each other, such as ``word_bpe_49k.json``, are served faster
by a table of words, and a unit is a word (``WordUnits``).

Chunks are shared inside a worker, not across the cluster: moving ids between machines would move more
bytes than the texts have. The table of chunks is bounded and starts afresh when full.

Edge cases: a null text is empty: no ids, and it decodes to an empty text. Texts of any length are taken whole; a
repeated row gives a repeated result; an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boletim.llm.common import steps
from boletim.llm.word_tokens import WordTokens, loaded, words_are_independent

TOKENIZER = "word_bpe_49k.json"
#: Bytes the rolling hash sees, low bits that must be zero at a cut, and the least bytes between two cuts.
WINDOW = 16
CUT_BITS = 9
LEAST = 64
#: Bytes of ids and chunks kept by a worker, and entries of its tables of words and of pieces. A worker keeps them
#: while it serves later stages, so they are small.
TABLE_BYTES = 16 << 20
WORDS = 250_000
PIECES = 300_000
#: Units that must agree on either side of a join, and the least bytes between them and the join.
AGREE = 2
MARGIN = 16

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text; the last one is the text's end."""
    n = len(text)
    if n <= LEAST + WINDOW:
        return [n]
    low = np.ndarray((n - WINDOW + 1,), "<u8", text, 0, (1,))
    high = np.ndarray((n - WINDOW + 1,), "<u8", text, 8, (1,))
    h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    found, last = [], 0
    for end in (np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + WINDOW).tolist():
        while end < n and text[end] & 0xC0 == 0x80:  # a character is not cut
            end += 1
        if end - last >= LEAST and end < n:
            found.append(end)
            last = end
    return [*found, n]


class Units(NamedTuple):
    """Where the units of a text start and end, in bytes, and their ids: those of unit i are ``ids[at[i]:at[i + 1]]``."""

    starts: array
    ends: array
    at: array
    ids: bytes

    def __len__(self) -> int:
        return len(self.starts)

    def same(self, i: int, other: Units, j: int, shift: int) -> bool:
        """If unit i is unit j of the other text, ``shift`` bytes farther on here."""
        return (
            j < len(other)
            and self.starts[i] == other.starts[j] + shift
            and self.ends[i] == other.ends[j] + shift
            and self.ids[self.at[i] : self.at[i + 1]] == other.ids[other.at[j] : other.at[j + 1]]
        )


class WordUnits:
    """Units of a tokenizer whose words don't depend on each other: its words."""

    def __init__(self, words: WordTokens) -> None:
        self._words, self.dtype, self.tokens = words, words.dtype, words.tokens
        self.size, self.margin = len(words.tokens), MARGIN

    def units(self, texts: Sequence[bytes]) -> list[Units]:
        words = self._words.each(texts)
        # All texts in one buffer, a line feed behind each; words start and end where white space changes.
        space = _SPACE[np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)]
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        at = np.cumsum(np.fromiter(map(len, chain([b""], *words)), np.int64))
        out, first, place = [], 0, 0
        for text, own in zip(texts, words, strict=True):
            last = first + len(own)
            out.append(Units(
                array("q", (starts[first:last] - place).tobytes()), array("q", (ends[first:last] - place).tobytes()),
                array("q", (at[first : last + 1] - at[first]).tobytes()), b"".join(own),
            ))
            first, place = last, place + len(text) + 1
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens between spaces, as the library joins them for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


class LibraryUnits:
    """Units of any tokenizer of the library: a token, or tokens that share a character."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self._library = tokenizer
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.dtype = np.dtype("<u4")
        self.size = max(tokenizer.get_vocab().values(), default=-1) + 1
        own = tokenizer.get_added_tokens_decoder().values()
        self.margin = max([MARGIN, *(len(t.content.encode()) + 1 for t in own)])

    def units(self, texts: Sequence[bytes]) -> list[Units]:
        found = self._library.encode_batch([t.decode() for t in texts], add_special_tokens=False)
        return [self._placed(text, e.ids, e.offsets) for text, e in zip(texts, found, strict=True)]

    def _placed(self, text: bytes, ids: list[int], spans: list[tuple[int, int]]) -> Units:
        starts, ends, at = array("q"), array("q"), array("q")
        for i, (a, b) in enumerate(spans):
            if starts and (a < ends[-1] or a == b):
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
                at.append(i * self.dtype.itemsize)
        at.append(len(ids) * self.dtype.itemsize)
        if not text.isascii():  # places count characters
            place = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80), len(text))
            starts, ends = (array("q", place[np.array(x, int)].tolist()) for x in (starts, ends))
        return Units(starts, ends, at, np.array(ids, self.dtype).tobytes())

    def decode(self, ids: np.ndarray) -> str:
        return self._library.decode(ids.tolist(), skip_special_tokens=False)


class _Reach(NamedTuple):
    """A stretch around a join: first unit it takes on the left and bytes there, last one on the right and bytes there.

    A unit is None where the stretch reaches the text's begin or end, so there is nothing to agree with.
    """

    left: int | None
    start: int
    right: int | None
    end: int


class _Part(NamedTuple):
    """A chunk, or several encoded as one, and how the part before goes over into it.

    Of the part before ``until`` units are used, then the ids ``between``, then this part's units from ``since`` on.
    """

    start: int
    end: int
    units: Units
    until: int = 0
    between: bytes = b""
    since: int = 0


def _reach(before: _Part, after: _Part, margin: int, length: int) -> _Reach | None:
    """The stretch that leaves ``margin`` bytes and ``AGREE`` units on both sides; None if a side hasn't so many."""
    own, to = before.units, after.units
    join = after.start
    left: int | None = bisect_right(own.ends, join - margin - before.start) - AGREE
    if left < before.since:
        if before.start:
            return None
        left, start = None, 0
    else:
        start = before.start + own.starts[left]
    right: int | None = bisect_left(to.starts, margin) + AGREE
    if right > len(to):
        if after.end < length:
            return None
        right, end = None, length
    else:
        end = join + to.ends[right - 1]
    return _Reach(left, start, right, end)


class ChunkEncoder:
    """Ids of texts by chunks; ``engine`` is a ``WordUnits`` or ``LibraryUnits``."""

    def __init__(self, engine: WordUnits | LibraryUnits, table_bytes: int = TABLE_BYTES) -> None:
        self.engine = engine
        self.decimal = [str(i) for i in range(engine.size)]
        self._table: dict[bytes, Units] = {}
        self._held, self._most = 0, table_bytes
        #: Chunks encoded and found again; stretches that had to grow; chunks made one.
        self.encoded = self.reused = self.grown = self.merged = 0

    def _keep(self, wanted: dict[bytes, None]) -> None:
        texts = list(wanted)
        for text, units in zip(texts, self.engine.units(texts), strict=True):
            self._table[text] = units
            self._held += len(text) + len(units.ids) + 24 * len(units) + 500

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        if self._held > self._most:
            self._table.clear()
            self._held = 0
        ends = [cuts(text) for text in texts]
        wanted: dict[bytes, None] = {}
        for text, own in zip(texts, ends, strict=True):
            for start, end in zip([0, *own], own, strict=False):
                chunk = text[start:end]
                if chunk in self._table or chunk in wanted:
                    self.reused += 1
                else:
                    wanted[chunk] = None
                    self.encoded += 1
        self._keep(wanted)

        parts: list[list[_Part]] = []
        wanted = {}
        for text, own in zip(texts, ends, strict=True):
            parts.append([_Part(a, b, self._table[text[a:b]]) for a, b in zip([0, *own], own, strict=False)])
            for before, after in zip(parts[-1], parts[-1][1:], strict=False):
                reach = _reach(before, after, self.engine.margin, len(text))
                if reach and text[reach.start : reach.end] not in self._table:
                    wanted[text[reach.start : reach.end]] = None
        self._keep(wanted)
        return [np.frombuffer(self._assembled(t, p), self.engine.dtype) for t, p in zip(texts, parts, strict=True)]

    def _units(self, text: bytes) -> Units:
        return self._table[text] if text in self._table else self.engine.units([text])[0]

    def _assembled(self, text: bytes, chunks: list[_Part]) -> bytes:
        done: list[_Part] = []
        at = 0
        while at < len(chunks):
            part, at = chunks[at], at + 1
            while done:
                joined = self._joined(text, done[-1], part)
                if joined:
                    part = joined
                    break
                # Make one of both, and of as much again: a long text without a place to agree is soon taken whole.
                start, end = done.pop().start, part.end
                wanted = start + 2 * (end - start)
                while at < len(chunks) and end < wanted:
                    end, at = chunks[at].end, at + 1
                self.merged += 1
                part = _Part(start, end, self._units(text[start:end]))
            done.append(part)
        out = []
        for i, part in enumerate(done):
            until = done[i + 1].until if i + 1 < len(done) else len(part.units)
            out += [part.between, part.units.ids[part.units.at[part.since] : part.units.at[until]]]
        return b"".join(out)

    def _joined(self, text: bytes, before: _Part, after: _Part) -> _Part | None:
        """``after`` with its joint to the part before it; None if no stretch inside both agrees with both."""
        own, to, join, margin = before.units, after.units, after.start, self.engine.margin
        while reach := _reach(before, after, margin, len(text)):
            mid = self._units(text[reach.start : reach.end])
            until, first, since, last = 0, 0, len(to), len(mid)
            agreed = True
            if reach.left is not None:
                shift = reach.start - before.start
                outermost = bisect_right(own.ends, join - self.engine.margin - before.start) - AGREE
                for u in range(outermost, reach.left - 1, -1):
                    t = bisect_left(mid.starts, own.starts[u] - shift)
                    if all(own.same(u + d, mid, t + d, shift) for d in range(AGREE)):
                        until, first = u + AGREE, t + AGREE
                        break
                else:
                    agreed = False
            if agreed and reach.right is not None:
                shift = reach.start - join
                for u in range(bisect_left(to.starts, self.engine.margin), reach.right - AGREE + 1):
                    t = bisect_left(mid.starts, to.starts[u] - shift)
                    if all(to.same(u + d, mid, t + d, shift) for d in range(AGREE)):
                        since, last = u, t
                        break
                else:
                    agreed = False
            if agreed and first <= last:
                return after._replace(until=until, between=mid.ids[mid.at[first] : mid.at[last]], since=since)
            self.grown += 1
            margin *= 4
        return None


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per worker and file, so its tables serve all tasks of the worker."""
    if path not in _ENCODERS:
        if words_are_independent(path):
            _ENCODERS[path] = ChunkEncoder(WordUnits(loaded(path, WORDS, PIECES)))
        else:
            _ENCODERS[path] = ChunkEncoder(LibraryUnits(Tokenizer.from_file(path)))
    return _ENCODERS[path]


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of every document."""
    path = path or public_tokenizers.path(TOKENIZER)

    def rows(batches):
        own = encoder(path)
        for batch in batches:
            for first, texts in steps(batch):
                ids = own.encode(texts)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(first, len(texts)).cast(pa.int64()),
                     pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                     pa.array([own.engine.decode(x) for x in ids], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, ids array<int>, decoded string"
    )


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, made where the ids are."""
    path = path or public_tokenizers.path(TOKENIZER)

    def rows(batches):
        own = encoder(path)
        for batch in batches:
            for first, texts in steps(batch):
                ids = own.encode(texts)
                numbers = [" ".join(map(own.decimal.__getitem__, x.tolist())) for x in ids]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(first, len(texts)).cast(pa.int64()),
                     pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x.encode()).hexdigest() for x in numbers]),
                     pa.array([hashlib.sha256(own.engine.decode(x).encode()).hexdigest() for x in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
