"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Both dictionaries are trained by the zstandard library: the ordinary one on windows of ordinary documents, the toxic one on the
passages that set toxic documents apart, which are what runs found in many toxic and few ordinary documents cover of a
word. The toxic one is laid over the ordinary one, so both explain ordinary text equally well. A text is cut into
windows, first of ``WINDOW_WORDS`` words; where the toxic dictionary saves bytes, the window is cut again into windows of one word
between bytes that both dictionaries hold. The distance of a window is what the toxic dictionary saves less what it
still needs.

The threshold of a distance, and the score of a document from its largest distance and its windows beyond the threshold, are
calibrated by cross-fitting: each third of the learning documents, by a hash of the text, is compressed with dictionaries trained on the
other two. The dictionaries that score are trained in the same way on all three. Nothing depends on the order of the learning rows, and
they never come to the driver: each training is a task, whose texts are bounded by ``FIT_BYTES``.

Edge cases: a null text is empty; empty texts have no window and get a score like any text without
distance; repeated rows are scored one by one; of several texts of one learnable id the smallest is learnt; without learnable
labels of both kinds every score is the share of label 1 (zero without any); an empty table gives no rows. Labels,
language, source and id are never inputs.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boletim.llm.common import kept_rows, learning_rows, remainder, steps, written
from boletim.llm.words import span_hashes

#: At most so many labelled documents are used to train and calibrate, of so many bytes; a longer one than ``FIT_TEXT`` is left out.
FIT_ROWS = 8_000
FIT_BYTES = 32 << 20
FIT_TEXT = 256 << 10
#: Documents are dealt by their text to so many folds, each calibrated with dictionaries of the others.
FOLDS = 3
#: Words in a first window, bytes of the ordinary dictionary, windows it is trained on, spread over all ordinary documents.
WINDOW_WORDS = 8
ORDINARY_BYTES = 4_096
ORDINARY_WINDOWS = 60_000
#: The toxic dictionary has so many bytes for each byte of its different passages, between these bounds.
TOXIC_SHARE = 3
TOXIC_BYTES = (4_096, 24_576)
#: Bytes that the trainer counts together, and bytes of a segment that it takes up, for both dictionaries.
ORDINARY_SEGMENTS = (6, 48)
TOXIC_SEGMENTS = (6, 200)
#: A word is cut into pieces of so many bytes.
WORD_BYTES = 48
#: Bytes in a run that may set toxic text apart, beside whole words, and most bytes of a passage; least toxic documents
#: that must hold a run, the chance that so many documents all happen to be toxic, and the share of toxic text among the
#: run's documents if both kinds were equally common.
RUNS = (5, 8)
LONGEST = 50
LEAST_TOXIC = 3
CHANCE = 1e-4
LEAST_SHARE = 0.97
#: A window that the toxic dictionary shortens by so many bytes is looked at word by word, behind so much context.
LOOK_CLOSER = 2
CONTEXT = 16
#: Between these the best word of a text counts; beyond them it says no more.
FLOOR, CEILING = 0, 6
#: Share of the looked-at words of ordinary documents that the threshold leaves below.
CALM_SHARE = 0.99


def windows(text: bytes) -> list[bytes]:
    """The lower-cased words of the text, a few at a time, between single spaces."""
    words = text.lower().split()
    if max(map(len, words), default=0) > WORD_BYTES:
        words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return [
        b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)
    ]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=13, chain_log=13, search_log=3, min_match=4, target_length=16,
        strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False,
        write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def _trained(samples: list[bytes], size: int, segments: tuple[int, int]) -> bytes:
    """Dictionary trained on the samples by the library; the commonest samples if they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, d=segments[0], k=segments[1]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return _commonest(samples, size)


def _commonest(samples: list[bytes], size: int) -> bytes:
    """The different samples that fit, commonest first taken and last put, where offsets are short."""
    kept, length = [], 0
    for sample, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])):
        if length + len(sample) <= size:
            kept.append(sample)
            length += len(sample)
    return b"".join(reversed(kept))


def _layers(samples: list[bytes]) -> list[bytes]:
    """All different samples, then all found twice or more, and so on, so that a segment holds many different ones."""
    left = Counter(samples)
    order, out = sorted(left, key=lambda x: (-left[x], x)), []
    while order:
        out += order
        left.subtract(order)
        order = [x for x in order if left[x]]
    return out


def _filler(size: int) -> bytes:
    """Bytes that no text holds, to give both dictionaries one length and so equal offsets."""
    return bytes(1 + (i * 7 + i // 5) % 8 for i in range(size))


class _Runs:
    """Runs of a text's words, the spaces beside them included: of ``RUNS`` bytes, and whole words.

    ``keys`` has for each kind the runs as numbers, ``start`` and ``end`` their places in ``text`` and ``word`` the
    number of the word each lies in; ``before`` has a hash of the word before each word. With ``only`` there is one kind.
    """

    def __init__(self, source: bytes, only: int | None = None) -> None:
        self.text = b" " + b" ".join(source.lower().split()) + b" "
        data = np.frombuffer(self.text, np.uint8)
        spaces = np.concatenate([[0], np.cumsum(data == 0x20)])
        first = np.flatnonzero(data == 0x20)
        starts, ends = first[:-1] + 1, first[1:]
        full = starts < ends
        starts, ends = starts[full], ends[full]
        whole = span_hashes(data, starts, ends)
        self.before = np.concatenate([np.zeros(1, np.uint64), whole])
        self.keys, self.start, self.end, self.word = [], [], [], []
        for kind, n in enumerate(RUNS):
            if only not in (None, kind):
                continue
            at = np.arange(max(len(data) - n + 1, 0))
            at = at[spaces[at + n - 1] == spaces[at + 1]]  # no space but at the ends
            key = np.zeros(len(at), np.uint64)
            for k in range(n):
                key = key << np.uint64(8) | data[at + k].astype(np.uint64)
            self._add(key, at, at + n, np.searchsorted(ends, at, "right"))
        if only in (None, len(RUNS)):
            self._add(whole, starts - 1, ends + 1, np.arange(len(starts)))

    def _add(self, key, start, end, word) -> None:
        self.keys.append(key)
        self.start.append(start.astype(np.int32))
        self.end.append(end.astype(np.int32))
        self.word.append(word.astype(np.int32))


def telling_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """What runs found mostly in toxic documents cover of each word, the spaces beside it included.

    A run must follow several different words, or copies of one document would make all their runs telling.
    """
    share = len(toxic) / max(len(toxic) + len(ordinary), 1)
    least = max(LEAST_TOXIC, np.log(CHANCE) / np.log(min(max(share, 1e-6), 0.5)))
    weight = len(ordinary) / max(len(toxic), 1)
    kinds = range(len(RUNS) + 1)
    # Runs are some sixty times a text, so they are made anew in each pass and never held for all texts.
    telling = []
    for kind in kinds:
        found = [np.zeros(0, np.uint64), *(np.unique(_Runs(text, kind).keys[0]) for text in toxic)]
        run, seen = np.unique(np.concatenate(found), return_counts=True)
        telling.append([run[seen >= least], seen[seen >= least], np.zeros(int((seen >= least).sum()), np.int64)])
        del found, run, seen
    for text in ordinary:
        runs = _Runs(text)
        for kind, (run, _, other) in enumerate(telling):
            other[np.isin(run, runs.keys[kind])] += 1
    out: list[bytes] = []
    chosen = [run[seen * weight >= LEAST_SHARE / (1 - LEAST_SHARE) * other] for run, seen, other in telling]
    pairs = [[np.zeros((0, 2), np.uint64)] for _ in kinds]
    for text in toxic:
        r = _Runs(text)
        for kind in kinds:
            hit = np.isin(r.keys[kind], chosen[kind])
            pairs[kind].append(np.unique(np.column_stack([r.keys[kind][hit], r.before[r.word[kind][hit]]]), axis=0))
    varied = []
    for kind in kinds:
        own, words = np.unique(np.unique(np.concatenate(pairs[kind]), axis=0)[:, 0], return_counts=True)
        varied.append(own[words >= least])
    for text in toxic:
        r = _Runs(text)
        spans: dict[int, tuple[int, int]] = {}
        for kind in kinds:
            for i in np.flatnonzero(np.isin(r.keys[kind], varied[kind])).tolist():
                word, start, end = int(r.word[kind][i]), int(r.start[kind][i]), int(r.end[kind][i])
                a, b = spans.get(word, (start, end))
                spans[word] = min(a, start), max(b, end)
        out += [r.text[a : min(b, a + LONGEST)] for _, (a, b) in sorted(spans.items())]
    return out


@dataclass
class Detector:
    ordinary: bytes
    toxic: bytes
    threshold: float
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    base: float

    def prepare(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor, bytes]:
        plain, toxic = self.ordinary + _filler(len(self.toxic)), self.ordinary + self.toxic
        return _compressor(plain), _compressor(toxic), self.ordinary[-CONTEXT:]

    def distances(self, pair, texts: list[bytes]) -> list[np.ndarray]:
        """Bytes saved by the toxic dictionary less the bytes it still needs, for each window of one word in the windows that it
        compresses better; a word that it holds whole saves more than it costs.

        A word is compressed between bytes that both dictionaries hold, as a few bytes alone don't compress and
        the library looks for no match that starts in the last bytes of its input.
        """
        plain, toxic, context = pair[0].compress, pair[1].compress, pair[2]
        bare = len(toxic(context + b" " + context))
        out = []
        for text in texts:
            found = []
            for window in windows(text):
                window += context
                if len(plain(window)) - len(toxic(window)) >= LOOK_CLOSER:
                    for word in window[: -len(context) or None].split():
                        piece = context + b" " + word + b" " + context
                        cost = len(toxic(piece))
                        found.append(len(plain(piece)) - cost - (cost - bare))
            out.append(np.array(found, np.int32))
        return out

    def evidence(self, distances: list[np.ndarray]) -> np.ndarray:
        """Largest distance, number of words beyond the threshold, and whether there is one, for each text."""
        rows = []
        for d in distances:
            beyond = int((d > self.threshold).sum())
            rows.append((float(min(d.max(initial=FLOOR), CEILING)), np.log1p(beyond), float(beyond > 0)))
        return np.array(rows).reshape(len(rows), 3)

    def scores(self, distances: list[np.ndarray]) -> np.ndarray:
        if not self.scale.any():
            return np.full(len(distances), self.base)
        x = (self.evidence(distances) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.base + x @ self.weights, -30, 30)))


def fold(text: bytes) -> int:
    """The fold of a text; copies share it."""
    return zlib.crc32(text) % FOLDS


def train(texts: list[bytes], labels: list[int]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of labelled texts, in whatever order they come."""
    pairs = sorted(zip(texts, labels, strict=True))
    toxic, ordinary = [t for t, y in pairs if y], [t for t, y in pairs if not y]
    step = -(-sum(len(windows(t)) for t in ordinary) // ORDINARY_WINDOWS) or 1
    cut = itertools.islice((w for t in ordinary for w in windows(t)), 0, None, step)
    plain = _trained(list(cut), ORDINARY_BYTES, ORDINARY_SEGMENTS)
    passages = telling_passages(toxic, ordinary)
    least, most = TOXIC_BYTES
    size = min(max(TOXIC_SHARE * sum(map(len, set(passages))), least), most)
    return plain, _trained(_layers(passages), size, TOXIC_SEGMENTS)


def _empty(base: float = 0.0) -> Detector:
    return Detector(b"", b"", 0.0, np.zeros(3), np.zeros(3), np.zeros(3), base)


def held_distances(texts: list[bytes], labels: list[int], at: int) -> list[tuple[int, np.ndarray]]:
    """Label and distances of the texts of one fold, with dictionaries of all others."""
    own = [fold(t) == at for t in texts]
    rest = [(t, y) for t, y, o in zip(texts, labels, own, strict=True) if not o]
    detector = _empty()
    detector.ordinary, detector.toxic = train([t for t, _ in rest], [y for _, y in rest])
    held = [(t, y) for t, y, o in zip(texts, labels, own, strict=True) if o]
    return [(y, d) for (_, y), d in zip(held, detector.distances(detector.prepare(), [t for t, _ in held]), strict=True)]


def calibrated(dictionaries: tuple[bytes, bytes], held: list[tuple[int, np.ndarray]]) -> Detector:
    """Detector with these dictionaries, its threshold and weights from labels and distances of texts they didn't learn from."""
    held = sorted(held, key=lambda x: (x[0], x[1].tolist()))
    y = np.array([label for label, _ in held], float)
    distances = [d for _, d in held]
    detector = _empty(float(y.mean()) if len(y) else 0.0)
    if len(np.unique(y)) < 2:
        return detector
    detector.ordinary, detector.toxic = dictionaries
    calm = np.concatenate([d for d, label in zip(distances, y, strict=True) if not label])
    detector.threshold = float(np.quantile(calm, CALM_SHARE)) if len(calm) else 0.0
    x = detector.evidence(distances)
    detector.centre, detector.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = np.column_stack([np.ones(len(y)), (x - detector.centre) / detector.scale])
    beta = np.zeros(4)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - 0.01 * beta
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(4), slope)
    detector.base, detector.weights = float(beta[0]), beta[1:]
    return detector


def fit(texts: list[bytes], labels: np.ndarray) -> Detector:
    """Detector learnt from texts in this process."""
    marks = [int(y) for y in labels]
    held = [x for at in range(FOLDS) for x in held_distances(texts, marks, at)]
    return calibrated(train(texts, marks), held)


def held_out(column: str = "doc_id"):
    """Whether labels of this id are kept for testing; false for a null id."""
    return F.coalesce(remainder(5, column) == 0, F.lit(False))


def _learnt(documents: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """``text, label`` of the learning rows: lowest by a hash of the id, as far as their bytes go."""
    rows = learning_rows(documents, labels, "toxic", ~held_out(), bound)
    rows = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_TEXT).groupBy("doc_id").agg(
        F.coalesce(F.min("text"), F.lit("")).alias("text"), F.min("label").alias("label")
    )
    rows = written(rows.withColumn("size", F.octet_length("text")), "learning")
    # At most ``bound`` rows of two numbers.
    sizes = rows.select("doc_id", "size")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    within = sizes.withColumn("total", F.sum("size").over(before)).filter(F.col("total") <= FIT_BYTES)
    return rows.join(F.broadcast(within.select("doc_id")), "doc_id", "left_semi").select("text", "label")


def fit_toxicity(documents: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Detector:
    """Detector learnt from at most ``bound`` labelled documents whose remainder modulo 5 is not 0.

    The folds and the final dictionaries are trained side by side, each in a task of at most ``FIT_BYTES`` of text; what comes
    back are the dictionaries and the distances of the learning documents.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("part")
    dealt = _learnt(documents, labels, bound).select("text", "label", parts).repartitionByRange(FOLDS + 1, "part")

    def trained(batches):
        held: dict[int, list] = {}
        for batch in batches:
            texts, marks = batch.column("text").cast(pa.binary()), batch.column("label").to_pylist()
            for i, part in enumerate(batch.column("part").to_pylist()):
                held.setdefault(part, []).append((texts[i].as_py(), marks[i]))
        for part in sorted(held):
            rows = held.pop(part)
            texts, marks = [t for t, _ in rows], [y for _, y in rows]
            if part < FOLDS:
                out = [(y, d.astype("<i4").tobytes(), None) for y, d in held_distances(texts, marks, part)]
            else:
                out = [(None, *train(texts, marks))]
            columns = zip(pa.schema([("label", pa.int32()), ("one", pa.binary()), ("two", pa.binary())]), zip(*out, strict=True), strict=True)
            if out:
                yield pa.record_batch({f.name: pa.array(list(v), f.type) for f, v in columns})

    got = dealt.mapInArrow(trained, "label int, one binary, two binary").collect()
    held = [(r.label, np.frombuffer(r.one, "<i4")) for r in got if r.label is not None]
    dictionaries = next(((bytes(r.one), bytes(r.two)) for r in got if r.label is None), (b"", b""))
    return calibrated(dictionaries, held)


def score(documents: DataFrame, detector: Detector) -> DataFrame:
    """``doc_id, score, predicted`` of every document."""

    def rows(batches):
        pair = detector.prepare()
        for batch in batches:
            for first, texts in steps(batch):
                s = detector.scores(detector.distances(pair, texts))
                ids = batch.column("doc_id").slice(first, len(texts)).cast(pa.int64())
                yield pa.record_batch(
                    [ids, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, score double, predicted int"
    )


def filter_documents(documents: DataFrame, detector: Detector) -> DataFrame:
    """The documents that score below one half, with all their columns; a null text counts as empty."""

    def rows(batches):
        pair = detector.prepare()
        for batch in batches:
            keep = [detector.scores(detector.distances(pair, texts)) < 0.5 for _, texts in steps(batch)]
            if keep:
                yield kept_rows(batch, np.concatenate(keep))

    return documents.mapInArrow(rows, documents.schema)
