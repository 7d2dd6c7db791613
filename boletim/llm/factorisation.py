"""Quality classifier: a factorisation machine over hashed words, structure and size of a text.

score = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the pairs cost linear time, as their sum is
half of (sum v_i x_i)^2 - sum (v_i x_i)^2 for each of the few factors.

Inputs of a score come from the text alone: hashed words (square root of the count, scaled to length
one), one level for each statistic of structure, and the size of the text as metadata; the label, language,
source and id are never inputs. Edge cases: a null text is empty and gets a score; repeated rows are scored
one by one; without learnable labels of both kinds every score is the share of label 1 (one half without
any); an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boletim.llm.common import kept_rows, learning_rows, remainder, steps
from boletim.llm.statistics import FEATURES, statistics
from boletim.llm.words import split_words

#: At most so many labelled documents are used to fit the model.
FIT_ROWS = 6_000
WORD_BITS = 14
LEVELS = 16
FACTORS = 8
_STRUCTURE = 1 << WORD_BITS
_META = _STRUCTURE + len(FEATURES) * LEVELS
SIZE_LEVELS = 32
COLUMNS = _META + SIZE_LEVELS

#: Upper ends of the levels of the ratios; sizes use the logarithm.
_RATIO_EDGES = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.9])
_SIZE_EDGES = np.arange(1, 16) * 0.75


@dataclass
class Sparse:
    """Rows of (column, value) pairs, one after another; ``first`` has one more entry than rows."""

    first: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def rows(self, order: np.ndarray) -> Sparse:
        sizes = np.diff(self.first)[order]
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.first[:-1][order] - first[:-1], sizes) + np.arange(first[-1])
        return Sparse(first, self.column[at], self.value[at])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each row; every row has an entry."""
        return np.add.reduceat(values, self.first[:-1], axis=0)


def encode(texts: list[bytes]) -> Sparse:
    """Inputs of the model; each row has its structure levels and size, so none is empty."""
    w, n = split_words(texts), len(texts)
    _, stats = statistics(texts)
    bucket = (w.hashes(lower=True) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pair, count = np.unique(w.text * _STRUCTURE + bucket, return_counts=True)
    text, column = pair // _STRUCTURE, pair % _STRUCTURE
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(text, value * value, n))
    value = value / norm[text]
    level = np.column_stack(
        [
            np.searchsorted(_SIZE_EDGES if name.startswith(("log", "mean", "words_per")) else _RATIO_EDGES, c)
            for name, c in zip(FEATURES, stats.T, strict=True)
        ]
    )
    size = np.fromiter((min(len(t).bit_length(), SIZE_LEVELS - 1) for t in texts), np.int64, n)
    dense = np.column_stack([_STRUCTURE + np.arange(len(FEATURES)) * LEVELS + level, _META + size])
    rows = np.concatenate([text, np.repeat(np.arange(n), dense.shape[1])])
    columns = np.concatenate([column, dense.ravel()])
    values = np.concatenate([value, np.full(dense.size, 0.3)])
    order = np.argsort(rows, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return Sparse(first, columns[order].astype(np.int32), values[order].astype(np.float32))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, x: Sparse) -> np.ndarray:
        if len(x.first) == 1:
            return np.zeros(0)
        weighted = self.factors[x.column] * x.value[:, None]
        sums = x.sums(weighted)
        pairs = 0.5 * ((sums * sums).sum(axis=1) - x.sums((weighted * weighted).sum(axis=1)))
        return self.bias + x.sums(self.linear[x.column] * x.value) + pairs

    def scores(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x).astype(np.float64), -40, 40)))


def fit(x: Sparse, y: np.ndarray, epochs: int = 6, rate: float = 0.15, ridge: float = 1e-5, batch: int = 64) -> Machine:
    """Stochastic descent on the logistic loss with a step per coordinate that shrinks with its gradients."""
    random = np.random.default_rng(7)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Machine(
        float(np.log(share / (1 - share))), np.zeros(COLUMNS, np.float32),
        random.normal(0, 0.02, (COLUMNS, FACTORS)).astype(np.float32),
    )
    if len(np.unique(y)) < 2:
        model.factors[:] = 0
        return model
    linear_sq, factor_sq, bias_sq = np.full(COLUMNS, 1e-4, np.float32), np.full((COLUMNS, FACTORS), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(y), batch):
            part = x.rows(order[at : at + batch])
            error = (model.scores(part) - y[order[at : at + batch]]).astype(np.float32)
            each = np.repeat(error, np.diff(part.first)) * part.value
            weighted = model.factors[part.column] * part.value[:, None]
            sums = np.repeat(part.sums(weighted), np.diff(part.first), axis=0)
            columns, place = np.unique(part.column, return_inverse=True)
            grad_v = np.zeros((len(columns), FACTORS), np.float32)
            terms = each[:, None] * (sums - weighted)
            for f in range(FACTORS):
                grad_v[:, f] = np.bincount(place, terms[:, f], len(columns))
            grad_v += ridge * model.factors[columns]
            grad_w = np.bincount(place, each, len(columns)).astype(np.float32) + ridge * model.linear[columns]
            bias_sq += float(error.sum()) ** 2
            model.bias -= 0.05 * float(error.sum()) / np.sqrt(bias_sq)
            linear_sq[columns] += grad_w * grad_w
            model.linear[columns] -= rate * grad_w / np.sqrt(linear_sq[columns])
            factor_sq[columns] += grad_v * grad_v
            model.factors[columns] -= 0.3 * rate * grad_v / np.sqrt(factor_sq[columns])
    return model


def held_out(column: str = "doc_id"):
    """Whether labels of this id are kept for testing; false for a null id."""
    return F.coalesce(remainder(3, column) == 1, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Machine:
    """Machine learnt from at most ``bound`` labelled documents whose remainder modulo 3 is not 1."""
    rows = learning_rows(documents, labels, "quality", ~held_out(), bound)

    def inputs(batches):
        for batch in batches:
            for first, texts in steps(batch):
                x = encode(texts)
                part = batch.slice(first, len(texts))
                cut = [slice(a, b) for a, b in zip(x.first, x.first[1:], strict=False)]
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()),
                     pa.array([x.column[c].tobytes() for c in cut], pa.binary()),
                     pa.array([x.value[c].tobytes() for c in cut], pa.binary())],
                    ["doc_id", "label", "columns", "values"],
                )

    schema = "doc_id long, label int, columns binary, values binary"
    got = sorted(rows.mapInArrow(inputs, schema).collect(), key=lambda r: (r.doc_id, bytes(r[2])))
    columns = [np.frombuffer(r[2], np.int32) for r in got] or [np.zeros(0, np.int32)]
    values = [np.frombuffer(r[3], np.float32) for r in got] or [np.zeros(0, np.float32)]
    first = np.concatenate([[0], np.cumsum([len(c) for c in columns])]) if got else np.zeros(1, np.int64)
    return fit(Sparse(first, np.concatenate(columns), np.concatenate(values)), np.array([float(r.label) for r in got]))


def score(documents: DataFrame, model: Machine) -> DataFrame:
    """``doc_id, score, predicted`` of every document."""

    def rows(batches):
        for batch in batches:
            for first, texts in steps(batch):
                s = model.scores(encode(texts))
                ids = batch.column("doc_id").slice(first, len(texts)).cast(pa.int64())
                yield pa.record_batch(
                    [ids, pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, score double, predicted int"
    )


def filter_documents(documents: DataFrame, model: Machine) -> DataFrame:
    """The documents that score at least one half, with all their columns; a null text counts as empty."""

    def rows(batches):
        for batch in batches:
            keep = [model.scores(encode(texts)) >= 0.5 for _, texts in steps(batch)]
            if keep:
                yield kept_rows(batch, np.concatenate(keep))

    return documents.mapInArrow(rows, documents.schema)
