"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are grown by Newton boosting on binned features. A feature may be given a direction;
then no split on it lets the score move the other way: the outputs of a split's sides must be in
order, and their midpoint bounds everything below. For scoring, all trees are laid out as flat
node arrays and every tree advances all rows one level per step.

Edge cases: a null text counts as empty and fails the base rules; repeated rows are judged one by
one; without any learnable label of both kinds the model keeps all; an empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boletim.llm.common import learning_rows, remainder, steps
from boletim.llm.statistics import BASE, FEATURES, statistics

#: Fixed values of the base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: At most so many labelled documents are used to fit the trees.
FIT_ROWS = 10_000
#: A document is kept if its chance of being good is at least this.
KEEP_FROM = 0.5
#: Directions: the more symbols, repeats or shouting, the lower the score.
MONOTONE = {
    "symbol_ratio": -1,
    "symbol_word_ratio": -1,
    "dup_line_ratio": -1,
    "repeat_word_ratio": -1,
    "upper_ratio": -1,
    "capital_word_ratio": -1,
}


@dataclass
class Trees:
    """All trees in one set of node arrays. A leaf points to itself, so extra steps change nothing."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the reached leaves, a row per row of ``x``; memory grows with rows times trees."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


@dataclass
class _Grower:
    bins: np.ndarray
    edges: list[np.ndarray]
    direction: np.ndarray
    depth: int
    rate: float
    ridge: float = 1.0
    least: float = 2.0
    nodes: list[list[float]] = field(default_factory=list)

    def _gain(self, g, h):
        return g * g / (h + self.ridge)

    def _split(self, rows, g, h, low, high):
        """Best split of the rows as (gain, feature, bin), allowed by the directions."""
        best = (1e-6, -1, -1)
        whole = self._gain(g[rows].sum(), h[rows].sum())
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            b = self.bins[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(edges) + 1))
            hl = np.cumsum(np.bincount(b, h[rows], len(edges) + 1))
            gr, hr = gl[-1] - gl[:-1], hl[-1] - hl[:-1]
            gl, hl = gl[:-1], hl[:-1]
            gain = self._gain(gl, hl) + self._gain(gr, hr) - whole
            gain[(hl < self.least) | (hr < self.least)] = -np.inf
            if self.direction[f]:
                vl = np.clip(-gl / (hl + self.ridge), low, high)
                vr = np.clip(-gr / (hr + self.ridge), low, high)
                gain[(vr - vl) * self.direction[f] < 0] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        return best

    def grow(self, rows, g, h, low=-np.inf, high=np.inf, level=0) -> int:
        """Adds the node of these rows and all below it; gives its number."""
        at = len(self.nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + self.ridge), low, high))
        self.nodes.append([0, np.inf, at, at, self.rate * value])
        if level == self.depth:
            return at
        _, f, k = self._split(rows, g, h, low, high)
        if f < 0:
            return at
        under = self.bins[rows, f] <= k
        bounds = [(low, high), (low, high)]
        if self.direction[f]:
            sides = [
                float(np.clip(-g[r].sum() / (h[r].sum() + self.ridge), low, high))
                for r in (rows[under], rows[~under])
            ]
            middle = sum(sides) / 2
            upward = self.direction[f] > 0
            bounds = [(low, middle), (middle, high)] if upward else [(middle, high), (low, middle)]
        left = self.grow(rows[under], g, h, *bounds[0], level + 1)
        right = self.grow(rows[~under], g, h, *bounds[1], level + 1)
        self.nodes[at] = [f, float(self.edges[f][k]), left, right, 0.0]
        return at


def fit(
    x: np.ndarray, y: np.ndarray, direction: np.ndarray, trees: int = 60, depth: int = 4,
    rate: float = 0.2, bins: int = 64,
) -> Trees:
    """Boosted trees for labels 0 and 1; ``direction`` is -1, 0 or 1 for each column."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else c for c in x.T]
    edges = [e[e < c.max()] if len(c) else e for e, c in zip(edges, x.T, strict=True)]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    share = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    grower = _Grower(binned, edges, direction, depth, rate)
    margin, roots = np.full(len(y), start), []
    if len(np.unique(y)) == 2:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grower.grow(np.arange(len(y)), p - y, p * (1 - p)))
            margin += _flat(grower, roots[-1:], depth, 0.0).margins(x)
    return _flat(grower, roots, depth, start)


def _flat(grower: _Grower, roots: list[int], depth: int, start: float) -> Trees:
    nodes = np.array(grower.nodes or [[0, np.inf, 0, 0, 0.0]])
    return Trees(
        np.array(roots, np.int64), nodes[:, 0].astype(np.int64), nodes[:, 1],
        nodes[:, 2].astype(np.int64), nodes[:, 3].astype(np.int64), nodes[:, 4], depth, start,
    )


def _directions() -> np.ndarray:
    return np.array([MONOTONE.get(name, 0) for name in FEATURES])


def fit_rules(documents: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Trees:
    """Trees learnt from at most ``bound`` labelled documents whose remainder modulo 3 is not 1."""
    rows = learning_rows(documents, labels, "quality", remainder(3) != 1, bound)
    schema = "doc_id long, label int, features array<double>"

    def features(batches):
        for batch in batches:
            for first, texts in steps(batch):
                _, x = statistics(texts)
                part = batch.slice(first, len(texts))
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()),
                     pa.array(list(x), pa.list_(pa.float64()))],
                    ["doc_id", "label", "features"],
                )

    got = sorted(rows.mapInArrow(features, schema).collect(), key=lambda r: (r.doc_id, r.features))
    x = np.array([r.features for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([float(r.label) for r in got]), _directions())


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, quality_score double, kept boolean"
)


def judge(documents: DataFrame, model: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, base verdict, score and verdict of every document."""

    def rows(batches):
        for batch in batches:
            for first, texts in steps(batch):
                base, x = statistics(texts)
                n_words, repeated = base[:, 0], base[:, 4]
                failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
                score = model.scores(x)
                ids = batch.column("doc_id").slice(first, len(texts)).cast(pa.int64())
                yield pa.record_batch(
                    [ids, *[pa.array(c) for c in base.T], pa.array(failed), pa.array(score),
                     pa.array(~failed & (score >= keep_from))],
                    ["doc_id", *BASE, "base_failed", "quality_score", "kept"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, SCHEMA)
