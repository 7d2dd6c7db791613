"""Periodic runs of words: maximal pairs from the LCP-interval tree of each text.

The suffixes of a text are sorted by doubled prefixes, several texts at once, and the words that neighbours share are
counted from the ranks of each doubling. The tree of intervals of shared prefixes is then walked from the bottom up. Each
interval holds the places of its suffixes in order, and each place has its class, the word on its left. Where two
children of an interval meet, places next to each other that come from different children and differ in class are a maximal
pair: their shared prefix can be extended to neither side. A pair with distance d and a prefix of l words is a stretch of
l + d words with period d, and it is maximal as it stands; nothing is extended. Two places that follow each other in an interval
have no third between them, so d is the smallest period whenever the prefix is long enough to count.

Only intervals of ``least prefix`` words or more are walked, and only those with two places so close that a prefix of theirs
can hold enough periods. The smaller child moves into the larger, so a place moves as often as the logarithm of the
words of its text; a text of one word repeated costs no more.

Edge cases: a null text has no words and no runs; repeated rows are judged one by one; words of different texts never
meet; runs that share words are all reported; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boletim.llm.common import steps
from boletim.llm.words import Words, keyed, split_words, window_hashes

#: A run has this many words at least, and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4


def _suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of ``codes``, and how many codes each shares with the one before it."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    edge = np.ones(n, bool)
    edge[1:] = codes[order][1:] != codes[order][:-1]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    levels, length = [rank.copy()], 1
    alone = edge & np.append(edge[1:], True)
    slots = np.flatnonzero(~alone)
    while len(slots):
        open_ = order[slots]
        key = rank[open_] * (n + 2) + rank[np.minimum(open_ + length, n)] + 1
        by = np.argsort(key, kind="stable")  # slots of one rank stay together, as it is the upper part
        open_, key = open_[by], key[by]
        order[slots] = open_
        edge = np.ones(len(slots), bool)
        edge[1:] = key[1:] != key[:-1]
        rank[open_] = slots[np.maximum.accumulate(np.where(edge, np.arange(len(slots)), 0))]
        slots = slots[~(edge & np.append(edge[1:], True))]
        levels.append(rank.copy())
        length *= 2
    shared = np.zeros(n, np.int64)
    near = np.arange(1, n)
    for level in range(len(levels) - 1, -1, -1):
        a, b = order[near] + shared[near], order[near - 1] + shared[near]
        a, b = np.minimum(a, n), np.minimum(b, n)
        same = (levels[level][a] == levels[level][b]) & (a != b)
        shared[near[same]] += 1 << level
    return order, shared


def _joined(a: list[int], b: list[int], left: list[int], prefix: int, found: list, periods: int, words: int) -> list[int]:
    """Both children's places in one list; pairs that count go to ``found`` as (start, length, period)."""
    if len(a) < len(b):
        a, b = b, a
    places = [bisect_left(a, x) for x in b]
    last = len(b) - 1
    for k, (x, at) in enumerate(zip(b, places, strict=True)):
        if at and (k == 0 or places[k - 1] != at):
            d = x - a[at - 1]
            if (periods - 1) * d <= prefix and prefix + d >= words and left[x] != left[a[at - 1]]:
                found.append((a[at - 1], prefix + d, d))
        if at < len(a) and (k == last or places[k + 1] != at):
            d = a[at] - x
            if (periods - 1) * d <= prefix and prefix + d >= words and left[x] != left[a[at]]:
                found.append((x, prefix + d, d))
    if len(b) * 16 < len(a):
        for x, at in zip(reversed(b), reversed(places), strict=True):
            a.insert(at, x)
        return a
    return sorted(a + b)


def _walked(places: list[int], shared: list[int], left: list[int], found: list, periods: int, words: int) -> None:
    """All pairs of one tree: ``places`` in the order of their suffixes, ``shared[k]`` words common to k - 1 and k."""
    stack: list[tuple[int, list[int]]] = []
    child = [places[0]]
    for k in range(1, len(places)):
        prefix = shared[k]
        while stack and stack[-1][0] > prefix:
            above, held = stack.pop()
            child = _joined(held, child, left, above, found, periods, words)
        if stack and stack[-1][0] == prefix:
            stack[-1] = prefix, _joined(stack[-1][1], child, left, prefix, found, periods, words)
        else:
            stack.append((prefix, child))
        child = [places[k]]
    while stack:
        above, held = stack.pop()
        child = _joined(held, child, left, above, found, periods, words)


def runs_in(words: Words, periods: int = LEAST_PERIODS, least: int = LEAST_WORDS) -> np.ndarray:
    """Every run as text, start in the text, length and smallest period, in this order; ``periods`` is 2 or more."""
    # The shortest prefix of a pair that counts: all of a run but its first period.
    shortest = min(max(least - d, (periods - 1) * d) for d in range(1, least + 1))
    hashes = words.hashes()
    width = min(shortest, 8)
    key, first = window_hashes(words, hashes, width)
    _, code, count = np.unique(keyed(key, words.text[first]), return_inverse=True, return_counts=True)
    some = np.zeros(len(words.counts), bool)
    some[words.text[first[count[code] > 1]]] = True
    at = np.flatnonzero(some[words.text])
    none = np.zeros((0, 4), np.int64)
    if not len(at):
        return none
    # Words of different texts get different codes, and a mark of its own stands behind each text.
    _, code = np.unique(keyed(hashes[at], words.text[at]), return_inverse=True)
    text, own = words.text[at], np.flatnonzero(some)
    place = np.arange(len(at)) + np.searchsorted(own, text)
    codes = np.arange(len(at) + len(own)) + len(at)
    codes[place] = code
    order, shared = _suffixes(codes)
    deep = shared >= shortest
    head = np.flatnonzero(~deep & np.append(deep[1:], False))  # first suffix of each tree
    tree = np.cumsum(~deep) - 1
    within = np.flatnonzero(deep | np.append(deep[1:], False))
    if not len(within):
        return none
    # A tree counts if two of its places are as close as its longest prefix allows.
    by = within[np.lexsort((order[within], tree[within]))]
    gap = np.diff(order[by])
    gap[tree[by][1:] != tree[by][:-1]] = len(codes)
    closest = np.full(int(tree[-1]) + 1, len(codes))
    np.minimum.at(closest, tree[by][1:], gap)
    longest = np.zeros(int(tree[-1]) + 1, np.int64)
    np.maximum.at(longest, tree[within], shared[within] * deep[within])
    head = head[(periods - 1) * closest[tree[head]] <= longest[tree[head]]]
    left = np.concatenate([[-1], codes[:-1]]).tolist()
    found: list[tuple[int, int, int]] = []
    for a, b in zip(head.tolist(), np.searchsorted(tree, tree[head], "right").tolist(), strict=True):
        _walked(order[a:b].tolist(), shared[a:b].tolist(), left, found, periods, least)
    if not found:
        return none
    runs = np.array(found)
    which = np.searchsorted(place, runs[:, 0])
    begin = np.searchsorted(text, own)[np.searchsorted(own, text[which])]
    out = np.column_stack([text[which], which - begin, runs[:, 1:]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(documents: DataFrame, periods: int = LEAST_PERIODS, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document.

    ``runs`` has all stretches of ``least`` words and ``periods`` smallest periods or more by start and period;
    ``collapsed`` the words that no run contains beyond its first period, joined by one space.
    """

    def rows(batches):
        for batch in batches:
            for first, texts in steps(batch):
                words = split_words(texts)
                found = runs_in(words, periods, least)
                cover = np.zeros(len(words.start) + 1, np.int64)
                begin = words.first[found[:, 0]] + found[:, 1]
                np.add.at(cover, begin + found[:, 3], 1)
                np.add.at(cover, begin + found[:, 2], -1)
                gone = np.cumsum(cover[:-1]) > 0
                bound = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
                listed, collapsed = [], []
                for i, text in enumerate(texts):
                    own, parts = found[bound[i] : bound[i + 1], 1:].tolist(), text.split()
                    if own:
                        keep = np.flatnonzero(~gone[words.first[i] : words.first[i + 1]])
                        parts = [parts[k] for k in keep.tolist()]
                    listed.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    collapsed.append(b" ".join(parts).decode())
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        pa.array(words.counts, pa.int64()),
                        pa.array(listed, pa.list_(_RUN)),
                        pa.array(collapsed, pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, _FOUND)


def planted(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` where about every tenth document, by a hash of its id, ends in repetitions of its own words."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = documents.select("doc_id", "text", crc.alias("crc")).withColumn(
        "words", F.expr(r"if(crc % 10 = 0, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), NULL)")
    )
    sizes = chosen.selectExpr("*", "size(words) AS n", "crc div 10 AS g").selectExpr(
        "*", "if(n > 0, g % n, NULL) AS a"
    ).selectExpr("*", "1 + (n - a) div (3 + g % 8) AS p")
    place = "if(i < a, i, a + (i - a) % p)"
    repeated = f"array_join(transform(sequence(0L, n - 1L), i -> words[int({place})]), ' ')"
    return sizes.selectExpr("doc_id", f"if(n > 0, {repeated}, text) AS text")


def digests(documents: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text of every document."""
    longest = F.expr(
        "array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))"
    )
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    return find_runs(documents).withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
