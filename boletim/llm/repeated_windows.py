"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted over all documents.

Each window gets two rolling polynomial hashes over its words, found for all windows at once from running sums. The hashes
are dealt by a part of the second to buckets, in which equal ones meet; the smallest id of each is the document that
keeps its words. Every other document gets back the hashes it must give up, and the windows that carry them merge
into maximal intervals of words to remove.

Rows that meet are reduced first: of a hash that several documents of one stretch of input share, only the smallest id goes
on to be counted, the others are known to lose it at once. A window in a third of all documents so costs its bucket an
entry for each stretch of ``STRETCH`` windows, not for each document. The number of buckets follows from the bytes of
all texts. Hashes that must agree have 72 bits and those of the bucket.

Edge cases: a null text has no words; a text of fewer than 50 words has no window and stays whole; documents with a null id
neither remove nor lose anything; rows of one id never remove from each other, and lose the same windows; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boletim.llm.common import steps
from boletim.llm.words import Words, mix, rolling_hashes, split_words

WINDOW = 50
#: Windows whose hashes are reduced and dealt out together.
STRETCH = 1 << 20
#: Bytes of text for which there is a partition at least, and buckets in a partition.
PARTITION_BYTES = 64 << 20
BUCKETS = 4

_U = np.uint64


def window_keys(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the first word of every window of ``width`` words inside one text."""
    one = words.hashes()
    two = mix(one ^ _U(0x5851F42D4C957F2D))
    first = np.arange(max(len(one) - width + 1, 0))
    first = first[words.text[first] == words.text[first + width - 1]]
    return rolling_hashes(one, width)[first], rolling_hashes(two, width)[first], first


def _bucket(two: np.ndarray, buckets: int) -> np.ndarray:
    return ((two >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _shared(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows in a later document than the first with equal hashes, once for each document; and
    all places that repeat an earlier one, of the same document or of another."""
    order = np.argsort(one, kind="stable")
    ranked = one[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    among = order[same[1:] | same[:-1]]
    among = among[np.lexsort((doc[among], two[among], one[among]))]
    if not len(among):
        return among, among
    new = np.ones(len(among), bool)
    new[1:] = (one[among][1:] != one[among][:-1]) | (two[among][1:] != two[among][:-1])
    leader = doc[among][np.maximum.accumulate(np.where(new, np.arange(len(among)), 0))]
    fresh = new.copy()
    fresh[1:] |= doc[among][1:] != doc[among][:-1]
    return among[fresh & (doc[among] > leader)], among[~new]


_COUNTED = pa.schema(
    [("bucket", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("one", pa.binary()), ("two", pa.binary())]
)
_COUNTED_DDL = "bucket long, docs binary, sizes binary, one binary, two binary"


def _stretch(one: np.ndarray, two: np.ndarray, doc: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket with its windows in the order of their documents, and for windows that are known to be
    lost a row in a negative bucket, with a document for each."""
    lost, repeated = _shared(one, two, doc)
    kept = np.ones(len(one), bool)
    kept[repeated] = False
    kept = np.flatnonzero(kept)
    bucket = _bucket(two[kept], buckets)
    order = np.argsort(bucket, kind="stable")
    kept, bucket = kept[order], bucket[order]
    edge = np.ones(len(kept), bool)
    edge[1:] = (bucket[1:] != bucket[:-1]) | (doc[kept][1:] != doc[kept][:-1])
    begin = np.flatnonzero(edge)
    sizes, docs = np.diff(np.append(begin, len(kept))).astype(np.int32), doc[kept[begin]]
    found, at = np.unique(bucket, return_index=True)
    runs = np.searchsorted(begin, at)

    def cut(values, places):
        return [part.tobytes() for part in np.split(values, places[1:])] if len(found) else []

    aside = [-1 - (int(lost[0]) + len(one)) % buckets] if len(lost) else []
    some = [b""] * len(aside)
    return pa.record_batch(
        [
            pa.array(found.tolist() + aside, pa.int64()),
            pa.array(cut(docs, runs) + [doc[lost].tobytes()] * len(aside), pa.binary()),
            pa.array(cut(sizes, runs) + some, pa.binary()),
            pa.array(cut(one[kept], at) + [one[lost].tobytes()] * len(aside), pa.binary()),
            pa.array(cut((two[kept] & _U(255)).astype(np.uint8), at) + some, pa.binary()),
        ],
        schema=_COUNTED,
    )


def _windows(documents: DataFrame, width: int, buckets: int) -> DataFrame:
    def rows(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in steps(batch):
                words = split_words(texts)
                one, two, at = window_keys(words, width)
                own = ids.slice(first, len(texts))
                doc = own.fill_null(0).to_numpy(zero_copy_only=False)[words.text[at]]
                if own.null_count:
                    known = own.is_valid().to_numpy(zero_copy_only=False)[words.text[at]]
                    one, two, doc = one[known], two[known], doc[known]
                held.append((one, two, doc))
                size += len(one)
                if size >= STRETCH:
                    yield _stretch(*map(np.concatenate, zip(*held, strict=True)), buckets)
                    held, size = [], 0
        if size:
            yield _stretch(*map(np.concatenate, zip(*held, strict=True)), buckets)

    return documents.mapInArrow(rows, _COUNTED_DDL)


def _losses(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of one bucket and the hashes of their windows that a smaller id has too."""
    if rows[0]["bucket"] < 0:
        return tuple(np.concatenate([np.frombuffer(r[n], k) for r in rows]) for n, k in (("docs", np.int64), ("one", _U)))
    docs, sizes, one, two = (
        np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        for name, kind in (("docs", np.int64), ("sizes", np.int32), ("one", _U), ("two", np.uint8))
    )
    doc = np.repeat(docs, sizes)
    lost, _ = _shared(one, two, doc)
    return doc[lost], one[lost]


def _home(doc: np.ndarray, homes: int) -> np.ndarray:
    """The bucket of a document; ``_home_column`` is the same in Spark."""
    return np.mod((doc.view(_U) ^ (doc.view(_U) >> _U(20))).view(np.int64), homes)


def _home_column(homes: int) -> Column:
    own = F.col("doc_id").bitwiseXOR(F.shiftrightunsigned("doc_id", 20))
    return F.pmod(F.coalesce(own, F.xxhash64("text")), F.lit(homes).cast("long"))


_LOST = "home long, doc_id long, text string, docs binary, keys binary"


def _packed(doc: np.ndarray, key: np.ndarray, homes: int) -> pa.RecordBatch:
    """A row for each home with the documents and hashes that belong there."""
    home = _home(doc, homes)
    order = np.argsort(home, kind="stable")
    found, first = np.unique(home[order], return_index=True)
    cut = [[p.tobytes() for p in np.split(v[order], first[1:])] if len(found) else [] for v in (doc, key)]
    none = pa.nulls(len(found))
    return pa.record_batch(
        [pa.array(found, pa.int64()), none.cast(pa.int64()), none.cast(pa.string()), *(pa.array(c, pa.binary()) for c in cut)],
        ["home", "doc_id", "text", "docs", "keys"],
    )


def lost_windows(documents: DataFrame, partitions: int, width: int = WINDOW) -> DataFrame:
    """``home, docs, keys``: pairs of a document and the first hash of a window that it must give up, packed by home."""
    homes = partitions * BUCKETS

    def counted(batches):
        held: list[dict] = []
        found, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    found.append(_losses(held))
                    size, held = size + len(found[-1][0]), []
                    if size >= STRETCH:
                        yield _packed(*map(np.concatenate, zip(*found, strict=True)), homes)
                        found, size = [], 0
                held.append(row)
        if held:
            found.append(_losses(held))
        if found:
            yield _packed(*map(np.concatenate, zip(*found, strict=True)), homes)

    dealt = _windows(documents, width, homes).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(counted, _LOST)


class _Home:
    """The hashes that the documents of one home give up."""

    def __init__(self) -> None:
        self.docs: list[bytes] = []
        self.keys: list[bytes] = []
        self.ready = None

    def add(self, docs: bytes, keys: bytes) -> None:
        self.docs.append(docs)
        self.keys.append(keys)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last place of each id's hashes, and all hashes."""
        if self.ready is None:
            doc = np.frombuffer(b"".join(self.docs), np.int64)
            order = np.argsort(doc, kind="stable")
            self.ready = doc[order], np.frombuffer(b"".join(self.keys), _U)[order]
            self.docs, self.keys = [], []
        doc, keys = self.ready
        return np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right"), keys


def _without(texts: list[bytes], ids: pa.Array, home: _Home, width: int) -> pa.RecordBatch:
    words = split_words(texts)
    one, _, at = window_keys(words, width)
    begin, end, keys = home.of(ids.fill_null(0).to_numpy(zero_copy_only=False))
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    bound = np.searchsorted(words.text[at], np.arange(len(texts) + 1))
    cover = np.zeros(len(words.start) + 1, np.int64)
    for i in np.flatnonzero(known & (begin < end)).tolist():
        a, b = bound[i], bound[i + 1]
        hit = at[a:b][np.isin(one[a:b], keys[begin[i] : end[i]])]
        cover[hit] += 1
        cover[hit + width] -= 1
    covered = np.cumsum(cover[:-1]) > 0
    spans, kept = [], []
    for i, text in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        edges = np.flatnonzero(np.diff(covered[a:b].view(np.int8), prepend=0, append=0)) if begin[i] < end[i] else []
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)])
        parts, last = text.split(), 0
        if spans[-1]:
            parts, whole = [], parts
            for span in spans[-1]:
                parts += whole[last : span["start"]]
                last = span["end"]
            parts += whole[last:]
        kept.append(b" ".join(parts).decode())
    return pa.record_batch(
        [
            ids,
            pa.array(words.counts, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array(kept, pa.string()),
        ],
        ["doc_id", "n_words", "removed", "kept"],
    )


_KEPT = "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept string"


def remove_repeats(documents: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, removed, kept`` of every document: its removal intervals, as first word and the one
    after the last, and the words that stay, joined by one space.

    Hashes to give up and texts meet by home, the hashes first; texts then pass one after another.
    """
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    texts = docs.select(
        _home_column(partitions * BUCKETS).alias("home"), "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("keys"),
    )
    met = lost_windows(docs, partitions, width).unionByName(texts).repartition(partitions, "home")
    met = met.sortWithinPartitions("home", F.col("docs").isNull())

    def rows(batches):
        now, home = None, _Home()
        for batch in batches:
            homes = batch.column("home").to_numpy()
            is_text = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
            docs, keys = batch.column("docs"), batch.column("keys")
            edges = np.flatnonzero((np.diff(homes) != 0) | np.diff(is_text)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(homes)], strict=True):
                if a == b:
                    continue
                if homes[a] != now:
                    now, home = homes[a], _Home()
                if not is_text[a]:
                    for k in range(a, b):
                        home.add(docs[k].as_py(), keys[k].as_py())
                    continue
                part = batch.slice(a, b - a)
                for first, texts in steps(part):
                    yield _without(texts, part.column("doc_id").slice(first, len(texts)), home, width)

    return met.mapInArrow(rows, _KEPT)


def digests(documents: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    return remove_repeats(documents, width).select(
        "doc_id",
        "n_words",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r.end - r.start).alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


#: Every window as text, the smallest id of each, and the words that later documents' windows cover.
ORACLE_SQL = r"""
WITH listed AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), windows AS (
    SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
    FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM listed WHERE len(w) >= 50)
), firsts AS (
    SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING count(DISTINCT doc_id) > 1
), covered AS (
    SELECT r, list(DISTINCT j) AS gone
    FROM (SELECT r, unnest(range(i, i + 50)) AS j FROM windows JOIN firsts USING (k) WHERE doc_id > first)
    GROUP BY r
), parts AS (
    SELECT r, string_agg(word, ' ' ORDER BY j) AS kept
    FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM listed)
    ANTI JOIN (SELECT r, unnest(gone) AS j FROM covered) USING (r, j)
    GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM listed LEFT JOIN covered USING (r) LEFT JOIN parts USING (r)
"""
