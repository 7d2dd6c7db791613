"""Token ids as binary files: ids ranked by frequency, in byte-aligned coding with separate control bytes.

The commonest id gets rank 0. Each rank takes one to four bytes; two bits of a control byte say how many, so
four ranks share one control byte and the data bytes stand apart. Decoding looks the lengths up in a table of the 256
control bytes and gathers all values of a document at once.

Files. A table in Parquet, its rows in ascending order of ``doc_id`` through the files' parts: ``part`` (number of the
part), ``start`` (ids of the part before the document), ``doc_id``, ``n_tokens``, ``control``, ``data``. Beside it ``ranks``
has ``rank, id``. Spark's committer writes both, so a lost executor's part is written again.

Edge cases: a null text is empty: one id, the end. Documents without id come first; documents of equal id
follow each other in the order of the input; an empty table gives empty files. Columns other than ``doc_id`` and ``text``
are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boletim.llm.common import new_path, steps, written
from boletim.llm.word_tokens import loaded

TOKENIZER = "word_bpe_49k.json"
END_ID = 1

#: Lengths of the four values that each control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


#: Ids handled at a time, about.
PORTION = 1 << 19


def pack_all(values: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of consecutive runs of unsigned numbers below 2^32."""
    values = values.astype("<u4")
    code = (values >= 1 << 8).astype(np.uint8)
    if len(values) and values.max() >= 1 << 16:
        code += (values >= 1 << 16).astype(np.uint8) + (values >= 1 << 24).astype(np.uint8)
    quads = -(-sizes // 4)
    first = np.cumsum(quads) - quads
    begin = np.cumsum(sizes) - sizes
    padded = np.zeros(4 * int(quads.sum()), np.uint8)
    padded[np.arange(len(values)) + np.repeat(4 * first - begin, sizes)] = code
    fours = padded.reshape(-1, 4)
    control = (fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6).tobytes()
    wide = int(code.max(initial=0)) + 1
    data = values.view(np.uint8).reshape(-1, 4)[:, :wide][np.arange(wide) <= code[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(code, dtype=np.int64) + np.arange(1, len(code) + 1)])
    cut = ends[np.concatenate([begin, [len(values)]])].tolist()
    first = [*first.tolist(), int(quads.sum())]
    return (
        [control[a:b] for a, b in zip(first, first[1:], strict=False)],
        [data[a:b] for a, b in zip(cut, cut[1:], strict=False)],
    )


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of one run."""
    control, data = pack_all(values, np.array([len(values)]))
    return control[0], data[0]


def unpack_all(control: list[bytes], data: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The numbers of consecutive runs, one after another."""
    quads = -(-sizes // 4)
    lengths = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].ravel()
    if (sizes % 4).any():  # leave out what fills the last control byte of a run
        place = np.arange(len(lengths)) - np.repeat(4 * (np.cumsum(quads) - quads), 4 * quads)
        lengths = lengths[place < np.repeat(sizes, 4 * quads)]
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(b"".join(data), np.uint8)
    values = raw[start].astype("<u4")
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        values[longer] |= raw[start[longer] + k].astype("<u4") << np.uint32(8 * k)
    return values


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack`` was given."""
    return unpack_all([control], [data], np.array([n]))


def _portions(ids: list[bytes], dtype: np.dtype):
    """Some documents' ids one after another, and how many each has."""
    at = 0
    while at < len(ids):
        end, size = at, 0
        while end < len(ids) and (size < PORTION * dtype.itemsize or end == at):
            size += len(ids[end])
            end += 1
        sizes = np.fromiter(map(len, ids[at:end]), np.int64, end - at) // dtype.itemsize
        yield np.frombuffer(b"".join(ids[at:end]), dtype), sizes
        at = end


def token_table(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids``: each document's ids with the end, as little-endian bytes, written once."""

    def rows(batches):
        words = loaded(path)
        end = np.array([end_id], words.dtype).tobytes()
        for batch in batches:
            for first, texts in steps(batch):
                yield pa.record_batch(
                    [batch.column("doc_id").slice(first, len(texts)).cast(pa.int64()),
                     pa.array([x + end for x in words.encode(texts)], pa.binary())],
                    ["doc_id", "ids"],
                )

    encoded = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, ids binary")
    return written(encoded, "token-ids")


def ranks(ids: DataFrame, path: str) -> np.ndarray:
    """Rank of each id of the vocabulary, the commonest first; ids of equal count by number."""

    def rows(batches):
        words = loaded(path)
        counts = np.zeros(len(words.tokens), np.int64)
        for batch in batches:
            for found, _ in _portions(batch.column("ids").to_pylist(), words.dtype):
                counts += np.bincount(found, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    size = len(loaded(path).tokens)
    counts = np.zeros(size, np.int64)
    # As many rows as the vocabulary has ids, however large the corpus is.
    for id_, n in ids.select("ids").mapInArrow(rows, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[id_] = n
    order = np.lexsort((np.arange(size), -counts))
    out = np.empty(size, np.uint32)
    out[order] = np.arange(size, dtype=np.uint32)
    return out


def write_tokens(documents: DataFrame, target: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode every document and write ``target/ranks`` and ``target/tokens``."""
    path = path or public_tokenizers.path(TOKENIZER)
    spark = documents.sparkSession
    ids = token_table(documents, path, end_id)
    rank = ranks(ids, path)
    dtype = loaded(path).dtype

    def rows(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for found, sizes in _portions(batch.column("ids").to_pylist(), dtype):
                control, data = pack_all(rank[found], sizes)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.record_batch(
                    [pa.array(np.full(len(sizes), part, np.int32)), pa.array(starts),
                     batch.column("doc_id").slice(at, len(sizes)), pa.array(sizes),
                     pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    ["part", "start", "doc_id", "n_tokens", "control", "data"],
                )
                at += len(sizes)

    ordered = ids.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(
        F.asc_nulls_first("doc_id"), F.asc("_row")
    )
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("_row")).select("doc_id", "ids")
    schema = "part int, start long, doc_id long, n_tokens long, control binary, data binary"
    ordered.mapInArrow(rows, schema).write.option("compression", "zstd").parquet(f"{target}/tokens")
    by_rank = np.argsort(rank)
    table = [(int(r), int(i)) for r, i in enumerate(by_rank)]
    spark.createDataFrame(table, "rank long, id long").coalesce(1).write.parquet(f"{target}/ranks")


def read_tokens(spark: SparkSession, target: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids`` (four bytes each) decoded from the files.

    ``start`` counts all ids before the document.
    """
    files = spark.read.parquet(f"{target}/tokens")
    # A row for each part: as many as the job that wrote them had tasks.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    # As many rows as the vocabulary has ids.
    id_of = np.zeros(spark.read.parquet(f"{target}/ranks").count(), "<u4")
    for r, i in spark.read.parquet(f"{target}/ranks").collect():
        id_of[r] = i

    def rows(batches):
        for batch in batches:
            control, data = batch["control"].to_pylist(), batch["data"].to_pylist()
            sizes = np.array(batch["n_tokens"].to_pylist(), np.int64)
            at = 0
            while at < len(sizes):
                end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), PORTION)) + at)
                own = sizes[at:end]
                raw = id_of[unpack_all(control[at:end], data[at:end], own)].tobytes()
                cut = [0, *(4 * np.cumsum(own)).tolist()]
                found = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                part = batch.slice(at, end - at)
                columns = [part["part"], part["start"], part["doc_id"], part["n_tokens"], pa.array(map(zlib.crc32, found), pa.int64())]
                names = ["part", "start", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(found, pa.binary()))
                    names.append("ids")
                yield pa.record_batch(columns, names)
                at = end

    schema = "part int, start long, doc_id long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return (
        files.mapInArrow(rows, schema)
        .join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("before") + F.col("start"))
        .drop("part", "before")
    )


def round_trip(documents: DataFrame, target: str | None = None) -> DataFrame:
    """Write the documents' ids and read them back: place, length and checksum of each document's."""
    target = target or new_path(documents.sparkSession, "tokens")
    write_tokens(documents, target)
    return read_tokens(documents.sparkSession, target, with_ids=False)
