"""What several operators share: shared storage, learning rows, batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised pass holds at a time; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Short rows, of numbers and a sketch at most, that one task writes.
PACKED_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, as in tests, a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="boletim-llm-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, with a lineage of one scan."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many tasks as ``rows`` short rows take, at least one for each core.

    A table of few rows is else written as a file for each part of a shuffle, and opening those takes longer than its rows.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PACKED_ROWS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def learning_rows(
    documents: DataFrame, labels: DataFrame, label: str, learnable, bound: int
) -> DataFrame:
    """At most ``bound`` labelled documents as ``doc_id, text, label``, the lowest by a hash of the id.

    ``learnable`` is a condition on ``doc_id``. A document labelled more than once counts
    with its lowest label; null ids and null labels are left out.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learnable)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    # At most ``bound`` rows of two numbers.
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of rows of about ``STEP_BYTES``: position of the first, and the texts as bytes.

    A null text is empty.
    """
    texts = batch.column(column).cast(pa.large_binary())
    first, held, size = 0, [], 0
    for i in range(len(texts)):
        text = texts[i].as_py() or b""
        if held and size + len(text) > STEP_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def kept_rows(batch: pa.RecordBatch, keep) -> pa.RecordBatch:
    """The rows of the batch that a boolean array marks."""
    return batch.filter(pa.array(keep))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each application; they may not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="boletim-package-")) / "boletim.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def runs(batches, keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows of equal keys that follow each other, as a list for each column; the input is sorted by the keys."""
    key, held = None, {}
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        marks = list(zip(*[columns[k] for k in keys], strict=True))
        at = 0
        while at < len(marks):
            end = at + 1
            while end < len(marks) and marks[end] == marks[at]:
                end += 1
            if marks[at] != key:
                if held:
                    yield key, held
                key, held = marks[at], {name: [] for name in columns}
            for name, values in columns.items():
                held[name] += values[at:end]
            at = end
    if held:
        yield key, held


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores behind it as it takes to differ from the columns of ``df``."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
