"""The report tables laid out by student, so that no report moves the attempts again.

Attempts, grades, enrolments and students are written in buckets by a hash of the student, sorted within; the other tables as
plain Parquet. Read back as tables that know their buckets, an attempt lies beside its grade and its student: joins and
sums by student need no shuffle of them. Give at least as many buckets as the reports have shuffle partitions. A
student's rows are one bucket's, so a single student's part of the attempts should fit a task; sums by student and exam are
formed while reading.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from boletim.schema import SCHEMAS, LazyTables, Tables

#: The column by which each of these tables is laid out.
STUDENT = {
    "quiz_user_progresses": "user_id",
    "quiz_grades": "user_id",
    "institution_enrollments": "user_id",
    "users": "id",
}


def lay_out(t: Tables, path: str, buckets: int) -> None:
    """Write all report tables to ``path``, those in ``STUDENT`` in so many buckets by student.

    The path must be new. What marks it complete is written last.
    """
    root = path.rstrip("/")
    spark = t["users"].sparkSession
    for name in SCHEMAS:
        if name not in STUDENT:
            t[name].write.parquet(f"{root}/{name}")
            continue
        key, written = STUDENT[name], f"boletim_{uuid.uuid4().hex}"
        rows = t[name].repartition(buckets, key).sortWithinPartitions(key)
        # A table at a path of its own: dropping its name leaves the files.
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{name}").saveAsTable(written)
        spark.sql(f"DROP TABLE {written}")
    spark.range(buckets, buckets + 1, 1, 1).withColumnRenamed("id", "buckets").write.parquet(f"{root}/layout")


def read_layout(spark: SparkSession, path: str) -> LazyTables:
    """The report tables in ``path``, as ``lay_out`` has written them."""
    root = path.rstrip("/")
    buckets = spark.read.parquet(f"{root}/layout").first()["buckets"]

    def read(name: str) -> DataFrame:
        files = spark.read.parquet(f"{root}/{name}")
        if name not in STUDENT:
            return files
        key, known = STUDENT[name], f"boletim_{hashlib.md5(f'{root}/{name}'.encode()).hexdigest()}"
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in files.schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {known} ({columns}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{root}/{name}'"
        )
        return spark.table(known)

    return LazyTables(read)
