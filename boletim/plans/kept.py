"""Exam completion kept as state: a day's attempts are merged in instead of counting all attempts again.

The state is a folder with three tables. ``done`` has every (student, exam name) finished so far, each in the generation
that brought it. ``students`` has the (student, class) pairs that count. ``totals`` has the distinct students per class and exam after a
generation. As a student is once in a class, a student's first finish of an exam adds one to each of the student's
classes, so a merge reads the day, ``done`` and ``students`` and sums new pairs only; a request reads ``totals`` alone.
Repeated and late attempts change nothing that is already counted.

A generation counts once its row is in ``commits``, written last; what an interrupted merge has left behind is overwritten by the
next. One merge runs at a time. When enrolments, students or the network change, ``enrol`` counts ``done`` against the new
classes, without the attempts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boletim.operators.exams import exams
from boletim.operators.rolls import enrolled_per_class, roll_with_college, student_ids
from boletim.plans.reports import matched_classes
from boletim.schema import Tables

KEYS = ["college", "classroom"]


class KeptProgress:
    """The state in ``path``, a folder that every executor reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._path = path.rstrip("/")

    def _folder(self, table: str, generation: int) -> str:
        return f"{self._path}/{table}/generation={generation}"

    def _read(self, table: str, generations: list[int]) -> DataFrame:
        return self._spark.read.parquet(*[self._folder(table, g) for g in generations])

    def _write(self, df: DataFrame, table: str, generation: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._folder(table, generation))
        return self._spark.read.schema(df.schema).parquet(self._folder(table, generation))

    def _commits(self) -> list:
        """Committed generations, a row each; few, as ``compact`` starts anew."""
        return self._spark.read.parquet(f"{self._path}/commits").orderBy("generation").collect()

    def _commit(self, generation: int, students: int, first: int) -> None:
        """``students``: generation that has the classes; ``first``: the earliest one whose ``done`` rows count."""
        row = self._spark.createDataFrame([(generation, students, first)], "generation int, students int, first int")
        row.coalesce(1).write.mode("append").parquet(f"{self._path}/commits")

    def _done(self, commits: list) -> DataFrame:
        return self._read("done", [r.generation for r in commits if r.generation >= commits[-1].first])

    def _classes(self, t: Tables, net: DataFrame, generation: int) -> DataFrame:
        rolls = roll_with_college(t, net, KEYS)
        enrolled = enrolled_per_class(rolls, KEYS, kept="in_college")
        self._write(enrolled, "enrolled", generation)
        takes_part = (F.col("in_college") > 0) & F.col("college").isNotNull() & F.col("classroom").isNotNull()
        students = rolls.filter(takes_part).select("user_id", *KEYS).join(student_ids(t), "user_id", "left_semi")
        return self._write(students, "students", generation)

    def _counted(self, done: DataFrame, students: DataFrame) -> DataFrame:
        return done.join(students, "user_id").groupBy(*KEYS, "exam").agg(F.count(F.lit(1)).alias("finished"))

    def start(self, t: Tables, net: DataFrame) -> None:
        """Begin with the classes of a network and no attempts; the folder must be new."""
        students = self._classes(t, net, 0)
        done = self._write(self._spark.createDataFrame([], "user_id long, exam string"), "done", 0)
        self._write(self._counted(done, students), "totals", 0)
        self._commit(0, 0, 0)

    def merge(self, t: Tables, day: DataFrame) -> None:
        """Add attempts ``user_id, quiz_id, finished``; only first finishes of an exam count."""
        commits = self._commits()
        last = commits[-1]
        generation = last.generation + 1
        tried = day.filter("finished AND user_id IS NOT NULL").select("user_id", "quiz_id").distinct()
        tried = tried.join(exams(t).select("quiz_id", "exam"), "quiz_id").select("user_id", "exam").distinct()
        before = self._done(commits).withColumnsRenamed({"user_id": "_user", "exam": "_exam"})
        known = (F.col("user_id") == F.col("_user")) & F.col("exam").eqNullSafe(F.col("_exam"))
        fresh = self._write(tried.join(before, known, "left_anti"), "done", generation)
        added = self._counted(fresh, self._read("students", [last.students]))
        totals = self._read("totals", [last.generation]).unionByName(added).groupBy(*KEYS, "exam")
        self._write(totals.agg(F.sum("finished").alias("finished")), "totals", generation)
        self._commit(generation, last.students, last.first)

    def enrol(self, t: Tables, net: DataFrame) -> None:
        """Count what is done against changed classes."""
        commits = self._commits()
        generation = commits[-1].generation + 1
        students = self._classes(t, net, generation)
        self._write(self._spark.createDataFrame([], "user_id long, exam string"), "done", generation)
        self._write(self._counted(self._done(commits), students), "totals", generation)
        self._commit(generation, generation, commits[-1].first)

    def compact(self) -> None:
        """Bring all finished pairs into one generation, so that a merge reads one folder, sorted by student."""
        commits = self._commits()
        last = commits[-1]
        generation = last.generation + 1
        self._write(self._done(commits).repartitionByRange("user_id").sortWithinPartitions("user_id"), "done", generation)
        self._write(self._read("totals", [last.generation]), "totals", generation)
        self._commit(generation, last.students, generation)

    def classes(self) -> DataFrame:
        """Every class with its exams as they stand: ``college, classroom, exam, finished, enrolled``."""
        last = self._commits()[-1]
        enrolled = self._read("enrolled", [last.students])
        return matched_classes(self._read("totals", [last.generation]), enrolled, KEYS)
