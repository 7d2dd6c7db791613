"""Exams: which ones count, who finished them and with what grade."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boletim.operators.network import renamed, stacked
from boletim.schema import Tables


def exams(t: Tables) -> DataFrame:
    return renamed(t["quizzes"], quiz_id="id", exam="name")


def directly_assigned(t: Tables, institution_ids: DataFrame) -> DataFrame:
    """Exam ids assigned to the given institutions."""
    return (
        t["institutions_quizzes"].join(institution_ids, "institution_id", "left_semi").select("quiz_id")
    )


def assigned_by_module(t: Tables, institution_ids: DataFrame) -> DataFrame:
    """Exam ids of the learning modules the given institutions use."""
    modules = (
        t["institutions_learning_modules"]
        .join(institution_ids, "institution_id", "left_semi")
        .select("learning_module_id")
    )
    return t["learning_module_quizzes"].join(modules, "learning_module_id", "left_semi").select("quiz_id")


def holding_scope(t: Tables, holding_id: int) -> DataFrame:
    """Distinct ids of existing exams a holding's institutions reach, by module or directly."""
    holding = renamed(t["holdings"].filter(F.col("id") == holding_id), holding_id="id")
    members = (
        renamed(t["institutions"], institution_id="id", holding_id="holding_id")
        .filter(F.col("holding_id") == holding_id)
        .join(holding, "holding_id", "left_semi")
        .select("institution_id")
    )
    reached = assigned_by_module(t, members).union(directly_assigned(t, members)).distinct()
    return reached.join(exams(t), "quiz_id", "left_semi")


def attempts(t: Tables, chosen: DataFrame, students: DataFrame) -> DataFrame:
    """Finished attempts per student and exam name: ``user_id, exam, attempts``.

    Only attempts of ``students`` are kept, before anything else is done: a
    report on a few institutions then drops most of the largest table in the one
    shuffle, of two numbers per row, that the later steps by student also use.
    """
    return (
        t["quiz_user_progresses"]
        .filter("finished")
        .select("user_id", "quiz_id")
        .join(students.select("user_id"), "user_id", "left_semi")
        .join(chosen.select("quiz_id", "exam"), "quiz_id")
        .groupBy("user_id", "exam")
        .agg(F.count(F.lit(1)).alias("attempts"))
    )


def grade_scale(t: Tables) -> int:
    """Digits after the point in the grades."""
    kind = t["quiz_grades"].schema["average"].dataType
    assert isinstance(kind, T.DecimalType)
    return kind.scale


def graded_attempts(t: Tables, chosen: DataFrame, students: DataFrame) -> DataFrame:
    """Finished and graded attempts of ``students`` per exam name.

    Columns ``user_id, exam, points, grades``: the grades, in whole units of
    their last digit, summed and counted once per attempt. Attempts and grades
    are stacked and shuffled once by student, instead of being joined.
    """
    scale = grade_scale(t)
    narrow = t["quiz_grades"].schema["average"].dataType.precision <= 9
    # A whole number either way, so no type loses a digit; short ones sum faster as bigint.
    units = (F.col("average") * F.lit(Decimal(10**scale))).cast("bigint" if narrow else "decimal(38,0)")
    tried = (
        t["quiz_user_progresses"]
        .filter("finished")
        .select("user_id", "quiz_id", F.lit(1).alias("attempt"))
    )
    graded = t["quiz_grades"].select(
        "user_id", "quiz_id", F.lit(1).alias("graded"), units.alias("units")
    )
    return (
        stacked([tried, graded])
        .join(students.select("user_id"), "user_id", "left_semi")
        .groupBy("user_id", "quiz_id")
        .agg(
            F.count("attempt").alias("attempts"),
            F.count("graded").alias("graded"),
            F.sum("units").alias("units"),
            F.count("units").alias("grades"),
        )
        .filter("attempts > 0 AND graded > 0")
        .join(chosen.select("quiz_id", "exam"), "quiz_id")
        .groupBy("user_id", "exam")
        .agg(
            F.sum(F.col("units") * F.col("attempts")).alias("points"),
            F.sum(F.col("grades") * F.col("attempts")).alias("grades"),
        )
    )
