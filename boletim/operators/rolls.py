"""Class rolls: which students are enrolled in which class, by class name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boletim.operators.network import renamed
from boletim.schema import Tables


def student_ids(t: Tables) -> DataFrame:
    return renamed(t["users"], user_id="id")


def roll(
    enrolments: DataFrame, net: DataFrame, keys: Sequence[str], agree: Sequence[str] = ()
) -> DataFrame:
    """Enrolments per student and class: ``user_id, *keys, enrolments``.

    ``agree`` names ids the enrolment carries itself that must equal those of
    the classroom's ancestors.
    """
    on = ["classroom_id", *agree]
    return (
        enrolments.select("user_id", *on)
        .join(net, on)
        .groupBy("user_id", *keys)
        .agg(F.count(F.lit(1)).alias("enrolments"))
    )


def roll_with_college(t: Tables, net: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Like ``roll`` for all enrolments, with ``in_college``: how many of them name
    the classroom's own school."""
    enrolled = renamed(
        t["institution_enrollments"],
        user_id="user_id",
        classroom_id="classroom_id",
        enrolled_college_id="college_id",
    )
    own = F.col("enrolled_college_id") == F.col("college_id")
    return (
        enrolled.join(net, "classroom_id")
        .groupBy("user_id", *keys)
        .agg(F.count(F.lit(1)).alias("enrolments"), F.count_if(own).alias("in_college"))
    )


def enrolled_per_class(rolls: DataFrame, keys: Sequence[str], kept: str) -> DataFrame:
    """Distinct enrolled students per class, as ``enrolled``.

    ``rolls`` is already one row per student and class, so a plain count does.
    Naming the column ``kept`` in a test that always holds keeps it from being
    pruned here, which leaves both uses of ``rolls`` the same and lets Spark run
    the shuffle beneath them once.
    """
    student = F.when(F.col(kept) >= 0, F.col("user_id"))
    return rolls.groupBy(*keys).agg(F.count(student).alias("enrolled"))
