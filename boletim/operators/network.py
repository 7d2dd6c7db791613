"""The school network: institution, school, course, level, classroom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from boletim.schema import Tables


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """Select ``old`` as ``new`` for every ``new=old``; joins then need no prefixes."""
    return df.selectExpr(*[f"{old} AS {new}" for new, old in names.items()])


def institutions(t: Tables) -> DataFrame:
    return renamed(
        t["institutions"], institution_id="id", institution="name", holding_id="holding_id"
    )


def colleges(t: Tables) -> DataFrame:
    return renamed(
        t["institution_colleges"],
        college_id="id",
        college="name",
        institution_id="institution_id",
        year="year",
        region_id="region_id",
    )


def courses(t: Tables) -> DataFrame:
    return renamed(
        t["institution_courses"], course_id="id", course="name", college_id="institution_college_id"
    )


def levels(t: Tables) -> DataFrame:
    return renamed(t["institution_levels"], level_id="id", level="name", course_id="course_id")


def classrooms(t: Tables) -> DataFrame:
    return renamed(
        t["institution_classrooms"], classroom_id="id", classroom="name", level_id="level_id"
    )


def network(t: Tables) -> DataFrame:
    """One row per classroom that has a complete chain of ancestors.

    Joined from the top, so that a filter on institution or school (Catalyst
    moves it down to those scans) shrinks every later join. The facts are then
    joined to this once instead of to each of its five tables.
    """
    return (
        institutions(t)
        .drop("holding_id")
        .join(colleges(t), "institution_id")
        .join(courses(t), "college_id")
        .join(levels(t), "course_id")
        .join(classrooms(t), "level_id")
    )


def with_city(net: DataFrame, t: Tables) -> DataFrame:
    """Add ``city_id`` and ``city`` through the school's region."""
    regions = renamed(t["regions"], region_id="id", city_id="city_id")
    cities = renamed(t["cities"], city_id="id", city="name")
    return net.join(regions.join(cities, "city_id"), "region_id")


def children_or_none(
    parents: DataFrame, children: DataFrame, key: str
) -> tuple[DataFrame, DataFrame]:
    """A left join in two parts: parents with their children, and childless parents.

    Adaptive execution can split a skewed side of an inner join but not the
    right side of a left join, so one parent holding much of the child table
    would otherwise be joined by a single task.
    """
    return (
        parents.join(children, key),
        parents.join(children.select(key).distinct(), key, "left_anti"),
    )


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a part lacks are NULL."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result
