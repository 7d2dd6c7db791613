"""Filters a caller adds to any report by column name."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(df: DataFrame, name: str) -> Column:
    """The named result column; any other name is refused."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r}; columns are {', '.join(df.columns)}")
    return F.col(f"`{name}`")


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def apply_filters(df: DataFrame, filters: Mapping[str, object], mode: str = "ilike") -> DataFrame:
    """Keep rows that meet every filter.

    ``ilike``: the value is a case-insensitive pattern used as it stands; empty
    values are skipped. ``eq``: plain equality, empty values included.
    """
    if mode not in ("ilike", "eq"):
        raise ValueError(f"mode is 'ilike' or 'eq', not {mode!r}")
    conditions = []
    for name, value in filters.items():
        column = checked(df, name)
        if mode == "eq":
            conditions.append(column == F.lit(value))
        elif value:
            conditions.append(column.cast("string").ilike(str(value)))
    return df.filter(all_of(conditions)) if conditions else df
