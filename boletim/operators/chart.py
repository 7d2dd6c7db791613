"""Series for a grouped bar chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boletim.operators.filters import checked


def chart_series(
    df: DataFrame,
    label: str,
    series: str,
    value: str,
    series_values: Sequence[str],
    other: str | None = None,
) -> DataFrame:
    """One row per label and one column per series, holding the summed values.

    The series are named by the caller, which spares a job to find them; values of any other series,
    or of none, are summed under the name ``other`` if one is given. A label without rows in a series
    has a bar of zero.
    """
    for name in (label, series, value):
        checked(df, name)
    names = list(series_values)
    if other is not None:
        known = F.col(f"`{series}`").isin(*names)
        df = df.withColumn(series, F.when(known, F.col(f"`{series}`")).otherwise(F.lit(other)))
        names.append(other)
    wide = df.groupBy(label).pivot(series, names).agg(F.sum(f"`{value}`"))
    return wide.fillna(0, subset=names)


def chart_payload(page: DataFrame) -> dict:
    """``{labels, datasets: [{label, data}]}`` of all given rows, which come to this process.

    Meant for a page of bars; ``write_chart`` writes a chart of any size.
    """
    label, *series = page.columns
    rows = page.orderBy(F.asc_nulls_last(f"`{label}`")).collect()
    return {
        "labels": [row[0] for row in rows],
        "datasets": [
            {"label": name, "data": [row[i + 1] for row in rows]} for i, name in enumerate(series)
        ],
    }


def write_chart(wide: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the bars in the order of their labels as JSON lines, in parallel, an object per label."""
    label = wide.columns[0]
    wide.orderBy(F.asc_nulls_last(f"`{label}`")).write.mode(mode).option("ignoreNullFields", "false").json(path)
