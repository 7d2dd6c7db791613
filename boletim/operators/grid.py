"""Operators of the result grid: search, facets, selection, order, pages, counts.

Conditions are columns, so several can be combined into one filter, or counted
in one pass without running the report again.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boletim.operators.filters import all_of, checked
from boletim.operators.order import order_key

def _text(df: DataFrame, name: str) -> Column:
    return checked(df, name).cast("string")


def phrases(text: str) -> list[str]:
    """The words of a search text; what stands between double quotes is one of them."""
    return [quoted or word for quoted, word in re.findall(r'"([^"]+)"|([^\s"]+)', text)]


def contains_words(df: DataFrame, text: str) -> Column:
    """Every word or quoted phrase occurs somewhere in the row, in any case."""
    row = F.lower(F.concat_ws("  ", *[_text(df, name) for name in df.columns]))
    return all_of([row.contains(F.lower(F.lit(word))) for word in phrases(text)])


def search(df: DataFrame, text: str) -> DataFrame:
    return df.filter(contains_words(df, text))


def first_column_search(df: DataFrame, text: str) -> DataFrame:
    """Rows whose first cell contains the text, in any case; a missing cell is empty text."""
    cell = F.upper(F.coalesce(_text(df, df.columns[0]), F.lit("")))
    return df.filter(cell.contains(F.upper(F.lit(text))))


def selected(df: DataFrame, choices: Mapping[str, Sequence[str]], match: str = "contains") -> Column:
    """Any of the values within a column, all columns together; no values means no limit.

    A cell matches if it contains a value, in any case; with ``match="exact"`` only if it equals one.
    """
    if match not in ("exact", "contains"):
        raise ValueError(f"match is 'exact' or 'contains', not {match!r}")
    conditions = []
    for name, values in choices.items():
        cell = _text(df, name)
        if not values:
            continue
        if match == "exact":
            conditions.append(cell.isin(*[str(value) for value in values]))
        else:
            hit = F.lit(False)
            for value in values:
                hit = hit | F.lower(cell).contains(F.lower(F.lit(str(value))))
            conditions.append(hit)
    return all_of(conditions)


def multiselect(
    df: DataFrame, choices: Mapping[str, Sequence[str]], match: str = "contains"
) -> DataFrame:
    return df.filter(selected(df, choices, match))


def facets(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values of each column as ``coluna, valor``, in one pass over the rows."""
    names = list(columns or df.columns)
    cells = F.array(
        *[F.struct(F.lit(name).alias("coluna"), _text(df, name).alias("valor")) for name in names]
    )
    return df.select(F.inline(cells)).distinct().orderBy("coluna", F.asc_nulls_last("valor"))


Keys = str | Sequence[tuple[str, bool]]


def total_order(
    df: DataFrame, column: Keys | None = None, descending: bool = False, collation: str | None = None
) -> list[Column]:
    """The chosen columns (the first one by default), then every other column to break ties.

    ``column`` is a name, or several names each with whether it descends.
    """
    if column is None:
        column = df.columns[0]
    chosen = [(column, descending)] if isinstance(column, str) else list(column)
    keys = []
    for name, down in chosen:
        checked(df, name)
        keys.append(order_key(df, name, down, collation))
    if collation:
        # Texts a collation holds equal still need one fixed order.
        keys += [order_key(df, name) for name, _ in chosen]
    names = {name for name, _ in chosen}
    return keys + [order_key(df, name) for name in df.columns if name not in names]


def sort(
    df: DataFrame, column: Keys | None = None, descending: bool = False, collation: str | None = None
) -> DataFrame:
    return df.orderBy(*total_order(df, column, descending, collation))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows in the report's own order."""
    return df.limit(rows)


def store(
    df: DataFrame,
    path: str,
    column: Keys | None = None,
    descending: bool = False,
    collation: str | None = None,
    mode: str = "errorifexists",
    searched: Sequence[str] = (),
    group_bytes: int | None = None,
) -> DataFrame:
    """Compute a report once, write it sorted to ``path`` and return it with its positions.

    The path is the caller's, where every executor reaches it. Search, facets, counts and pages of
    the returned rows then read the files and never run the report again. Exact selections on the order's
    columns skip row groups by their bounds, those on the columns ``searched`` by bloom filters; ``group_bytes``
    is the size of a row group.
    """
    ordered = sort(df, column, descending, collation)
    # The id holds the range in its upper bits and the row within it in the lower 33.
    out = ordered.withColumn("_row", F.monotonically_increasing_id()).write.mode(mode)
    for name in searched:
        checked(df, name)
        out = out.option(f"parquet.bloom.filter.enabled#{name}", "true")
    if group_bytes:
        out = out.option("parquet.block.size", str(group_bytes))
    out.parquet(path)
    return stored(df.sparkSession, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A stored report with the place of each row in its order, as ``position`` from 0.

    Positions come from one count per written range, so no task sees more than its own range.
    """
    rows = spark.read.parquet(path)
    part = F.shiftrightunsigned("_row", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per range: the window is as small as the number of partitions written.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return (
        rows.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn("position", F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_start", "_row")
    )


def page(rows: DataFrame, number: int = 0, size: int = 10) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows of a stored report, the first one like any other."""
    start = number * size
    wanted = rows.filter(F.col("position").between(start, start + size - 1))
    return wanted.orderBy("position").drop("position")


def order_index(
    spark: SparkSession,
    path: str,
    index_path: str,
    column: str,
    descending: bool = False,
    collation: str | None = None,
    mode: str = "errorifexists",
) -> DataFrame:
    """Another order of the report stored in ``path``: ``position, _row``, written to ``index_path``.

    Only the sort key and the place of a row in the files are read, sorted and written, whatever other columns the
    report has. Rows of equal keys keep their stored order.
    """
    rows = spark.read.parquet(path)
    checked(rows, column)
    keys = [order_key(rows, column, descending, collation)]
    if collation:
        keys.append(order_key(rows, column))
    places = rows.select(f"`{column}`", "_row").orderBy(*keys, "_row").select(F.col("_row").alias("_place"))
    places.withColumn("_row", F.monotonically_increasing_id()).write.mode(mode).parquet(index_path)
    return stored(spark, index_path)


def page_by_index(
    spark: SparkSession, path: str, index: DataFrame, number: int = 0, size: int = 10
) -> DataFrame:
    """Page ``number`` of ``size`` rows of the report stored in ``path``, in the order of the index.

    The page's places come here, at most ``size`` numbers; the files are then read at these places, which skips
    the row groups without them.
    """
    start = number * size
    wanted = index.filter(F.col("position").between(start, start + size - 1)).orderBy("position").collect()
    order = F.array_position(F.array(*[F.lit(row["_place"]) for row in wanted]).cast("array<bigint>"), F.col("_row"))
    rows = spark.read.parquet(path).filter(F.col("_row").isin([row["_place"] for row in wanted]))
    return rows.orderBy(order).drop("_row")


def counts(df: DataFrame, condition: Column) -> DataFrame:
    """One row: all rows, and those that meet the condition, counted in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(condition).alias("filtered")
    )
