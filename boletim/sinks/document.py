"""A whole result as one JSON document, written in parallel.

A document is a table of lines with their places: ``parte``, ``posicao`` and ``linha``. Its lines in this order are the text, whatever
parts they are written in. Separators stand before a line, and only the first line of an array has none, so empty parts and
the number of parts don't matter. Rows come from a stored report (``grid.store``), which knows their places, or from a
selection of its rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boletim.sinks.json import cell, json_rows


def _placed(rows: DataFrame) -> Column:
    """What stands before a row's line: nothing for the first of the rows, else a comma."""
    if "position" not in rows.columns:
        raise ValueError("rows have no position; store the report first")
    first = rows.agg(F.min("position")).scalar()
    return F.when(F.col("position") == first, F.lit("")).otherwise(F.lit(","))


def _framed(lines: DataFrame, frame: Sequence[tuple[int, str]]) -> DataFrame:
    """The lines with one more before each part's first."""
    spark = lines.sparkSession
    edges = spark.createDataFrame([(part, -1, text) for part, text in frame], "parte int, posicao long, linha string")
    return edges.unionByName(lines)


def _text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def json_document(rows: DataFrame) -> DataFrame:
    """The lines of ``{"columns": [...], "data": [[...], ...]}`` of a stored report, a line for each row."""
    comma, names = _placed(rows), [name for name in rows.columns if name != "position"]
    cells = json_rows(rows, names)
    lines = cells.select(F.lit(0).alias("parte"), F.col("position").alias("posicao"), F.concat(comma, "linha").alias("linha"))
    return _framed(lines, [(0, f'{{"columns":{_text(names)},"data":['), (1, "]}")])


def chart_document(rows: DataFrame) -> DataFrame:
    """The lines of ``{"labels": [...], "datasets": [{"label": ..., "data": [...]}, ...]}`` of a stored chart series.

    The first column has the labels, each other one is a data set. The table is turned on its side on the
    cluster: each cell becomes a line of its column's array, at the place of its row.
    """
    comma, (label, *series) = _placed(rows), [name for name in rows.columns if name != "position"]
    turned = F.array(
        *[
            F.struct(F.lit(i).alias("parte"), F.col("position").alias("posicao"), F.concat(comma, cell(rows, name)).alias("linha"))
            for i, name in enumerate([label, *series])
        ]
    )
    frame = [(0, '{"labels":[')]
    for i, name in enumerate(series, 1):
        before = '],"datasets":[' if i == 1 else "]},"
        frame.append((i, f'{before}{{"label":{_text(name)},"data":['))
    frame.append((len(series) + 1, "]}]}" if series else '],"datasets":[]}'))
    return _framed(rows.select(F.inline(turned)), frame)


def write_document(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the lines in order as text parts, which joined as bytes by name are the document."""
    lines.orderBy("parte", "posicao").select("linha").write.mode(mode).text(path)
