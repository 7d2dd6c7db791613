"""JSON output: column names, and one array of cells per row."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(df: DataFrame, name: str) -> Column:
    """One cell as JSON text; decimals become strings, as a double could not hold them."""
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.DecimalType):
        value = value.cast("string")
    text = F.to_json(F.array(value))
    return text.substr(F.lit(2), F.length(text) - 2)


def json_rows(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Each row as the text of a JSON array, as ``linha``; numbers and nulls keep their type.

    With ``names`` only these columns are cells, and all others stay as they are.
    """
    cells = F.concat_ws(",", *[cell(df, name) for name in names or df.columns])
    others = [f"`{name}`" for name in df.columns if names is not None and name not in names]
    return df.select(F.concat(F.lit("["), cells, F.lit("]")).alias("linha"), *others)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``path/columns`` (the names, one JSON array) and ``path/data`` (a row per line)."""
    names = json.dumps(df.columns, ensure_ascii=False)
    header = df.sparkSession.range(0, 1, 1, 1).select(F.lit(names).alias("linha"))
    json_rows(df).write.mode(mode).text(f"{path.rstrip('/')}/data")
    header.write.mode(mode).text(f"{path.rstrip('/')}/columns")


def json_payload(page: DataFrame) -> dict:
    """``{"columns": [...], "data": [[...], ...]}`` of all given rows, which come to this process.

    Meant for a page (``grid.page``); ``write_json`` writes a result of any size.
    """
    lines = json_rows(page).collect()
    return {"columns": page.columns, "data": [json.loads(line.linha) for line in lines]}
