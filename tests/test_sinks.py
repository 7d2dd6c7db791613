"""CSV and JSON output, byte by byte."""

from __future__ import annotations

import csv
import glob
import io
import json
from decimal import Decimal

import pytest

from boletim.plans import reports
from boletim.sinks.csv import csv_rows, write_csv
from boletim.sinks.json import json_payload, json_rows, write_json
from tests.school import tables

ROWS = [
    ("a;b", 1, None, Decimal("6.2")),
    ('q"x', 2, "é", None),
    ("  blanks ", None, "", Decimal("0.0")),
    ("plain, comma", 4, "t", Decimal("100.0")),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "nome string, n bigint, `média` string, taxa decimal(10,1)").coalesce(1)


def _python_csv(columns, rows):
    out = io.StringIO()
    out.write("﻿")
    writer = csv.writer(out, dialect="excel", delimiter=";", quotechar='"', quoting=csv.QUOTE_MINIMAL)
    writer.writerow(columns)
    writer.writerows(rows)
    return out.getvalue().encode()


def test_csv_bytes(df, tmp_path):
    write_csv(df.repartitionByRange(3, "n").sortWithinPartitions("n"), str(tmp_path / "out"))
    parts = sorted(glob.glob(f"{tmp_path}/out/part-*"))
    found = b"".join(open(path, "rb").read() for path in parts)
    assert len(parts) > 2 and found.startswith(b"\xef\xbb\xbf")
    assert b'"a;b";1;;6.2\r\n' in found
    assert b'"q""x";2;' in found
    order = sorted(ROWS, key=lambda row: (row[1] is not None, row[1]))
    assert found == _python_csv(df.columns, order)


def test_csv_rows(df):
    assert [row.linha for row in csv_rows(df).collect()] == [
        '"a;b";1;;6.2',
        '"q""x";2;é;',
        "  blanks ;;;0.0",
        "plain, comma;4;t;100.0",
    ]


def test_csv_of_a_report(spark, tmp_path):
    report = reports.class_totals(tables(spark))
    write_csv(report, str(tmp_path / "out"))
    parts = sorted(glob.glob(f"{tmp_path}/out/part-*"))
    expected = _python_csv(report.columns, [tuple(row) for row in report.collect()])
    assert b"".join(open(path, "rb").read() for path in parts) == expected


def test_csv_line_ends_inside_cells(spark, tmp_path):
    rows = [("a\nb", "c"), ("d\r\ne", 'f"')]
    df = spark.createDataFrame(rows, "x string, `y;` string").coalesce(1)
    write_csv(df, str(tmp_path / "out"))
    parts = sorted(glob.glob(f"{tmp_path}/out/part-*"))
    assert b"".join(open(path, "rb").read() for path in parts) == _python_csv(df.columns, rows)


def test_json_rows(df):
    lines = [json.loads(row.linha) for row in json_rows(df).collect()]
    assert lines == [
        ["a;b", 1, None, "6.2"],
        ['q"x', 2, "é", None],
        ["  blanks ", None, "", "0.0"],
        ["plain, comma", 4, "t", "100.0"],
    ]


def test_json_payload(df):
    payload = json_payload(df)
    assert payload["columns"] == ["nome", "n", "média", "taxa"]
    assert payload["data"][0] == ["a;b", 1, None, "6.2"]
    assert len(payload["data"]) == len(ROWS)


def test_json_files(df, tmp_path):
    write_json(df, str(tmp_path / "out"))
    read = lambda part: open(glob.glob(f"{tmp_path}/out/{part}/part-*")[0], encoding="utf-8").read()
    assert json.loads(read("columns")) == df.columns
    assert len(read("data").splitlines()) == len(ROWS)
