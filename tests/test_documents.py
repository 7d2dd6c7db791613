"""Whole results as one JSON document, in any number of parts."""

from __future__ import annotations

import glob
import json
from decimal import Decimal

import pytest

from boletim.operators import grid
from boletim.operators.chart import chart_payload
from boletim.plans import reports
from boletim.sinks.document import chart_document, json_document, write_document
from boletim.sinks.json import json_payload
from tests.school import tables

ROWS = [
    ('a"b\\c', 1, None, Decimal("6.2")),
    ("línea\nnova", 2, 0.5, None),
    (None, None, -1e300, Decimal("0.0")),
    ("x,]}", 4, 3.25, Decimal("100.0")),
]
SCHEMA = 'nome string, n bigint, `mé"dia` double, taxa decimal(10,1)'


def joined(path):
    return b"".join(open(name, "rb").read() for name in sorted(glob.glob(f"{path}/part-*")))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return grid.store(df, str(tmp_path_factory.mktemp("store") / "rows"))


@pytest.mark.parametrize("parts", [1, 3, 50])
@pytest.mark.parametrize("chosen", ["TRUE", "n >= 2", "n = 4", "FALSE"])
def test_json_document(spark, stored, tmp_path, parts, chosen):
    rows = stored.filter(chosen)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        write_document(json_document(rows), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wanted = json_payload(rows.orderBy("position").drop("position"))
    assert json.loads(joined(tmp_path / "out")) == wanted
    if chosen == "TRUE":
        assert [row[0] for row in wanted["data"]] == ['a"b\\c', "línea\nnova", "x,]}", None]


def test_json_document_of_a_report(spark, tmp_path):
    report = reports.listing_with_rate(tables(spark), [10])
    rows = grid.store(report, str(tmp_path / "rows"))
    write_document(json_document(rows), str(tmp_path / "out"))
    found = json.loads(joined(tmp_path / "out"))
    assert found == json_payload(rows.orderBy("position").drop("position")) and len(found["data"]) > 3


@pytest.mark.parametrize("chosen", ["TRUE", "n = 4", "FALSE"])
def test_chart_document(stored, tmp_path, chosen):
    wide = stored.filter(chosen).drop("taxa")
    write_document(chart_document(wide), str(tmp_path / "out"))
    found = json.loads(joined(tmp_path / "out"))
    assert found == chart_payload(wide.drop("position"))
    assert [d["label"] for d in found["datasets"]] == ["n", 'mé"dia']


def test_chart_document_without_series(stored, tmp_path):
    write_document(chart_document(stored.select("nome", "position")), str(tmp_path / "out"))
    assert json.loads(joined(tmp_path / "out")) == {"labels": ['a"b\\c', "línea\nnova", "x,]}", None], "datasets": []}


def test_rows_need_places(spark):
    for document in (json_document, chart_document):
        with pytest.raises(ValueError, match="store"):
            document(spark.createDataFrame(ROWS, SCHEMA))
