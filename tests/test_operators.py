"""Filters, grid operators and chart series."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from boletim.operators import grid
from boletim.operators.chart import chart_payload, chart_series, write_chart
from boletim.operators.filters import apply_filters
from boletim.operators.order import sorted_by
from boletim.plans import reports
from tests.school import tables

ROWS = [
    ("Ana", "A", "x", 3),
    ("bia", "B", "x", 1),
    ("Caio", "A", None, 2),
    (None, "A", "y", 5),
    ("escola A", "B", "y", 4),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "nome string, turma string, tipo string, n int")


def firsts(df):
    return [row[0] for row in df.collect()]


def test_nulls_sort_last(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "v string")
    assert firsts(sorted_by(df, ["v"])) == ["a", "b", None]


def test_collation(spark):
    df = spark.createDataFrame([("Eva",), ("Érica",), ("Davi",)], "v string")
    assert firsts(sorted_by(df, ["v"])) == ["Davi", "Eva", "Érica"]
    assert firsts(sorted_by(df, ["v"], collation="UNICODE")) == ["Davi", "Érica", "Eva"]


def test_ilike_filters(df):
    assert firsts(apply_filters(df, {"nome": "ESC%"})) == ["escola A"]
    assert firsts(apply_filters(df, {"nome": "esc"})) == []
    assert apply_filters(df, {"nome": "", "turma": None}).count() == 5
    assert firsts(apply_filters(df, {"turma": "a", "tipo": "X"})) == ["Ana"]
    assert firsts(apply_filters(df, {"n": "2"})) == ["Caio"]


def test_equality_filters(df):
    assert firsts(apply_filters(df, {"turma": "A", "tipo": "x"}, mode="eq")) == ["Ana"]
    assert firsts(apply_filters(df, {"tipo": ""}, mode="eq")) == []
    assert firsts(apply_filters(df, {"turma": "a"}, mode="eq")) == []
    assert firsts(apply_filters(df, {"n": "1"}, mode="eq")) == ["bia"]


def test_unknown_filters_are_refused(df):
    with pytest.raises(ValueError, match="nome, turma, tipo, n"):
        apply_filters(df, {"1=1; --": "x"})
    with pytest.raises(ValueError):
        apply_filters(df, {"nome": "x"}, mode="regex")


def test_filters_work_on_every_report(spark):
    t = tables(spark)
    found = apply_filters(reports.progress_by_exam(t, [10]), {"escola": "escola%", "turma": "b"})
    assert [tuple(row) for row in found.collect()] == [("Escola A", "B", None, None, 0, 1)]
    accented = apply_filters(reports.class_totals(t), {"média_notas": "6.5"})
    assert {row.nome_do_simulado for row in accented.collect()} == {"Geral"}


def test_search(df):
    assert firsts(grid.search(df, "a B")) == ["bia", "escola A"]
    assert firsts(grid.search(df, "CAIO 2")) == ["Caio"]
    assert grid.search(df, "  ").count() == 5
    assert grid.search(df, "zz").count() == 0
    assert grid.phrases('um "dois três" qua"tro') == ["um", "dois três", "qua", "tro"]
    assert firsts(grid.search(df, '"escola a" 4')) == ["escola A"]
    assert grid.search(df, '"a escola"').count() == 0


def test_first_column_search(df):
    assert firsts(grid.first_column_search(df, "a")) == ["Ana", "bia", "Caio", "escola A"]
    assert grid.first_column_search(df, "").count() == 5


def test_multiselect(df):
    both = grid.multiselect(df, {"turma": ["A", "B"], "tipo": ["x"]}, match="exact")
    assert firsts(both) == ["Ana", "bia"]
    assert grid.multiselect(df, {"turma": []}).count() == 5
    assert firsts(grid.multiselect(df, {"n": ["5", "4"]}, "exact")) == [None, "escola A"]
    part = grid.multiselect(df, {"nome": ["A", "zz"]})
    assert firsts(part) == ["Ana", "bia", "Caio", "escola A"]


def test_facets_are_the_distinct_values(df):
    found = [tuple(row) for row in grid.facets(df).collect()]
    expected = {
        (name, None if cell is None else str(cell))
        for name, cells in zip(df.columns, zip(*ROWS))
        for cell in cells
    }
    assert len(found) == len(set(found)) and set(found) == expected
    assert [row[1] for row in found if row[0] == "tipo"] == ["x", "y", None]


def test_sort(df):
    assert firsts(grid.sort(df)) == ["Ana", "Caio", "bia", "escola A", None]
    assert [row.n for row in grid.sort(df, "n", descending=True).collect()] == [5, 4, 3, 2, 1]
    assert [row.nome for row in grid.sort(df, "turma").collect()][-2:] == ["bia", "escola A"]
    several = grid.sort(df, [("turma", True), ("tipo", False)]).collect()
    assert [row.n for row in several] == [1, 4, 3, 5, 2]
    with pytest.raises(ValueError):
        grid.sort(df, "outra")


def test_pages_make_up_the_sorted_whole(spark, tmp_path):
    df = spark.range(0, 95, 1, 4).select(
        F.when(F.col("id") % 7 != 0, (F.col("id") % 3).cast("string")).alias("k"),
        (F.col("id") % 10).alias("v"),
        "id",
    )
    whole = [tuple(row) for row in grid.sort(df).collect()]
    rows = grid.store(df, str(tmp_path / "report"))
    assert [tuple(r) for n in range(10) for r in grid.page(rows, n, 10).collect()] == whole
    assert grid.page(rows, 50, 10).collect() == []
    again = grid.stored(spark, str(tmp_path / "report"))
    assert [tuple(r) for r in grid.page(again, 9, 10).collect()] == whole[90:]


def test_positions(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    rows = grid.store(df, str(tmp_path / "report"), descending=True).collect()
    assert sorted((row.position, row.v) for row in rows) == [(n, 999 - n) for n in range(1000)]


def test_a_stored_report_is_not_run_again(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(1)
            yield batch

    df = spark.range(0, 10, 1, 1).mapInArrow(counted, "id long")
    rows = grid.store(df, str(tmp_path / "report"))
    first = runs.value
    assert grid.counts(rows, grid.selected(rows, {"id": ["3"]}, "exact")).first() == (10, 1)
    assert grid.page(rows, 1, 4).count() == 4 and grid.facets(rows).count() == 20
    assert runs.value == first


def test_counts(df):
    row = grid.counts(df, grid.selected(df, {"turma": ["A"]})).collect()
    assert [tuple(r) for r in row] == [(5, 3)]


def test_preview(df):
    assert grid.preview(sorted_by(df, ["n"]), 2).collect()[0].n == 1
    assert grid.preview(df).count() == 5


def test_chart(df):
    wide = chart_series(df, "turma", "tipo", "n", ["x", "y"])
    assert sorted(tuple(row) for row in wide.collect()) == [("A", 3, 5), ("B", 1, 4)]
    assert chart_payload(wide) == {
        "labels": ["A", "B"],
        "datasets": [{"label": "x", "data": [3, 1]}, {"label": "y", "data": [5, 4]}],
    }
    whole = chart_series(df, "turma", "tipo", "n", ["x"], other="outros")
    assert sorted(tuple(row) for row in whole.collect()) == [("A", 3, 7), ("B", 1, 4)]


def test_chart_files(df, tmp_path):
    write_chart(chart_series(df, "turma", "tipo", "n", ["x"], other="outros"), str(tmp_path / "out"))
    lines = [line for path in sorted(tmp_path.glob("out/part-*")) for line in path.read_text().splitlines()]
    assert [json.loads(line) for line in lines] == [
        {"turma": "A", "x": 3, "outros": 7},
        {"turma": "B", "x": 1, "outros": 4},
    ]
