"""Reports on random tables with missing values, repeated keys and one hot student,
class and exam, against the plain DuckDB texts."""

from __future__ import annotations

import random
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as registered
import oracle_queries
from boletim.schema import SCHEMAS, LazyTables
from tests.test_oracle import _rows

NAMES = {
    "institutions": ["Rede 2024", "rede - 2024", "Rede 2023", None],
    "institution_colleges": ["Escola Municipal X", "ESCOLA MUNICIPAL y", "Wiquadro", "TESTE", "Outra", None],
    "institution_classrooms": ["A", "B", None],
    "institution_levels": ["5º ano", "6º ano", None],
    "quizzes": ["Sim Geral LP C1", "Geral MT C2", "Minissim", "minisim", "LP MT", "Brand#1", None],
    "cities": ["Tauá", "Acari"],
    "holdings": ["H", "K"],
    "institution_courses": ["Fund", None],
}
ROW_COUNTS = {
    "holdings": 4,
    "institutions": 18,
    "cities": 4,
    "regions": 8,
    "institution_colleges": 24,
    "institution_courses": 30,
    "institution_levels": 36,
    "institution_classrooms": 60,
    "users": 20,
    "institution_enrollments": 300,
    "quizzes": 20,
    "quiz_user_progresses": 400,
    "quiz_grades": 250,
    "institutions_quizzes": 60,
    "institutions_learning_modules": 30,
    "learning_module_quizzes": 20,
}
# The table each reference points into, and the row a third of them point at.
TARGETS = {
    "user_id": "users",
    "quiz_id": "quizzes",
    "classroom_id": "institution_classrooms",
    "level_id": "institution_levels",
    "course_id": "institution_courses",
    "college_id": "institution_colleges",
    "institution_college_id": "institution_colleges",
    "institution_id": "institutions",
    "holding_id": "holdings",
    "region_id": "regions",
    "city_id": "cities",
    "learning_module_id": "institutions_learning_modules",
}
HOT = 2
HOT_INSTITUTIONS = (2, 4, 15)


def _value(rng, table, number, field):
    if field.name == "id":
        # Every tenth row repeats the id before it; ids are not promised to be unique.
        return number - 1 if number % 10 == 9 else number
    if field.name == "name":
        return rng.choice(NAMES[table])
    if field.name == "finished":
        return rng.choice([True, True, False, None])
    if field.name == "average":
        return rng.choice([None] + [Decimal(n) / 10 for n in range(0, 101, 5)])
    if field.name == "year":
        return rng.choice([2023, 2024, 2023, 2024, None])
    draw = rng.random()
    if draw < 0.04:
        return None
    if draw < 0.37:
        return rng.choice(HOT_INSTITUTIONS) if field.name == "institution_id" else HOT
    # A little beyond the last row, so that some references lead nowhere.
    return rng.randrange(ROW_COUNTS[TARGETS[field.name]] + 2)


def _follow_classroom(rng, tables, enrolment):
    """Most enrolments carry the ids of their classroom's ancestors."""
    user, key, college, institution, holding = enrolment
    steps = (
        ("institution_classrooms", 2),
        ("institution_levels", 2),
        ("institution_courses", 2),
    )
    for name, column in steps:
        key = next((row[column] for row in tables[name] if row[0] == key), None)
    if key is None or rng.random() < 0.2:
        return enrolment
    college = key
    institution = next((r[2] for r in tables["institution_colleges"] if r[0] == key), institution)
    holding = next((r[2] for r in tables["institutions"] if r[0] == institution), holding)
    return (user, enrolment[1], college, institution, holding)


def _tables(seed):
    rng = random.Random(seed)
    tables = {
        name: [
            tuple(_value(rng, name, number, field) for field in schema.fields)
            for number in range(ROW_COUNTS[name])
        ]
        for name, schema in SCHEMAS.items()
    }
    tables["institution_enrollments"] = [
        _follow_classroom(rng, tables, row) for row in tables["institution_enrollments"]
    ]
    return tables


def _arrow(name, rows):
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema(
        [
            (f.name, kinds.get(f.dataType.simpleString(), pa.decimal128(5, 1)))
            for f in SCHEMAS[name].fields
        ]
    )
    return pa.Table.from_pylist([dict(zip(schema.names, row)) for row in rows], schema=schema)


SEEDS = (9, 21, 26)


@pytest.fixture(scope="module", params=SEEDS)
def case(request, spark, tmp_path_factory):
    con = duckdb.connect()
    folder = tmp_path_factory.mktemp("school")
    for name, rows in _tables(request.param).items():
        con.register(name, _arrow(name, rows))
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(2).write.parquet(f"{folder}/{name}")
    ready = LazyTables(lambda name: spark.read.parquet(f"{folder}/{name}"))
    return con, ready


REPORTS = [name for name in registered._QUERIES if name.startswith("r")] + ["exam_scope_union"]


def test_first_seed_leaves_no_report_empty():
    con = duckdb.connect()
    for name, rows in _tables(SEEDS[0]).items():
        con.register(name, _arrow(name, rows))
    texts = oracle_queries.texts(derived=False)
    assert all(con.execute(texts[name]).fetchall() for name in REPORTS)


@pytest.mark.parametrize("name", REPORTS)
def test_report_on_random_tables(case, name):
    con, ready = case
    found = registered._doubles(registered._QUERIES[name](ready))
    wanted = con.execute(oracle_queries.texts(derived=False)[name])
    columns = [column[0] for column in wanted.description]
    expected = _rows(columns, wanted.fetchall())
    assert _rows(found.columns, [tuple(row) for row in found.collect()]) == expected
