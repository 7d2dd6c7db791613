"""The tables the reports read, and the check every source runs on load."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Tables = Mapping[str, DataFrame]

_LONG = T.LongType()
_TEXT = T.StringType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "holdings": _table(id=_LONG, name=_TEXT),
    "institutions": _table(id=_LONG, name=_TEXT, holding_id=_LONG),
    "institution_colleges": _table(
        id=_LONG, name=_TEXT, institution_id=_LONG, year=T.IntegerType(), region_id=_LONG
    ),
    "institution_courses": _table(id=_LONG, name=_TEXT, institution_college_id=_LONG),
    "institution_levels": _table(id=_LONG, name=_TEXT, course_id=_LONG),
    "institution_classrooms": _table(id=_LONG, name=_TEXT, level_id=_LONG),
    "institution_enrollments": _table(
        user_id=_LONG, classroom_id=_LONG, college_id=_LONG, institution_id=_LONG, holding_id=_LONG
    ),
    "users": _table(id=_LONG),
    "quizzes": _table(id=_LONG, name=_TEXT),
    "quiz_user_progresses": _table(user_id=_LONG, quiz_id=_LONG, finished=T.BooleanType()),
    "quiz_grades": _table(user_id=_LONG, quiz_id=_LONG, average=T.DecimalType(5, 1)),
    "regions": _table(id=_LONG, city_id=_LONG),
    "cities": _table(id=_LONG, name=_TEXT),
    "institutions_quizzes": _table(institution_id=_LONG, quiz_id=_LONG),
    "institutions_learning_modules": _table(institution_id=_LONG, learning_module_id=_LONG),
    "learning_module_quizzes": _table(learning_module_id=_LONG, quiz_id=_LONG),
}

# The three tables that grow with student activity, and all that grow with students, schools or
# exams; sources split their reads.
FACTS = ("quiz_user_progresses", "quiz_grades", "institution_enrollments")
GROWING = (
    *FACTS,
    "users",
    "quizzes",
    "institution_classrooms",
    "institutions_quizzes",
    "learning_module_quizzes",
)


def _grade_type(actual: T.DataType) -> T.DecimalType:
    """Decimal type of the grades: the source's own, with one digit after the point at least.

    A double has its shortest decimal form, of which 18 digits after the point are kept.
    """
    if isinstance(actual, T.DecimalType):
        return actual if actual.scale else T.DecimalType(min(actual.precision + 1, 38), 1)
    return T.DecimalType(21, 1) if isinstance(actual, T.IntegralType) else T.DecimalType(38, 18)


def _compatible(actual: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(wanted, T.DecimalType):
        return isinstance(actual, T.NumericType)
    if isinstance(wanted, T.IntegralType):
        # JDBC numerics without a declared scale may arrive as whole decimals.
        return isinstance(actual, T.IntegralType) or (
            isinstance(actual, T.DecimalType) and actual.scale == 0
        )
    if isinstance(wanted, T.StringType):
        return isinstance(actual, (T.StringType, T.CharType, T.VarcharType))
    return isinstance(actual, type(wanted))


def conform(name: str, df: DataFrame) -> DataFrame:
    """Check ``df`` against the schema of table ``name`` and cast to its types."""
    found = {field.name: field.dataType for field in df.schema.fields}
    problems = []
    columns = []
    for field in SCHEMAS[name].fields:
        actual = found.get(field.name)
        if actual is None:
            problems.append(f"{field.name} is missing")
        elif not _compatible(actual, field.dataType):
            problems.append(
                f"{field.name} is {actual.simpleString()}, not {field.dataType.simpleString()}"
            )
        else:
            kind = (
                _grade_type(actual) if isinstance(field.dataType, T.DecimalType) else field.dataType
            )
            columns.append(f"CAST({field.name} AS {kind.simpleString()}) AS {field.name}")
    if problems:
        raise ValueError(f"table {name}: " + "; ".join(problems))
    return df.selectExpr(*columns)


class LazyTables(Mapping[str, DataFrame]):
    """The report tables, each read and checked when a report first asks for it."""

    def __init__(self, read: Callable[[str], DataFrame]) -> None:
        self._read = read
        self._ready: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name not in self._ready:
            self._ready[name] = conform(name, self._read(name))
        return self._ready[name]

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)
