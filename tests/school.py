"""A hand-sized school network, one row set per case the reports must tell apart."""

from __future__ import annotations

from decimal import Decimal

from boletim.schema import SCHEMAS, LazyTables

ROWS = {
    "holdings": [(1, "Rede H"), (2, "Rede K")],
    "institutions": [(10, "Municipio 2024", 1), (11, "Municipio 2023", 1)],
    "cities": [(50, "Tauá"), (51, "Acari")],
    "regions": [(5, 50), (6, 51)],
    "institution_colleges": [
        (100, "Escola A", 10, 2024, 5),
        (101, "Wiquadro", 10, 2024, 5),
        (102, "TESTE", 10, 2024, 5),
        (103, "ESCOLA MUNICIPAL B", 11, 2023, 6),
        (104, "Escola Vazia", 10, 2024, 5),
    ],
    "institution_courses": [
        (200, "Fund", 100),
        (201, "Fund", 101),
        (202, "Fund", 102),
        (203, "Fund", 103),
        (204, "Sem nivel", 100),
    ],
    "institution_levels": [
        (300, "5º ano", 200),
        (301, "6º ano", 200),
        (302, "5º ano", 201),
        (303, "5º ano", 202),
        (304, "5º ano", 203),
    ],
    "institution_classrooms": [
        (400, "A", 300),
        (401, "A", 301),
        (402, "B", 300),
        (403, "A", 302),
        (404, "A", 303),
        (405, "A", 304),
    ],
    "users": [(1,), (2,), (3,), (4,)],
    "institution_enrollments": [
        (1, 400, 100, 10, 1),
        (1, 401, 100, 10, 1),
        (2, 400, 100, 10, 1),
        (2, 401, 101, 10, 1),
        (3, 402, 100, 10, 1),
        (9, 400, 100, 10, 1),
        (3, 404, 102, 10, 1),
        (2, 403, 101, 10, 1),
        (4, 405, 103, 11, 1),
    ],
    "quizzes": [
        (1, "Sim Geral LP C1"),
        (2, "Geral"),
        (3, "Minissim 1"),
        (4, "minisim 1"),
        (5, "MT C3"),
        (6, "LP livre"),
    ],
    "quiz_user_progresses": [
        (1, 1, True),
        (1, 1, True),
        (2, 1, True),
        (2, 1, False),
        (1, 2, True),
        (3, 2, False),
        (3, 5, None),
        (1, 3, True),
        (2, 4, True),
        (4, 5, True),
        (4, 5, True),
        (4, 2, True),
        (9, 1, True),
    ],
    "quiz_grades": [
        (1, 1, Decimal("6.0")),
        (2, 1, Decimal("6.5")),
        (1, 2, Decimal("6.5")),
        (4, 5, Decimal("9.0")),
    ],
    "institutions_quizzes": [(10, 1), (10, 5), (11, 5)],
    "institutions_learning_modules": [(11, 70)],
    "learning_module_quizzes": [(70, 2)],
}


def tables(spark, **changed):
    """The report tables; ``changed`` replaces the rows of the tables it names."""
    rows = {**ROWS, **changed}
    return LazyTables(lambda name: spark.createDataFrame(rows[name], SCHEMAS[name]))
