"""Reports on the hand-sized network, with rows worked out by hand."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from boletim.operators.exams import assigned_by_module, directly_assigned, holding_scope
from boletim.operators.network import renamed
from boletim.plans import reports
from tests.school import ROWS, tables

LP = "Língua Portuguesa"
MT = "Matemática"


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


def rows(df):
    return [tuple(row) for row in df.collect()]


def test_progress_by_exam(t):
    report = reports.progress_by_exam(t, [10])
    assert report.columns == [
        "escola",
        "turma",
        "disciplina",
        "simulado_minisimulado",
        "simulados_concluídos",
        "matriculados_na_turma",
    ]
    found = rows(report)
    assert sorted(found[:2]) == [
        ("Escola A", "A", LP, "Sim Geral LP C1", 2, 3),
        ("Escola A", "A", LP, "minisim 1", 1, 3),
    ]
    assert found[2:] == [
        ("Escola A", "A", MT, "Minissim 1", 1, 3),
        ("Escola A", "A", None, "Geral", 1, 3),
        ("Escola A", "B", None, None, 0, 1),
        ("TESTE", "A", None, None, 0, 1),
    ]


def test_listing_with_rate(t):
    found = rows(reports.listing_with_rate(t, [10]))
    assert sorted(found[:2]) == [
        ("Escola A", "A", LP, "Sim Geral LP C1", 2, 3, D("66.67")),
        ("Escola A", "A", LP, "minisim 1", 1, 3, D("33.33")),
    ]
    assert found[2:] == [
        ("Escola A", "A", MT, "Minissim 1", 1, 3, D("33.33")),
        ("Escola A", "A", None, "Geral", 1, 3, D("33.33")),
        ("Escola A", "B", None, None, 0, 1, D("0.00")),
    ]


def test_class_totals(t):
    report = reports.class_totals(t)
    assert report.columns == [
        "municipio",
        "escola",
        "turma",
        "ano",
        "nome_do_simulado",
        "disciplina",
        "simulados_concluidos",
        "matriculados_na_turma",
        "média_notas",
        "taxa_participacao",
    ]
    found = sorted(rows(report), key=str)
    assert found == sorted(
        [
            ("Tauá", "Escola A", "A", "5º ano", "Geral", None, 1, 3, D("6.5"), D("33.3")),
            ("Tauá", "Escola A", "A", "5º ano", "Sim Geral LP C1", LP, 2, 3, D("6.2"), D("66.7")),
            ("Tauá", "Escola A", "A", "6º ano", "Geral", None, 1, 2, D("6.5"), D("50.0")),
            ("Tauá", "Escola A", "A", "6º ano", "Sim Geral LP C1", LP, 2, 2, D("6.2"), D("100.0")),
        ],
        key=str,
    )


def test_class_totals_without_level(t):
    report = reports.class_totals(t, by_level=False)
    assert report.columns == [
        "municipio",
        "college",
        "turma",
        "nome_simulado",
        "cursos",
        "total_alunos_simulado",
        "total_alunos_matriculados",
        "média_notas",
        "taxa_participacao",
    ]
    assert rows(report) == [
        ("Tauá", "Escola A", "A", "Geral", None, 1, 3, D("6.5"), D("33.3")),
        ("Tauá", "Escola A", "A", "Sim Geral LP C1", LP, 2, 3, D("6.2"), D("66.7")),
    ]


def test_class_totals_rows_are_distinct(t):
    for by_level in (True, False):
        report = reports.class_totals(t, by_level=by_level)
        assert report.count() == report.dropDuplicates().count()


def test_double_grades_give_the_same_means(spark):
    t = tables(spark)
    as_double = dict(t)
    as_double["quiz_grades"] = t["quiz_grades"].withColumn("average", F.col("average").cast("double"))
    from boletim.schema import conform

    as_double["quiz_grades"] = conform("quiz_grades", as_double["quiz_grades"])
    assert sorted(rows(reports.class_totals(as_double)), key=str) == sorted(
        rows(reports.class_totals(t)), key=str
    )


def test_grades_keep_all_their_digits(spark):
    from boletim.schema import conform

    t = dict(tables(spark))
    plain = t["quiz_grades"]
    for text, mean in (("6.2499999", "6.2"), ("6.249999999999999999", "6.2"), ("6.25", "6.3")):
        fine = plain.withColumn("average", F.lit(text).cast("decimal(38,18)"))
        t["quiz_grades"] = conform("quiz_grades", fine)
        found = {row["média_notas"] for row in reports.class_totals(t).collect()}
        assert found - {None} == {D(mean)}


def test_enrolment_by_college(t):
    report = reports.enrolment_by_college(t)
    assert report.columns == ["Nome da Instituição", "Nome do College", "Quantidade de Alunos"]
    assert sorted(rows(report)) == [
        ("Municipio 2024", "Escola A", 4),
        ("Municipio 2024", "TESTE", 1),
        ("Municipio 2024", "Wiquadro", 2),
    ]
    plain = reports.enrolment_by_college(t, snake_case=True)
    assert plain.columns == ["nome_da_instituicao", "nome_do_college", "quantidade_de_alunos"]


def test_hierarchy_listing(t):
    report = reports.hierarchy_listing(t, institution_id=10, year=2024)
    assert report.columns == [
        "holding_id",
        "holding_name",
        "institution_name",
        "institution_id",
        "college_name",
        "college_id",
        "course_name",
        "course_id",
        "level_name",
        "level_id",
        "classroom_name",
        "classroom_id",
    ]
    found = {(r.college_id, r.course_id, r.level_id, r.classroom_id) for r in report.collect()}
    assert found == {
        (100, 200, 300, 400),
        (100, 200, 300, 402),
        (100, 200, 301, 401),
        (101, 201, 302, 403),
        (102, 202, 303, 404),
        (100, 204, None, None),
        (104, None, None, None),
    }
    assert report.count() == 7
    assert {(r.holding_id, r.holding_name, r.institution_name) for r in report.collect()} == {
        (1, "Rede H", "Municipio 2024")
    }


def test_students_by_exam(t):
    course = "Língua Portuguesa - Curso 1"
    assert rows(reports.students_by_exam(t, [10], 2024, 50)) == [
        (course, "Escola A", "A", "Tauá", "Sim Geral LP C1", 2),
        (course, "Wiquadro", "A", "Tauá", "Sim Geral LP C1", 1),
    ]


def test_students_by_exam_without_a_known_course(spark):
    t = tables(
        spark,
        quiz_user_progresses=[(1, 6, True), (1, 6, True)],
        institutions_quizzes=[(10, 6)],
    )
    assert rows(reports.students_by_exam(t, [10], 2024, 50)) == [
        ("Outro Curso", "Escola A", "A", "Tauá", "LP livre", 1)
    ]


def test_students_by_exam_holding(t):
    found = reports.students_by_exam_holding(t, 2024, 50, 1)
    assert found.columns == ["curso", "escola", "turma", "cidade", "simulado", "n_user_id"]
    first = "Municipio 2024"
    assert sorted(rows(found)) == [
        (first, "Escola A", "A", "Tauá", "Geral", 2),
        (first, "Escola A", "A", "Tauá", "Minissim 1", 2),
        (first, "Escola A", "A", "Tauá", "Sim Geral LP C1", 5),
        (first, "Escola A", "A", "Tauá", "minisim 1", 1),
        (first, "Wiquadro", "A", "Tauá", "Sim Geral LP C1", 1),
        (first, "Wiquadro", "A", "Tauá", "minisim 1", 1),
    ]


def test_a_holding_that_does_not_exist_has_no_rows(spark):
    t = tables(spark, holdings=[(2, "Rede K")])
    assert rows(reports.students_by_exam_holding(t, 2024, 50, 1)) == []
    assert rows(reports.scoped_exams(t, holding_id=1)) == []


def test_scoped_exams(t):
    found = reports.scoped_exams(t, holding_id=1)
    assert found.columns == ["curso", "escola", "turma", "simulado", "n_user_id"]
    assert sorted(rows(found)) == [
        ("Municipio 2023", "ESCOLA MUNICIPAL B", "A", "Geral", 1),
        ("Municipio 2023", "ESCOLA MUNICIPAL B", "A", "MT C3", 2),
    ]


def test_scope_has_both_arms(t):
    ids = renamed(t["institutions"], institution_id="id")
    assert {r.quiz_id for r in directly_assigned(t, ids).collect()} == {1, 5}
    assert {r.quiz_id for r in assigned_by_module(t, ids).collect()} == {2}
    assert sorted(rows(holding_scope(t, 1))) == [(1,), (2,), (5,)]
    assert rows(holding_scope(t, 2)) == []


def test_classes_whose_only_enrolment_names_no_student_stay_listed(spark):
    enrolments = ROWS["institution_enrollments"] + [(None, 403, 101, 10, 1)]
    only = [row for row in enrolments if row[1] != 404] + [(None, 404, 102, 10, 1)]
    found = rows(reports.progress_by_exam(tables(spark, institution_enrollments=only), [10]))
    assert ("TESTE", "A", None, None, 0, 0) in found


def test_unnamed_classes_match_no_exam(spark):
    classrooms = [(400, None, 300)] + ROWS["institution_classrooms"][1:]
    found = rows(reports.progress_by_exam(tables(spark, institution_classrooms=classrooms), [10]))
    assert [row for row in found if row[1] is None] == [("Escola A", None, None, None, 0, 3)]


def test_ties_round_away_from_zero(spark):
    grades = [(1, 1, D("6.0")), (2, 1, D("6.5"))]
    progress = [(1, 1, True), (2, 1, True)]
    t = tables(
        spark,
        quiz_grades=grades,
        quiz_user_progresses=progress,
        institution_enrollments=[(1, 400, 100, 10, 1), (2, 400, 100, 10, 1)],
    )
    assert [row[8] for row in rows(reports.class_totals(t))] == [D("6.3")]
