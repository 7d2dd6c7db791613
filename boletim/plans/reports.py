"""The nine reports. Each takes the tables and parameters and returns a lazy DataFrame.

Attempts and enrolments meet on the student alone, so a student with many of
both would multiply. Each report therefore first reduces enrolments to (student,
class name), keeps the attempts of those students only, reduces these to
(student, exam name), and joins the two reduced sets. That join holds each
(student, class, exam) once: counting its rows is the distinct count of
students, and multiplying the carried counts gives the plain count, without a
shuffle for distinct values. The attempts cross the network once, by student;
should one student hold a large part of them, adaptive execution splits that
partition and adds a shuffle after map-side reduction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boletim.functions import fixed_values as fixed
from boletim.functions.metrics import mean, rate
from boletim.functions.rules import label_by_pattern, like_any, not_named, not_named_any
from boletim.operators.exams import (
    attempts,
    exams,
    grade_scale,
    graded_attempts,
    holding_scope,
)
from boletim.operators.network import (
    children_or_none,
    classrooms,
    colleges,
    courses,
    institutions,
    levels,
    network,
    renamed,
    stacked,
    with_city,
)
from boletim.operators.order import sorted_by
from boletim.operators.rolls import enrolled_per_class, roll, roll_with_college, student_ids
from boletim.schema import Tables


def _classes_with_exams(t: Tables, net: DataFrame) -> DataFrame:
    """Every class with its exams: ``college, classroom, exam, finished, enrolled``.

    A class nobody finished an exam in has one row without exam. The two counts
    are stacked and matched within each class, of which there are at most as
    many rows as exam names. Classes without a name match nothing.
    """
    keys = ["college", "classroom"]
    rolls = roll_with_college(t, net, keys)
    enrolled = enrolled_per_class(rolls, keys, kept="in_college")
    takes_part = (
        (F.col("in_college") > 0) & F.col("college").isNotNull() & F.col("classroom").isNotNull()
    )
    students = rolls.select(F.when(takes_part, F.col("user_id")).alias("user_id"), *keys)
    finished = (
        students.join(student_ids(t), "user_id", "left_semi")
        .join(attempts(t, exams(t), students).select("user_id", "exam"), "user_id")
        .groupBy(*keys, "exam")
        .agg(F.count(F.lit(1)).alias("finished"))
    )
    return matched_classes(finished, enrolled, keys)


def matched_classes(finished: DataFrame, enrolled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both measures of a class side by side: ``*keys, exam, finished, enrolled``."""
    in_class = Window.partitionBy(*keys)
    return (
        stacked([finished, enrolled])
        .withColumn("exams", F.count("finished").over(in_class))
        .withColumn("total", F.max("enrolled").over(in_class))
        .filter(F.col("finished").isNotNull() | (F.col("exams") == 0))
        .select(
            *keys,
            "exam",
            F.coalesce("finished", F.lit(0)).alias("finished"),
            F.coalesce("total", F.lit(0)).alias("enrolled"),
        )
    )


def progress_by_exam(
    t: Tables,
    institution_ids: Sequence[int] = fixed.PROGRESS_INSTITUTIONS,
    excluded_school: str = fixed.EXCLUDED_SCHOOL,
) -> DataFrame:
    """Students who finished each exam beside those enrolled, for every class."""
    return progress_rows(_classes_with_exams(t, progress_network(t, institution_ids, excluded_school)))


def progress_network(
    t: Tables,
    institution_ids: Sequence[int] = fixed.PROGRESS_INSTITUTIONS,
    excluded_school: str = fixed.EXCLUDED_SCHOOL,
) -> DataFrame:
    """The classes of the progress report."""
    return network(t).filter(
        F.col("institution_id").isin(*institution_ids)
        & not_named(F.col("college"), excluded_school)
    )


def progress_rows(classes: DataFrame) -> DataFrame:
    """The progress report of classes with their exams, counted now or kept."""
    report = classes.select(
        F.col("college").alias("escola"),
        F.col("classroom").alias("turma"),
        label_by_pattern(F.col("exam"), fixed.SUBJECTS_WITH_MINI_EXAMS).alias("disciplina"),
        F.col("exam").alias("simulado_minisimulado"),
        F.col("finished").alias("simulados_concluídos"),
        F.col("enrolled").alias("matriculados_na_turma"),
    )
    return sorted_by(report, ["escola", "turma", "disciplina"])


def listing_with_rate(
    t: Tables,
    institution_ids: Sequence[int] = fixed.LISTING_INSTITUTIONS,
    excluded_schools: Sequence[str] = fixed.EXCLUDED_SCHOOLS,
) -> DataFrame:
    """Participation in each exam with its rate, for every class."""
    net = network(t).filter(
        F.col("institution_id").isin(*institution_ids)
        & not_named_any(F.col("college"), excluded_schools)
    )
    report = _classes_with_exams(t, net).select(
        F.col("college").alias("escola"),
        F.col("classroom").alias("turma"),
        label_by_pattern(F.col("exam"), fixed.SUBJECTS_WITH_MINI_EXAMS_LISTING).alias("cursos"),
        F.col("exam").alias("nome_simulado"),
        F.col("finished").alias("alunos_simulado"),
        F.col("enrolled").alias("alunos_matriculados"),
        rate(F.col("finished"), F.col("enrolled"), 2).alias("taxa_participacao"),
    )
    return sorted_by(report, ["escola", "turma", "cursos"])


def class_totals(
    t: Tables,
    by_level: bool = True,
    municipality: str = fixed.MUNICIPALITY,
    exam_patterns: Sequence[str] = fixed.GENERAL_EXAMS,
    institution_pattern: str = fixed.INSTITUTIONS_2024,
    excluded_schools: Sequence[str] = fixed.EXCLUDED_SCHOOLS,
) -> DataFrame:
    """Participation and mean grade per class and exam; with or without the level.

    The mean counts a grade once per attempt and enrolment, as joined rows would.
    """
    keys = ["college", "classroom"] + (["level"] if by_level else [])
    net = network(t).filter(
        F.col("institution").ilike(institution_pattern)
        & not_named_any(F.col("college"), excluded_schools)
    )
    rolls = roll(t["institution_enrollments"], net, keys)
    enrolled = enrolled_per_class(rolls, keys, kept="enrolments")
    students = rolls.select(
        F.when(F.col("enrolments") > 0, F.col("user_id")).alias("user_id"), *keys, "enrolments"
    )
    copies = student_ids(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("copies"))
    chosen = exams(t).filter(like_any(F.col("exam"), exam_patterns))
    graded = graded_attempts(t, chosen, students)
    weight = F.col("enrolments") * F.col("copies")
    finished = (
        students.join(copies, "user_id")
        .join(graded, "user_id")
        .groupBy(*keys, "exam")
        .agg(
            F.count(F.lit(1)).alias("finished"),
            F.sum(F.col("points") * weight).alias("points"),
            F.sum(F.col("grades") * weight).alias("grades"),
        )
    )
    average = mean(F.col("points"), F.col("grades"), grade_scale(t)).alias("média_notas")
    share = rate(F.col("finished"), F.col("enrolled"), 1).alias("taxa_participacao")
    subject = label_by_pattern(F.col("exam"), fixed.SUBJECTS)
    both = finished.join(enrolled, keys)
    if by_level:
        report = both.select(
            F.lit(municipality).alias("municipio"),
            F.col("college").alias("escola"),
            F.col("classroom").alias("turma"),
            F.col("level").alias("ano"),
            F.col("exam").alias("nome_do_simulado"),
            subject.alias("disciplina"),
            F.col("finished").alias("simulados_concluidos"),
            F.col("enrolled").alias("matriculados_na_turma"),
            average,
            share,
        )
        return sorted_by(report, ["escola", "turma", "nome_do_simulado"])
    report = both.select(
        F.lit(municipality).alias("municipio"),
        "college",
        F.col("classroom").alias("turma"),
        F.col("exam").alias("nome_simulado"),
        subject.alias("cursos"),
        F.col("finished").alias("total_alunos_simulado"),
        F.col("enrolled").alias("total_alunos_matriculados"),
        average,
        share,
    )
    return sorted_by(report, ["college", "turma", "nome_simulado"])


def enrolment_by_college(
    t: Tables,
    institution_pattern: str = fixed.INSTITUTIONS_2024,
    year: int = fixed.YEAR,
    snake_case: bool = False,
) -> DataFrame:
    """Enrolments per institution and school, each enrolment counted.

    Goes from enrolment to school directly, whether or not the classroom exists.
    """
    schools = (
        institutions(t)
        .drop("holding_id")
        .filter(F.col("institution").ilike(institution_pattern))
        .join(colleges(t).filter(F.col("year") == year), "institution_id")
        .select("college_id", "institution", "college")
    )
    counted = (
        t["institution_enrollments"]
        .select("user_id", "college_id")
        .join(schools, "college_id")
        .join(student_ids(t), "user_id")
        .groupBy("institution", "college")
        .agg(F.count(F.lit(1)).alias("students"))
    )
    names = (
        ["nome_da_instituicao", "nome_do_college", "quantidade_de_alunos"]
        if snake_case
        else ["Nome da Instituição", "Nome do College", "Quantidade de Alunos"]
    )
    return counted.toDF(*names)


def hierarchy_listing(
    t: Tables, institution_id: int = fixed.HIERARCHY_INSTITUTION, year: int = fixed.YEAR
) -> DataFrame:
    """An institution's schools down to classrooms; childless ancestors keep a row."""
    holdings = renamed(t["holdings"], holding_id="id", holding_name="name")
    top = (
        institutions(t)
        .filter(F.col("institution_id") == institution_id)
        .join(holdings, "holding_id")
        .join(
            colleges(t)
            .filter(F.col("year") == year)
            .drop("year", "region_id"),
            "institution_id",
        )
    )
    with_course, no_course = children_or_none(top, courses(t), "college_id")
    with_level, no_level = children_or_none(with_course, levels(t), "course_id")
    with_classroom, no_classroom = children_or_none(with_level, classrooms(t), "level_id")
    return stacked([with_classroom, no_classroom, no_level, no_course]).select(
        "holding_id",
        "holding_name",
        F.col("institution").alias("institution_name"),
        "institution_id",
        F.col("college").alias("college_name"),
        "college_id",
        F.col("course").alias("course_name"),
        "course_id",
        F.col("level").alias("level_name"),
        "level_id",
        F.col("classroom").alias("classroom_name"),
        "classroom_id",
    )


def _attempts_in_holding(
    t: Tables, holding_id: int, net: DataFrame, chosen: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Attempts times enrolments per class and exam: ``*keys, exam, n_user_id``.

    Only enrolments under the holding count, and only if it exists. The holding
    is a single number here; a join on it would send every enrolment to one task.
    """
    holdings = t["holdings"].filter(F.col("id") == holding_id).agg(F.count(F.lit(1))).scalar()
    enrolments = t["institution_enrollments"].filter(F.col("holding_id") == holding_id)
    rolls = roll(enrolments, net, keys, agree=["college_id", "institution_id"])
    return (
        rolls.join(student_ids(t), "user_id")
        .join(attempts(t, chosen, rolls), "user_id")
        .groupBy(*keys, "exam")
        .agg(F.sum(F.col("attempts") * F.col("enrolments")).alias("n_user_id"))
        .withColumn("n_user_id", F.col("n_user_id") * holdings)
        .filter(F.col("n_user_id") > 0)
    )


def students_by_exam(
    t: Tables,
    institution_ids: Sequence[int] = fixed.EXAM_INSTITUTIONS,
    year: int = fixed.YEAR,
    city_id: int = fixed.CITY,
) -> DataFrame:
    """Distinct students per class and exam, for exams assigned to the institutions."""
    keys = ["college", "classroom", "city"]
    in_scope: Column = F.col("institution_id").isin(*institution_ids)
    chosen = (
        exams(t)
        .filter(like_any(F.col("exam"), fixed.SUBJECT_EXAMS))
        .join(t["institutions_quizzes"].filter(in_scope), "quiz_id", "left_semi")
    )
    net = with_city(network(t), t).filter((F.col("year") == year) & (F.col("city_id") == city_id))
    rolls = roll(
        t["institution_enrollments"].filter(in_scope),
        net.drop("institution_id"),
        keys,
        agree=["college_id"],
    )
    counted = (
        rolls.select("user_id", *keys)
        .join(student_ids(t), "user_id", "left_semi")
        .join(attempts(t, chosen, rolls).select("user_id", "exam"), "user_id")
        .groupBy(*keys, "exam")
        .agg(F.count(F.lit(1)).alias("n_user_id"))
    )
    report = counted.select(
        label_by_pattern(F.col("exam"), fixed.COURSES, fixed.OTHER_COURSE).alias("curso"),
        F.col("college").alias("escola"),
        F.col("classroom").alias("turma"),
        F.col("city").alias("cidade"),
        F.col("exam").alias("simulado"),
        "n_user_id",
    )
    return sorted_by(report, ["curso", "escola", "turma", "cidade", "simulado"])


def students_by_exam_holding(
    t: Tables,
    year: int = fixed.YEAR,
    city_id: int = fixed.CITY,
    holding_id: int = fixed.CITY_HOLDING,
) -> DataFrame:
    """Attempts per institution, class and exam in a city, for one holding."""
    keys = ["institution", "college", "classroom", "city"]
    net = with_city(network(t), t).filter((F.col("year") == year) & (F.col("city_id") == city_id))
    return _attempts_in_holding(t, holding_id, net, exams(t), keys).select(
        F.col("institution").alias("curso"),
        F.col("college").alias("escola"),
        F.col("classroom").alias("turma"),
        F.col("city").alias("cidade"),
        F.col("exam").alias("simulado"),
        "n_user_id",
    )


def scoped_exams(
    t: Tables,
    school_pattern: str = fixed.MUNICIPAL_SCHOOLS,
    year: int = fixed.SCOPED_YEAR,
    holding_id: int = fixed.SCOPE_HOLDING,
) -> DataFrame:
    """Attempts per institution, class and exam, for exams in the holding's scope."""
    keys = ["institution", "college", "classroom"]
    chosen = exams(t).join(holding_scope(t, holding_id), "quiz_id", "left_semi")
    net = network(t).filter((F.col("year") == year) & F.col("college").ilike(school_pattern))
    return _attempts_in_holding(t, holding_id, net, chosen, keys).select(
        F.col("institution").alias("curso"),
        F.col("college").alias("escola"),
        F.col("classroom").alias("turma"),
        F.col("exam").alias("simulado"),
        "n_user_id",
    )
