"""Properties of the physical plans that matter at scale."""

from __future__ import annotations

import re

import pytest

from boletim.operators.filters import apply_filters
from boletim.plans import reports
from boletim.sources import read_parquet
from tests.school import tables

WITHOUT_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("school")
    for name, df in tables(spark).items():
        df.write.parquet(f"{folder}/{name}")
    return read_parquet(spark, str(folder))


def plan(df, settings=None):
    """The final plan, after adaptive execution, under the given settings."""
    spark = df.sparkSession
    before = {key: spark.conf.get(key) for key in settings or {}}
    try:
        for key, value in (settings or {}).items():
            spark.conf.set(key, value)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        # Subqueries carry initial plans too; the query's own is not indented.
        return re.split(r"^\+- == Initial Plan", text, flags=re.MULTILINE)[0]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


CALLS = {
    "progress": lambda t: reports.progress_by_exam(t, [10]),
    "listing": lambda t: reports.listing_with_rate(t, [10]),
    "totals": lambda t: reports.class_totals(t),
    "enrolment": lambda t: reports.enrolment_by_college(t),
    "hierarchy": lambda t: reports.hierarchy_listing(t, 10, 2024),
    "students": lambda t: reports.students_by_exam(t, [10], 2024, 50),
    "holding": lambda t: reports.students_by_exam_holding(t, 2024, 50, 1),
    "scoped": lambda t: reports.scoped_exams(t, holding_id=1),
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_no_cross_join_and_no_broadcast_hint(t, name):
    df = CALLS[name](t)
    text = plan(df, WITHOUT_BROADCAST)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BroadcastHashJoin" not in text
    assert "ResolvedHint" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["progress", "listing", "totals"])
def test_class_rolls_are_shuffled_once(t, name):
    text = plan(CALLS[name](t), WITHOUT_BROADCAST)
    assert "ReusedExchange [user_id" in text
    assert len(re.findall(r"FileScan parquet \[user_id#\d+L,classroom_id", text)) == 1


def test_facts_are_read_with_filters_and_needed_columns_only(t):
    text = plan(CALLS["students"](t))
    assert "EqualTo(finished,true)" in text
    assert "In(institution_id, [10])" in text or "EqualTo(institution_id,10)" in text
    assert "ReadSchema: struct<user_id:bigint,classroom_id:bigint,college_id:bigint,institution_id:bigint>" in text


def test_added_filters_reach_the_scans(t):
    df = apply_filters(reports.class_totals(t), {"turma": "A", "nome_do_simulado": "Geral"}, mode="eq")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"isnotnull\(name#\d+\) AND \(name#\d+ = A\)", text)) >= 1
    assert re.search(r"name#\d+ = Geral\)", text)


def test_a_hot_student_joins_as_reduced_rows(spark):
    """Attempts and enrolments of one student meet as distinct exams and classes."""
    hot = tables(
        spark,
        quiz_user_progresses=[(1, 1, True)] * 500,
        institution_enrollments=[(1, 400, 100, 10, 1)] * 500,
    )
    report = reports.students_by_exam_holding(hot, 2024, 50, 1)
    assert [row.n_user_id for row in report.collect()] == [250_000]
    assert [row[4] for row in reports.progress_by_exam(hot, [10]).collect()] == [1]


def test_a_hot_student_is_split_over_tasks(spark, tmp_path):
    """Half of all attempts are one student's: adaptive execution splits that partition."""
    hot = [(1, quiz, True) for quiz in range(1, 6)] * 4000
    others = [(2 + n % 500, 1 + n % 5, True) for n in range(20_000)]
    enrolments = [(user, 400, 100, 10, 1) for user in range(1, 502)]
    changed = {
        "users": [(user,) for user in range(1, 502)],
        "institution_enrollments": enrolments,
    }
    attempts = spark.createDataFrame(hot + others, "user_id bigint, quiz_id bigint, finished boolean")
    attempts.repartition(8).write.parquet(f"{tmp_path}/attempts")
    t = dict(tables(spark, **changed))
    t["quiz_user_progresses"] = spark.read.parquet(f"{tmp_path}/attempts")
    report = reports.students_by_exam_holding(t, 2024, 50, 1)
    text = plan(
        report,
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        },
    )
    assert "SortMergeJoin(skew=true) [user_id" in re.sub(r"#\d+L?", "", text)
    counted = {row.simulado: row.n_user_id for row in report.collect()}
    assert sum(counted.values()) == len(hot) + len(others)
    assert set(counted.values()) == {8000}
