"""Labels, exclusions, rates and means."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from boletim.functions import fixed_values as fixed
from boletim.functions.metrics import mean, rate
from boletim.functions.rules import label_by_pattern, like_any, not_named, not_named_any

LP = "Língua Portuguesa"
MT = "Matemática"


def texts(spark, values):
    return spark.createDataFrame([(value,) for value in values], "name string")


@pytest.mark.parametrize(
    "scale, cases",
    [
        (
            1,
            [
                (1, 16, "6.3"),
                (23, 80, "28.8"),
                (41, 80, "51.3"),
                (0, 0, "0.0"),
                (3, 0, "300.0"),
                (None, 4, "0.0"),
                (2, None, "200.0"),
            ],
        ),
        (2, [(2, 3, "66.67"), (1, 3, "33.33"), (1, 800, "0.13"), (10**9, 3 * 10**9, "33.33")]),
    ],
)
def test_rate(spark, scale, cases):
    df = spark.createDataFrame([case[:2] for case in cases], "n bigint, total bigint")
    found = [row[0] for row in df.select(rate(F.col("n"), F.col("total"), scale)).collect()]
    assert found == [D(case[2]) for case in cases]


def test_mean(spark):
    cases = [
        (185, 3, D("6.2")),
        (125, 2, D("6.3")),
        (-125, 2, D("-6.3")),
        # Just below a tie: rounding to five digits first would give 6.3.
        (62499999, 1000000, D("6.2")),
        (62500000, 1000000, D("6.3")),
        (None, 0, None),
    ]
    df = spark.createDataFrame([case[:2] for case in cases], "units bigint, c bigint")
    found = [row[0] for row in df.select(mean(F.col("units"), F.col("c"), 1)).collect()]
    assert found == [case[2] for case in cases]
    fine = spark.createDataFrame([(6249999, 1), (6250000, 1)], "units bigint, c bigint")
    found = [row[0] for row in fine.select(mean(F.col("units"), F.col("c"), 6)).collect()]
    assert found == [D("6.2"), D("6.3")]


def test_subjects(spark):
    names = ["x LP y", "LP MT", "Minissim", "minisim", "lp", "MT", None, "minisim Minissim"]

    def labels(rules):
        df = texts(spark, names)
        return [row[0] for row in df.select(label_by_pattern(F.col("name"), rules)).collect()]

    assert labels(fixed.SUBJECTS_WITH_MINI_EXAMS) == [LP, LP, MT, LP, None, MT, None, MT]
    assert labels(fixed.SUBJECTS_WITH_MINI_EXAMS_LISTING) == [LP, LP, MT, LP, None, MT, None, LP]
    assert labels(fixed.SUBJECTS) == [LP, LP, None, None, None, MT, None, None]


def test_courses(spark):
    df = texts(spark, ["a LP C1", "MT C2 b", "LP", None])
    label = label_by_pattern(F.col("name"), fixed.COURSES, fixed.OTHER_COURSE)
    assert [row[0] for row in df.select(label).collect()] == [
        "Língua Portuguesa - Curso 1",
        "Matemática - Curso 2",
        "Outro Curso",
        "Outro Curso",
    ]


def test_general_exams(spark):
    df = texts(spark, ["Sim Geral 1", "Geral", "geral", None])
    kept = df.filter(like_any(F.col("name"), fixed.GENERAL_EXAMS))
    assert [row.name for row in kept.collect()] == ["Sim Geral 1", "Geral"]


def test_exclusions(spark):
    df = texts(spark, ["TESTE", "Wiquadro", "WIQUADRO", "Escola Demonstração", "Outra", None])
    exact = df.filter(not_named(F.col("name"), fixed.EXCLUDED_SCHOOL))
    assert [r.name for r in exact.collect()] == ["TESTE", "WIQUADRO", "Escola Demonstração", "Outra"]
    listed = df.filter(not_named_any(F.col("name"), fixed.EXCLUDED_SCHOOLS))
    assert [r.name for r in listed.collect()] == ["Outra"]
