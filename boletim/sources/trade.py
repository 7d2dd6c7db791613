"""The report tables derived from a trade data set (region ... lineitem).

Suppliers stand for schools, customers for students, parts for exams, orders for
enrolments and order lines for exam attempts; every row of these becomes one. The
odd divisors make every case the reports must tell apart: excluded names, schools
whose courses belong to another one, enrolments whose school differs from their
classroom's, classes without exams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boletim.schema import LazyTables

# The columns used, with the types of the files; naming them spares a job per
# file to find them.
_FILES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "customer": "c_custkey bigint",
    "part": "p_partkey bigint, p_brand string",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint,"
    " l_quantity double, l_linestatus string",
}

_EXAM_SUFFIXES = (
    " LP C1",
    " MT C1",
    " LP C2",
    " MT C2",
    " Sim Geral LP",
    " Sim Geral MT",
    " Minissim",
    " minisim",
    " Geral",
)


def _two_children(parent: DataFrame, parent_column: str) -> DataFrame:
    """Two rows per parent: ``k`` is 0 or 1 and ids stay unique."""
    return parent.selectExpr(f"id AS {parent_column}", "explode(array(0, 1)) AS k").selectExpr(
        f"{parent_column} * 2 + k AS id", "k", parent_column
    )


class _School:
    """One method per report table, over the files of one folder."""

    def __init__(self, spark: SparkSession, folder: str, grade: str) -> None:
        self._spark = spark
        self._grade = grade
        self._folder = folder.rstrip("/")

    def _file(self, name: str) -> DataFrame:
        return self._spark.read.schema(_FILES[name]).parquet(f"{self._folder}/{name}.parquet")

    def holdings(self) -> DataFrame:
        return self._file("region").selectExpr("r_regionkey AS id", "r_name AS name")

    cities = holdings

    def regions(self) -> DataFrame:
        return self._file("nation").selectExpr("n_nationkey AS id", "n_regionkey AS city_id")

    def institutions(self) -> DataFrame:
        return self._file("nation").selectExpr(
            "n_nationkey AS id",
            "concat(n_name, if(n_nationkey % 2 = 0, ' - 2024', ' - 2023')) AS name",
            "n_regionkey AS holding_id",
        )

    def institution_colleges(self) -> DataFrame:
        return self._file("supplier").selectExpr(
            "s_suppkey AS id",
            """CASE WHEN s_suppkey % 20 = 8 THEN 'Wiquadro'
                    WHEN s_suppkey % 20 = 9 THEN 'TESTE'
                    WHEN s_suppkey % 3 = 0 THEN concat('ESCOLA MUNICIPAL ', s_name)
                    ELSE s_name END AS name""",
            "s_nationkey AS institution_id",
            "int(2023 + s_suppkey % 2) AS year",
            "s_nationkey AS region_id",
        )

    def institution_courses(self) -> DataFrame:
        colleges = self._file("supplier").selectExpr("s_suppkey AS id")
        return _two_children(colleges, "institution_college_id").selectExpr(
            "id",
            "concat('Curso ', k + 1) AS name",
            "institution_college_id - int(institution_college_id % 7 = 3) AS institution_college_id",
        )

    def institution_levels(self) -> DataFrame:
        return _two_children(self.institution_courses(), "course_id").selectExpr(
            "id", "concat(k + 1, 'º ano') AS name", "course_id - int(course_id % 11 = 5) AS course_id"
        )

    def institution_classrooms(self) -> DataFrame:
        return _two_children(self.institution_levels(), "level_id").selectExpr(
            "id", "if(k = 0, 'Turma A', 'Turma B') AS name", "level_id"
        )

    def users(self) -> DataFrame:
        return self._file("customer").selectExpr("c_custkey AS id")

    def institution_enrollments(self) -> DataFrame:
        supplier, nation = self._file("supplier"), self._file("nation")
        customer, order = F.col("o_custkey"), F.col("o_orderkey")
        schools = supplier.agg(F.count(F.lit(1))).scalar()
        placed = (
            self._file("orders")
            .select(
                customer.alias("user_id"),
                ((customer % schools) * 8 + order % 8).alias("classroom_id"),
                ((customer + F.expr("if(o_orderkey % 13 = 0, 1, 0)")) % schools).alias("college_id"),
            )
        )
        colleges = supplier.selectExpr("s_suppkey AS college_id", "s_nationkey AS institution_id")
        institutions = nation.selectExpr(
            "n_nationkey AS institution_id", "n_regionkey AS holding_id"
        )
        return placed.join(colleges, "college_id").join(institutions, "institution_id")

    def quizzes(self) -> DataFrame:
        suffixes = ", ".join(f"'{suffix}'" for suffix in _EXAM_SUFFIXES)
        number = f"int(p_partkey % {len(_EXAM_SUFFIXES)})"
        return self._file("part").selectExpr(
            "p_partkey AS id", f"concat(p_brand, get(array({suffixes}), {number})) AS name"
        )

    def _lines(self) -> DataFrame:
        orders = self._file("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS user_id")
        return self._file("lineitem").join(orders, "l_orderkey")

    def quiz_user_progresses(self) -> DataFrame:
        return (
            self._lines().selectExpr(
                "user_id",
                "l_partkey AS quiz_id",
                "l_linestatus = 'F' AND user_id % 10 <> 4 AS finished",
            )
        )

    def quiz_grades(self) -> DataFrame:
        return (
            self._lines()
            .groupBy("user_id", "l_partkey")
            .agg(F.max("l_quantity").alias("best"))
            .selectExpr("user_id", "l_partkey AS quiz_id", f"{self._grade} AS average")
        )

    def institutions_quizzes(self) -> DataFrame:
        supplier = self._file("supplier").selectExpr(
            "s_suppkey AS l_suppkey", "s_nationkey AS institution_id"
        )
        return (
            self._file("lineitem")
            .join(supplier, "l_suppkey")
            .selectExpr("institution_id", "l_partkey AS quiz_id")
            .distinct()
        )

    def institutions_learning_modules(self) -> DataFrame:
        return self._file("nation").selectExpr(
            "n_nationkey AS institution_id", "n_nationkey % 7 AS learning_module_id"
        )

    def learning_module_quizzes(self) -> DataFrame:
        return (
            self._file("part").selectExpr(
                "p_partkey % 35 AS learning_module_id", "p_partkey AS quiz_id"
            )
        )


def school_tables(
    spark: SparkSession, sf_dir: str, grade: str = "CAST(best AS DECIMAL(5, 1))"
) -> LazyTables:
    """The sixteen report tables over the Parquet files in ``sf_dir``.

    ``grade`` is the grade as an expression on ``best``, the largest quantity of a student and part.
    """
    school = _School(spark, sf_dir, grade)

    def build(name: str) -> DataFrame:
        make: Callable[[], DataFrame] = getattr(school, name)
        return make()

    return LazyTables(build)
