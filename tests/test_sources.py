"""Sources: schema checks, Parquet, JDBC options."""

from __future__ import annotations

import pytest

from boletim.schema import FACTS, GROWING, SCHEMAS, conform
from boletim.sources import jdbc_options, read_jdbc, read_parquet, school_tables
from boletim.sources.jdbc import Split
from tests.conftest import DATA
from tests.school import tables

CONNECTION = {"url": "jdbc:postgresql://db.invalid/school", "user": "reader"}


def test_derived_tables_have_the_schemas(spark):
    ready = school_tables(spark, f"{DATA}/sf0.001")
    assert set(ready) == set(SCHEMAS)
    for name, schema in SCHEMAS.items():
        found = [(f.name, f.dataType.typeName()) for f in ready[name].schema.fields]
        assert found == [(f.name, f.dataType.typeName()) for f in schema.fields]


def test_parquet_tables(spark, tmp_path):
    for name, df in tables(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
    ready = read_parquet(spark, str(tmp_path))
    assert ready["users"].count() == 4
    with pytest.raises(KeyError):
        ready["educators"]


def test_missing_and_wrong_columns_are_named(spark):
    df = spark.createDataFrame([("x",)], "id string")
    with pytest.raises(ValueError, match="id is string, not bigint; name is missing"):
        conform("holdings", df)


def test_compatible_types_are_cast(spark):
    df = spark.createDataFrame([(1, 2, 6.25)], "user_id int, quiz_id int, average double")
    found = conform("quiz_grades", df)
    assert found.dtypes == [("user_id", "bigint"), ("quiz_id", "bigint"), ("average", "decimal(38,18)")]
    whole = spark.createDataFrame([(1, 2, 6)], "user_id int, quiz_id int, average int")
    assert conform("quiz_grades", whole).dtypes[2] == ("average", "decimal(21,1)")
    own = whole.selectExpr("user_id", "quiz_id", "CAST(6.25 AS DECIMAL(38, 18)) AS average")
    assert conform("quiz_grades", own).dtypes[2] == ("average", "decimal(38,18)")


def test_jdbc_options():
    assert jdbc_options(CONNECTION, "users", Split("id", 1, 1000, 8), schema="public") == {
        "url": CONNECTION["url"],
        "user": "reader",
        "dbtable": "public.users",
        "fetchsize": "10000",
        "partitionColumn": "id",
        "lowerBound": "1",
        "upperBound": "1000",
        "numPartitions": "8",
    }
    assert "partitionColumn" not in jdbc_options(CONNECTION, "cities")
    with pytest.raises(ValueError, match="url"):
        jdbc_options({}, "users")


def test_tables_that_grow_are_never_read_by_one_task(spark):
    assert set(FACTS) < set(GROWING)
    with pytest.raises(ValueError, match=", ".join(GROWING)):
        read_jdbc(spark, CONNECTION)
    facts = {name: Split("user_id", 1, 1000, 8) for name in FACTS}
    with pytest.raises(ValueError, match="users, quizzes"):
        read_jdbc(spark, CONNECTION, facts)
