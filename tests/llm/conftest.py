import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def shipped(spark):
    from boletim.llm.common import ship

    return ship(spark)


@pytest.fixture(scope="session")
def small():
    """Rows of a table of the smallest data set."""

    def rows(sql: str, folder: str = SMALL):
        con = duckdb.connect()
        for name in ("documents", "pages", "labels", "embeddings"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        return con.execute(sql).fetchall()

    return rows
