"""The report tables from a relational database over JDBC.

Connection options come from the caller; nothing is stored here. A table with a
``Split`` is read by many tasks at once. Splitting on row ranges of a key suits
evenly spread keys; where one key may hold much of the table, pass predicates
that cut the table evenly, such as block ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from boletim.schema import GROWING, LazyTables


@dataclass(frozen=True)
class Split:
    """Key range of a table and the number of parallel reads over it."""

    column: str
    lower: int
    upper: int
    parts: int


def jdbc_options(
    connection: Mapping[str, str],
    table: str,
    split: Split | None = None,
    fetch_size: int = 10_000,
    schema: str | None = None,
) -> dict[str, str]:
    """Reader options for one table; only the columns the reports use are asked for."""
    missing = {"url"} - set(connection)
    if missing:
        raise ValueError(f"connection needs {', '.join(sorted(missing))}")
    options = dict(connection)
    options["dbtable"] = f"{schema}.{table}" if schema else table
    options["fetchsize"] = str(fetch_size)
    if split is not None:
        options["partitionColumn"] = split.column
        options["lowerBound"] = str(split.lower)
        options["upperBound"] = str(split.upper)
        options["numPartitions"] = str(split.parts)
    return options


#: Ranges that a planning query counts at a time, and most queries on one range.
PLAN_BINS = 64
PLAN_DEPTH = 16

#: Runs a query in the database and gives back its rows, a tuple each.
Query = Callable[[str], Sequence[tuple]]


def database(spark: SparkSession, connection: Mapping[str, str]) -> Query:
    """Queries that the database behind the connection runs; only their rows come here."""

    def run(text: str) -> list[tuple]:
        reader = spark.read.format("jdbc").options(**connection).option("query", text)
        return [tuple(row) for row in reader.load().collect()]

    return run


def plan_predicates(
    query: Query, table: str, column: str, parts: int, schema: str | None = None
) -> list[str]:
    """Conditions that cut a table by a whole-number key into about ``parts`` ranges of about equal row counts.

    The database counts rows by ``PLAN_BINS`` ranges of the key; a range with more rows than a part should have is
    counted again in finer ranges, down to single keys. Neighbouring ranges are then put together while they fit a part. Every
    row meets exactly one condition; rows without key have one of their own. A key with more rows than a part can't
    be cut by key and is a part of its own.
    """
    if parts < 1:
        raise ValueError("parts is 1 or more")
    name = f"{schema}.{table}" if schema else table
    summary = f"SELECT min({column}), max({column}), count({column}), count(*) FROM {name}"
    low, high, keyed, total = query(summary)[0]
    without = [f"{column} IS NULL"] if total > keyed else []
    if not keyed:
        return without or [f"{column} IS NOT NULL"]
    low, high = int(low), int(high)
    most = -(-int(keyed) // parts)

    def ranges(start: int, end: int, depth: int) -> list[tuple[int, int, int]]:
        """``start <= key < end`` as ranges with their row counts, none with more than ``most`` if it can be cut."""
        width = -(-(end - start) // PLAN_BINS)
        within = f"({column} - mod({column} - ({start}), {width}))"
        bins = query(
            f"SELECT {within}, count(*) FROM {name} WHERE {column} >= {start} AND {column} < {end} GROUP BY {within}"
        )
        found = []
        for first, rows in sorted((int(b), int(n)) for b, n in bins):
            last = min(first + width, end)
            found += ranges(first, last, depth + 1) if rows > most and last - first > 1 and depth < PLAN_DEPTH else [(first, last, rows)]
        return found

    cuts, held = [], 0
    for first, _, rows in ranges(low, high + 1, 1):
        if held and held + rows > most:
            cuts.append(first)
            held = 0
        held += rows
    if not cuts:
        return [f"{column} IS NOT NULL", *without]
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    # The ends are open: rows written after planning are read too.
    return [f"{column} < {cuts[0]}", *between, f"{column} >= {cuts[-1]}", *without]


#: The key by which each table that grows is cut if the caller gives nothing else.
PLAN_KEYS = {
    "quiz_user_progresses": "user_id",
    "quiz_grades": "user_id",
    "institution_enrollments": "user_id",
    "users": "id",
    "quizzes": "id",
    "institution_classrooms": "id",
    "institutions_quizzes": "quiz_id",
    "learning_module_quizzes": "quiz_id",
}


def planned(query: Query, parts: int, schema: str | None = None) -> dict[str, list[str]]:
    """``predicates`` for ``read_jdbc`` on every table that grows, from counts the database gives."""
    return {name: plan_predicates(query, name, PLAN_KEYS[name], parts, schema) for name in GROWING}


def read_jdbc(
    spark: SparkSession,
    connection: Mapping[str, str],
    splits: Mapping[str, Split] | None = None,
    predicates: Mapping[str, Sequence[str]] | None = None,
    schema: str | None = None,
) -> LazyTables:
    """Read the report tables asked for. Each table that grows must have a split or predicates."""
    splits = splits or {}
    predicates = predicates or {}
    whole = [name for name in GROWING if name not in splits and name not in predicates]
    if whole:
        raise ValueError(f"give a split or predicates for {', '.join(whole)}")

    def read(name: str) -> DataFrame:
        if name in predicates:
            options = jdbc_options(connection, name, schema=schema)
            url, table = options.pop("url"), options.pop("dbtable")
            return spark.read.jdbc(url, table, predicates=list(predicates[name]), properties=options)
        options = jdbc_options(connection, name, splits.get(name), schema=schema)
        return spark.read.format("jdbc").options(**options).load()

    return LazyTables(read)
