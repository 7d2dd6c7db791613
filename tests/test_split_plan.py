"""Equal parts of a table from counts, with the database replaced by a function."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from boletim.schema import GROWING
from boletim.sources.jdbc import plan_predicates, planned


class Counted:
    """Runs the planner's queries on keys held here, and counts them."""

    def __init__(self, keys, name="attempts"):
        self.con = duckdb.connect()
        self.con.execute(f"CREATE TABLE {name} (user_id BIGINT, id BIGINT, quiz_id BIGINT)")
        self.con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", [(k, k, k) for k in keys] or [(None, None, None)])
        if not keys:
            self.con.execute(f"DELETE FROM {name}")
        self.texts = []

    def __call__(self, text):
        self.texts.append(text)
        return self.con.execute(text).fetchall()

    def sizes(self, predicates, name="attempts"):
        return [self.con.execute(f"SELECT count(*) FROM {name} WHERE {p}").fetchone()[0] for p in predicates]

    def met(self, predicates, name="attempts"):
        terms = " + ".join(f"coalesce(CAST({p} AS INT), 0)" for p in predicates)
        return {n for (n,) in self.con.execute(f"SELECT DISTINCT {terms} FROM {name}").fetchall()}


RANDOM = random.Random(4)
KEYS = {
    "even": list(range(1000)),
    "gaps": [k * k * k for k in range(-20, 500)],
    "clumped": [int(RANDOM.lognormvariate(10, 4)) for _ in range(1500)],
    "missing": [None] * 50 + list(range(100)),
    "one key": [7] * 100,
    "wide": [-(1 << 60), 0, 1 << 60] * 5,
}


@pytest.mark.parametrize("name", sorted(KEYS))
@pytest.mark.parametrize("parts", [1, 4, 13])
def test_every_row_is_in_one_part(name, parts):
    query = Counted(KEYS[name])
    predicates = plan_predicates(query, "attempts", "user_id", parts)
    assert query.met(predicates) == {1}
    keyed = [k for k in KEYS[name] if k is not None]
    most = -(-len(keyed) // parts)
    hot = max(keyed.count(k) for k in set(keyed))
    sizes = query.sizes([p for p in predicates if p != "user_id IS NULL"])
    # No part is larger than it should be, but for one key's own rows.
    assert max(sizes) <= max(most, hot)
    assert len(sizes) <= 2 * parts + 1


def test_a_hot_key_is_a_part_of_its_own():
    keys = [500] * 400 + list(range(1000))
    query = Counted(keys)
    predicates = plan_predicates(query, "attempts", "user_id", 10)
    assert max(query.sizes(predicates)) == 401 and query.met(predicates) == {1}


def test_only_counts_come_back():
    query = Counted(KEYS["clumped"])
    plan_predicates(query, "attempts", "user_id", 8)
    assert all(re.match(r"SELECT (min\(|\(user_id - mod)", text) and "count(*)" in text for text in query.texts)
    assert len(query.texts) < 60


def test_empty_tables_and_wrong_parts():
    assert plan_predicates(Counted([]), "attempts", "user_id", 4) == ["user_id IS NOT NULL"]
    query = Counted([None, None])
    assert plan_predicates(query, "attempts", "user_id", 4) == ["user_id IS NULL"]
    with pytest.raises(ValueError):
        plan_predicates(query, "attempts", "user_id", 0)


def test_all_growing_tables_are_planned():
    def query(text):
        assert re.search(r"FROM db\.\w+", text)
        return [(1, 100, 100, 100)] if text.startswith("SELECT min") else [(1 + 2 * n, 2) for n in range(50)]

    found = planned(query, 4, "db")
    assert set(found) == set(GROWING) and all(3 <= len(p) <= 9 for p in found.values())
