"""Tables laid out by student, kept state, orders beside a stored one, selections that skip row groups."""

from __future__ import annotations

import os
import random
import re

import pyarrow.parquet as pq
import pytest

from boletim.operators import grid
from boletim.operators.network import network
from boletim.plans import reports
from boletim.plans.kept import KeptProgress
from boletim.schema import LazyTables
from boletim.sources import read_parquet, school_tables
from boletim.sources.layout import lay_out, read_layout
from tests.conftest import DATA
from tests.school import tables
from tests.test_plans import CALLS, WITHOUT_BROADCAST, plan
from tests.test_random import _arrow, _tables


@pytest.fixture(scope="module")
def school(spark):
    return school_tables(spark, f"{DATA}/sf0.01")


@pytest.fixture(scope="module")
def laid(spark, school, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "school")
    lay_out(school, path, 8)
    return read_layout(spark, path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def small_laid(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small") / "school")
    lay_out(tables(spark), path, 4)
    return read_layout(spark, path)


@pytest.mark.parametrize("name", sorted(CALLS))
def test_reports_of_laid_out_tables(spark, small_laid, name):
    assert rows(CALLS[name](small_laid)) == rows(CALLS[name](tables(spark)))


def chains(text, column):
    """The nodes above each scan that reads the column, from the scan up."""
    path, found = [], []
    for line in text.splitlines():
        hit = re.search(r"[A-Za-z*]", line)
        if not hit:
            continue
        path = [(d, x) for d, x in path if d < hit.start()]
        path.append((hit.start(), line[hit.start() :]))
        if "FileScan" in line and column in line:
            found.append([x for _, x in reversed(path)])
    return found


def moved_before(chain, stop):
    """Exchanges of a scan's own rows before the node that the pattern finds."""
    at = next(i for i, x in enumerate(chain) if re.search(stop, x))
    return [x for x in chain[:at] if "Exchange" in x]


@pytest.mark.parametrize("settings", [{}, WITHOUT_BROADCAST])
def test_no_shuffle_of_attempts_or_grades(laid, settings):
    text = plan(reports.class_totals(laid), settings)
    for column in ("finished#", "average#"):
        for chain in chains(text, column):
            # Attempts are matched with grades and summed by student and exam where they lie.
            assert moved_before(chain, r"HashAggregate\(keys=\[user_id#\d+L, quiz_id#\d+L\], functions=\[count") == []
            if not settings:
                assert moved_before(chain, r"Exchange hashpartitioning\(college#") == []
        assert chains(text, column)


def test_no_shuffle_of_attempts_in_progress(laid):
    text = plan(reports.progress_by_exam(laid, [0, 2, 4]))
    found = chains(text, "finished#")
    assert found and all(moved_before(chain, r"Exchange hashpartitioning\(college#") == [] for chain in found)


def test_attempts_of_other_tables_are_shuffled(spark, school, tmp_path):
    """The same plan over plain files does move the attempts: the layout makes the difference."""
    for name in ("quiz_user_progresses", "quiz_grades", "institution_enrollments", "users"):
        school[name].write.parquet(str(tmp_path / name))
    plain = LazyTables(lambda n: spark.read.parquet(str(tmp_path / n)) if os.path.exists(tmp_path / n) else school[n])
    text = plan(reports.class_totals(plain), WITHOUT_BROADCAST)
    assert any("hashpartitioning(user_id#" in x for chain in chains(text, "finished#") for x in chain[:8])


# Kept state


def state_of(spark, t, folder):
    state = KeptProgress(spark, str(folder))
    state.start(t, network(t))
    return state


def with_attempts(t, df):
    return LazyTables(lambda name: df if name == "quiz_user_progresses" else t[name])


def test_state_equals_a_full_run(spark, tmp_path):
    for name, held in _tables(11).items():
        pq.write_table(_arrow(name, held), str(tmp_path / f"{name}.parquet"))
    t = read_parquet(spark, str(tmp_path), ".parquet")
    tried = t["quiz_user_progresses"]
    state, seen = state_of(spark, t, tmp_path / "kept"), tried.limit(0)
    pick = random.Random(3)
    days = tried.randomSplit([0.3, 0.3, 0.4], seed=5)
    for n, day in enumerate([days[0], days[1], days[0], days[2].union(days[2])]):
        state.merge(t, day)
        seen = seen.union(day)
        full = with_attempts(t, spark.createDataFrame(seen.collect(), seen.schema))
        wanted = reports.matched_classes(*_measures(full), ["college", "classroom"])
        assert rows(state.classes()) == rows(wanted), n
        if pick.random() < 0.5:
            state.compact()
            assert rows(state.classes()) == rows(wanted)


def _measures(t):
    """Finished and enrolled as the report counts them, from all attempts."""
    whole = reports._classes_with_exams(t, network(t))
    keys = ["college", "classroom"]
    finished = whole.filter("exam IS NOT NULL OR finished > 0").select(*keys, "exam", "finished")
    return finished, whole.select(*keys, "enrolled").distinct()


def test_an_interrupted_merge_counts_nothing(spark, tmp_path, monkeypatch):
    t = tables(spark)
    state = state_of(spark, t, tmp_path / "kept")
    state.merge(t, t["quiz_user_progresses"].limit(2))
    before = rows(state.classes())
    with monkeypatch.context() as broken:
        broken.setattr(KeptProgress, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.merge(t, t["quiz_user_progresses"])
    assert rows(state.classes()) == before
    state.merge(t, t["quiz_user_progresses"])
    assert rows(state.classes()) == rows(reports._classes_with_exams(t, network(t)))


def test_changed_enrolments(spark, tmp_path):
    t = tables(spark)
    state = state_of(spark, t, tmp_path / "kept")
    state.merge(t, t["quiz_user_progresses"])
    moved = t["institution_enrollments"].filter("user_id <> 1")
    other = LazyTables(lambda name: moved if name == "institution_enrollments" else t[name])
    state.enrol(other, network(other))
    state.merge(other, t["quiz_user_progresses"])
    assert rows(state.classes()) == rows(reports._classes_with_exams(other, network(other)))


def test_a_request_reads_totals_only(spark, tmp_path):
    t = tables(spark)
    state = state_of(spark, t, tmp_path / "kept")
    state.merge(t, t["quiz_user_progresses"])
    read = {path.split("/kept/")[1].split("/")[0] for path in state.classes().inputFiles()}
    assert read == {"totals", "enrolled"}


# A second order


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("column", ["n", "t"])
def test_pages_of_a_second_order(spark, tmp_path, column, descending):
    df = spark.range(500).selectExpr("id % 7 AS n", "if(id % 5 = 0, NULL, concat('v', id % 11)) AS t", "id")
    grid.store(df, str(tmp_path / "rows"))
    index = grid.order_index(spark, str(tmp_path / "rows"), str(tmp_path / "index"), column, descending)
    wanted = [tuple(r) for r in grid.sort(df, [(column, descending)]).collect()]
    for number, size in ((0, 10), (7, 33), (49, 10), (50, 10)):
        page = grid.page_by_index(spark, str(tmp_path / "rows"), index, number, size)
        assert page.columns == df.columns
        assert [tuple(r) for r in page.collect()] == wanted[number * size : (number + 1) * size]


def test_an_index_is_as_large_as_its_places(spark, tmp_path):
    def size(name):
        return sum(os.path.getsize(tmp_path / name / f) for f in os.listdir(tmp_path / name) if f.endswith(".parquet"))

    for name, wide in (("narrow", 1), ("wide", 40)):
        df = spark.range(5000).selectExpr("id", *[f"uuid() AS c{i}" for i in range(wide)], "id % 97 AS k")
        grid.store(df, str(tmp_path / name))
        grid.order_index(spark, str(tmp_path / name), str(tmp_path / f"{name}-index"), "k")
    assert size("wide") > 10 * size("narrow") and size("wide-index") < 1.2 * size("narrow-index")


# Selections


def scanned(df):
    """Rows the scans of the stored report have given out."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    nodes, total = [text], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
            continue
        if "Scan" in node.nodeName() and "_size" not in str(node.output()):
            total = max(total, node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_selections_skip_row_groups(spark, tmp_path):
    names = "concat('n', lpad(xxhash64(id) % 1000000, 9, '0'))"
    df = spark.range(200_000).selectExpr("concat('e', lpad(id div 100, 6, '0')) AS escola", f"{names} AS nome", "uuid() AS text")
    grid.store(df.coalesce(1), str(tmp_path / "rows"), searched=["nome"], group_bytes=256 << 10)
    file = spark.read.parquet(str(tmp_path / "rows"))
    some = file.filter("escola = 'e000777'").first()["nome"]
    for choices, rows_found in (({"escola": ["e000777"]}, 100), ({"nome": [some]}, None), ({"nome": ["n-none"]}, 0)):
        hit = grid.multiselect(file, choices, "exact")
        count = hit.count()
        assert count == rows_found if rows_found is not None else count >= 1
        assert scanned(grid.multiselect(file, choices, "exact")) < 60_000, choices
