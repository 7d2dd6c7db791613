"""Near-duplicate documents and vectors against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest

from boletim.llm import common, nn_descent, setsketch
from boletim.llm import components as components_module
from boletim.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def members(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))


def smallest(nodes, links):
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def wanted(rows):
    sets = {i: members(t) for i, t in rows if i is not None}
    links = [
        (a, b)
        for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    return sets, smallest(sets, links)


def family(random, size, edits, length=120):
    """Near copies of one text, each with some words changed; others are unlike it."""
    base = ["w%d" % n for n in random.integers(0, 10**6, length)]
    out = []
    for _ in range(size):
        copy = list(base)
        for at in random.integers(0, length, random.integers(0, edits + 1)):
            copy[at] = "e%d" % random.integers(0, 10**6)
        out.append(" ".join(copy))
    return out


def test_members_equal_a_plain_set():
    texts = ["", " ", "a", "A b c D", "a b c d", "a b c d e", "a b c d e a b c d e", "é É x\x1cy z w", "x " * 50]
    found = setsketch.sets([t.encode() for t in texts])
    assert [len(f) for f in found] == [len(members(t)) for t in texts]
    for (i, a), (j, b) in combinations(enumerate(texts), 2):
        shared = len(np.intersect1d(found[i], found[j]))
        assert shared == len(members(a) & members(b))


def test_registers_can_be_merged_and_estimate_the_overlap():
    random = np.random.default_rng(4)
    a, b = (random.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(2))
    assert (np.maximum(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(np.union1d(a, b))).all()
    errors = []
    for _ in range(40):
        x = np.unique(random.integers(0, 2**63, 1000).astype(np.uint64))
        y = np.concatenate([x[:900], random.integers(0, 2**63, 60).astype(np.uint64)])
        p, q = setsketch.registers(x), setsketch.registers(y)
        equal, greater = int((p == q).sum()), int((p > q).sum())
        got = setsketch.likeliest(np.array([greater]), np.array([equal]), np.array([len(p) - equal - greater]), len(x), np.array([len(y)]))
        errors.append(got[0] - 900 / (len(x) + 60))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id long, text string, kept string, component_id long")
    sets, label = wanted(rows)
    found = setsketch.near_duplicates(docs.repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is not None) == sorted(
        (i, len(sets[i]), label[i], label[i] == i) for i, _ in rows if i is not None
    )
    nameless = [r for r in found if r.doc_id is None]
    assert all(r.component_id is None and r.kept for r in nameless)
    one = setsketch.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in one if r.doc_id is not None) == sorted(i for i in label if label[i] == i)
    assert len(one) - len({i for i in label if label[i] == i}) == len(nameless)


def test_groups_of_documents(shipped, monkeypatch):
    random = np.random.default_rng(8)
    texts = family(random, 60, 6) + family(random, 40, 14) + family(random, 5, 2, 40) + family(random, 12, 3, 2000)
    texts += ["", " \n", None, "one two", "One TWO", "a b c d e", "a b c d e f", "z " * 30_000, "z " * 30_000]
    ids = random.permutation(len(texts)).tolist()
    rows = list(zip(ids, texts, strict=True)) + [(ids[0], texts[0]), (None, texts[1]), (None, None)]
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 16)  # several blocks for a bucket
    check(shipped, rows)


def test_a_large_group_is_placed_in_proportion(shipped, monkeypatch):
    """Rows that meet in blocks, for a group of near copies of one size and of three times that."""
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 16)
    placed, inner = [], setsketch._links

    def counted(rows, *others):
        placed.append(rows.count())
        return inner(rows, *others)

    monkeypatch.setattr(setsketch, "_links", counted)
    totals = []
    for size in (120, 360):
        random = np.random.default_rng(size)
        texts = family(random, size, 1, 200) + family(random, 3, 1) + ["u%d a b c d e f" % k for k in range(20)]
        placed.clear()
        check_links(shipped, list(enumerate(texts)))
        totals.append(sum(placed))
    assert totals[1] < 4 * totals[0], totals


def check_links(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, label = wanted(rows)
    assert {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()} == label


def test_two_large_groups_that_are_near_each_other(shipped, monkeypatch):
    """Two families that share most of their text, below the threshold but for some members."""
    random = np.random.default_rng(12)
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 12)
    base = ["w%d" % n for n in random.integers(0, 10**6, 200)]
    other = base[:186] + ["v%d" % n for n in random.integers(0, 10**6, 14)]
    texts = []
    for start, size in ((base, 50), (other, 30)):
        for _ in range(size):
            copy = list(start)
            for at in random.integers(0, 200, random.integers(0, 6)):
                copy[at] = "e%d" % random.integers(0, 10**6)
            texts.append(" ".join(copy))
    check_links(shipped, list(enumerate(random.permutation(texts).tolist())))


def test_tables_without_links(shipped):
    check(shipped, [])
    check(shipped, [(1, ""), (2, None), (3, "a b c d e f")])


def test_given_documents(shipped, small):
    check(shipped, small("SELECT doc_id, text FROM documents"))


def test_components_of_chains(shipped):
    links = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (7, 7)]
    found = components(shipped.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted([(i, 0) for i in range(51)] + [(n, 90) for n in (90, 95, 100)])


def test_small_tables_take_few_tasks_however_many_parts_a_shuffle_has(shipped, monkeypatch):
    links = shipped.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    parts, inner = [], common.written

    def counted(df, name):
        out = inner(df, name)
        parts.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components_module, "written", counted)
    before = {k: shipped.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        shipped.conf.set("spark.sql.shuffle.partitions", 40 + 2 * shipped.sparkContext.defaultParallelism)
        shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components(links).collect()
    finally:
        for k, v in before.items():
            shipped.conf.set(k, v)
    assert sorted(found) == [(n, 0) for n in range(41)]
    assert max(parts) <= shipped.sparkContext.defaultParallelism


def test_labels_are_shuffled_where_links_are_many(shipped, monkeypatch):
    monkeypatch.setattr(components_module, "SENT_LINKS", 3)
    links = [(i, i + 1) for i in range(30)] + [(100, 140), (140, 120), (7, 7)]
    found = components(shipped.createDataFrame(links, "a long, b long")).collect()
    assert sorted(found) == sorted([(n, 0) for n in range(31)] + [(n, 100) for n in (100, 120, 140)])


def test_links_of_blocks_are_found_once(shipped, monkeypatch):
    plans, inner = [], setsketch.components

    def seen(links):
        plans.append(links._jdf.queryExecution().toString())
        return inner(links)

    monkeypatch.setattr(setsketch, "components", seen)
    words = [f"w{n}" for n in range(60)]
    rows = [(n, " ".join(words[:50] + [f"x{n}"])) for n in range(4)] + [(9, "quite another text of some words")]
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    assert plans and not any("MapInArrow" in plan for plan in plans)


def vectors_wanted(rows):
    usable = {
        k: (np.array(e, float), label)
        for k, (i, e, label) in enumerate(rows)
        if i is not None and label is not None and e and all(c is not None and np.isfinite(c) for c in e) and any(e)
    }
    links = []
    for a, b in combinations(usable, 2):
        (x, p), (y, q) = usable[a], usable[b]
        if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
            links.append((a, b))
    ids = {k: rows[k][0] for k in range(len(rows))}
    count = {k: sum(k in link for link in links) for k in ids}
    label = smallest([i for i in ids.values() if i is not None], [(ids[a], ids[b]) for a, b in links])
    return sorted(((ids[k] is not None, ids[k] or 0), count[k], label.get(ids[k])) for k in ids)


def check_vectors(spark, rows):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, label int, similarity double")
    found = nn_descent.near_duplicates(df.repartition(3)).collect()
    assert sorted(((r.vec_id is not None, r.vec_id or 0), r.n_links, r.component_id) for r in found) == vectors_wanted(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_groups_of_vectors(shipped):
    random = np.random.default_rng(6)
    points = []
    for label, groups in ((0, (1,) * 150 + (40, 7, 3, 2)), (1, (1,) * 60 + (300,)), (2, (5,))):
        for size in groups:
            centre = random.normal(size=24)
            points += [((centre + random.normal(0, 0.16, 24)).astype("f4").tolist(), label) for _ in range(size)]
    points += [points[0], points[160], points[160]]
    points += [([0.0] * 24, 0), ([], 0), (None, 0), ([1.0, None], 0), ([float("nan")] * 24, 0), ([float("inf")] * 24, 1)]
    points += [(points[1][0], None), ([1.0, 0.0], 0), ([2.0, 0.0], 0), ([1e30, 1e-30], 0), ([-1.0, -0.0], 0)]
    ids = random.permutation(len(points)).tolist()
    rows = [(i, e, label) for i, (e, label) in zip(ids, points, strict=True)]
    check_vectors(shipped, rows + [(None, points[0][0], 0)])


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, None, None), (None, None, None)]])
def test_few_vectors(shipped, rows):
    check_vectors(shipped, rows)


def test_given_vectors(shipped, small):
    check_vectors(shipped, small("SELECT vec_id, embedding, label FROM embeddings"))


def test_families_of_families_of_vectors(shipped):
    # Each vector has more and nearer neighbours in its own family than a list has places.
    random = np.random.default_rng(11)
    rows = []
    for label in range(6):
        centre = random.normal(size=64)
        for _ in range(3):
            own = centre + random.normal(0, 0.22, 64)
            rows += [(len(rows) + k, (own + random.normal(0, 0.01, 64)).astype("f4").tolist(), label) for k in range(20)]
    assert sum(links > 19 for _, links, _ in vectors_wanted(rows)) > len(rows) / 2
    check_vectors(shipped, rows)


def test_tables_grow_with_the_planes():
    for planes in range(25):
        shared = (1 - np.arccos(0.93) / np.pi) ** planes
        assert (1 - shared) ** nn_descent.tables_for(planes, 0.93) <= 1e-4
    assert nn_descent.tables_for(0, 0.93) == 1


def test_a_label_whose_links_are_lost_is_compared_in_full(shipped, monkeypatch):
    # The hot group's links hide nothing: the audit counts vectors. A search that never finds the lone pair ends in full blocks.
    random = np.random.default_rng(12)
    centre, lone, other = random.normal(size=(3, 24))
    points = [(centre + random.normal(0, 0.01, 24), 0) for _ in range(100)]
    points += [(lone, 0), (lone + random.normal(0, 0.01, 24), 0), *((other + random.normal(0, 0.01, 24), 1) for _ in range(3))]
    rows = [(i, p.tolist(), label) for i, (p, label) in enumerate(points)]
    start, across, whole, asked = nn_descent._start, nn_descent._across, nn_descent._whole, []
    monkeypatch.setattr(nn_descent, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nn_descent, "_start", lambda *x: start(*x).filter("u NOT IN (100, 101) AND v NOT IN (100, 101)"))
    monkeypatch.setattr(nn_descent, "_across", lambda *x: across(*x).filter("a NOT IN (100, 101) AND b NOT IN (100, 101)"))
    monkeypatch.setattr(nn_descent, "_whole", lambda c, labels, g: (asked.extend(labels.collect()), whole(c, labels, g))[1])
    check_vectors(shipped, rows)
    assert [(r.label, r.size) for r in asked] == [("0", 24)]


def test_the_pipeline_links_from_four_fifths(shipped):
    import corpus_pipeline

    random = np.random.default_rng(13)
    rows = []
    for n in range(0, 60, 2):
        words = ["w%d" % k for k in random.integers(0, 10**6, 100)]
        other = words[:-10] + ["x%d" % k for k in random.integers(0, 10**6, 10)]
        rows += [(n, " ".join(words)), (n + 1, " ".join(other))]  # 86 of 106 runs are shared
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert sorted(r.doc_id for r in stage(shipped, docs, "").collect()) == list(range(0, 60, 2))
    assert setsketch.one_of_each(docs).count() == 60
    assert setsketch.scheme(85) == setsketch.Scheme(85, 22, 5)
