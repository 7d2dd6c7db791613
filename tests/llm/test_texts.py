"""Words, statistics and the two quality models and the toxicity detector."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boletim.llm import boosted_rules, compression_toxicity, factorisation
from boletim.llm.statistics import FEATURES, statistics
from boletim.llm.words import split_words, window_hashes

TEXTS = st.text(alphabet=st.sampled_from("ab#é \t\n\x1c|Z"), max_size=60)
ODD = ["", " \n", "a\n\n a\na\n a\n", "é  x y", "a b c d e f g h a b c d e f g h a b", "x" * 5000 + " y", "#|#\n#|#"]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return [len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_counts_equal_a_plain_count(texts):
    texts = texts + ODD
    base, features = statistics([t.encode() for t in texts])
    assert base.tolist() == [counts(t) for t in texts]
    assert features.shape == (len(texts), len(FEATURES)) and np.isfinite(features).all()


def test_no_texts():
    base, features = statistics([])
    assert base.shape == (0, 5) and len(features) == 0


def test_counts_of_given_documents(small):
    texts = [t for (t,) in small("SELECT text FROM documents")]
    base, _ = statistics([t.encode() for t in texts])
    assert base.tolist() == [counts(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_windows_are_equal_where_words_are(texts):
    w = split_words([t.encode() for t in texts])
    found, first = window_hashes(w, w.hashes(), 2)
    plain = [tuple(x) for t in texts for words in [re.findall(r"[^\x20\x09-\x0d]+", t)] for x in zip(words, words[1:], strict=False)]
    assert len(found) == len(plain)
    assert [[a == b for b in found.tolist()] for a in found.tolist()] == [[a == b for b in plain] for a in plain]


def test_trees_follow_directions():
    random = np.random.default_rng(1)
    x = random.random((800, 3))
    y = ((x[:, 0] < 0.5) ^ (random.random(800) < 0.2)).astype(float)
    trees = boosted_rules.fit(x, y, np.array([-1, 1, 0]), trees=20)
    for f, sign in ((0, -1), (1, 1)):
        rows = np.repeat(random.random((30, 3)), 50, axis=0)
        rows[:, f] = np.tile(np.linspace(0, 1, 50), 30)
        steps = np.diff(trees.margins(rows).reshape(30, 50), axis=1)
        assert (steps * sign >= -1e-12).all()
    assert ((trees.scores(x) >= 0.5) == y).mean() > 0.75


def test_flat_trees_equal_a_walk():
    random = np.random.default_rng(2)
    x, y = random.random((300, 4)), random.integers(0, 2, 300).astype(float)
    trees = boosted_rules.fit(x, y, np.zeros(4, int), trees=5)

    def walked(row):
        total = trees.start
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return total

    assert np.allclose(trees.margins(x), [walked(r) for r in x])


@pytest.mark.parametrize("y", [np.zeros(0), np.ones(5), np.zeros(5)])
def test_one_kind_of_label(y):
    trees = boosted_rules.fit(np.random.default_rng(0).random((len(y), 2)), y, np.zeros(2, int))
    assert np.isfinite(trees.scores(np.zeros((3, 2)))).all()
    texts = [b"a b"] * len(y)
    machine = factorisation.fit(factorisation.encode(texts) if texts else factorisation.Sparse(np.zeros(1, int), np.zeros(0, np.int32), np.zeros(0, np.float32)), y)
    assert np.isfinite(machine.scores(factorisation.encode([b"", b"x y"]))).all()
    detector = compression_toxicity.fit(texts, y.astype(int))
    assert np.isfinite(detector.scores(detector.distances(detector.prepare(), [b"", b"x"]))).all()


def test_pairs_in_linear_time_equal_all_pairs():
    random = np.random.default_rng(3)
    machine = factorisation.Machine(
        0.3, random.normal(size=factorisation.COLUMNS).astype("f4"),
        random.normal(0, 0.1, (factorisation.COLUMNS, factorisation.FACTORS)).astype("f4"),
    )
    x = factorisation.encode([b"", b"one two two", b"Three ### four\nfive"])
    plain = []
    for a, b in zip(x.first, x.first[1:], strict=False):
        c, v = x.column[a:b], x.value[a:b].astype(float)
        total = machine.bias + (machine.linear[c] * v).sum()
        for i in range(len(c)):
            for j in range(i):
                total += machine.factors[c[i]] @ machine.factors[c[j]] * v[i] * v[j]
        plain.append(total)
    assert np.allclose(machine.margins(x), plain, atol=1e-4)


def test_frames_with_nulls_and_extra_columns(shipped):
    spark = shipped
    docs = spark.createDataFrame(
        [(1, None, "x", 5.0), (2, "", "y", None), (None, "a b c", None, 1.0), (2, "", "y", None), (3, "w " * 30_000, "z", 0.0)],
        "doc_id long, text string, kept string, score double",
    )
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    trees = boosted_rules.fit_rules(docs, labels)
    rows = boosted_rules.judge(docs, trees).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.base_failed) for r in rows) == [
        (-1, 3, True), (1, 0, True), (2, 0, True), (2, 0, True), (3, 30_000, True),
    ]
    for module, fit in ((factorisation, factorisation.fit_quality), (compression_toxicity, compression_toxicity.fit_toxicity)):
        model = fit(docs, labels)
        scored = module.score(docs, model).collect()
        assert len(scored) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
        kept = module.filter_documents(docs, model)
        assert kept.columns == docs.columns
        wanted = {1} if module is factorisation else {0}
        assert kept.count() == sum(r.predicted in wanted for r in scored)
        none = docs.limit(0)
        assert module.score(none, model).count() == module.filter_documents(none, model).count() == 0
        assert module.score(none, fit(none, labels.limit(0))).count() == 0
    assert boosted_rules.judge(docs.limit(0), trees).count() == 0


def test_labels_of_held_out_ids_are_not_learnt(shipped):
    from boletim.llm.common import learning_rows

    docs = shipped.range(200).selectExpr("id AS doc_id", "'t' AS text")
    labels = shipped.range(200).selectExpr("id AS doc_id", "1 AS quality")
    seen = {r.doc_id for r in learning_rows(docs, labels, "quality", ~factorisation.held_out(), 500).collect()}
    assert seen == {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(learning_rows(docs, labels, "quality", ~factorisation.held_out(), 20).collect()) == 20


@pytest.fixture(scope="module")
def labelled(small):
    rows = small("SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id) ORDER BY md5(doc_id::VARCHAR)", "/root/testdata/sf0.1")
    return [r[0] for r in rows], [r[1].encode() for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows])


def held(ids, modulus, remainder):
    return np.array([zlib.crc32(str(i).encode()) % modulus == remainder for i in ids])


def test_quality_on_held_out_rows(labelled):
    ids, texts, quality, _ = labelled
    out = held(ids, 3, 1)
    pick = lambda m: [t for t, k in zip(texts, m, strict=True) if k]
    machine = factorisation.fit(factorisation.encode(pick(~out)), quality[~out].astype(float))
    assert ((machine.scores(factorisation.encode(pick(out))) >= 0.5) == quality[out]).mean() > 0.98
    x = statistics(texts)[1]
    trees = boosted_rules.fit(x[~out], quality[~out].astype(float), boosted_rules._directions())
    verdict = trees.scores(x[out]) >= 0.5
    assert (verdict == quality[out]).mean() > 0.98 and verdict[quality[out] == 1].mean() > 0.99


def test_toxicity_on_held_out_rows(labelled):
    ids, texts, _, toxic = labelled
    out = held(ids, 5, 0)
    pick = lambda m: [t for t, k in zip(texts, m, strict=True) if k]
    learn, marks = pick(~out), toxic[~out]
    detector = compression_toxicity.fit(learn, marks)
    said = detector.scores(detector.distances(detector.prepare(), pick(out))) >= 0.5
    assert (said == toxic[out]).mean() > 0.97
    assert said[toxic[out] == 1].mean() > 0.85 and said[toxic[out] == 0].mean() < 0.01
    # Both dictionaries come from the library's trainer, which marks what it makes.
    assert detector.ordinary[:4] == detector.toxic[:4] == (0xEC30A437).to_bytes(4, "little")


def test_order_of_learning_rows_does_not_matter(labelled):
    _, texts, _, toxic = labelled
    texts, toxic = texts[:900], toxic[:900]
    one = compression_toxicity.fit(texts, toxic)
    for seed in (1, 2, 3):
        order = np.random.default_rng(seed).permutation(len(texts))
        other = compression_toxicity.fit([texts[i] for i in order], toxic[order])
        assert (one.ordinary, one.toxic, one.threshold, one.base) == (other.ordinary, other.toxic, other.threshold, other.base)
        assert (one.weights == other.weights).all()


def test_trained_in_tasks_equals_trained_here(shipped, small):
    documents, labels = (shipped.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = small("SELECT DISTINCT doc_id, text, toxic FROM documents JOIN labels USING (doc_id)")
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    here = compression_toxicity.fit([r[1].encode() for r in rows], np.array([r[2] for r in rows]))
    there = compression_toxicity.fit_toxicity(documents, labels)
    assert (here.ordinary, here.toxic, here.threshold, here.base) == (there.ordinary, there.toxic, there.threshold, there.base)


def test_learning_rows_are_bounded(shipped, monkeypatch):
    monkeypatch.setattr(compression_toxicity, "FIT_BYTES", 5_000)
    monkeypatch.setattr(compression_toxicity, "FIT_TEXT", 1_000)
    docs = shipped.range(40).selectExpr("id AS doc_id", "repeat('w ', 100 + int(id % 2) * 1000) AS text")
    docs = docs.union(shipped.range(3000).selectExpr("2L AS doc_id", "concat('v', id) AS text"))  # a hot id
    labels = shipped.range(40).selectExpr("id AS doc_id", "int(id % 4 = 0) AS toxic")
    rows = compression_toxicity._learnt(docs, labels, 100).collect()
    assert 15 < len(rows) <= 25 and sum(len(r.text) for r in rows) <= 5_000 and max(len(r.text) for r in rows) <= 200
    model = compression_toxicity.fit_toxicity(docs, labels)
    assert compression_toxicity.score(docs, model).count() == 3040


def test_plain_distances(labelled):
    """Each distance from lengths of windows, one by one."""
    _, texts, _, toxic = labelled
    detector = compression_toxicity.fit(texts[:900], toxic[:900])
    plain, bad, context = detector.prepare()
    got = detector.distances((plain, bad, context), texts[900:960])
    for text, found in zip(texts[900:960], got, strict=True):
        words = [w[i : i + 48] for w in text.lower().split() for i in range(0, len(w), 48)]
        wanted = []
        for k in range(0, len(words), 8):
            window = b" " + b" ".join(words[k : k + 8]) + b" " + context
            if len(plain.compress(window)) - len(bad.compress(window)) >= 2:
                for w in words[k : k + 8]:
                    around = [context + b" " + x + b" " + context for x in (w, b"")]
                    around[1] = context + b" " + context
                    need = len(bad.compress(around[0])) - len(bad.compress(around[1]))
                    wanted.append(len(plain.compress(around[0])) - len(bad.compress(around[0])) - need)
        assert found.tolist() == wanted


def test_windows_hold_every_word():
    text = b"One\ttwo " + b"x" * 200 + b" " + b"w " * 40
    assert b"".join(b"".join(w.split()) for w in compression_toxicity.windows(text)) == b"".join(text.lower().split())
