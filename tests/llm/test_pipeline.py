"""The stages one after another, each against its operator's verdicts."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from boletim.llm import compression_toxicity, factorisation, pfair_mix, setsketch
from boletim.llm.common import table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(shipped, tmp_path_factory):
    docs, out = table(shipped, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(shipped, docs, FOLDER).write.parquet(path)
        docs = shipped.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages(shipped, stages):
    docs, labels = table(shipped, FOLDER, "documents"), table(shipped, FOLDER, "labels")
    assert len(corpus_pipeline.STAGES) == 5 and all(s.columns == docs.columns for s in stages[:-1])
    calm, good, single, mix, tokens = stages
    detector = compression_toxicity.fit_toxicity(docs, labels)
    assert ids(calm) == ids(compression_toxicity.score(docs, detector).filter("predicted = 0"))
    machine = factorisation.fit_quality(calm, labels)
    assert ids(good) == ids(factorisation.score(calm, machine).filter("predicted = 1"))
    assert ids(single) == ids(setsketch.near_duplicates(good, corpus_pipeline.NEAR).filter("kept"))
    assert ids(mix) == ids(single) == ids(tokens)
    assert 0 < single.count() < good.count() < calm.count() < docs.count()
    toxic = calm.join(labels, "doc_id").agg({"toxic": "avg"}).first()[0]
    bad = good.join(labels, "doc_id").filter("quality = 0").count()
    assert toxic < 0.08 and bad <= 5


def test_order_of_the_mix(stages):
    place = {r.doc_id: r.position for r in pfair_mix.schedule(stages[2]).collect()}
    order = [place[r.doc_id] for r in stages[3].select("doc_id").collect()]
    assert sorted(order) == list(range(len(order)))
    # Each part of the files goes on where the one before has ended.
    assert sum(b != a + 1 for a, b in zip(order, order[1:], strict=False)) < 8


def test_tokens_of_what_stays(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text_of = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        own = library.encode(text_of[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        text = library.decode(own, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_and_odd_documents(shipped):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _position int, score double"
    rows = [(1, None, None, None, None, 1, 0.0), (1, None, None, None, None, 1, 0.0), (None, "", "x", "s", 0, None, None)]
    for docs in (shipped.createDataFrame(rows, schema), shipped.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            found = stage(shipped, docs, FOLDER)
            assert found.count() <= docs.count()
            if found.columns != ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]:
                assert found.columns == docs.columns
