"""Token ids, chunks and token files against the tokenizers library."""

import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from boletim.llm import chunk_reuse, ranked_varint
from boletim.llm.chunk_reuse import ChunkEncoder, LibraryUnits, WordUnits
from boletim.llm.word_tokens import WordTokens, words_are_independent

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = WordTokens(PATH)
TEXTS = st.text(alphabet=st.sampled_from("aBc ,'stéÉß<|>\n\t\x1c ́İ1½—日"), max_size=200)
ODD = [
    "", "  ", "a\x1cb", "don't I'LL 'sab \"'s", "<|endoftext|>a<|startoftext|>b <| c", "ﬁ ½ ² ª º K ſ", "x" * 3000 + " y",
    "日本語 テキスト", "a\u0085b", "é É", "word " * 2000, "abcabcabc" * 500,
]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_word_ids_equal_the_library(texts):
    assert [np.frombuffer(x, "<u2").tolist() for x in WORDS.encode([t.encode() for t in texts])] == [library_ids(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(TEXTS, min_size=1, max_size=6), min_size=1, max_size=3))
def test_chunks_equal_the_library(parts):
    texts = [" ".join(p) for p in parts] + ["".join(p) * 4 for p in parts]
    encoder = ChunkEncoder(WordUnits(WORDS), table_bytes=500)
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [library_ids(t) for t in texts]


def test_odd_texts():
    wanted = [library_ids(t) for t in ODD]
    small = WordTokens(PATH, words=3, pieces=2)
    for words in (WORDS, small):
        assert [np.frombuffer(x, "<u2").tolist() for x in words.encode([t.encode() for t in ODD])] == wanted
        assert [x.tolist() for x in ChunkEncoder(WordUnits(words)).encode([t.encode() for t in ODD])] == wanted
    for ids in wanted:
        assert WordUnits(WORDS).decode(np.array(ids, int)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_known_words_are_looked_up_together():
    random = np.random.default_rng(8)
    texts = [" ".join("w%d" % n for n in random.integers(0, 20_000, 20_000)).encode() for _ in range(8)]
    words = WordTokens(PATH)
    took = {}
    for run in (words.encode, words.each):
        run(texts)
        times = []
        for _ in range(3):
            began = time.thread_time()
            found = run(texts)
            times.append(time.thread_time() - began)
        took[run.__name__] = min(times)
    assert [b"".join(x) for x in found] == words.encode(texts)
    assert took["encode"] < 0.8 * took["each"]


def test_words_that_differ_in_length_or_nulls_only():
    letters = "abcdefghijklmnop"
    words = [letters[:n] + end for n in range(17) for end in ("", "\0", "\0\0", "q")]
    texts = [" ".join(words), *words, "", " ".join(reversed(words)), "x" + "\0" * 14, "x" + "\0" * 15]
    for own in (WordTokens(PATH), WordTokens(PATH, words=5, pieces=3)):
        for _ in range(2):
            assert [np.frombuffer(x, "<u2").tolist() for x in own.encode([t.encode() for t in texts])] == [library_ids(t) for t in texts]


def test_more_words_than_the_table_holds_at_first():
    texts = [" ".join("v%d" % n for n in range(a, a + 9000)) for a in (0, 4000, 30_000, 0)]
    for own in (WordTokens(PATH), WordTokens(PATH, words=10_000, pieces=500)):
        for text in texts:
            assert np.frombuffer(own.encode([text.encode()])[0], "<u2").tolist() == library_ids(text)


def test_shared_passages_are_cut_alike_and_encoded_once():
    random = np.random.default_rng(5)
    passage = " ".join("w%d" % n for n in random.integers(0, 10**6, 3000)).encode()
    texts = [b"one two " + passage + b" end", b"quite another beginning " * 40 + passage]
    assert all(b"".join(t[a:b] for a, b in zip([0, *chunk_reuse.cuts(t)], chunk_reuse.cuts(t), strict=False)) == t for t in texts)
    encoder = ChunkEncoder(WordUnits(WORDS))
    encoder.encode(texts)
    assert encoder.reused > 0.8 * len(chunk_reuse.cuts(passage))


def spaced():
    """A tokenizer without pieces: its tokens reach over white space, and its merges overlap each other."""
    merges = [("a", "b"), (" ", "a"), ("b", " "), ("ab", " "), (" a", "b"), ("c", " a"), ("ab ", "ab "), ("c", "c"), ("cc", "cc"), ("b", "b")]
    tokens = ["?", *"abcdé日 \n", *("".join(m) for m in merges)]
    known = models.BPE({t: i for i, t in enumerate(dict.fromkeys(tokens))}, merges, unk_token="?")
    own = Tokenizer(known)
    own.add_special_tokens(["<|stop|>", "<|a longer mark with spaces|>"])
    return own


BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SPACED = spaced()


@pytest.fixture(params=["bytes", "words", "spaced"])
def engine(request, monkeypatch):
    monkeypatch.setattr(chunk_reuse, "CUT_BITS", 3)
    monkeypatch.setattr(chunk_reuse, "LEAST", 24)
    return LibraryUnits({"bytes": BYTES, "words": Tokenizer.from_file(PATH), "spaced": SPACED}[request.param])


def agree(engine, texts):
    encoder = ChunkEncoder(engine)
    found = [x.tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert found == [engine._library.encode(t, add_special_tokens=False).ids for t in texts]
    return encoder


PARTS = st.sampled_from(["ab", " ab", "ab ", "c a", " ", "cc", "b", "é", "é", "日本", "\n\n", "  ", "12", "'st", "don't", "<|stop|>", "<|endoftext|>",
                         "<|a longer mark with spaces|>", "word", "The", "unbelievably", "x" * 40, ". ", "\r\n"])


@settings(max_examples=120, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PARTS, max_size=120), min_size=1, max_size=3))
def test_repaired_joins_equal_the_library(engine, parts):
    agree(engine, ["".join(p) for p in parts] + [" ".join(p) for p in parts])


def test_stretches_grow_until_they_agree(engine):
    random = np.random.default_rng(8)
    texts = ["".join(random.choice(list("abc  d"), 4000)), "ab " * 1500, "c" * 5000, "<|stop|>" * 400, "", "é日 " * 700]
    encoder = agree(engine, texts)
    assert encoder.encoded > 30 and encoder.merged > 0
    again = encoder.encoded
    encoder.encode([t.encode() for t in texts])
    assert encoder.encoded == again


def test_ids_of_chunks_alone_would_be_wrong(engine):
    text = "".join(np.random.default_rng(9).choice(["ab ", "c ab", "word ", "unbelievably "], 800))
    ends = chunk_reuse.cuts(text.encode())
    alone = engine.units([text.encode()[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    assert len(ends) > 40
    assert b"".join(u.ids for u in alone) != engine.units([text.encode()])[0].ids
    encoder = agree(engine, [text])
    assert encoder.merged < len(ends) / 4


def test_a_long_text_without_agreement_is_not_taken_again_and_again(monkeypatch):
    monkeypatch.setattr(chunk_reuse, "CUT_BITS", 3)
    encoder = ChunkEncoder(WordUnits(WordTokens(PATH)))
    text = "".join(np.random.default_rng(2).choice(list("abcdefgh"), 200_000))
    asked = []
    plain = encoder.engine.units
    monkeypatch.setattr(encoder.engine, "units", lambda texts: (asked.extend(map(len, texts)), plain(texts))[1])
    assert encoder.encode([text.encode()])[0].tolist() == library_ids(text)
    assert sum(asked) < 6 * len(text)


def test_which_files_have_independent_words():
    assert words_are_independent(PATH) and not words_are_independent(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40), max_size=6))
def test_coding_round_trip(rows):
    sizes = np.array([len(r) for r in rows], np.int64)
    values = np.array([v for r in rows for v in r], np.uint32)
    control, data = ranked_varint.pack_all(values, sizes)
    assert ranked_varint.unpack_all(control, data, sizes).tolist() == values.tolist()
    for row, c, d in zip(rows, control, data, strict=True):
        assert (c, d) == ranked_varint.pack(np.array(row, np.uint32))
        assert ranked_varint.unpack(c, d, len(row)).tolist() == row
        assert len(c) == -(-len(row) // 4) and len(d) == sum(max(1, (v.bit_length() + 7) // 8) for v in row)


def test_files_in_order_of_ids(shipped, tmp_path):
    rows = [(5, "b c"), (None, "z"), (3, None), (5, "b c"), (-2, "x " * 500), (9, ""), (4, "a, b! the the the")]
    docs = shipped.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, start string").repartition(3)
    ranked_varint.write_tokens(docs, f"{tmp_path}/out")
    found = ranked_varint.read_tokens(shipped, f"{tmp_path}/out").orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, -2, 3, 4, 5, 5, 9]
    text_of, at = dict(rows), 0
    for r in found:
        ids = np.array([*library_ids(text_of[r.doc_id] or ""), 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    ranks = dict((r.rank, r.id) for r in shipped.read.parquet(f"{tmp_path}/out/ranks").collect())
    assert ranks[0] == library_ids("x")[0] and len(ranks) == len(WORDS.tokens)
    assert ranked_varint.round_trip(docs.limit(0)).count() == 0


def test_encoded_documents(shipped):
    docs = shipped.createDataFrame([(1, "A b"), (2, None), (None, "A b"), (1, "A b")], "doc_id long, text string")
    rows = chunk_reuse.encode_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows) == [
        (0, library_ids("A b"), "a</w> b</w>"), (1, library_ids("A b"), "a</w> b</w>"),
        (1, library_ids("A b"), "a</w> b</w>"), (2, [], ""),
    ]
    assert chunk_reuse.digests(docs.limit(0)).count() == 0
    clashing = docs.withColumns({"ids": F.lit(1), "decoded": F.lit("x"), "n_tokens": F.lit("y"), "ids_sha256": F.lit(None)})
    assert sorted(map(str, chunk_reuse.digests(clashing).collect())) == sorted(map(str, chunk_reuse.digests(docs).collect()))
    assert sorted(map(str, chunk_reuse.encode_documents(clashing).collect())) == sorted(map(str, rows))


def test_documents_by_another_file(shipped):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Some  text, it's 12 o'clock.\n" * 90, "日本語 テキスト " * 60, "", None]
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in chunk_reuse.encode_documents(docs, path).collect():
        ids = BYTES.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == ids and row.decoded == BYTES.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("ids", [[0, 1, 2], [49406, 49407], []])
def test_decoding_is_the_library_s(ids):
    assert WordUnits(WORDS).decode(np.array(ids, int)) == LIBRARY.decode(ids, skip_special_tokens=False)
