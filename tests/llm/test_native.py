"""Mixing and shards, made of DataFrame operations alone."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from boletim.llm import kd_shards, pfair_mix
from boletim.llm.queries import ORACLE_SQL, QUERIES


def edf(weights):
    """Earliest deadline first over one round, slot by slot."""
    parts, done, picks = sum(weights), [0] * len(weights), []
    for slot in range(parts):
        ready = [
            (-(-(n + 1) * parts // w), i)
            for i, (n, w) in enumerate(zip(done, weights, strict=True))
            if n < w and n * parts // w <= slot
        ]
        picks.append(min(ready)[1])
        done[picks[-1]] += 1
    return picks


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 5, 2], [1, 50, 7, 7], [13, 1, 1, 1, 84], [9] * 11])
def test_rounds_keep_every_deadline(shipped, weights):
    row = shipped.range(1).select(
        pfair_mix.edf_round(F.array(*[F.lit(w).cast("long") for w in weights]), F.lit(sum(weights)).cast("long")).alias("p")
    )
    picks = row.first().p
    assert picks == edf(weights)
    had = Counter()
    for slot, pick in enumerate(picks, 1):
        had[pick] += 1
        for i, w in enumerate(weights):
            assert abs(had[i] - Fraction(w * slot, sum(weights))) < 1


def mix(spark, rows, weights, block):
    docs = spark.createDataFrame([(i, s, "t", 7) for i, s in rows], "doc_id long, source string, text string, position long")
    frame = None if weights is None else spark.createDataFrame(list(weights.items()), "source string, weight long")
    return docs, pfair_mix.schedule(docs.repartition(3), frame, block).collect()


def test_blocks_interleave_by_weight(shipped):
    rows = [(i, "a") for i in range(600)] + [(1000 + i, "b") for i in range(300)] + [(2000 + i, None) for i in range(100)]
    weights = {"a": 6, "b": 3, None: 1}
    docs, found = mix(shipped, rows, weights, 10)
    assert sorted(r.position for r in found) == list(range(1000))
    assert Counter((r.doc_id, r.source) for r in found) == Counter(rows)
    by_block = defaultdict(list)
    for r in sorted(found, key=lambda r: r.position):
        by_block[r.position // 10].append(r.source)
    had = Counter()
    for n in range(100):
        assert len(set(by_block[n])) == 1
        had[by_block[n][0]] += 1
        for source, w in weights.items():
            assert abs(had[source] - Fraction(w * (n + 1), 10)) < 1
    kept = pfair_mix.mixed(docs, shipped.createDataFrame(list(weights.items()), "source string, weight long"), 10)
    assert kept.columns == docs.columns
    order = [r.doc_id for r in kept.collect()]
    assert order == [r.doc_id for r in sorted(found, key=lambda r: r.position)]


def test_a_source_that_runs_out_and_odd_rows(shipped):
    rows = [(i, "hot") for i in range(400)] + [(5, "small")] * 3 + [(None, "small"), (None, "small")]
    docs, found = mix(shipped, rows, {"hot": 1, "small": 9, "absent": 5}, 4)
    assert sorted(r.position for r in found) == list(range(405))
    assert max(r.position for r in found if r.source == "small") < 12
    assert Counter((r.doc_id, r.source) for r in found) == Counter(rows)
    assert pfair_mix.mixed(docs, block_rows=4).count() == 405
    assert mix(shipped, [], None, 4)[1] == [] and pfair_mix.mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mix(shipped, rows, {"hot": 1}, 4)


def test_mix_equals_duckdb(shipped):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    wanted = con.execute(ORACLE_SQL["op4_pfair_mix"]).fetchall()
    found = QUERIES["op4_pfair_mix"](shipped, "/root/testdata/sf0.01")
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def shard(spark, rows, **how):
    docs = spark.createDataFrame(
        [(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, shard string"
    ).repartition(3)
    return kd_shards.slots(kd_shards.kd_shards(docs, **how)).collect()


def test_shards_have_near_equal_bytes(shipped):
    import random

    pick = random.Random(1)
    rows = [
        (i, "é" * pick.choice([1, 5, 40, 400]), pick.choice(["en", "de", None]), "hot" if i % 3 else "s%d" % (i % 40))
        for i in range(3000)
    ]
    rows[7] = (7, None, None, None)
    found = shard(shipped, rows, shards=8)
    sizes, slots = defaultdict(int), defaultdict(list)
    text_of = {r[0]: (r[1] or "").encode() for r in rows}
    for r in found:
        assert r["size"] == len(text_of[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text_of[r.doc_id])
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in found) == list(range(3000))
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 4 * 801
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_by_target_bytes_and_odd_tables(shipped):
    rows = [(i, "abc", "en", "s") for i in range(100)]
    found = shard(shipped, rows, target_bytes=60)
    assert Counter(r.shard for r in found).keys() == set(range(7))
    assert max(Counter(r.shard for r in found).values()) <= 16
    same = shard(shipped, [(1, "abc", "en", "s")] * 64 + [(None, None, None, None)] * 64, shards=4)
    assert len(same) == 128 and len({r.shard for r in same}) == 4
    assert shard(shipped, [], shards=8) == [] and shard(shipped, [], target_bytes=10) == []
    one = shard(shipped, [(3, "x" * 10_000, "en", "s"), (4, "", "en", "s")], shards=8)
    assert len(one) == 2 and all(0 <= r.shard < 8 and r.slot >= 0 for r in one)
    assert len(shard(shipped, rows, shards=1)) == 100


def test_query_covers_all_documents(shipped):
    found = QUERIES["op7_kd_shards"](shipped, "/root/testdata/sf0.001").collect()
    docs = shipped.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    largest = max(r["size"] for r in found)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 4 * largest
