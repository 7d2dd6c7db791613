"""The trie of conversations against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np

from boletim.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string"


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(held)] for c, held in turns.items()}
    sequences = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        sequences[c] = original.get(int(c - np.fmod(c, 100)), [])[:h] + own[h:]
    return plain_nodes(sequences)


def plain_nodes(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(sequences.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children[node]]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        totals[node] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    return sorted(
        (
            m[0], len(node), members[node[:-1]][0] if node else -1, len(m), len(children[node]), *totals[node],
            hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def found(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, df.collect()))


def test_random_conversations(shipped):
    random = np.random.default_rng(8)
    rows = []
    for c in [*range(0, 12), 100, *range(200, 220), 305, -1, -100, 1 << 40]:
        for t in random.permutation(random.integers(0, 14)):
            turn = None if t == 3 else int(t) // 2  # ties
            rows.append((c, turn, random.choice(["u", "a", None]), random.choice(["x", "é€", "", None]), 1, "o"))
    rows += rows[:20] + [(None, 1, "u", "x", 1, "o"), (400, None, None, None, 1, "o")]
    df = shipped.createDataFrame([tuple(None if v is None else v for v in r) for r in rows], SCHEMA)
    wanted = plain_trie([r[:4] for r in rows])
    assert found(prefix_trie.conversation_trie(df.repartition(4))) == wanted


def test_a_long_conversation_and_a_common_one(shipped):
    rows = [(1, t, "u", f"t{t // 7}", 0, "") for t in range(150)]
    rows += [(2, t, "u", f"t{t // 7}", 0, "") for t in range(150)] + [(2, 150, "u", "end", 0, "")]
    rows += [(c, t, "u", "same", 0, "") for c in range(10, 80) for t in range(3)]
    df = shipped.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.conversation_trie(df)) == plain_trie([r[:4] for r in rows])


def test_empty_tables(shipped):
    none = shipped.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(none).collect() == []
    # Neither a conversation of its own turns only in the head, nor one without an id, has turns.
    bare = shipped.createDataFrame([(5, 1, "u", "x", 0, ""), (None, 1, "u", "x", 0, "")], SCHEMA)
    assert found(prefix_trie.conversation_trie(bare)) == plain_trie([(5, 1, "u", "x")])
    assert len(found(prefix_trie.conversation_trie(bare))) == 1


def test_members_are_hashed_over_batches():
    import pyarrow as pa

    ids = list(range(50))
    batches = [
        pa.record_batch([pa.array([1] * 20), pa.array([2] * 20), pa.array(ids[k : k + 20])], ["owner", "depth", "conv"]) for k in (0, 20)
    ] + [pa.record_batch([pa.array([1] * 10 + [3]), pa.array([2] * 11), pa.array(ids[40:] + [7])], ["owner", "depth", "conv"])]
    out = [r for b in prefix_trie._hashed(iter(batches)) for r in b.to_pylist()]
    wanted = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert [(r["owner"], r["ends"]) for r in out] == [(1, wanted), (3, hashlib.sha256(b"7").hexdigest())]
