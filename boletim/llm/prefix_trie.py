"""Trie of conversations by their first turns, built by the recursion of van Emde Boas.

Going down, every sequence of turns is cut at half depth, then each half at its half, for all sequences and all halves at
once. A cut prefix is named by its start's name and a digest of the turns between, so sequences that agree up to
there share the name; the upper half goes on with the name it began with, the lower half with the new one. After as many
rounds as the logarithm of the greatest depth every prefix has its name. Prefixes of one name are a node, and the smallest
conversation below it owns it.

Going up, blocks of doubling height hold the totals of the trees inside them. Two blocks that lie on each other become
one: the totals of the lower forest are summed by the node they hang on and grafted onto it and its ancestors inside the
upper block. A node is touched once a round, so a conversation that is a third of the table costs the logarithm of
its length, not its square, and its turns are numbered by position in a sort of all rows, not within one task.

Edge cases: rows without a conversation id are left out; a null role or text is empty; turns of equal number are in
order of role, then text, and turns without number stand first; a conversation without turns belongs to the root alone; an
empty table has no nodes. The conversation ids that end in a node are hashed as one stream, held in no list. Other
columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boletim.llm.common import written

_ROOT = "unhex('00')"


def _digest(*parts: str) -> Column:
    """Half a SHA-256 of the parts, which are binary and of fixed length but for the last."""
    return F.expr(f"substring(unhex(sha2(concat({', '.join(parts)}), 256)), 1, 16)")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, at, role, text``: the turns of each conversation, numbered from 1 in order of their turn."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "tie"]
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # The id holds the range in its upper bits and the row within it in the lower 33.
    rows = written(ranged.withColumn("row", F.monotonically_increasing_id()).drop("tie", "turn"), "turns")
    part = F.shiftrightunsigned("row", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    # One row for each range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "conv", (F.col("start") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"), "role", "text"
    )
    first = placed.groupBy("conv").agg(F.min("place").alias("first"))
    return placed.join(first, "conv").select("conv", (F.col("place") - F.col("first") + 1).alias("at"), "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences whose first turns come from the first conversation of each hundred.

    Returns ``conv, at, role, text`` of the rebuilt turns and ``conv, length`` of every conversation.
    """
    own = turns.groupBy("conv").agg(F.max("at").alias("own"))
    convs = own.select(
        "conv", "own", F.expr("conv - conv % 100").alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("lent"),
    )
    bases = own.select(F.col("conv").alias("base"), F.col("own").alias("held"))
    convs = convs.join(bases, "base", "left").select(
        "conv", "base", "lent", F.least("lent", F.coalesce("held", F.lit(0))).alias("taken"), "own"
    )
    heads = turns.filter("at <= 5 AND conv % 100 = 0").withColumnRenamed("conv", "base")
    lent = convs.select("conv", "base", "lent").join(heads, "base").filter("at <= lent").select("conv", "at", "role", "text")
    tails = turns.join(convs.select("conv", "lent", "taken"), "conv").filter("at > lent")
    tails = tails.select("conv", (F.col("at") - F.col("lent") + F.col("taken")).alias("at"), "role", "text")
    lengths = convs.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("lent"), F.lit(0))).alias("length"))
    return lent.unionByName(tails), lengths


def _named(turns: DataFrame, lengths: DataFrame, rounds: int) -> DataFrame:
    """``conv, depth, name`` of every prefix: ``turns`` has ``conv, at, digest``."""
    blocks = [turns.select("conv", (F.col("at") - 1).alias("block"), "digest")]
    for _ in range(1, rounds):
        left = F.max(F.when(F.col("block") % 2 == 0, F.col("digest"))).alias("left")
        right = F.max(F.when(F.col("block") % 2 == 1, F.col("digest"))).alias("right")
        halves = blocks[-1].groupBy("conv", F.shiftright("block", 1).alias("pair")).agg(left, right)
        whole = halves.filter("left IS NOT NULL AND right IS NOT NULL")
        blocks.append(written(whole.select("conv", F.col("pair").alias("block"), _digest("left", "right").alias("digest")), "blocks"))
    names = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.expr(_ROOT).alias("name"))
    for level in range(rounds - 1, -1, -1):
        cut = names.withColumn("block", F.shiftright("depth", level)).join(blocks[level], ["conv", "block"])
        below = cut.select("conv", (F.col("depth") + (1 << level)).alias("depth"), _digest("name", "digest").alias("name"))
        names = names.unionByName(written(below, "names"))
    return names


def _grafted(nodes: DataFrame, paths: DataFrame, rounds: int) -> DataFrame:
    """``conv, depth, leaves, saved`` summed over the subtree of each node below the root.

    ``nodes`` has the same columns with each node's own values, and ``parent``; ``paths`` has the owner of
    each prefix: ``conv, depth, owner``.
    """
    totals = nodes.select("conv", "depth", "leaves", "saved")
    parents = nodes.select("conv", "depth", "parent")
    for level in range(rounds):
        height = 1 << level
        # The lowest nodes of upper blocks lie at odd multiples of the height.
        tops = (F.col("depth") - 1) % (2 * height) == height
        hung = totals.filter(tops).join(parents.filter(tops), ["conv", "depth"])
        hung = hung.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("end")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        hung = hung.withColumn("block", F.shiftright(F.col("end") - 1, level))
        above = paths.withColumn("block", F.shiftright(F.col("depth") - 1, level)).filter("block % 2 = 0")
        grafts = above.join(hung, ["conv", "block"]).select(F.col("owner").alias("conv"), "depth", "leaves", "saved")
        summed = totals.unionByName(grafts).groupBy("conv", "depth").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        totals = written(summed, "totals")
    return totals


def _hashed(batches):
    """A digest of the members of each node; rows of a node follow each other, in order."""
    key, state, out = None, None, []
    for batch in batches:
        rows = list(zip(*(batch.column(n).to_pylist() for n in ("owner", "depth", "conv")), strict=True))
        at = 0
        while at < len(rows):
            end = at + 1
            while end < len(rows) and rows[end][:2] == rows[at][:2]:
                end += 1
            ids = ",".join(str(r[2]) for r in rows[at:end])
            if rows[at][:2] == key:
                state.update(b"," + ids.encode())
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = rows[at][:2], hashlib.sha256(ids.encode())
            at = end
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("owner", "depth", "ends"), r, strict=True)) for r in out])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"owner": key[0], "depth": key[1], "ends": state.hexdigest()}])


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences: ``turns`` has ``conv, at, role, text``, ``lengths`` every conversation's length."""
    lengths = written(lengths, "lengths")
    marked = turns.select(
        "conv", "at", F.length("text").cast("long").alias("points"),
        _digest("cast(concat(length(role), ':', role, text) as binary)").alias("digest"),
    )
    marked = written(marked, "marked")
    deepest = lengths.agg(F.max("length")).first()[0] or 0
    rounds = int(deepest).bit_length()
    names = _named(marked.select("conv", "at", "digest"), lengths, rounds)
    root = lengths.agg(F.min("conv").alias("root"), F.count(F.lit(1)).alias("all")).filter("all > 0")
    # Below the root: each prefix with its name, and each node with its owner.
    prefixes = written(names.filter("depth > 0").join(marked.select("conv", F.col("at").alias("depth"), "points"), ["conv", "depth"]), "prefixes")
    named = prefixes.groupBy("depth", "name").agg(
        F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("points").alias("points")
    )
    named = written(named, "nodes")
    paths = written(prefixes.join(named.select("depth", "name", "owner"), ["depth", "name"]).select("conv", "depth", "owner"), "paths")
    up = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    nodes = named.withColumnRenamed("owner", "conv").join(up, ["conv", "depth"], "left").crossJoin(F.broadcast(root))
    nodes = nodes.withColumn("parent", F.coalesce("parent", "root"))
    children = nodes.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(children, ["conv", "depth"], "left").select(
        "conv", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("points")).alias("saved"),
    )
    own = written(own, "own")
    totals = _grafted(own, paths, rounds)
    below = totals.filter("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    top = root.crossJoin(below).select(
        F.col("root").alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"),
        F.col("all").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"),
    )
    whole = own.drop("leaves", "saved").join(totals, ["conv", "depth"]).unionByName(top)
    ends = lengths.withColumnRenamed("length", "depth").join(paths, ["conv", "depth"]).select("owner", "depth", "conv")
    bare = lengths.filter("length = 0").join(F.broadcast(root)).select(F.col("root").alias("owner"), F.col("length").alias("depth"), "conv")
    ends = ends.unionByName(bare).repartition("owner", "depth").sortWithinPartitions("owner", "depth", "conv")
    ends = ends.mapInArrow(_hashed, "owner long, depth long, ends string").withColumnRenamed("owner", "conv")
    return whole.join(ends, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    return trie(*rebuilt(written(numbered_turns(conversations), "numbered")))


ORACLE_SQL = """
WITH RECURSIVE ordered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
    FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
    SELECT c, 0 AS pos, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT conv_id AS c FROM ordered)
    UNION ALL
    SELECT c, pos + 1, list_reduce(
        list_prepend(xor(crc, ascii(substr(c::VARCHAR, pos + 1, 1))::BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
    FROM bits WHERE pos < length(c::VARCHAR)
), convs AS (
    SELECT c, c - c % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM bits WHERE pos = length(c::VARCHAR)
), turns AS (
    SELECT c, o.t, o.role, o.text FROM convs JOIN ordered o ON o.conv_id = base AND o.t <= h
    UNION ALL
    SELECT c, 100000000 + o.t, o.role, o.text FROM convs JOIN ordered o ON o.conv_id = c AND o.t > h
), lists AS (
    SELECT c, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY t) FILTER (WHERE t IS NOT NULL), []) AS l,
           coalesce(list(length(text) ORDER BY t) FILTER (WHERE t IS NOT NULL), []) AS p
    FROM convs LEFT JOIN turns USING (c) GROUP BY c
), prefixes AS (
    SELECT c, d, d = len(l) AS ends, md5(array_to_string(l[1:d], ',')) AS k, CASE WHEN d = 0 THEN 0 ELSE p[d] END AS points
    FROM (SELECT c, l, p, unnest(range(0, len(l) + 1)) AS d FROM lists)
), nodes AS (
    SELECT d, k, min(c) AS owner, count(*) AS n, any_value(points) AS points,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
    FROM prefixes GROUP BY d, k
), paths AS (
    SELECT c, d, k, owner FROM prefixes JOIN nodes USING (d, k)
), children AS (
    SELECT up.owner AS parent, nodes.d - 1 AS d, count(*) AS n_children
    FROM nodes JOIN paths up ON up.c = nodes.owner AND up.d = nodes.d - 1 GROUP BY 1, 2
), own AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf
    FROM nodes LEFT JOIN children ON parent = owner AND children.d = nodes.d
), totals AS (
    SELECT up.owner, up.d, sum(leaf) AS leaves, sum((own.n - 1) * own.points) AS saved
    FROM own JOIN paths up ON up.c = own.owner AND up.d <= own.d GROUP BY 1, 2
)
SELECT own.owner AS conv_id, own.d::BIGINT AS depth, up.owner AS parent_conv_id, own.n AS n_convs, n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM own JOIN totals ON totals.owner = own.owner AND totals.d = own.d
LEFT JOIN paths up ON up.c = own.owner AND up.d = own.d - 1
"""
