"""Near-duplicate vectors by NN-descent.

Only vectors of one label and length are compared. Each vector has a list of its nearest neighbours known so far. The
lists start from blocks of vectors on the same sides of random planes. Then rounds of joins refine them: the
neighbours of a vector, in both directions, are compared with each other, and every pair better than what either list holds enters
it. Rounds end when one finds no new pair beyond the threshold.

A list all of whose places are taken by neighbours beyond the threshold is saturated: there may be more. Lists
are then enlarged to all that a vector reaches over pairs beyond the threshold, its group. What several groups share a cell of
planes is compared across them in full, so that a link counts however many nearer neighbours both ends have; groups
with such links become one. Every group is then compared in full, in double precision, block against block, which gives the
exact links inside it without writing out pairs. The
number of tables of planes there follows from the rows of a label: a pair at the threshold that nothing else connects is
lost once in 10,000 at any size. An audit compares a bounded set of vectors with all others; if any of them lacks a
link, more tables and rounds follow. Labels that still lack links after ``AUDITS`` of them are compared in full, block against block.

Vectors equal in every component form a class and go on as one; their copies count in the number of links.

Edge cases: vectors that are null, empty or zero or hold null or non-finite components, and rows without label or id, link with
nothing (a row without id has a null component); rows of equal id are counted one by one; an empty table gives no rows.
Columns other than ``vec_id, embedding, label`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boletim.llm.common import runs, written
from boletim.llm.components import components

THRESHOLD = 0.93
#: Places in a list, starting tables of planes, most rounds in a row, rows in a block.
PLACES = 8
TABLES = 4
ROUNDS = 6
BLOCK_ROWS = 256
#: Chance that a pair at the threshold shares no cell in any of the tables where groups are compared with each other.
MISS = 1e-4
#: Vectors the audit compares with all others, and audits before a label is compared in full.
AUDIT_ROWS = 256
AUDITS = 3
#: Rows in a cell and in a block where groups are compared with each other.
CELL_ROWS = 1024
CROSS_ROWS = 512
#: What a similarity in single, double and half precision may be off by.
SLACK = 1e-5
ROUNDING = 1e-12
HALF_SLACK = 2e-3

_PAIRS = "u long, v long, similarity float"


def _unit(vectors: list[bytes], dtype=np.float32) -> np.ndarray:
    x = np.array([np.frombuffer(v, "<f8") for v in vectors])
    scale = np.abs(x).max(axis=1, keepdims=True)  # first to a moderate size, so that squares stay finite
    x = x / scale
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(dtype)


def vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, size, vector, key_a, key_b`` of the vectors that can link; the vector as little-endian doubles."""

    def rows(batches):
        for batch in batches:
            keep, found = [], []
            for i, x in enumerate(batch.column("embedding").to_pylist()):
                if not x or any(c is None for c in x):
                    continue
                x = np.array(x, "<f8") + 0.0  # one zero
                if np.isfinite(x).all() and x.any():
                    keep.append(i)
                    found.append(x.tobytes())
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch(
                [part["vec_id"], part["label"], pa.array([len(x) // 8 for x in found], pa.int32()), pa.array(found, pa.binary())],
                ["vec_id", "label", "size", "vector"],
            )

    usable = embeddings.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    found = usable.mapInArrow(rows, "vec_id long, label string, size int, vector binary")
    return found.withColumns({"key_a": F.xxhash64("vector"), "key_b": F.xxhash64(F.lit(3), "vector")})


def tables_for(planes: int, threshold: float) -> int:
    """Tables in which a pair at the threshold shares no cell of so many planes with a chance of ``MISS`` at most."""
    chance = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** planes
    return 1 if chance >= 1 - MISS else int(np.ceil(np.log(MISS) / np.log1p(-chance)))


def _hashed(classes: DataFrame, first: int, tables, cell: int, keep: str) -> DataFrame:
    """``rep, label, size, t, side`` and a column to keep: each vector's cell in each table of planes, from table ``first`` on.

    The planes of a label leave about ``cell`` rows or less in a cell of vectors spread evenly; ``tables`` gives the
    number of tables for a number of planes.
    """
    groups = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("rows"))
    # A row for each label and length.
    planes = groups.select(
        F.col("label").alias("_l"), F.col("size").alias("_s"),
        F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / cell))).cast("int").alias("planes"),
    )
    kept = keep.split()[0]
    rows = classes.join(planes, (F.col("label") == F.col("_l")) & (F.col("size") == F.col("_s")))
    rows = rows.select("rep", "label", "size", F.col("vector").alias("_vector"), "planes", F.col(kept).alias("_kept"))

    def hashed(batches):
        for batch in batches:
            x = batch.column("_vector").to_pylist()
            sizes = np.array(batch.column("size").to_pylist())
            planes_of = np.array(batch.column("planes").to_pylist())
            number = {n: tables(n) for n in np.unique(planes_of).tolist()}
            needed = np.array([number[n] for n in planes_of.tolist()])
            units = {size: _unit([x[i] for i in np.flatnonzero(sizes == size)]) for size in np.unique(sizes).tolist()}
            for t in range(first, first + int(needed.max(initial=0))):
                side = np.zeros(len(x), np.int64)
                for size, unit in units.items():
                    own = np.flatnonzero(sizes == size)
                    most = int(planes_of[own].max())
                    normals = np.random.default_rng([t, size]).normal(size=(size, max(most, 1)))
                    use = np.arange(max(most, 1))[None, :] < planes_of[own][:, None]
                    side[own] = ((unit @ normals > 0) & use) @ (1 << np.arange(max(most, 1), dtype=np.int64))
                yield pa.record_batch(
                    [batch["rep"], batch["label"], batch["size"], pa.array(np.full(len(x), t, np.int32)), pa.array(side),
                     batch["_kept"]],
                    ["rep", "label", "size", "t", "side", kept],
                ).filter(pa.array(needed > t - first))

    return rows.mapInArrow(hashed, f"rep long, label string, size int, t int, side long, {keep}")


def _half(classes: DataFrame) -> DataFrame:
    """``half_of, vector``: unit vectors in half precision."""

    def rows(batches):
        for batch in batches:
            stored = batch.column("vector").to_pylist()
            half = [_unit([v], np.float16)[0].tobytes() for v in stored]
            yield pa.record_batch([batch["rep"], pa.array(half, pa.binary())], ["half_of", "vector"])

    return classes.select("rep", "vector").mapInArrow(rows, "half_of long, vector binary")


def _start(classes: DataFrame, first: int) -> DataFrame:
    """Neighbours inside blocks of vectors on the same sides of random planes, for each table of planes."""
    placed = _hashed(classes, first, lambda _: TABLES, BLOCK_ROWS // 2, "vector binary")
    crowd = placed.groupBy("t", "label", "size", "side").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    key = ["t", "label", "size", "side"]
    placed = placed.join(crowd, key).withColumn("block", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")))
    placed = placed.repartition(*key, "block").sortWithinPartitions(*key, "block")

    def best(batches):
        for _, rows in runs(batches, (*key, "block")):
            reps = np.array(rows["rep"])
            x = _unit(rows["vector"])
            for at in range(0, len(reps), 2 * BLOCK_ROWS):
                similar = x[at : at + 2 * BLOCK_ROWS] @ x.T
                similar[np.arange(len(similar)), at + np.arange(len(similar))] = -2
                n = min(PLACES, len(reps) - 1)
                if n:
                    top = np.argpartition(-similar, n - 1, axis=1)[:, :n]
                    yield pa.record_batch(
                        [pa.array(np.repeat(reps[at : at + len(similar)], n)), pa.array(reps[top.ravel()]),
                         pa.array(np.take_along_axis(similar, top, 1).ravel().astype(np.float32))],
                        ["u", "v", "similarity"],
                    )

    return placed.select("rep", "vector", *key, "block").mapInArrow(best, _PAIRS)


def _lists(pairs: DataFrame) -> DataFrame:
    """The best places of each vector's list."""
    once = pairs.groupBy("u", "v").agg(F.max("similarity").alias("similarity"))
    own = Window.partitionBy("u").orderBy(F.desc("similarity"), "v")
    return once.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= PLACES).drop("place")


def _joined(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of neighbours of one vector that are better than the worst place of either one's list."""
    worst = lists.groupBy("u").agg(
        F.when(F.count(F.lit(1)) >= PLACES, F.min("similarity")).otherwise(F.lit(-1.0)).cast("float").alias("worst")
    )
    members = classes.select("rep", "vector").join(worst, F.col("rep") == F.col("u")).select("rep", "vector", "worst")
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "similarity")
    around = lists.select("u", "v").union(_lists(back).select("u", "v")).distinct()
    around = around.join(members, F.col("v") == F.col("rep")).select("u", "v", "vector", "worst")
    around = around.repartition("u").sortWithinPartitions("u")

    def pairs(batches):
        for _, rows in runs(batches, ("u",)):
            ids, x, worst = np.array(rows["v"]), _unit(rows["vector"]), np.array(rows["worst"], np.float32)
            similar = x @ x.T
            np.fill_diagonal(similar, -2)
            a, b = np.nonzero(similar > worst[:, None])
            if len(a):
                yield pa.record_batch(
                    [pa.array(ids[a]), pa.array(ids[b]), pa.array(similar[a, b].astype(np.float32))], ["u", "v", "similarity"]
                )

    return around.mapInArrow(pairs, _PAIRS)


def descend(lists: DataFrame, classes: DataFrame, threshold: float, rounds: int = ROUNDS) -> DataFrame:
    """Refine the lists until a round finds no pair beyond the threshold that was not in a list before."""
    def close(pairs):
        return pairs.filter(F.col("similarity") >= threshold - SLACK).agg(F.sum("similarity"), F.count(F.lit(1))).first()

    known = close(lists)
    for _ in range(rounds):
        lists = written(_lists(lists.union(_joined(lists, classes))), "lists")
        now = close(lists)
        if now == known:
            break
        known = now
    return lists


def _across(classes: DataFrame, groups: DataFrame, threshold: float, first: int) -> DataFrame:
    """``a, b``: links between groups, from all pairs of different groups that share a cell in one of the tables,
    which are as many as the planes of a label need.

    A vector in no group is one of its own. A cell is compared in blocks, each with each other one; a group with more
    rows there than a block has blocks of its own, which aren't compared among each other. Of a pair of blocks the links are those that
    join its groups, not all pairs. In half precision they may fall short of the threshold by ``HALF_SLACK``, which
    the comparison inside the joined groups makes good.
    """
    rows = classes.join(groups, F.col("rep") == F.col("node"), "left").select(
        "rep", "label", "size", "vector", F.coalesce("component", "rep").alias("family")
    )
    cell = ["t", "label", "size", "side"]
    placed = written(_hashed(rows, first, lambda planes: tables_for(planes, threshold), CELL_ROWS, "family long"), "cells")
    own = placed.groupBy(*cell, "family").agg(F.count(F.lit(1)).alias("rows"))
    own = own.withColumn("big", F.when(F.col("rows") > CROSS_ROWS, F.col("family")))
    crowd = own.groupBy(*cell, "big").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("families"))
    crowd = crowd.withColumn("blocks", F.ceil(F.col("rows") / CROSS_ROWS).cast("int"))
    # A row for the small families of a cell, and one for each big one.
    every = Window.partitionBy(*cell)
    crowd = crowd.withColumns({
        "all": F.sum("blocks").over(every).cast("int"), "among": F.sum("families").over(every),
        "from": (F.sum("blocks").over(every.orderBy(F.col("big").asc_nulls_first())) - F.col("blocks")).cast("int"),
    }).filter("among > 1")
    crowd = written(crowd.select(*cell, "big", "blocks", "all", "from"), "crowds")
    big = crowd.filter("big IS NOT NULL").withColumnRenamed("big", "family")
    large = placed.join(big, [*cell, "family"]).withColumn("whole", F.lit(True))
    small = placed.join(big.select(*cell, "family"), [*cell, "family"], "left_anti")
    small = small.join(crowd.filter("big IS NULL").drop("big"), cell).withColumn("whole", F.lit(False))
    small = small.select(*large.columns)
    spread = large.union(small).withColumn("block", F.col("from") + F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int"))
    others = F.filter(
        F.sequence(F.lit(0), F.col("all") - 1),
        lambda i: ~F.col("whole") | (i < F.col("from")) | (i >= F.col("from") + F.col("blocks")),
    )
    spread = spread.withColumn("other", F.explode(others))
    spread = spread.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    key = (*cell, "left", "right")
    spread = spread.select(*key, "block", "family", "rep").join(written(_half(classes), "halves"), F.col("rep") == F.col("half_of"))
    spread = spread.select(*key, "block", "family", "vector").repartition(*key).sortWithinPartitions(*key)

    def links(batches):
        for (*_, left, right), rows in runs(batches, key):
            family, block = np.array(rows["family"]), np.array(rows["block"])
            x = np.array([np.frombuffer(v, np.float16) for v in rows["vector"]]).astype(np.float32)
            names, number = np.unique(family, return_inverse=True)
            here, there = (np.arange(len(x)),) * 2 if left == right else (np.flatnonzero(block == left), np.flatnonzero(block == right))
            pairs = [np.zeros((0, 2), np.int64)]
            for at in range(0, len(here), CROSS_ROWS):
                part = here[at : at + CROSS_ROWS]
                i, j = np.nonzero(x[part] @ x[there].T >= threshold - HALF_SLACK)
                pairs.append(np.unique(np.column_stack([number[part[i]], number[there[j]]]), axis=0))
            root = list(range(len(names)))

            def top(n, root=root):
                while root[n] != n:
                    root[n] = root[root[n]]
                    n = root[n]
                return n

            for i, j in np.concatenate(pairs).tolist():
                i, j = top(i), top(j)
                root[max(i, j)] = min(i, j)
            joined = [(top(n), n) for n in range(len(names)) if top(n) != n]
            if joined:
                a, b = np.array(joined).T
                yield pa.record_batch([pa.array(names[a]), pa.array(names[b])], ["a", "b"])

    return spread.mapInArrow(links, "a long, b long")


def _in_groups(classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """``rep, links, root``: exact links of each vector inside its group, by block, and the smallest it joins there."""
    rows = classes.join(groups, F.col("rep") == F.col("node")).select("rep", "copies", "vector", "component")
    crowd = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK_ROWS)).cast("int").alias("blocks"))
    rows = rows.join(crowd, "component").withColumn("side", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"left": F.least("side", "other"), "right": F.greatest("side", "other")})
    key = ("component", "left", "right")
    rows = rows.select(*key, "side", "rep", "copies", "vector").repartition(*key).sortWithinPartitions(*key)

    def links(batches):
        for (_, left, right), rows in runs(batches, key):
            reps, copies, side = np.array(rows["rep"]), np.array(rows["copies"]), np.array(rows["side"])
            x = _unit(rows["vector"], np.float64)
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if left != right:
                linked &= side[:, None] != side[None, :]
            root = np.arange(len(reps))
            order = np.argsort(reps)
            for start in order:  # spread the smallest id over what it reaches
                if root[start] != start:
                    continue
                seen = np.zeros(len(reps), bool)
                seen[start] = True
                front = seen.copy()
                while front.any():
                    front = linked[front].any(axis=0) & ~seen
                    seen |= front
                fresh = seen & (root == np.arange(len(reps)))
                root[fresh] = start
            yield pa.record_batch(
                [pa.array(reps), pa.array(linked @ copies, pa.int64()), pa.array(reps[root])], ["rep", "links", "root"]
            )

    return rows.mapInArrow(links, "rep long, links long, root long")


def _audit(classes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """``label, size`` of the vectors of a bounded set that lack a link, against a comparison with all; a vector with many counts like
    one with few."""
    asked = classes.orderBy(F.xxhash64("rep", F.lit(13)), "rep").limit(AUDIT_ROWS).select("rep", "label", "size", "vector").collect()
    groups: dict[tuple, list] = {}
    for row in asked:
        groups.setdefault((row["label"], row["size"]), []).append(row)
    asked_of = {k: (np.array([r["rep"] for r in v]), _unit([r["vector"] for r in v], np.float64)) for k, v in groups.items()}

    def counts(batches):
        total: dict[int, int] = {}
        for batch in batches:
            labels, sizes = batch.column("label").to_pylist(), batch.column("size").to_pylist()
            reps, copies = np.array(batch.column("rep").to_pylist()), np.array(batch.column("copies").to_pylist())
            stored = batch.column("vector").to_pylist()
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(labels, sizes, strict=True)):
                if k in asked_of:
                    places.setdefault(k, []).append(i)
            for k, own in places.items():
                ids, x = asked_of[k]
                linked = x @ _unit([stored[i] for i in own], np.float64).T >= threshold + ROUNDING
                linked &= ids[:, None] != reps[own][None, :]
                for i, n in zip(ids.tolist(), (linked @ copies[own]).tolist(), strict=True):
                    total[i] = total.get(i, 0) + n
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["rep", "true"])

    true = classes.select("rep", "label", "size", "vector", "copies").mapInArrow(counts, "rep long, true long")
    true = true.groupBy("rep").agg(F.sum("true").alias("true"))
    both = true.join(found.select("rep", "links"), "rep", "left")
    lacking = both.filter(F.col("true") > F.coalesce("links", F.lit(0))).select(F.col("rep").alias("_rep"))
    # At most a row for each audited vector.
    return classes.join(F.broadcast(lacking), F.col("rep") == F.col("_rep")).select("label", "size").distinct()


def _whole(classes: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups``, where all vectors of one of the given labels and lengths are one group."""
    own = classes.join(F.broadcast(labels), ["label", "size"])  # at most a row for each audited vector
    first = own.groupBy("label", "size").agg(F.min("rep").alias("component"))
    whole = own.join(F.broadcast(first), ["label", "size"]).select(F.col("rep").alias("node"), "component")
    return groups.join(own.select(F.col("rep").alias("node")), "node", "left_anti").select("node", "component").union(whole)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    usable = written(vectors(embeddings), "vectors")
    same = ["label", "size", "key_a", "key_b"]
    classes = usable.groupBy(*same).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )
    classes = written(classes, "classes")
    lists = across = None
    for audit in range(AUDITS + 1):
        if audit == AUDITS:  # labels where more tables haven't helped are compared in full
            inside = written(_in_groups(classes, written(_whole(classes, lacking, groups), "whole"), threshold), "inside")
            found = written(inside.groupBy("rep").agg(F.sum("links").alias("links")), "found")
            break
        fresh = _start(classes, audit * TABLES)
        lists = written(_lists(fresh if lists is None else lists.union(fresh)), "lists")
        lists = descend(lists, classes, threshold)
        near = lists.filter((F.col("similarity") >= threshold - SLACK) & (F.col("u") != F.col("v")))
        near = near.select(F.col("u").alias("a"), F.col("v").alias("b"))
        near = near if across is None else near.union(across)
        # Tables of their own for each repeat.
        more = written(_across(classes, components(near), threshold, audit << 20), "across")
        across = more if across is None else across.union(more)
        groups = components(near.union(more))
        inside = written(_in_groups(classes, groups, threshold), "inside")
        found = written(inside.groupBy("rep").agg(F.sum("links").alias("links")), "found")
        lacking = written(_audit(classes, found, threshold), "lacking")
        if lacking.isEmpty():
            break
    joined = components(inside.select(F.col("root").alias("a"), F.col("rep").alias("b")))
    verdict = classes.join(found, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select(
        *same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    # A hot class is a hot key of this join; adaptive execution splits it, as nothing is grouped after it.
    linked = usable.select("vec_id", *same).join(verdict, same).select("vec_id", "n_links", "component")
    rest = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    void = ~F.exists("embedding", lambda c: c.isNotNull() & (c != 0))
    alone = F.col("vec_id").isNull() | F.col("label").isNull() | F.col("embedding").isNull() | bad | void
    rest = rest.filter(F.coalesce(alone, F.lit(True))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return linked.union(rest).select(
        "vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept")
    )

