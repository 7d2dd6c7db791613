"""Mixing sources to target weights by a Pfair schedule.

Each source has a whole number of parts as its target weight; all parts together are the length of a round. Its
documents, in a fixed random order, form blocks of equal size. Block k of a source with w of Q parts is released at slot
floor(k * Q / w) and due by slot ceil((k + 1) * Q / w); each slot goes to the released block that is due first. One machine and
full use, so every deadline is met, and at any slot each source has had its target share of the slots to
within less than one block. The round repeats, so it is worked out once and a document finds its place by arithmetic.

Every document is placed once. When a source has run out its slots stay empty, the positions close up, and the other
sources go on in their own ratio.

Size: the schedule has as many slots as there are parts, and holds a count of each source at each slot. Parts are at
least as many as sources, so it suits up to some thousand sources; join small ones under one name before.

Edge cases: a null source is a source of its own; texts are not read; rows of equal id and source get
neighbouring places in any order; documents without id come first in their source; an empty table gives no rows.
Only ``doc_id`` and ``source`` are read by ``schedule``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boletim.llm.common import fresh, written

#: Parts of a round, power of the sizes that the default weights follow, rows in a block.
PARTS = 1000
POWER = 0.5
BLOCK_ROWS = 16
#: Rows that one task numbers at a time, about.
BUCKET_ROWS = 8192


def weights_by_size(documents: DataFrame, parts: int = PARTS, power: float = POWER) -> DataFrame:
    """``source, weight``: about ``parts`` whole parts, shared out by the sizes to a power; at least one each."""
    sizes = documents.groupBy("source").agg(F.pow(F.count(F.lit(1)), F.lit(power)).alias("size"))
    # One row for each source.
    total = sizes.agg(F.sum("size").alias("total"))
    share = F.floor(F.lit(parts) * F.col("size") / total.select("total").scalar() + 0.5)
    return sizes.select("source", F.greatest(F.lit(1), share).cast("long").alias("weight"))


def edf_round(weights: Column, parts: Column) -> Column:
    """The source (by place in ``weights``) that each slot of a round goes to."""

    def step(state, slot):
        done = state["done"]
        due = F.transform(
            F.sequence(F.lit(0), F.size(weights) - 1),
            lambda i: F.when(
                (F.get(done, i) < F.get(weights, i))
                & (F.floor(F.get(done, i) * parts / F.get(weights, i)) <= slot),
                F.struct(
                    F.ceil((F.get(done, i) + 1) * parts / F.get(weights, i)).alias("due"), i.alias("source")
                ),
            ),
        )
        pick = F.array_min(due)["source"]
        return F.struct(
            F.transform(done, lambda n, i: F.when(i == pick, n + 1).otherwise(n)).alias("done"),
            F.concat(state["picks"], F.array(pick)).alias("picks"),
        )

    start = F.struct(
        F.transform(weights, lambda _: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<int>").alias("picks"),
    )
    return F.aggregate(F.sequence(F.lit(0).cast("long"), parts - 1), start, step, lambda state: state["picks"])


def plan(weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each source with rows: its parts, the round's length, its slots in a round, and at each of these how many
    blocks each source has had before; with all sources' parts and sizes. All of it is as small as the schedule.
    """
    known = weights.join(sizes, weights["source"].eqNullSafe(sizes["name"])).select("source", "weight", "rows")
    order = F.sort_array(F.collect_list(F.struct("source", "weight", "rows")))
    table = known.agg(order.alias("all")).filter(F.size("all") > 0)
    table = table.select(
        F.col("all.source").alias("names"), F.col("all.weight").alias("weights"), F.col("all.rows").alias("sizes"),
        F.aggregate("all.weight", F.lit(0).cast("long"), lambda a, b: a + b).alias("parts"),
    )
    table = table.withColumn("picks", edf_round(F.col("weights"), F.col("parts")))
    slots = table.select("*", F.posexplode("picks").alias("slot", "which"))
    slots = slots.select(
        F.get("names", F.col("which")).alias("source"), F.get("weights", F.col("which")).alias("weight"),
        "parts", "weights", "sizes", F.col("slot").cast("long").alias("slot"),
        F.transform(
            F.sequence(F.lit(0), F.size("weights") - 1),
            lambda i: F.size(F.filter(F.slice("picks", F.lit(1), F.col("slot")), lambda p: p == i)).cast("long"),
        ).alias("had"),
    )
    return slots.groupBy("source", "weight", "parts", "weights", "sizes").agg(
        F.sort_array(F.collect_list(F.struct("slot", "had"))).alias("slots")
    )


def numbered(documents: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``_number``: the place of each document in its source, from 0, in the order of a hash of the id.

    A source is cut into ranges of the hash, as many as its size asks for, each numbered by itself; the count
    of the ranges before is added.
    """
    mark = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    unit = F.coalesce(F.conv(F.substring(mark, 1, 8), 16, 10).cast("long"), F.lit(0))
    rows = documents.withColumns({"_mark": mark, "_unit": unit})
    # One row for each source.
    rows = rows.join(F.broadcast(sizes), F.col("source").eqNullSafe(F.col("name")))
    ranges = F.ceil(F.col("rows") / BUCKET_ROWS)
    rows = rows.withColumn("_range", F.floor(F.col("_unit") * ranges / (1 << 32))).drop("_unit", "rows", "name")
    counts = rows.groupBy("source", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    own = Window.partitionBy("source", "_range").orderBy("_mark", "doc_id")
    rows = rows.withColumn("_place", F.row_number().over(own) - 1)
    return (
        rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("_number", F.col("_start") + F.col("_place"))
        .drop("_mark", "_range", "_place", "_s", "_r", "_start")
    )


def schedule(documents: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, source, block, slot, position`` of every document; positions are gapless from 0.

    ``weights`` has a whole number of parts, at least 1, for each source; without it they follow the sizes. Sources without
    a weight are refused by an error, as a document would be lost.
    """
    rows = documents.select("doc_id", "source")
    sizes = written(rows.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("rows")), "sizes")
    if weights is None:
        weights = weights_by_size(rows)
    weights = written(weights.select("source", F.col("weight").cast("long").alias("weight")), "weights")
    without = sizes.join(weights, sizes["name"].eqNullSafe(weights["source"]), "left_anti").limit(1).count()
    if without:
        raise ValueError("every source needs a weight")
    places = plan(weights, sizes).withColumnRenamed("source", "_source")
    # One row for each source; together as large as the schedule.
    rows = numbered(rows, sizes).join(F.broadcast(places), F.col("source").eqNullSafe(F.col("_source")))
    block = F.floor(F.col("_number") / block_rows)
    at = F.get("slots", (block % F.col("weight")).cast("int"))
    turns = F.floor(block / F.col("weight"))
    earlier = F.zip_with(
        F.zip_with(at["had"], "weights", lambda had, w: (had + turns * w) * block_rows),
        "sizes",
        lambda had, size: F.least(had, size),
    )
    position = F.aggregate(earlier, F.lit(0).cast("long"), lambda a, b: a + b) + F.col("_number") % block_rows
    return rows.select(
        "doc_id", "source", block.alias("block"), (turns * F.col("parts") + at["slot"]).alias("slot"),
        position.alias("position"),
    )


def mixed(documents: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All documents with all their columns, range-partitioned and sorted by their position in the mix.

    Rows of equal id and source are told apart by a number, so each is placed once.
    """
    id_, source, position, twin, own_twin = (
        fresh(documents, name) for name in ("mix_id", "mix_source", "mix_position", "mix_twin", "mix_own_twin")
    )
    order = schedule(documents, weights, block_rows)
    order = written(
        order.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("position").alias(position)), "order"
    )
    rows = documents
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source))
    if order.groupBy(id_, source).count().filter("count > 1").limit(1).count():
        order = order.withColumn(twin, F.row_number().over(Window.partitionBy(id_, source).orderBy(position)))
        rows = rows.withColumn(own_twin, F.row_number().over(Window.partitionBy("doc_id", "source").orderBy(F.lit(0))))
        same = same & (F.col(twin) == F.col(own_twin))
    return (
        # Sorted and merged at every size: a broadcast at small sizes would hide what the shuffle of the texts takes.
        rows.join(order.hint("merge"), same)
        .repartitionByRange(position)
        .sortWithinPartitions(position)
        .select(*[f"`{name}`" for name in documents.columns])
    )


#: DuckDB text for ``schedule(documents)`` with the default weights.
ORACLE_SQL = f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (
  SELECT source, n, greatest(1, floor({PARTS} * sqrt(n) / (SELECT sum(sqrt(n)) FROM c) + 0.5))::BIGINT AS a,
         row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i
  FROM c),
l AS (SELECT list(a ORDER BY i) AS a, sum(a)::BIGINT AS q, count(*) AS s FROM w),
sched AS (
  SELECT -1::BIGINT AS t, list_transform(a, lambda x: 0::BIGINT) AS done, -1::BIGINT AS pick, a, q, s FROM l
  UNION ALL
  SELECT t + 1, list_transform(range(s), lambda j: done[j + 1] + (j = p)::BIGINT), p, a, q, s
  FROM (
    SELECT *, list_min(list_transform(range(s), lambda j: CASE
        WHEN done[j + 1] < a[j + 1] AND done[j + 1] * q // a[j + 1] <= t + 1
        THEN ((done[j + 1] + 1) * q + a[j + 1] - 1) // a[j + 1] * s + j END)) % s AS p
    FROM sched WHERE t + 1 < q)),
slots AS (SELECT t, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM sched WHERE t >= 0),
d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r
  FROM documents),
placed AS (
  SELECT d.doc_id, d.source, r // {BLOCK_ROWS} AS block,
         (r // {BLOCK_ROWS} // w.a) * (SELECT q FROM l) + slots.t AS slot, r % {BLOCK_ROWS} AS o
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
  JOIN slots ON slots.pick = w.i AND slots.k = (r // {BLOCK_ROWS}) % w.a)
SELECT doc_id, source, block::BIGINT AS block, slot::BIGINT AS slot,
       (row_number() OVER (ORDER BY slot, o) - 1)::BIGINT AS position
FROM placed
"""
