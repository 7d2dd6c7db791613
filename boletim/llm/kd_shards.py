"""Shards of near equal bytes by a k-d tree over the documents' metadata.

A node of the tree holds a number of leaves. It is split along the dimension in which its documents spread
widest, at the weighted median (or the quantile that gives each side its share of the leaves) of their bytes, until each
node is a leaf. All nodes of a level are split together. A document's place along a dimension has 30 bits: ten for the
dimension itself and twenty for a hash that spreads documents of equal value, so a hot source is split like any
other. The median is found by three histograms of 1024 bins, each within the bin that the one before has found; a node
never needs more than that, whatever it holds.

Dimensions: length (logarithm of the bytes), id, source and language (each name at a fixed random place).

Edge cases: a null text has size 1 and the checksum of no bytes; null metadata stands at 0; a document larger than a
leaf's share makes its leaf larger; repeated rows are placed one by one; an empty table gives no rows. Columns other
than ``doc_id, text, lang, source`` are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boletim.llm.common import written

BITS = 10
_BINS = 1 << BITS
DIMENSIONS = ("at_length", "at_id", "at_source", "at_lang")
#: Rows that one task numbers at a time, about.
BUCKET_ROWS = 8192


def _named(column: str) -> Column:
    """A fixed random place for each name."""
    place = F.shiftrightunsigned(F.xxhash64(F.col(column).cast("string")), 64 - BITS)
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(place).cast("int")


def _scaled(column: str, low, high) -> Column:
    share = (F.col(column) - F.lit(low)) / F.lit(float(high - low) or 1.0)
    return F.coalesce(F.floor(share * (_BINS - 1)), F.lit(0)).cast("int")


def metadata(documents: DataFrame) -> DataFrame:
    """Size, checksum and places of every document, without its text, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _named("source").alias("at_source"),
        _named("lang").alias("at_lang"),
        F.monotonically_increasing_id().alias("row"),
    )
    return written(rows.withColumn("length", F.log2(F.col("size").cast("double"))), "metadata")


def _cut(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``first, split``: for each node the place at which the left side has its share of the bytes.

    ``rows`` has ``first, key, size``, ``nodes`` has ``first`` and ``want``, the bytes wanted on the left.
    """
    found = nodes.select("first", "want", F.lit(0).cast("long").alias("prefix"))
    for shift in (2 * BITS, BITS, 0):
        inside = rows.join(found.select("first", "prefix"), "first").filter(
            F.shiftright("key", shift + BITS) == F.col("prefix")
        )
        bins = inside.groupBy("first", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("first").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("size").over(upto)).join(found.select("first", "want"), "first")
        # At most 1024 bins a node: the first that reaches the wanted bytes, or the last one.
        reached = F.min(F.when(F.col("upto") >= F.col("want"), F.struct("bin", "upto", "size")))
        last = F.max(F.struct("bin", "upto", "size"))
        pick = bins.groupBy("first", "want").agg(F.coalesce(reached, last).alias("pick"))
        found = pick.select(
            "first", (F.col("want") - (F.col("pick.upto") - F.col("pick.size"))).alias("want"),
            F.col("pick.bin").alias("prefix"),
        )
        found = written(found, "cut")
    # The last bin holds few documents: it goes to the side that it brings nearer to the wanted bytes.
    edge = rows.join(found, "first").filter("key = prefix").groupBy("first", "want", "prefix").agg(F.sum("size").alias("size"))
    return edge.select("first", F.when(2 * F.col("want") >= F.col("size"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("split"))


def kd_shards(documents: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, row, shard`` of every document, for a number of shards or bytes of a shard."""
    rows = metadata(documents)
    total = rows.agg(
        F.sum("size"), F.min("length"), F.max("length"), F.min("doc_id"), F.max("doc_id")
    ).first()  # one row
    if shards is None:
        shards = max(1, math.ceil((total[0] or 0) / max(1, target_bytes or 1)))
    low, high = total[3] or 0, total[4] or 0
    tree = rows.select(
        "doc_id", "size", "text_crc32", "row", "at_source", "at_lang",
        _scaled("length", total[1] or 0.0, total[2] or 0.0).alias("at_length"),
        _scaled("doc_id", low, high).alias("at_id"),
        F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "row"), 64 - 2 * BITS).alias("tie"),
        F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("leaves"),
    )
    # As files, the first node is a column like any other; as a constant it would turn joins into products with one row.
    tree = written(tree, "tree")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        spread = [F.struct((F.max(d) - F.min(d)).alias("spread"), F.lit(-i).alias("order")) for i, d in enumerate(DIMENSIONS)]
        nodes = tree.filter("leaves > 1").groupBy("first", "leaves").agg(
            F.sum("size").alias("bytes"), F.greatest(*spread).alias("widest")
        )
        nodes = written(
            nodes.select(
                "first", (-F.col("widest.order")).cast("int").alias("along"),
                F.floor(F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("want"),
            ),
            "nodes",
        )
        place = F.get(F.array(*DIMENSIONS), F.col("along")).cast("long")
        keyed = tree.join(nodes.select("first", "along"), "first", "left").withColumn(
            "key", F.shiftleft(place, 2 * BITS) + F.col("tie")
        )
        cut = _cut(keyed.filter("along IS NOT NULL").select("first", "key", "size"), nodes.select("first", "want"))
        left = F.floor(F.col("leaves") / 2)
        right = F.col("key") > F.col("split")
        tree = keyed.join(cut, "first", "left").select(
            "doc_id", "size", "text_crc32", "row", *DIMENSIONS, "tie",
            F.when(right, F.col("first") + left).otherwise(F.col("first")).alias("first"),
            F.when(F.col("split").isNull(), F.col("leaves")).when(right, F.col("leaves") - left).otherwise(left).alias("leaves"),
        )
        tree = written(tree, "tree")
    return tree.select("doc_id", "size", "text_crc32", "row", F.col("first").cast("int").alias("shard"))


def slots(sharded: DataFrame) -> DataFrame:
    """Adds ``slot``: the document's place in its shard, gapless from 0.

    Each shard is cut into buckets by a hash, numbered by themselves; the count of the buckets before is added.
    """
    largest = sharded.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, math.ceil(largest / BUCKET_ROWS))
    rows = sharded.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")
    return (
        rows.withColumn("place", F.row_number().over(own) - 1)
        .join(starts, ["shard", "bucket"])
        .withColumn("slot", (F.col("start") + F.col("place")).cast("long"))
        .drop("bucket", "place", "start", "row")
    )
