"""Connected components of a graph given by its links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boletim.llm.common import packed, written

#: Links up to which every task is sent all labels (two numbers each) instead of shuffling them.
SENT_LINKS = 250_000


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node each node of the links ``a, b`` reaches.

    Every round gives each node the smallest label beside it, then the label of that label, so a chain shortens by
    half. Nodes without links are not in the result. A node with many links costs rows of its own only: labels are
    reduced before they are shuffled, and adaptive execution splits its part of a join. The links are counted first, so they
    had better be stored.
    """
    edges = links.select("a", "b").filter("a <> b")
    number = edges.count()
    few = F.broadcast if number <= SENT_LINKS else lambda df: df
    edges = written(packed(edges.union(edges.select("b", "a")).distinct(), 2 * number), "links")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    labels = written(packed(labels, 2 * number), "labels")
    while True:
        beside = edges.join(few(labels), F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        near = beside.join(few(labels), F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("near")
        )
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("further"))
        # Every label is itself a node with links, so the join keeps all rows.
        found = near.join(few(up), F.col("near") == F.col("up")).select(
            "node", "old", F.least("near", "further").alias("component")
        )
        found = written(packed(found, 2 * number), "labels")
        changed = found.filter("old <> component").limit(1).count()
        labels = found.select("node", "component")
        if not changed:
            return labels
