"""Connected components of an edge table by contraction; nothing is collected.

Each round, every node points to the least of itself and its neighbours, and the edges are renamed to what their ends point to. At most
half the nodes of a component are least among their neighbours, so nodes halve from round to round and the work of all rounds is
a small multiple of the first. The pointers of the rounds are then followed from the last to the first. Pointers are tables with one row a node, so the joins
can split a hub's many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component."""
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not levels or now.limit(1).count():
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(spark, both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        levels.append(to)
        end = lambda name, to=to: to.select(F.col("node").alias(name), F.col("to").alias(f"to_{name}"))
        moved = now.join(end("a"), "a").join(end("b"), "b").select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b"))
        after = written(spark, moved.where("a <> b").distinct())
        discard(now)
        now = after
    out = levels.pop()
    while levels:
        to, last = levels.pop(), out
        # The roots of a round that are in no edge of the next stay as they are.
        after = last.select(F.col("node").alias("to"), F.col("to").alias("root"))
        out = written(spark, to.join(after, "to", "left").select("node", F.coalesce("root", "to").alias("to")))
        discard(to, last)
    return out.withColumnRenamed("to", "root")
