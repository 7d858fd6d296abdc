"""Connected components of a link table, without gathering links anywhere.

Alternating large-star and small-star rounds: each is a partial aggregation by node and an equi-join whose
both sides are shuffled, so that adaptive execution may split a hub's partition. Each round ends in a
checkpoint; the rounds stop when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

MAX_ROUNDS = 60


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Link every neighbour of a node to the least of the node and its neighbours: the larger ones with both, else the smaller ones."""
    near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.union(near.select("v", "u"))
    least = durable(near.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m")))
    joined = near.join(least, "u")
    if both:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of a link; root is the least node that is reachable. Nodes are longs; a null end drops its link."""
    a_, b_ = F.col(a), F.col(b)
    now = durable(links.where(a_ != b_).select(F.greatest(a_, b_).alias("a"), F.least(a_, b_).alias("b")).distinct())
    before = _mark(now)
    if before[0]:
        for _ in range(MAX_ROUNDS):
            now = durable(_star(durable(_star(now, True)), False))
            after = _mark(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
