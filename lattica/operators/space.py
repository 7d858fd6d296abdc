"""Analytics over a file's blocks: best fit, overlaps, and free runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_fit(requests: DataFrame, free: DataFrame) -> DataFrame:
    """For each request (id, size) the least free block (at, size) that holds it, the first of equals; null if none.

    Distinct sizes of blocks and requests are put in one order: the block that fits is the next one after the
    wanted size. Ranges of sizes are dealt out; what a range lacks is the first block of the ranges after it.
    """
    both = requests.select("size").distinct().select("size", F.lit(1).alias("is_request"), F.lit(None).cast("long").alias("at")).unionByName(
        free.groupBy("size").agg(F.min("at").alias("at")).select("size", F.lit(0).alias("is_request"), "at")
    )
    # By powers of two of the size; a request looks in its own range, then in the least block of the later ones.
    both = both.withColumn("range", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    least = both.where("is_request = 0").groupBy("range").agg(F.min(F.struct("size", "at")).alias("b"))
    after = least.select(F.col("range").alias("r2"), F.col("b").alias("b2"))
    ranges = both.select("range").distinct()
    later = ranges.join(F.broadcast(after), F.col("r2") > F.col("range"), "left").groupBy("range").agg(F.min("b2").alias("later"))  # at most 64 ranges
    own = Window.partitionBy("range").orderBy(F.col("size").desc(), "is_request").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = F.when(F.col("is_request") == 0, F.struct("size", "at"))
    found = both.withColumn("here", F.last(block, ignorenulls=True).over(own)).where("is_request = 1").join(F.broadcast(later), "range")
    fits = found.select("size", F.coalesce("here", "later").alias("b"))
    return requests.join(fits, "size").select("id", F.col("size").alias("wanted"), F.col("b.at").alias("at"), F.col("b.size").alias("block_size"))


def overlaps(blocks: DataFrame, file_col: str = "file") -> DataFrame:
    """Blocks (file, at, size) that start before an earlier block of their file ends."""
    before = Window.partitionBy(file_col).orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.col("at") + F.col("size")).over(before)
    return blocks.withColumn("end_before", ends).where(F.col("at") < F.col("end_before"))


def coalesced(free: DataFrame, file_col: str = "file") -> DataFrame:
    """Free blocks with neighbours joined: runs where each block starts at or before the end of those before it."""
    order = Window.partitionBy(file_col).orderBy("at", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = free.withColumn("new", F.coalesce((F.col("at") > F.max(F.col("at") + F.col("size")).over(before)).cast("long"), F.lit(1)))
    x = x.withColumn("run", F.sum("new").over(order))
    return x.groupBy(file_col, "run").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("size")).alias("end"), F.count("*").alias("blocks")).select(file_col, "at", (F.col("end") - F.col("at")).alias("size"), "blocks")


def is_allocated(at: Column, size: Column, start: Column, length: Column) -> Column:
    """Whether a range shares bytes with a block."""
    return (start < at + size) & (at < start + length)
