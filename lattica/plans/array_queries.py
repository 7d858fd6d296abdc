"""Queries over arrays: scans, selections, chunks, extents and index arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import shapes
from lattica.operators import layout
from lattica.operators.selection import Hyperslab, hyperslab, slice_nd

from .registry import query
from .tables import DIMS, E_SQL, ROWS_SQL, WIDTH, embeddings, extent, table

CHUNKS = (100, 10)
SLAB = Hyperslab.of((10, 8), (25, 8), (2, 4), (1, 2))
CUBE = (500, 8, 8)
CUBE_SLAB = Hyperslab.of((3, 1, 0), (20, 3, 2), (7, 2, 4), (2, 1, 3))


@query(f"{E_SQL} SELECT i0, i1, CAST(value AS DOUBLE) AS value FROM e")
def read_full_f64(spark, sf_dir):
    return embeddings(spark, sf_dir).withColumn("value", F.col("value").cast("double"))


@query("SELECT vec_id, generate_series AS k, CAST(embedding[generate_series + 9] AS DOUBLE) AS value FROM embeddings, generate_series(1, 12) WHERE vec_id >= 20 AND vec_id < 60")
def slice_rows(spark, sf_dir):
    """A box in row form: rows by predicate, the last dimension by slice()."""
    e = table(spark, sf_dir, "embeddings").where("vec_id >= 20 and vec_id < 60")
    return e.select("vec_id", F.posexplode(F.slice("embedding", 10, 12)).alias("k", "value")).select("vec_id", (F.col("k") + 1).cast("long").alias("k"), F.col("value").cast("double").alias("value"))


@query(f"{E_SQL} SELECT i0, i1, value FROM e WHERE i0 >= 20 AND i0 < 60 AND i1 >= 9 AND i1 < 21")
def slice_box(spark, sf_dir):
    return slice_nd(embeddings(spark, sf_dir), (20, 9), (40, 12), DIMS)


@query(f"{E_SQL} SELECT i0, i1, value FROM e WHERE false")
def slice_empty(spark, sf_dir):
    """A count of zero selects nothing."""
    return slice_nd(embeddings(spark, sf_dir), (20, 9), (0, 12), DIMS)


SLAB_WHERE = "i0 >= 10 AND i0 < 59 AND (i0 - 10) % 2 < 1 AND i1 >= 8 AND i1 < 38 AND (i1 - 8) % 4 < 2"
SLAB_INDEX = "((i0 - 10) // 2) * 16 + ((i1 - 8) // 4) * 2 + (i1 - 8) % 4"


@query(f"{E_SQL} SELECT i0, i1, value, CAST({SLAB_INDEX} AS BIGINT) AS out_idx FROM e WHERE {SLAB_WHERE}")
def hyperslab_stride_block_2d(spark, sf_dir):
    return hyperslab(embeddings(spark, sf_dir), SLAB, DIMS)


@query(f"{E_SQL} SELECT (i0 - 10) // 2 AS out_row, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean FROM e WHERE {SLAB_WHERE} GROUP BY 1")
def hyperslab_row_means(spark, sf_dir):
    s = hyperslab(embeddings(spark, sf_dir), SLAB, DIMS, None).withColumn("out_row", SLAB.output_coords()[0])
    return s.groupBy("out_row").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"))


@query(f"""{E_SQL}, c AS (SELECT i0, i1 // 8 AS j, i1 % 8 AS k, value FROM e)
SELECT i0, j AS i1, k AS i2, value,
  CAST((((i0 - 3) // 7) * 2 + (i0 - 3) % 7) * 18 + ((j - 1) // 2) * 6 + (k // 4) * 3 + k % 4 AS BIGINT) AS out_idx
FROM c WHERE i0 >= 3 AND i0 < 138 AND (i0 - 3) % 7 < 2 AND j >= 1 AND j < 6 AND (j - 1) % 2 < 1 AND k >= 0 AND k < 7 AND k % 4 < 3""")
def hyperslab_3d(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    i0, j, k = shapes.delinearise(F.col("i0") * WIDTH + F.col("i1"), (1 << 40, 8, 8))
    return hyperslab(e.select(i0.alias("i0"), j.alias("i1"), k.alias("i2"), "value"), CUBE_SLAB, CUBE)


@query(f"""{E_SQL} SELECT i0, i1, i0 * 64 + i1 AS linear, (i0 * 64 + i1) // 640 AS a, ((i0 * 64 + i1) // 32) % 20 AS b, (i0 * 64 + i1) % 32 AS c
FROM e""")
def linear_and_back(spark, sf_dir):
    """Row-major offsets, and their coordinates in another shape."""
    e = embeddings(spark, sf_dir)
    linear = shapes.linear_offset([F.col("i0"), F.col("i1")], DIMS)
    a, b, c = shapes.delinearise(F.col("linear"), (1 << 40, 20, 32))
    return e.select("i0", "i1", linear.alias("linear")).select("i0", "i1", "linear", a.alias("a"), b.alias("b"), c.alias("c"))


@query("SELECT l_linenumber AS n, count(*) AS lines, CAST(l_linenumber * 3 * 5 AS BIGINT) AS elements FROM lineitem GROUP BY 1")
def output_sizes(spark, sf_dir):
    """Elements of a selection as the product of an array of sizes."""
    dims = F.array(F.col("n").cast("long"), F.lit(3).cast("long"), F.lit(5).cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(F.count("*").alias("lines")).withColumn("elements", shapes.total_elements(dims))


@query(f"""{E_SQL} SELECT i0 // 100 AS c0, i1 // 10 AS c1, count(*) AS n, min(value) AS low, max(value) AS high,
  least(100, {ROWS_SQL} - (i0 // 100) * 100) AS rows, least(10, 64 - (i1 // 10) * 10) AS cols FROM e GROUP BY ALL""")
def chunk_iterate(spark, sf_dir):
    """Each chunk with its shape, cut at the edges."""
    e = embeddings(spark, sf_dir)
    rows, _ = extent(spark, sf_dir)
    c = layout.with_chunks(e, CHUNKS).groupBy("c0", "c1").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return c.withColumns({"rows": shapes.clamped(F.col("c0"), 100, rows), "cols": shapes.clamped(F.col("c1"), 10, WIDTH)})


@query(f"""{E_SQL} SELECT i0 // 100 AS c0, i1 // 10 AS c1, count(*) AS n, round(sum(CAST(value AS DOUBLE) * ((i0 % 100) * least(10, 64 - (i1 // 10) * 10) + i1 % 10)), 4) AS checksum
FROM e GROUP BY ALL""")
def chunk_form(spark, sf_dir):
    """Chunks as arrays in row-major order: the sum of value times place says that the order is right."""
    c = layout.to_chunks(embeddings(spark, sf_dir), extent(spark, sf_dir), CHUNKS)
    weighted = F.aggregate(F.transform("data", lambda v, i: v.cast("double") * i), F.lit(0.0), lambda a, x: a + x)
    return c.select("c0", "c1", F.size("data").cast("long").alias("n"), F.round(weighted, 4).alias("checksum"))


@query("""SELECT a.x AS c0, b.x AS c1 FROM generate_series(0, 9) AS a(x), generate_series(0, 12) AS b(x)
WHERE EXISTS (SELECT 1 FROM generate_series(0, 5) AS k(x) WHERE 7 + k.x * 90 <= a.x * 50 + 49 AND 7 + k.x * 90 + 20 > a.x * 50)
AND EXISTS (SELECT 1 FROM generate_series(0, 3) AS k(x) WHERE 2 + k.x * 17 <= b.x * 5 + 4 AND 2 + k.x * 17 + 3 > b.x * 5)""")
def chunk_overlap_prune(spark, sf_dir):
    """Chunks that a selection touches, those between its blocks left out."""
    return layout.overlapping_chunks(spark, Hyperslab.of((7, 2), (6, 4), (90, 17), (20, 3)), (500, 65), (50, 5))


@query("""SELECT a.x AS c0, b.x AS c1 FROM generate_series(0, 4) AS a(x), generate_series(0, 6) AS b(x)""")
def chunk_grid(spark, sf_dir):
    return layout.grid(spark, DIMS, CHUNKS)


@query(f"""{E_SQL} SELECT i0, i1, CASE WHEN (i0 // 100 + i1 // 10) % 3 = 0 THEN 0.0 ELSE value END::FLOAT AS value FROM e""")
def sparse_chunk_fill(spark, sf_dir):
    """Chunks that were never written read as the fill value."""
    e, dims = embeddings(spark, sf_dir), extent(spark, sf_dir)
    written = layout.with_chunks(e, CHUNKS).where("(c0 + c1) % 3 <> 0").select("i0", "i1", "value")
    cells = spark.range(shapes.safe_product(dims)).select(*[c.alias(f"i{k}") for k, c in enumerate(shapes.delinearise(F.col("id"), dims))])
    return layout.fill_sparse(written, cells, 2, F.lit(0.0).cast("float"))


@query(f"""{E_SQL} SELECT i0, count(*) AS n, round(sum(CAST(value AS DOUBLE) * i1), 4) AS checksum FROM e GROUP BY i0""")
def regrid_assemble(spark, sf_dir):
    """Chunks put together into rows again."""
    c = layout.to_chunks(embeddings(spark, sf_dir), extent(spark, sf_dir), CHUNKS)
    rows = layout.to_rows(layout.from_chunks(c, 2), 2)
    weighted = F.aggregate(F.transform("values", lambda v, i: v.cast("double") * i), F.lit(0.0), lambda a, x: a + x)
    return rows.select("i0", F.size("values").cast("long").alias("n"), F.round(weighted, 4).alias("checksum"))


@query(f"""{E_SQL}, g AS (SELECT unnest(range(0, {ROWS_SQL} + 20)) AS i0, b.x AS i1 FROM generate_series(0, 69) AS b(x))
SELECT g.i0, g.i1, coalesce(e.value, 0.0)::FLOAT AS value FROM g LEFT JOIN e ON g.i0 = e.i0 AND g.i1 = e.i1""")
def resize_grow(spark, sf_dir):
    rows, width = extent(spark, sf_dir)
    return layout.resize(embeddings(spark, sf_dir), (rows, width), (rows + 20, 70), (None, None))


@query(f"{E_SQL} SELECT i0, i1, value FROM e WHERE i0 < 123 AND i1 < 45")
def resize_shrink(spark, sf_dir):
    return layout.resize(embeddings(spark, sf_dir), DIMS, (123, 45), (None, 128))


@query(f"""{E_SQL} SELECT i0, i1 // 8 AS r, round(sum(CAST(value AS DOUBLE)), 5) AS total FROM e GROUP BY ALL""")
def array_type_reshape(spark, sf_dir):
    """64 values as 8 rows of 8."""
    from lattica.operators.compound import reshape

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode(reshape(F.col("embedding"), 8, 8)).alias("r", "row"))
    return e.select("i0", F.col("r").cast("long").alias("r"), F.round(F.aggregate("row", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query(f"""{E_SQL}, b AS (SELECT i0, i1 * 4 + k AS src, k * 64 + i1 AS dst FROM e, generate_series(0, 3) AS g(k))
SELECT i0, count(*) AS n, sum(src * dst)::BIGINT AS checksum, max(dst) AS last FROM b GROUP BY i0""")
def shuffle_index_map(spark, sf_dir):
    """Where the byte transposition puts each byte of a row of float32 values."""
    e = embeddings(spark, sf_dir).select("i0", "i1", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    src, dst = F.col("i1") * 4 + F.col("k"), F.col("k") * WIDTH + F.col("i1")
    return e.groupBy("i0").agg(F.count("*").alias("n"), F.sum(src * dst).alias("checksum"), F.max(dst).alias("last"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 1000000000000 AS product, CASE WHEN l_quantity > 9 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 1000000000000000000 END AS checked FROM lineitem")
def overflow_safe_multiply(spark, sf_dir):
    """Products that don't fit 64 bits are null."""
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q * F.lit(10**12)).alias("product"), shapes.checked_multiply(q, F.lit(10**18)).alias("checked"))
