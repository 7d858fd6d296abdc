"""The driver's tables in the engine's forms, shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.layout import to_long

WIDTH = 64  # values of an embedding
#: Fixed dimensions of the selections: rows that all scale factors have, and the width.
DIMS = (500, WIDTH)

#: SQL of the coordinate form.
E_SQL = "WITH e AS (SELECT vec_id AS i0, unnest(range(0, len(embedding))) AS i1, unnest(embedding) AS value FROM embeddings)"


#: SQL of the number of rows of the embeddings as an array.
ROWS_SQL = "(SELECT max(vec_id) + 1 FROM embeddings)"


def extent(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The dimensions of all embeddings as an array; an empty table has a row, as a dimension is positive."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("n")).first()["n"]
    return (1 if last is None else int(last) + 1, WIDTH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates i0, i1 (longs) and value (float) of the embeddings."""
    return to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("i1", F.col("i1").cast("long"))


def operations(spark: SparkSession, sf_dir: str, scale: float = 1e6) -> DataFrame:
    """Events as operations: views and clicks read, sign-ups and purchases write, errors delete; four keys."""
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "click"), "Read").when(kind.isin("signup", "purchase"), "Write").otherwise("Delete")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("long").alias("key"), F.col("event_id").alias("seq"), "ts", op.alias("op"), F.round(F.col("value") * scale).cast("long").alias("file_size"))


def ops_sql(scale: str = "1e6") -> str:
    return f"""WITH ops AS (SELECT user_id % 4 AS key, event_id AS seq, ts, epoch_us(ts) AS us,
  CASE WHEN event_type IN ('view','click') THEN 'Read' WHEN event_type IN ('signup','purchase') THEN 'Write' ELSE 'Delete' END AS op,
  CAST(round(value * {scale}) AS BIGINT) AS file_size FROM events)"""


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as attributes: object, name, value; parts of odd keys lack a size."""
    p = table(spark, sf_dir, "part")
    wide = p.select(F.col("p_partkey").alias("object"), F.col("p_name").alias("name_"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).alias("size"))
    long = wide.unpivot(["object"], ["name_", "brand", "kind", "size"], "name", "value")
    return long.where("value is not null")


A_SQL = """WITH a AS (SELECT object, name, value FROM (
  SELECT p_partkey AS object, 'name_' AS name, p_name AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part
  UNION ALL SELECT p_partkey, 'kind', p_type FROM part UNION ALL SELECT p_partkey, 'size', CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) END FROM part
) WHERE value IS NOT NULL)"""


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and customers as a tree: links (parent, name, link_type, target) and kinds (address, kind).

    Addresses: 0 the root, 1,000 + region, 2,000 + nation, 10,000 + customer. Each region also links back to the root.
    """
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    r = region.select(F.lit(0).cast("long").alias("parent"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 1000).cast("long").alias("target"))
    up = region.select((F.col("r_regionkey") + 1000).cast("long").alias("parent"), F.lit("up").alias("name"), F.lit(0).cast("long").alias("target"))
    n = nation.select((F.col("n_regionkey") + 1000).cast("long").alias("parent"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 2000).cast("long").alias("target"))
    c = customer.select((F.col("c_nationkey") + 2000).cast("long").alias("parent"), F.col("c_name").alias("name"), (F.col("c_custkey") + 10000).cast("long").alias("target"))
    links = r.union(up).union(n).union(c).withColumn("link_type", F.lit("hard"))
    kinds = spark.createDataFrame([(0, "group")], "address bigint, kind string")
    kinds = kinds.union(region.select((F.col("r_regionkey") + 1000).cast("long"), F.lit("group"))).union(nation.select((F.col("n_nationkey") + 2000).cast("long"), F.lit("group"))).union(customer.select((F.col("c_custkey") + 10000).cast("long"), F.lit("dataset")))
    return links, kinds


L_SQL = """WITH RECURSIVE links AS (
  SELECT 0::BIGINT AS parent, r_name AS name, (r_regionkey + 1000)::BIGINT AS target FROM region
  UNION ALL SELECT r_regionkey + 1000, 'up', 0 FROM region
  UNION ALL SELECT n_regionkey + 1000, n_name, n_nationkey + 2000 FROM nation
  UNION ALL SELECT c_nationkey + 2000, c_name, c_custkey + 10000 FROM customer
), kinds AS (
  SELECT 0::BIGINT AS address, 'group' AS kind UNION ALL SELECT r_regionkey + 1000, 'group' FROM region
  UNION ALL SELECT n_nationkey + 2000, 'group' FROM nation UNION ALL SELECT c_custkey + 10000, 'dataset' FROM customer
)"""
