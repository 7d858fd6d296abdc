"""Queries that go through a file of the array format: written by Spark, read back by the data source."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F

from lattica.operators import catalog
from lattica.session import shared_folder
from lattica.sources.h5array import regions, register, scan, write_catalog, write_chunks
from lattica.sources.h5types import OBJECT_REFERENCE, REGION_REFERENCE, VLEN_STRING, compound, enum_of, fixed_string, floating, integer, type_of
from lattica.sources.h5write import Writer, filter_list

from .array_queries import SLAB, SLAB_INDEX, SLAB_WHERE
from .registry import query
from .tables import E_SQL, embeddings, extent, table


def _folder(spark) -> str:
    """A new folder that driver and executors share, in the shared folder; files of the format go to mounted paths."""
    shared = re.sub("^file:(//)?", "", shared_folder(spark))
    if "://" in shared:
        raise ValueError("set spark.checkpoint.dir to a mounted folder: files of the format are not written to stores")
    path = os.path.join(shared, f"h5array-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _written(spark, sf_dir) -> str:
    register(spark)
    path = f"{_folder(spark)}/embeddings.h5"
    write_chunks(embeddings(spark, sf_dir), path, "/vectors/all", list(extent(spark, sf_dir)), [60, 10], "float32", gzip=6, shuffle=True, fletcher32=True)
    return path


@query(f"{E_SQL} SELECT i0, i1, value FROM e")
def source_round_trip(spark, sf_dir):
    """All elements through chunks with shuffle, deflate and checksum."""
    return scan(spark, _written(spark, sf_dir), "/vectors/all")


@query(f"{E_SQL} SELECT i0, i1, value, CAST({SLAB_INDEX} AS BIGINT) AS out_idx FROM e WHERE {SLAB_WHERE}")
def source_hyperslab(spark, sf_dir):
    """A selection of the file: only the chunks within its bounds are read."""
    return scan(spark, _written(spark, sf_dir), "/vectors/all", SLAB)


@query(f"{E_SQL} SELECT i0 // 60 AS c0, i1 // 10 AS c1, count(*) AS n, min(value) AS low FROM e GROUP BY ALL")
def source_chunks(spark, sf_dir):
    """Chunks as rows, cut at the edges."""
    path = _written(spark, sf_dir)
    c = spark.read.format("h5array").options(path=path, dataset="/vectors/all", form="chunks").load()
    return c.select(F.element_at("chunk", 1).alias("c0"), F.element_at("chunk", 2).alias("c1"), F.size("data").cast("long").alias("n"), F.array_min("data").alias("low"))


def _nations(spark, sf_dir) -> str:
    """A file of the regions and nations: bounded tables of 5 and 25 rows."""
    path = f"{_folder(spark)}/nations.h5"
    regions = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    with Writer(path) as w:
        for r in regions:
            w.group(f"/{r['r_name']}")
            w.attribute(f"/{r['r_name']}", "key", int(r["r_regionkey"]))
            w.attribute(f"/{r['r_name']}", "label", f"region {r['r_name']}")
        place = {r["r_regionkey"]: r["r_name"] for r in regions}
        for n in nations:
            w.dataset(f"/{place[n['n_regionkey']]}/{n['n_name']}", [float(n["n_nationkey"]), n["n_nationkey"] * 2.0], floating("float64"), dims=(2,))
        rows = [{"key": n["n_nationkey"], "name": n["n_name"], "region": n["n_regionkey"], "half": {"x": n["n_nationkey"] / 2}} for n in nations]
        w.dataset("/table", rows, compound({"key": integer(32), "name": VLEN_STRING, "region": integer(8, signed=False), "half": compound({"x": floating("float32")})}), dims=(len(rows),))
        w.dataset("/names", [n["n_name"] for n in nations], fixed_string(7), dims=(len(rows),))
        w.dataset("/ragged", [list(range(n["n_nationkey"] % 4)) for n in nations], type_of("vlen:int64"), dims=(len(rows),))
        w.dataset("/kinds", [("even", "odd")[n["n_nationkey"] % 2] for n in nations], enum_of(integer(16, big=True), {"even": 0, "odd": 1}), dims=(len(rows),))
        w.dataset("/sparse", [[n["n_nationkey"]] * 4 for n in nations], integer(64), dims=(len(rows), 4), chunks=(5, 2), filters=filter_list(8, lzf=True), skip=[(1, 1)], fill=(77).to_bytes(8, "little"))
        w.soft_link("/soft", "/table")
        w.external_link("/elsewhere", "other.h5", "/x")
        w.hard_link("/again", "/table")
    return path


@query("""SELECT '/' AS parent, r_name AS name, 'hard' AS link_type, NULL AS target_path FROM region
UNION ALL SELECT '/' || r_name, n_name, 'hard', NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT '/', x, 'hard', NULL FROM (VALUES ('table'), ('names'), ('ragged'), ('kinds'), ('sparse'), ('again')) AS v(x)
UNION ALL SELECT '/', 'soft', 'soft', '/table' UNION ALL SELECT '/', 'elsewhere', 'external', '/x'""")
def source_links(spark, sf_dir):
    register(spark)
    return spark.read.format("h5array").options(path=_nations(spark, sf_dir), table="links").load().select("parent", "name", "link_type", "target_path")


@query("SELECT '/' || r_name AS path, 'key' AS name, CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL SELECT '/' || r_name, 'label', '\"region ' || r_name || '\"' FROM region")
def source_attributes(spark, sf_dir):
    register(spark)
    return spark.read.format("h5array").options(path=_nations(spark, sf_dir), table="attributes").load().select("path", "name", "value")


@query("SELECT kind, coalesce(layout, '-') AS layout, n FROM (VALUES ('group', NULL, 6), ('dataset', 'contiguous', 30), ('dataset', 'chunked', 1)) AS v(kind, layout, n)")
def source_objects(spark, sf_dir):
    register(spark)
    o = spark.read.format("h5array").options(path=_nations(spark, sf_dir), table="objects").load()
    return o.groupBy("kind", F.coalesce("layout", F.lit("-")).alias("layout")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT n_nationkey AS key, n_name AS name, CAST(n_regionkey AS SMALLINT) AS region, CAST(n_nationkey / 2 AS FLOAT) AS x FROM nation")
def source_compound(spark, sf_dir):
    return scan(spark, _nations(spark, sf_dir), "/soft").select("value.key", "value.name", "value.region", "value.half.x")


@query("SELECT n_nationkey::BIGINT AS i0, substr(n_name, 1, 7) AS value FROM nation")
def source_strings(spark, sf_dir):
    return scan(spark, _nations(spark, sf_dir), "/names")


@query("SELECT n_nationkey::BIGINT AS i0, n_nationkey % 4 AS n, CAST((n_nationkey % 4) * (n_nationkey % 4 - 1) // 2 AS BIGINT) AS total FROM nation")
def source_vlen(spark, sf_dir):
    return scan(spark, _nations(spark, sf_dir), "/ragged").select("i0", F.size("value").alias("n"), F.aggregate("value", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT n_nationkey::BIGINT AS i0, CAST(n_nationkey % 2 AS DOUBLE) AS value FROM nation")
def source_enum_compat(spark, sf_dir):
    """Codes of an enum with big-endian base."""
    return scan(spark, _nations(spark, sf_dir), "/kinds").select("i0", F.col("value").cast("double").alias("value"))


@query("SELECT n_nationkey::BIGINT AS i0, k AS i1, CASE WHEN n_nationkey BETWEEN 5 AND 9 AND k >= 2 THEN 77 ELSE n_nationkey END::BIGINT AS value FROM nation, generate_series(0, 3) AS g(k)")
def source_sparse_fill(spark, sf_dir):
    """A chunk that was never written reads as the fill value."""
    return scan(spark, _nations(spark, sf_dir), "/sparse")




def _save(df, path: str, dataset: str, n: int, mode: str = "overwrite", **options: str) -> None:
    df.write.format("h5array").options(dataset=dataset, dims=str(n), **options).mode(mode).save(path)


def _parts(spark, sf_dir):
    """Parts by their place (their keys), and how many places there are."""
    register(spark)
    p = table(spark, sf_dir, "part")
    return p.withColumn("i0", F.col("p_partkey").cast("long")), p.agg((F.max("p_partkey") + 1).alias("n")).first()["n"] or 1


@query("SELECT p_partkey::BIGINT AS i0, p_name AS value FROM part")
def source_write_strings(spark, sf_dir):
    """Strings of any length from a DataFrame."""
    p, n = _parts(spark, sf_dir)
    path = f"{_folder(spark)}/strings.h5"
    _save(p.select("i0", F.col("p_name").alias("value")), path, "/deep/down/names", n)
    return scan(spark, path, "/deep/down/names")


@query("SELECT p_partkey::BIGINT AS i0, substr(p_brand, 1, 6) AS value FROM part")
def source_write_fixed_strings(spark, sf_dir):
    p, n = _parts(spark, sf_dir)
    path = f"{_folder(spark)}/fixed.h5"
    _save(p.select("i0", F.col("p_brand").alias("value")), path, "/brands", n, dtype="string:6", chunks="100", gzip="6")
    return scan(spark, path, "/brands")


@query("SELECT p_partkey::BIGINT AS i0, p_partkey AS id, p_retailprice AS price, CAST(p_size AS FLOAT) AS x FROM part")
def source_write_structs(spark, sf_dir):
    """Structs become compounds; of the members only those that are asked for are decoded."""
    p, n = _parts(spark, sf_dir)
    path = f"{_folder(spark)}/structs.h5"
    value = F.struct(F.col("p_partkey").alias("id"), F.struct(F.col("p_size").cast("float").alias("x"), F.lit(1).cast("short").alias("one")).alias("point"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    _save(p.select("i0", value.alias("value")), path, "/rows", n)
    return scan(spark, path, "/rows", fields="id,point,price").select("i0", "value.id", "value.price", "value.point.x")


@query("""WITH v AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1)
SELECT g.x::BIGINT AS i0, coalesce(n, 0)::BIGINT AS n, coalesce(total, 0) AS total FROM (SELECT unnest(range(0, (SELECT max(l_orderkey) + 1 FROM lineitem))) AS x) g LEFT JOIN v ON g.x = l_orderkey""")
def source_write_sequences(spark, sf_dir):
    """Sequences of any length; a place without a row holds an empty one."""
    register(spark)
    lines = table(spark, sf_dir, "lineitem")
    n = lines.agg((F.max("l_orderkey") + 1).alias("n")).first()["n"] or 1
    v = lines.groupBy(F.col("l_orderkey").cast("long").alias("i0")).agg(F.collect_list("l_quantity").alias("value"))
    path = f"{_folder(spark)}/sequences.h5"
    _save(v.sortWithinPartitions("i0"), path, "/quantities", n)  # a heap's neighbours are then read together
    return scan(spark, path, "/quantities").select("i0", F.size("value").cast("long").alias("n"), F.aggregate("value", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT o_orderkey::BIGINT AS i0, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS value FROM orders UNION ALL SELECT -1, max(p_partkey)::INTEGER FROM part")
def source_append(spark, sf_dir):
    """A second dataset added to a file: codes of named values; the first is still there."""
    p, n = _parts(spark, sf_dir)
    path = f"{_folder(spark)}/append.h5"
    _save(p.select("i0", F.col("p_partkey").alias("value")), path, "/keys", n, dtype="int64")
    orders = table(spark, sf_dir, "orders")
    last = orders.agg((F.max("o_orderkey") + 1).alias("n")).first()["n"] or 1
    _save(orders.select(F.col("o_orderkey").cast("long").alias("i0"), F.col("o_orderstatus").alias("value")), path, "/orders/status", last, mode="append", enum="O=0,F=1,P=2", dtype="int8")
    first = scan(spark, path, "/keys").agg(F.lit(-1).cast("long").alias("i0"), F.max("value").cast("int").alias("value"))
    return scan(spark, path, "/orders/status").select("i0", F.col("value").cast("int").alias("value")).union(first)


@query("""SELECT '/' AS parent, r_name AS name, 'hard' AS link_type, NULL AS target_path FROM region UNION ALL SELECT '/' || r_name, n_name, 'soft', '/' || r_name || '/none' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
UNION ALL SELECT '/' || r_name, n_name, 'external', '/data' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 1""")
def source_write_catalog(spark, sf_dir):
    """Groups and links from a DataFrame."""
    return _catalog(spark, sf_dir, "links").select("parent", "name", "link_type", "target_path")


@query("SELECT '/' || r_name AS path, 'key' AS name, CAST(r_regionkey AS VARCHAR) AS value FROM region WHERE r_regionkey > 0")
def source_write_attributes(spark, sf_dir):
    """Attributes put in, one of them in place of another, and one deleted."""
    return _catalog(spark, sf_dir, "attributes").select("path", "name", "value")


def _catalog(spark, sf_dir, kind: str):
    register(spark)
    path = f"{_folder(spark)}/catalog.h5"
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    groups = region.select(F.concat(F.lit("/"), "r_name").alias("path"), F.lit("group").alias("link_type"), F.lit(None).cast("string").alias("target_path"), F.lit(None).cast("string").alias("target_file"))
    n = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    soft = F.col("n_nationkey") % 2 == 0
    links = n.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"), F.when(soft, "soft").otherwise("external").alias("link_type"), F.when(soft, F.concat(F.lit("/"), "r_name", F.lit("/none"))).otherwise(F.lit("/data")).alias("target_path"), F.when(~soft, F.lit("other.h5")).alias("target_file"))
    at = region.select(F.concat(F.lit("/"), "r_name").alias("path"), F.lit("key").alias("name"), F.col("r_regionkey").alias("value"))
    write_catalog(spark, path, groups.union(links), at.withColumn("value", F.col("value") + 7))
    write_catalog(spark, path, attributes=at)
    write_catalog(spark, path, deleted=at.where("value = 0").drop("value"))
    return spark.read.format("h5array").options(path=path, table=kind).load()


@query("SELECT n_nationkey::BIGINT AS i0, '/' || r_name AS path, 'group' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_references(spark, sf_dir):
    """References to groups, resolved by the addresses of a file's objects."""
    register(spark)
    base, path = f"{_folder(spark)}/base.h5", f"{_folder(spark)}/references.h5"
    regions = {r["r_regionkey"]: r["r_name"] for r in table(spark, sf_dir, "region").collect()}  # five rows
    nations = [r["n_regionkey"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows

    def write(to: str, address: dict[str, int]) -> dict[str, int]:
        with Writer(to) as w:
            for name in regions.values():
                w.group(f"/{name}")
            w.dataset("/refs", [address.get(regions[k], 0) for k in nations], OBJECT_REFERENCE, dims=(len(nations),))
        objects = spark.read.format("h5array").options(path=to, table="objects").load().collect()  # a file of seven objects
        return {o["path"].strip("/"): o["address"] for o in objects}

    # Headers are placed when a file is closed: the same file written again has them at the same places.
    write(path, write(base, {}))
    objects = spark.read.format("h5array").options(path=path, table="objects").load()
    return catalog.resolve_references(scan(spark, path, "/refs"), objects).select("i0", "path", "kind")


@query("SELECT '/point' AS path, 'x' AS member, 0 AS at, 4 AS size UNION ALL SELECT '/point', 'n', 4, 8 UNION ALL SELECT '/kind', NULL, NULL, 2")
def source_named_types(spark, sf_dir):
    register(spark)
    path = f"{_folder(spark)}/types.h5"
    with Writer(path) as w:
        w.named_type("/point", compound({"x": floating("float32"), "n": integer(64)}))
        w.named_type("/kind", enum_of(integer(16), {"even": 0, "odd": 1}))
    t = spark.read.format("h5array").options(path=path, table="named_types").load()
    return t.select("path", F.explode_outer("members").alias("m"), F.col("size").alias("whole")).select("path", F.col("m.name").alias("member"), F.col("m.offset").alias("at"), F.coalesce("m.size", "whole").alias("size"))


def _part_links(spark, sf_dir, superblock: int):
    register(spark)
    path = f"{_folder(spark)}/links{superblock}.h5"
    p = table(spark, sf_dir, "part")
    groups = p.select(F.concat(F.lit("/"), "p_brand")).distinct().toDF("path").withColumn("link_type", F.lit("group")).withColumn("target_path", F.lit(None).cast("string"))
    links = p.select(F.concat(F.lit("/"), "p_brand", F.lit("/part-"), "p_partkey").alias("path"), F.lit("soft").alias("link_type"), F.concat(F.lit("/"), "p_name").alias("target_path"))
    again = p.where("p_size > 25").select(F.concat(F.lit("/"), "p_brand", F.lit("/same-"), "p_partkey").alias("path"), F.lit("hard").alias("link_type"), F.concat(F.lit("/"), "p_brand").alias("target_path"))
    write_catalog(spark, path, groups.union(links).union(again).withColumn("target_file", F.lit(None).cast("string")), superblock=superblock)
    return spark.read.format("h5array").options(path=path, table="links").load().select("parent", "name", "link_type", "target_path")


_PART_LINKS = """SELECT DISTINCT '/' AS parent, p_brand AS name, 'hard' AS link_type, NULL AS target_path FROM part UNION ALL SELECT '/' || p_brand, 'part-' || p_partkey, 'soft', '/' || p_name FROM part
UNION ALL SELECT '/' || p_brand, 'same-' || p_partkey, 'hard', NULL FROM part WHERE p_size > 25"""


@query(_PART_LINKS)
def source_indexed_groups(spark, sf_dir):
    """Groups of many links: these stand in a heap, with an index by hash."""
    return _part_links(spark, sf_dir, 2)


@query(_PART_LINKS)
def source_old_groups(spark, sf_dir):
    """The same links in an old file, in tables of names."""
    return _part_links(spark, sf_dir, 0)


@query("""SELECT n_nationkey::BIGINT AS i0, '/grid' AS path, [n_nationkey, 0]::BIGINT[] AS lo, [n_nationkey + 2, n_regionkey]::BIGINT[] AS hi FROM nation
UNION ALL SELECT n_nationkey, '/grid', [40, 5]::BIGINT[], [40, 5]::BIGINT[] FROM nation WHERE n_nationkey % 2 = 1""")
def source_regions(spark, sf_dir):
    """References to blocks of a dataset, resolved to its path and the blocks."""
    register(spark)
    folder = _folder(spark)
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows

    def write(path: str, address: int) -> int:
        with Writer(path) as w:
            w.dataset("/grid", [0.0] * 300, floating("float32"), dims=(50, 6))
            blocks = [[((r["n_nationkey"], 0), (r["n_nationkey"] + 2, r["n_regionkey"]))] + [((40, 5), (40, 5))] * (r["n_nationkey"] % 2) for r in rows]
            w.dataset("/refs", [w.region_reference(address, b) for b in blocks], REGION_REFERENCE, dims=(len(rows),))
        return spark.read.format("h5array").options(path=path, table="objects").load().where("path = '/grid'").first()["address"]

    # The same file written again has its headers at the same places.
    write(f"{folder}/regions.h5", write(f"{folder}/base.h5", 1))
    return regions(spark, f"{folder}/regions.h5", "/refs")
