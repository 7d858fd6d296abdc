"""Queries over trees, links, attributes and a file's space."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import catalog, space

from .registry import query
from .tables import A_SQL, L_SQL, attributes, table, tree


@query(f"""{L_SQL}, walked AS (
  SELECT '/' || name AS path, target, kind, 1 AS depth, [parent] AS seen FROM links JOIN kinds ON target = address WHERE parent = 0
  UNION ALL SELECT w.path || '/' || l.name, l.target, k.kind, w.depth + 1, list_append(w.seen, l.parent)
  FROM walked w JOIN links l ON l.parent = w.target JOIN kinds k ON l.target = k.address WHERE w.kind = 'group' AND NOT list_contains(w.seen, w.target)
) SELECT path || CASE WHEN kind = 'group' THEN '/' ELSE '' END AS path, target AS address, kind, depth FROM walked""")
def tree_walk(spark, sf_dir):
    """All paths of a tree with links back to its root: cycles are listed and end."""
    links, kinds = tree(spark, sf_dir)
    return catalog.walk(links, kinds, 0)


@query(f"{L_SQL} SELECT target AS address, count(*) AS refcount FROM links GROUP BY 1")
def hardlink_refcount(spark, sf_dir):
    return catalog.refcounts(tree(spark, sf_dir)[0])


@query("""SELECT '/s/' || c_custkey AS path, '/c/' || (c_custkey + 20) AS target_path, CASE WHEN c_custkey + 20 <= (SELECT max(c_custkey) FROM customer) THEN c_custkey + 20 END AS address FROM customer
UNION ALL SELECT '/t/' || c_custkey, '/s/' || c_custkey, CASE WHEN c_custkey + 20 <= (SELECT max(c_custkey) FROM customer) THEN c_custkey + 20 END FROM customer""")
def softlink_resolve(spark, sf_dir):
    """Soft links to objects, to other soft links, and to nothing."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    paths = c.select(F.concat(F.lit("/c/"), k).alias("path"), k.alias("address"))
    soft = c.select(F.concat(F.lit("/s/"), k).alias("path"), F.concat(F.lit("/c/"), k + 20).alias("target_path")).union(c.select(F.concat(F.lit("/t/"), k), F.concat(F.lit("/s/"), k)))
    return catalog.resolve_soft(soft.withColumn("link_type", F.lit("soft")), paths)


@query("SELECT '/c/' || (c_custkey + 20) AS target_path, '/s/' || c_custkey AS path FROM customer WHERE c_custkey + 20 > (SELECT max(c_custkey) FROM customer)")
def softlink_dangling(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    links = c.select(F.concat(F.lit("/s/"), k).alias("path"), F.concat(F.lit("/c/"), k + 20).alias("target_path"), F.lit("soft").alias("link_type"))
    return catalog.dangling(links, c.select(F.concat(F.lit("/c/"), k).alias("path"))).select("target_path", "path")


@query("""SELECT parent, name, target FROM (SELECT c_nationkey + 2000 AS parent, c_name AS name, c_custkey + 10000 AS target FROM customer
UNION ALL SELECT 2000, 'extra ' || c_custkey, c_custkey + 10000 FROM customer WHERE c_custkey % 5 = 0)""")
def add_hard_links(spark, sf_dir):
    """More names for objects that exist."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    links = c.select((F.col("c_nationkey") + 2000).alias("parent"), F.col("c_name").alias("name"), F.lit("hard").alias("link_type"), (k + 10000).alias("target"))
    paths = c.select(F.concat(F.lit("/"), "c_name").alias("path"), (k + 10000).alias("address"))
    new = c.where("c_custkey % 5 = 0").select(F.lit(2000).alias("parent"), F.concat(F.lit("extra "), k).alias("name"), F.concat(F.lit("/"), "c_name").alias("target_path"))
    return catalog.add_hard_links(links, new, paths).select("parent", "name", "target")


@query(f"""{L_SQL}, kept AS (SELECT * FROM links WHERE NOT (target >= 10000 AND target % 3 = 0))
SELECT address, kind FROM kinds WHERE address < 10000 OR address IN (SELECT target FROM kept)""")
def delete_cascade(spark, sf_dir):
    """Objects after a third of the data sets were unlinked."""
    links, kinds = tree(spark, sf_dir)
    doomed = links.where("target >= 10000 and target % 3 = 0").select("parent", "name", "target")
    return catalog.delete_links(links, kinds, doomed)[1].select("address", "kind")


@query(f"{L_SQL} SELECT l.parent, l.name, l.target FROM links l WHERE l.target >= 2000 AND l.target < 10000 AND l.target IN (SELECT parent FROM links)")
def nonempty_guard(spark, sf_dir):
    """Deletes that are refused, for the group has members."""
    links, _ = tree(spark, sf_dir)
    return catalog.blocked_deletes(links, links.where("target >= 2000").select("parent", "name", "target"))


@query(f"{L_SQL} SELECT parent, name, row_number() OVER (PARTITION BY parent ORDER BY name) AS place FROM links")
def name_listing(spark, sf_dir):
    return catalog.listing(tree(spark, sf_dir)[0]).select("parent", "name", F.col("place").cast("long").alias("place"))


@query(f"""{A_SQL}, c AS (SELECT p_partkey AS object, 'size' AS name, 'new ' || p_size AS value FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(c.object, a.object) AS object, coalesce(c.name, a.name) AS name, coalesce(c.value, a.value) AS value FROM a FULL JOIN c ON a.object = c.object AND a.name = c.name""")
def attr_upsert(spark, sf_dir):
    """Create or replace; of two changes the later holds."""
    part = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    first = part.select(F.col("p_partkey").alias("object"), F.lit("size").alias("name"), F.lit("old").alias("value"), F.lit(1).cast("long").alias("version"))
    second = part.select("p_partkey", F.lit("size"), F.concat(F.lit("new "), "p_size"), F.lit(2).cast("long"))
    return catalog.upsert(attributes(spark, sf_dir), first.union(second)).select("object", "name", "value")


@query(f"{A_SQL} SELECT object, name, value FROM a WHERE NOT (name = 'brand' AND object % 7 = 0)")
def attr_delete(spark, sf_dir):
    a = attributes(spark, sf_dir)
    return catalog.delete_attributes(a, a.where("name = 'brand' and object % 7 = 0").select("object", "name"))


@query("SELECT l_orderkey AS object, count(*) AS n, CASE WHEN count(*) > 8 THEN 'dense' ELSE 'compact' END AS storage FROM lineitem GROUP BY 1")
def attr_storage_tier(spark, sf_dir):
    return catalog.attribute_storage(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object")))


@query("SELECT object, count(*) AS attributes, max(kind) AS kind FROM (SELECT p_partkey AS object, 'dataset' AS kind FROM part JOIN lineitem ON p_partkey = l_partkey) GROUP BY 1")
def object_attributes(spark, sf_dir):
    """Objects with their attributes: a join on the address."""
    objects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object"), F.lit("dataset").alias("kind"))
    own = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("object"))
    return objects.join(own, "object").groupBy("object").agg(F.count("*").alias("attributes"), F.max("kind").alias("kind"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'dataset' WHEN 1 THEN 'group' WHEN 2 THEN 'datatype' ELSE 'unknown' END AS kind FROM nation")
def object_kinds(spark, sf_dir):
    """Kinds from the messages that headers have."""
    m = F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("datatype"), F.lit("dataspace"), F.lit("layout"))).when(F.col("n_nationkey") % 4 == 1, F.array(F.lit("link_info"))).when(F.col("n_nationkey") % 4 == 2, F.array(F.lit("datatype"))).otherwise(F.array(F.lit("comment")))
    return table(spark, sf_dir, "nation").select("n_nationkey", catalog.object_kind(m).alias("kind"))


@query("SELECT o.o_orderkey, h.l_linenumber AS index, h.l_partkey AS data FROM orders o JOIN lineitem h ON h.l_orderkey = o.o_orderkey WHERE h.l_linenumber = 1 + o.o_orderkey % 3")
def heap_lookup_join(spark, sf_dir):
    """References (collection, index) to what they stand for."""
    refs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("collection"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("index"))
    heap = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("collection"), F.col("l_linenumber").alias("index"), F.col("l_partkey").alias("data"))
    return refs.join(heap, ["collection", "index"]).select("o_orderkey", "index", "data")


@query("""WITH free AS (SELECT doc_id * 100000 AS "at", n_chars AS size FROM documents), req AS (SELECT page_id AS id, length(html)::BIGINT AS wanted FROM pages)
SELECT id, wanted, (SELECT min("at") FROM free WHERE size = b) AS "at", b AS block_size FROM (SELECT id, wanted, (SELECT min(size) FROM free WHERE size >= wanted) AS b FROM req)""")
def best_fit_alloc(spark, sf_dir):
    """For each request the least block that holds it."""
    free = table(spark, sf_dir, "documents").select((F.col("doc_id") * 100000).alias("at"), F.col("n_chars").alias("size"))
    want = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("size"))
    return space.best_fit(want, free)


BLOCKS = '(SELECT l_orderkey // 100 AS file, l_orderkey % 100 * 50 + l_linenumber * 10 AS "at", CAST(l_quantity AS BIGINT) AS size FROM lineitem)'


def _blocks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("file"), (F.col("l_orderkey") % 100 * 50 + F.col("l_linenumber") * 10).alias("at"), F.col("l_quantity").cast("long").alias("size"))


@query(f"""WITH b AS {BLOCKS}, w AS (SELECT *, max("at" + size) OVER (PARTITION BY file ORDER BY "at", size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM b)
SELECT file, "at", size, e AS end_before FROM w WHERE "at" < e""")
def block_overlaps(spark, sf_dir):
    return space.overlaps(_blocks(spark, sf_dir)).select("file", "at", "size", "end_before")


@query(f"""WITH b AS {BLOCKS}, w AS (SELECT *, CASE WHEN "at" > max("at" + size) OVER (PARTITION BY file ORDER BY "at", size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM b),
r AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY "at", size ROWS UNBOUNDED PRECEDING) AS run FROM w)
SELECT file, min("at") AS "at", max("at" + size) - min("at") AS size, count(*) AS blocks FROM r GROUP BY file, run""")
def free_coalesce(spark, sf_dir):
    return space.coalesced(_blocks(spark, sf_dir))


@query(f"SELECT file, count(*) FILTER (2000 < \"at\" + size AND \"at\" < 2100) AS touching, count(*) FILTER (2000 < \"at\" + size AND \"at\" < 2100) > 0 AS allocated FROM {BLOCKS} b GROUP BY file")
def range_allocated(spark, sf_dir):
    """Whether a range of each file is allocated, and by how many blocks."""
    hit = space.is_allocated(F.col("at"), F.col("size"), F.lit(2000), F.lit(100))
    return _blocks(spark, sf_dir).groupBy("file").agg(F.count_if(hit).alias("touching")).withColumn("allocated", F.col("touching") > 0)
