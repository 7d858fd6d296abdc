"""A file's tree as tables: objects, links and attributes, and what changes them.

objects(address, kind, path) with kind group, dataset or datatype; links(parent, name, link_type, target,
target_path, target_file) with link_type hard, soft or external: hard links name an address, soft links a
path, external links a file and a path. attributes(object, name, value, …).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import durable

COMPACT_MOST = 8
SOFT_LINK_DEPTH = 32
MOST_LEVELS = 128


def walk(links: DataFrame, kinds: DataFrame, root: object, most_levels: int = MOST_LEVELS) -> DataFrame:
    """(path, address, kind, depth) of all that hard links reach from the root; groups end in a slash.

    A group that is met again below itself is listed but not entered, so cycles end. One join a level; no
    level is gathered on the driver. A tree of more than ``most_levels`` levels is an error.
    """
    hard = links.where("link_type = 'hard'").select(F.col("parent").alias("from_"), "name", F.col("target").alias("to_"))
    known = hard.join(kinds.select(F.col("address").alias("to_"), "kind"), "to_")
    level = known.where(F.col("from_") == F.lit(root)).select(F.concat(F.lit("/"), "name").alias("path"), F.col("to_").alias("address"), "kind", F.array(F.col("from_")).alias("seen"))
    found, depth = None, 1
    while True:
        level = durable(level)
        if level.isEmpty():
            break
        if depth > most_levels:
            raise ValueError(f"the tree has more than {most_levels} levels")
        shown = level.select(F.when(F.col("kind") == "group", F.concat("path", F.lit("/"))).otherwise(F.col("path")).alias("path"), "address", "kind", F.lit(depth).alias("depth"))
        found = shown if found is None else found.union(shown)
        inside = level.where((F.col("kind") == "group") & ~F.array_contains("seen", F.col("address"))).select(F.col("path").alias("above"), F.col("address").alias("from_"), "seen")
        level = inside.join(known, "from_").select(F.concat("above", F.lit("/"), "name").alias("path"), F.col("to_").alias("address"), "kind", F.concat("seen", F.array("from_")).alias("seen"))
        depth += 1
    if found is None:
        return level.select("path", "address", "kind", F.lit(0).alias("depth"))
    return found


def resolve_soft(links: DataFrame, paths: DataFrame, most: int = SOFT_LINK_DEPTH) -> DataFrame:
    """(path, target_path, address) of soft links: chains are followed up to a depth; null addresses dangle or go round.

    links: path, link_type and target_path of each link; paths: path and address of each object.
    """
    soft = links.where("link_type = 'soft'").select("path", F.col("target_path").alias("goal"))
    step = soft.select(F.col("path").alias("goal"), F.col("goal").alias("further"))
    now = soft.withColumn("target_path", F.col("goal"))
    for _ in range(most):
        now = durable(now.join(step, "goal", "left").select("path", "target_path", F.coalesce("further", "goal").alias("goal"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    now = now.join(paths.select(F.col("path").alias("goal"), "address"), "goal", "left")
    return now.select("path", "target_path", "address")


def refcounts(links: DataFrame) -> DataFrame:
    return links.where("link_type = 'hard'").groupBy(F.col("target").alias("address")).agg(F.count("*").alias("refcount"))


def dangling(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Soft links whose target is no object's path."""
    return links.where("link_type = 'soft'").join(paths.select(F.col("path").alias("target_path")), "target_path", "left_anti")


def add_hard_links(links: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """Links with new ones (parent, name, target_path) whose targets exist; a target that doesn't is an error."""
    aim = new.join(paths.select(F.col("path").alias("target_path"), F.col("address").alias("target")), "target_path", "left")
    checked = aim.withColumn("target", F.when(F.col("target").isNull(), F.raise_error(F.concat(F.lit("no such object: "), "target_path"))).otherwise(F.col("target")))
    return links.unionByName(checked.select("parent", "name", F.lit("hard").alias("link_type"), "target"), allowMissingColumns=True)


def blocked_deletes(links: DataFrame, doomed: DataFrame) -> DataFrame:
    """Of links (parent, name, target) to be deleted, those whose last link would leave a group with members."""
    left = refcounts(links)
    last = doomed.join(left, doomed["target"] == left["address"]).where("refcount = 1").select("parent", "name", "target")
    members = links.select(F.col("parent").alias("inside")).distinct()
    return last.join(members, last["target"] == members["inside"], "left_semi")


def delete_links(links: DataFrame, objects: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and objects after deletes that were checked: objects without a link left go, with what they own."""
    kept = links.join(doomed.select("parent", "name"), ["parent", "name"], "left_anti")
    gone = doomed.select("target").distinct().join(refcounts(kept), F.col("target") == F.col("address"), "left_anti")
    return kept, objects.join(gone.select(F.col("target").alias("address")), "address", "left_anti")


def upsert(attributes: DataFrame, changes: DataFrame, keys: Sequence[str] = ("object", "name")) -> DataFrame:
    """Attributes with changes put in or in place of those with the same key; of several changes the last (by ``version``, then value) holds."""
    version = "version"
    old = attributes if version in attributes.columns else attributes.withColumn(version, F.lit(-1).cast("long"))
    both = old.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("x"))
    return best.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest if c != version])


def delete_attributes(attributes: DataFrame, doomed: DataFrame, keys: Sequence[str] = ("object", "name"), strict: bool = True) -> DataFrame:
    """Attributes without those named; with strict, a name that is not there is an error."""
    names = doomed.select(*keys).distinct()
    if strict:
        missing = names.join(attributes, list(keys), "left_anti").select(F.concat_ws(".", *keys).alias("m")).take(1)
        if missing:
            raise KeyError(f"no such attribute: {missing[0]['m']}")
    return attributes.join(names, list(keys), "left_anti")


def attribute_storage(attributes: DataFrame, key: str = "object", most: int = COMPACT_MOST) -> DataFrame:
    """Attributes of each object, and whether they are kept in its header or in an index."""
    return attributes.groupBy(key).agg(F.count("*").alias("n")).withColumn("storage", F.when(F.col("n") > most, "dense").otherwise("compact"))


def listing(links: DataFrame) -> DataFrame:
    """Links with their place in their group's listing, by the bytes of the name."""
    return links.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.col("name").cast("binary"))))


def object_kind(messages: Column) -> Column:
    """Kind from the names of a header's messages."""
    has = lambda *names: F.arrays_overlap(messages, F.array(*[F.lit(n) for n in names]))
    return F.when(has("layout"), "dataset").when(has("symbol_table", "link_info", "link"), "group").when(has("datatype") & ~has("dataspace"), "datatype").otherwise("unknown")


def resolve_references(values: DataFrame, objects: DataFrame, column: str = "value") -> DataFrame:
    """Object references (addresses) with the path and kind of what they refer to; nulls where nothing has that address.

    Of an object with several paths the first by its bytes is given.
    """
    first = objects.groupBy(F.col("address").alias("at")).agg(F.min(F.struct("path", "kind")).alias("x"))
    return values.join(first, values[column] == first["at"], "left").select(*values.columns, F.col("x.path").alias("path"), F.col("x.kind").alias("kind"))


def index_order(names: DataFrame, hash_col: str = "hash", name_col: str = "name", *groups: str) -> DataFrame:
    """Names with their place in an index: by hash, then by the bytes of the name; within groups if there are any."""
    order = Window.partitionBy(*groups) if groups else Window.partitionBy()
    return names.withColumn("place", F.row_number().over(order.orderBy(hash_col, F.col(name_col).cast("binary"))))


def index_lookup(index: DataFrame, wanted: DataFrame, hash_col: str = "hash", name_col: str = "name") -> DataFrame:
    """The index's rows of wanted names (with their hashes): hashes meet first, names tell apart those that share one."""
    w = wanted.select(F.col(hash_col).alias("h_"), F.col(name_col).alias("n_")).distinct()
    return index.join(w, (F.col(hash_col) == F.col("h_")) & (F.col(name_col) == F.col("n_"))).drop("h_", "n_")
