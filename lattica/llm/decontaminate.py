r"""Operator 10: benchmark decontamination by canonical templates, with DataFrame functions alone.

Numbers, names (capitalised words inside a sentence) and units (after a number) become typed placeholders;
punctuation goes and the rest is lower-cased, so a re-parameterised question has the template of the
original. Windows of WIDTH template words are hashed and joined with those of the benchmark. A window of fewer
than LEAST_PLAIN plain words is hashed with the values in its places: runs of numbers or names are one template,
which says nothing. A window with names is also hashed with the lower-cased words in their places, on both
sides: letter case says what a name is, so a copy in capitals, in title case or without any has other names but
the same folded windows. Items that have enough of their windows in a document are its candidates; then the
matches are gathered by document, item and shift, and a shift counts if its slots are consistent: each value of
the item stands for one value of the document. A document is contaminated by an item if the consistent windows
are half of the item's different windows, or LEAST_WINDOWS of them.

Items of fewer words than a window are one window of their own length, with all values. Items of fewer than
LEAST_SHORT words (which are in most texts) are found only where they are a document's whole text.

Only document ids, positions, hashes and the few slot values of windows that the benchmark has leave a document.
The benchmark's sizes are measured; up to BROADCAST_KEYS hashes and BROADCAST_BYTES of windows are broadcast, beyond that the joins shuffle.

Cases: null or empty texts match nothing; null and empty items are not looked for. Rows with one id are one document. Rows of the benchmark with one id and
several texts are several items that share the id. Null ids are ids. An empty table on either side gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

WIDTH = 8
SHARE, LEAST_WINDOWS, LEAST_PLAIN, LEAST_SHORT = 0.5, 8, 2, 3
BROADCAST_KEYS, BROADCAST_BYTES = 2_000_000, 32 << 20
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches yd yards l ml litres liters h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years dollars euros pounds cents percent usd eur gbp degrees mph kmh".split()
MARK = "\u0001"
NAME = MARK + "a"  # of words, which are lower-cased


def template_words(text: Column) -> Column:
    """Words of a text; placeholders are the mark, N, A or U, and then the value."""
    x = F.regexp_replace(text, MARK, " ")
    x = F.regexp_replace(x, r"(?<=[\p{L}\p{N},;:] )\p{Lu}[\p{L}\p{N}'’-]*", MARK + "A$0")
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}" + MARK + r"])[-+]?[0-9]+(?:[.,][0-9]+)*", MARK + "N$0 ")
    # A unit in capitals has been taken for a name.
    x = F.regexp_replace(x, "(" + MARK + r"N\S+\s+)(?:" + MARK + "A)?((?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r"))(?![\p{L}\p{N}])", "$1" + MARK + "U$2")
    x = F.regexp_replace(x, r"(?<![0-9])[^\p{L}\p{N}\s" + MARK + r"]+|[^\p{L}\p{N}\s" + MARK + r"]+(?![0-9])", " ")
    # ß is SS in capitals. (The optimiser makes lower(upper(x)) lower(x).)
    return F.filter(F.split(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), r"\s+", -1), lambda w: w != "")


def _value(word: Column) -> Column:
    """A word, or the value of a placeholder."""
    return F.when(word.startswith(MARK), F.substring(word, 3, 1 << 30)).otherwise(word)


def template_windows(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, at, h, slots, folded): hashed template windows and the values of their placeholders.

    A window with names gives a second row (folded), whose hash has the names' words and whose slots have no names.
    """
    # No filter on the words: it would be pushed below and have the templates made twice.
    w = df.select(df[id_col].alias("id"), template_words(df[text_col]).alias("words"))
    w = w.withColumn("marked", F.exists("words", lambda x: x.startswith(MARK)))
    # Each word is hashed once; windows hash the words' hashes.
    w = w.withColumn("canon", F.transform("words", lambda x: F.xxhash64(F.when(x.startswith(MARK), F.substring(x, 1, 2)).otherwise(x))))
    w = w.withColumn("marks", F.when(F.col("marked"), F.transform("words", lambda x: x.startswith(MARK))))
    n = F.size("canon") - (width - 1)
    none = F.array().cast("array<string>")
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    row = lambda i, h, slots, folded: F.struct(i.alias("at"), h.alias("h"), slots.alias("slots"), F.lit(folded).alias("folded"))
    plain = F.transform(places, lambda i: row(i, F.xxhash64(F.slice("canon", i, width)), none, False))

    def with_marks(i: Column) -> Column:
        some = F.array_contains(F.slice("marks", i, width), True)
        few = F.size(F.filter(F.slice("marks", i, width), lambda x: x)) > width - LEAST_PLAIN
        h = F.when(some & few, F.xxhash64(F.slice("words", i, width))).otherwise(F.xxhash64(F.slice("canon", i, width)))
        slots = F.when(some & ~few, F.filter(F.slice("words", i, width), lambda x: x.startswith(MARK))).otherwise(none)
        return row(i, h, slots, False)

    # The names' places give the windows to fold, so that texts of few names cost little.
    names = F.array_compact(F.transform("words", lambda x, k: F.when(x.startswith(NAME), F.sequence(F.greatest(k + 2 - width, F.lit(1)), F.least(k + 1, n)))))
    folded = F.transform(
        F.array_distinct(F.flatten(names)),
        lambda i: row(
            i,
            F.xxhash64(F.transform(F.slice("words", i, width), lambda x: F.xxhash64(F.when(x.startswith(NAME), F.substring(x, 3, 1 << 30)).when(x.startswith(MARK), F.substring(x, 1, 2)).otherwise(x)))),
            F.filter(F.slice("words", i, width), lambda x: x.startswith(MARK) & ~x.startswith(NAME)),
            True,
        ),
    )
    made = F.when(n >= 1, F.when(F.col("marked"), F.concat(F.transform(places, with_marks), folded)).otherwise(plain))  # texts with fewer words give no row
    return w.select("id", F.explode(made).alias("x")).select("id", "x.at", "x.h", "x.slots", "x.folded")


def _bounded(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def short_matches(docs: DataFrame, items: DataFrame, width: int) -> DataFrame | None:
    """(id, item) of items of fewer words than a window, which a document has with all values; None if there are no such items."""
    value_words = lambda text: F.transform(template_words(text), _value)
    short = items.select("item", value_words(F.col("text")).alias("v")).where((F.size("v") > 0) & (F.size("v") < width))
    short = durable(short.select("item", F.size("v").alias("size"), F.xxhash64(F.transform("v", lambda x: F.xxhash64(x))).alias("h")))
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())  # fewer than a window's
    if not sizes:
        return None
    w = docs.select("id", F.transform(template_words(F.col("text")), lambda x: F.xxhash64(_value(x))).alias("v"))

    def of_size(k: int) -> Column:
        n = F.size("v") - (k - 1)
        made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.lit(k).alias("size"), F.xxhash64(F.slice("v", i, k)).alias("h")))
        return F.when((n >= 1) if k >= LEAST_SHORT else (n == 1), made).otherwise(F.array().cast("array<struct<size:int,h:bigint>>"))

    had = w.select("id", F.explode(F.array_distinct(F.concat(*map(of_size, sizes)))).alias("x")).select("id", "x.size", "x.h")
    return had.join(_bounded(short, short.count() <= BROADCAST_KEYS), ["size", "h"]).select("id", "item").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, share: float = SHARE, least: int = LEAST_WINDOWS) -> DataFrame:
    """(document, item, windows of the item, windows matched, slots, whether slot values differ) of contaminated documents."""
    # Items with one id and several texts stay apart by the hash of their text.
    items = benchmark.select(F.struct(benchmark[item_col].alias("id"), F.xxhash64(benchmark[item_text_col]).alias("t")).alias("item"), benchmark[item_text_col].alias("text")).where("text is not null").distinct()
    b = template_windows(items, "item", "text", width)
    # Of windows that an item has several times, the first one stands.
    b = b.groupBy(F.col("id").alias("item"), "h").agg(F.min(F.struct("at", "slots", "folded")).alias("x")).select("item", "h", F.col("x.at").alias("item_at"), F.col("x.slots").alias("item_slots"), F.col("x.folded").alias("folded"))
    b = durable(b.withColumn("n_windows", F.count(F.when(~F.col("folded"), 1)).over(Window.partitionBy("item"))).drop("folded"))
    size = b.agg(F.count_distinct("h").alias("keys"), F.sum(64 + F.octet_length(F.array_join("item_slots", " ")) + 24 * F.size("item_slots")).alias("bytes")).first()
    b = _bounded(b, (size["bytes"] or 0) <= BROADCAST_BYTES)
    d = template_windows(docs, id_col, text_col, width).select("id", "at", "h", "slots")
    hits = durable(d.join(_bounded(b.select("h").distinct(), size["keys"] <= BROADCAST_KEYS), "h", "left_semi"))
    enough = lambda n: (n >= least) | (n >= share * F.col("n_windows"))
    candidates = hits.select("id", "h").distinct().join(b, "h").groupBy("id", "item", "n_windows").agg(F.count_distinct("item_at").alias("found")).where(enough(F.col("found")))
    candidates = candidates.select(F.col("id").alias("c_id"), F.col("item").alias("c_item"))
    met = hits.join(b, "h").join(candidates, F.col("id").eqNullSafe(F.col("c_id")) & F.col("item").eqNullSafe(F.col("c_item")), "left_semi")
    met = met.withColumn("shift", F.col("at") - F.col("item_at")).withColumn("pairs", F.arrays_zip("item_slots", "slots"))
    by_shift = met.groupBy("id", "item", "shift", "n_windows").agg(
        F.count_distinct("item_at").alias("matched"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    left = F.transform("pairs", lambda p: p["item_slots"])
    by_shift = by_shift.where(F.size("pairs") == F.size(F.array_distinct(left)))
    by_shift = by_shift.withColumn("changed", F.exists("pairs", lambda p: p["item_slots"] != p["slots"]))
    by_item = by_shift.groupBy("id", "item", "n_windows").agg(F.least(F.sum("matched"), F.col("n_windows")).alias("n_matched"), F.max(F.size("pairs")).alias("n_slots"), F.max("changed").alias("changed_slots"))
    held = by_item.where(enough(F.col("n_matched"))).select("id", "item", "n_windows", "n_matched", "n_slots", "changed_slots")
    short = short_matches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), items, width)
    if short is not None:
        held = held.unionByName(short.select("id", "item", F.lit(1).cast("long").alias("n_windows"), F.lit(1).cast("long").alias("n_matched"), F.lit(0).alias("n_slots"), F.lit(False).alias("changed_slots")))
    return held.select(F.col("id").alias(id_col), F.col("item.id").alias(item_col), "n_windows", "n_matched", F.col("n_slots").cast("long").alias("n_slots"), "changed_slots")
