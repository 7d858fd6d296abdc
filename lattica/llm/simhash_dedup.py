"""Operator 2: near-duplicates by 64-bit SimHash, found with a byte-position inverted index.

A fingerprint is eight positional bytes. Two fingerprints within three bits differ in at most three bytes,
so they share at least five positional bytes. The index posts each distinct fingerprint under conjunctions
of four positional bytes; the fourteen conjunctions (weight-4 words of the extended Hamming code) are such
that any five shared bytes hold one whole. Candidates of a posting list get their shared positional bytes
counted; pairs with five or more are kept and their bits compared. Single-byte lists would hold a 256th of
all fingerprints each; these hold what shares 32 bits.

Copies with one fingerprint are one entry of the index. A posting list of many fingerprints is split into
blocks; each pair of blocks is a unit of work, which gives a spanning forest of its links, not all pairs.

Cases: null, empty and wordless texts have fingerprint zero and link like others. Repeated rows and rows
with one id are kept, each with its component. A null id is never the component's id unless all its
members' ids are null. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, durable, give_back, normal_words, shuffle_partitions
from .components import components
from .shapes import plain

SEED = 42
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
BLOCK = 1024
_UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CODE = [0b11110000, 0b11001100, 0b10101010, 0b11111111]


def conjunctions() -> list[int]:
    """The byte positions (as bit sets) of the fourteen conjunctions: span of the generators, weight four."""
    words = {0}
    for g in _CODE:
        words |= {w ^ g for w in words}
    return sorted(w for w in words if bin(w).count("1") == 4)


def _mask(positions: int) -> int:
    return sum(0xFF << (8 * p) for p in range(8) if positions >> p & 1)


MASKS = [_mask(c) for c in conjunctions()]


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a text; bit b of it is set if it is set in over half the shingle hashes."""
    joined, starts, ends = normal_words((text or ""))
    joined = joined.translate(_UPPER_TO_LOWER)
    n = len(starts)
    if n == 0:
        return 0
    k = min(width, n)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n - k + 1)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long, for each row."""
    kind = df.schema[id_col].dataType.simpleString()
    out, schema = plain(f"id {kind}, fp bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
            yield batch_of(schema, [batch.column(0), pa.array(fps.view(np.int64))])
        give_back()

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, out)


def verified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs share enough positional bytes, and then whether their bits are near."""
    d = x ^ y
    shared = (d.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (shared >= LEAST_BYTES) & (np.bitwise_count(d) <= MOST_BITS)


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, by breadth-first search over what is not reached."""
    left, a, b = fps.copy(), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = verified(np.full(len(left), x), left)
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                left = left[~near]
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links_of_runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (c, key, i, j, fp) come sorted by (c, key, i, j); a run is a unit of work. The last run of a batch waits for the next batch."""
    held: list[np.ndarray] = []

    def links(c, key, i, j, fp) -> pa.RecordBatch:
        n = len(fp)
        change = np.ones(n, dtype=bool)
        change[1:] = (c[1:] != c[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(change)
        sizes = np.diff(starts, append=n)
        run = np.cumsum(change) - 1
        small = sizes <= 16
        a, b = [], []
        for d in range(1, 16):
            k = np.flatnonzero((run[d:] == run[:-d]) & small[run[d:]]) if d < n else []
            if len(k) == 0:
                break
            x, y = fp[k], fp[k + d]
            ok = verified(x, y)
            a.append(x[ok])
            b.append(y[ok])
        for s, m in zip(starts[~small], sizes[~small], strict=True):
            x, y = forest(np.unique(fp[s : s + m]))
            a.append(x)
            b.append(y)
        none = np.zeros(0, dtype=np.uint64)
        a, b = (np.concatenate(x) if x else none for x in (a, b))
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        return batch_of(schema, [pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        cols[4] = np.ascontiguousarray(cols[4]).view(np.uint64)
        if held:
            cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]) | (cols[3] != cols[3][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(*(x[:cut] for x in cols))
        held = [x[cut:] for x in cols]
    if held and len(held[0]):
        yield links(*held)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect what any links within three bits connect."""
    spark = distinct.sparkSession
    posted = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in MASKS])).alias("c", "key"))
    sizes = posted.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    lists = posted.join(sizes, ["c", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    lists = lists.withColumn("mine", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int"))
    # In a list of several blocks a fingerprint meets each block once: block pairs (i, j) with i <= j that hold its own.
    units = lists.select("c", "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("c", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    out, schema = plain("a bigint, b bigint")
    n = shuffle_partitions(spark)
    return units.repartition(n, "c", "key", "i", "j").sortWithinPartitions("c", "key", "i", "j").mapInArrow(lambda it: _links_of_runs(it, schema), out)


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """For each row its id, its fingerprint (16 hex digits) and its component's id: the least id that is reachable over links."""
    marked = durable(fingerprints(df, id_col, text_col, width))
    distinct = durable(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_links(distinct.select("fp")))
    # The least id of each component: fingerprints without a link are their own.
    rooted = durable(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = durable(rooted.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
