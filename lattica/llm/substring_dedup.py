"""Operator 7: repeated word windows, found through difference-cover anchors.

A difference cover D modulo v holds, for any two positions, an offset d < v that takes both to positions
whose remainder is in D. So if windows of W words are equal at two places, the anchor windows of W - v + 1
words that start d words further in are equal too, and both start at cover positions. Only those (4 of 13
positions at W = 20) are hashed and shuffled in the first pass. Where an anchor is found elsewhere, the
second pass extends it: it hashes the whole windows around it (128 bits, which stand for the words: among N
windows fewer than N^2 / 2^129 pairs are taken for equal wrongly, 10^-13 for N = 10^13), and the earliest place
of each window keeps it. Windows are judged on the input: (doc id, start), smaller first, null ids first.

Both passes pre-aggregate: what repeats within a part of about HASHES_AT_ONCE hashes is settled there, and one row
of it goes on, so a passage that a third of all documents share is a row for each part. Hashes and positions are
shuffled as packed arrays, one for each part and bucket. There is a bucket for each shuffle partition, which a task holds whole:
about three times the input over the number of shuffle partitions. Documents have buckets too, by their key.

Cases: a null text has no words. Rows with one id and one text are one document: each gets its result, and
they don't repeat each other. Rows with one id and several texts are ordered by the texts' hashes. A text of
fewer words than a window keeps all. An empty table gives an empty result. Columns that are not named in
``carry`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import batch_of, give_back, normal_words, shuffle_partitions
from .shapes import plain

WINDOW = 20
#: Perfect difference covers by period.
COVERS = {13: (0, 1, 3, 9), 7: (0, 1, 3), 3: (0, 1), 1: (0,)}
LEAST_ANCHOR = 8
#: How hard texts are compressed for the shuffle.
TEXT_LEVEL = 3
#: Positions that a task gathers before it sends them, and hashes that it settles at once.
MARKS_AT_ONCE, HASHES_AT_ONCE = 1_000_000, 1_000_000


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of LEAST_ANCHOR words (for short windows: any anchor)."""
    return next(((v, d) for v, d in COVERS.items() if window - v + 1 >= min(LEAST_ANCHOR, window)), (1, (0,)))


def doc_key(doc_id, text: str) -> int:
    """A signed 64-bit key of one document: its id and text."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest(repr(doc_id).encode())) - (1 << 63)


def _planes(a: np.ndarray) -> bytes:
    """The first bytes of all elements, then the second ones, and so on: small numbers compress to little."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join([np.array([len(arrays[0])], dtype=np.int64).tobytes(), *map(_planes, arrays)]), 1)


def unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(-1))
        at += n * size
    return out


def bucket_names(n: int) -> np.ndarray:
    """For each of n shuffle partitions an int that Spark's hash partitioning deals to it."""
    names, at = np.full(n, -1, dtype=np.int64), 0
    m = np.uint64(0xFFFFFFFF)
    rot = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & m
    while (names < 0).any():
        ids = np.arange(at, at + 4 * n, dtype=np.uint64)
        k = rot(ids * np.uint64(0xCC9E2D51) & m, 15) * np.uint64(0x1B873593) & m
        h = (rot(np.uint64(42) ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
        h ^= np.uint64(4)
        for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(times) & m
        place = h.astype(np.uint32).view(np.int32).astype(np.int64) % n
        free = names[place] < 0
        names[place[free][::-1]] = ids[free][::-1].astype(np.int64)
        at += 4 * n
    return names


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(starts, append=len(key))


def _by_bucket_of(names: np.ndarray, place: np.ndarray, parts: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Bucket names and packed arrays of rows that are to go to a place each; rows keep their order."""
    order = np.argsort(place, kind="stable")
    place, parts = place[order], [p[order] for p in parts]
    starts, sizes = _runs(place)
    return pa.array(names[place[starts]], pa.int32()), pa.array([pack(*(p[s : s + m] for p in parts)) for s, m in zip(starts, sizes, strict=True)], pa.binary())


def _marks_of(names: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Positions of documents, by the documents' buckets."""
    order = np.lexsort((at, keys))
    return _by_bucket_of(names, keys[order] % len(names), [keys[order], at[order].astype(np.uint32)])


class Documents:
    """A document's words joined by one space, and where they start and end."""

    def __init__(self, text: str):
        self.joined, self.starts, self.ends = normal_words(text)
        self.n = len(self.starts)

    def slices(self, at: np.ndarray, width: int) -> list[bytes]:
        j = self.joined
        return [j[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + width - 1].tolist(), strict=True)]


#: Rows between passes. kind 0: positions of documents of a bucket; kind 1: hashes of a bucket.
_ROWS = "kind int, bucket int, data binary"
_MARKS = "bucket int, data binary"


def _hash_rows(schema: pa.Schema, names: np.ndarray, place: np.ndarray, parts: list[np.ndarray], marked: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Packed hashes by bucket, and what is settled by the documents' buckets."""
    for kind, (bucket, data) in ((1, _by_bucket_of(names, place, parts)), (0, _marks_of(names, *marked))):
        if len(bucket):
            yield batch_of(schema, [np.full(len(bucket), kind, np.int32), bucket, data])


def _anchors(schema: pa.Schema, window: int, names: np.ndarray) -> Callable:
    period, cover = cover_for(window)
    width = window - period + 1
    in_cover = np.isin(np.arange(period), cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest

        def parts() -> Iterator[tuple[list, list, list]]:
            hashes, keys, places, seen, n = [], [], [], set(), 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)), strict=True):
                    doc = Documents(text or "")
                    if doc.n < window or (key := doc_key(doc_id, text)) in seen:
                        continue
                    seen.add(key)
                    at = np.arange(doc.n - width + 1)
                    at = at[in_cover[at % period]]
                    hashes.append(np.fromiter(map(digest, doc.slices(at, width)), dtype=np.uint64, count=len(at)))
                    keys.append(np.full(len(at), key, dtype=np.int64))
                    places.append(at.astype(np.uint32))
                    n += len(at)
                    if n >= HASHES_AT_ONCE:
                        yield hashes, keys, places
                        hashes, keys, places, seen, n = [], [], [], set(), 0
            if hashes:
                yield hashes, keys, places

        for hashes, keys, places in parts():
            h, k, p = (np.concatenate(x) for x in (hashes, keys, places))
            order = np.argsort(h, kind="stable")
            starts, sizes = _runs(h[order])
            again = np.repeat(sizes > 1, sizes)
            first = np.zeros(len(h), dtype=bool)
            first[order[starts]] = True
            twice = np.zeros(len(h), dtype=bool)
            twice[order] = again
            send, rest = np.flatnonzero(first), twice & ~first
            place = ((h[send] >> np.uint64(32)) % np.uint64(len(names))).astype(np.int64)
            yield from _hash_rows(schema, names, place, [h[send].astype(np.uint32), k[send], p[send], twice[send]], (k[rest], p[rest]))
        give_back()

    return run


def _group_anchors(schema: pa.Schema, names: np.ndarray) -> Callable:
    """Positions of anchors that are found twice or more."""

    def settle(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, k, p, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        starts, sizes = _runs(h[order])
        known = np.logical_or.reduceat(twice[order], starts)
        hit = order[np.repeat((sizes > 1) | known, sizes)]
        return k[hit], p[hit]

    return lambda batches: _by_bucket(schema, names, batches, settle, (np.uint32, np.int64, np.uint32, np.bool_))


def _by_bucket(schema: pa.Schema, names: np.ndarray, batches: Iterator[pa.RecordBatch], settle: Callable, types: tuple) -> Iterator[pa.RecordBatch]:
    """Pass settled rows on; give the unpacked rows of each bucket to ``settle``, whose positions go to the documents' buckets. Rows come sorted by bucket."""
    held, bucket, marks, n_marks = [], None, [], 0

    def send() -> Iterator[pa.RecordBatch]:
        if n_marks:
            yield batch_of(schema, list(_marks_of(names, *(np.concatenate(x) for x in zip(*marks, strict=True)))))

    for batch in batches:
        kind = batch.column(0).to_numpy()
        if (kind == 0).any():
            part = batch.filter(pa.array(kind == 0))
            yield batch_of(schema, [part.column(1), part.column(2)])
        for b, is_hash, data in zip(batch.column(1).to_pylist(), kind.tolist(), batch.column(2), strict=True):
            if not is_hash:
                continue
            if b != bucket and held:
                marks.append(settle(held))
                held, n_marks = [], n_marks + len(marks[-1][0])
                if n_marks > MARKS_AT_ONCE:
                    yield from send()
                    marks, n_marks = [], 0
            bucket = b
            held.append(unpack(data.as_buffer(), *types))
    if held:
        marks.append(settle(held))
        n_marks += len(marks[-1][0])
    yield from send()
    give_back()


def _documents(df: DataFrame, id_col: str, text_col: str, names: np.ndarray, carry: list[str]) -> DataFrame:
    """(bucket, kind, id, data, carry) of each row: its bucket, 1, the id, the compressed text and the carried columns."""
    own = [*plain("bucket int, kind int")[0].fields, StructField("id", df.schema[id_col].dataType), *plain("data binary")[0].fields]
    extra = [StructField("carry", StructType([df.schema[c] for c in carry]))] if carry else []
    out = StructType(own + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_text = zstandard.ZstdCompressor(level=TEXT_LEVEL).compress
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            keys = np.array([doc_key(i, t) for i, t in zip(ids, texts, strict=True)], dtype=np.int64)
            data = pa.array([zip_text(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
            cols = [pa.array(names[keys % len(names)], pa.int32()), pa.array(np.ones(len(ids), np.int32)), batch.column(0), data, *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out.fields])

    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *([F.struct(*[df[c] for c in carry]).alias("carry")] if carry else []))
    return picked.mapInArrow(run, out)


def _met(marks: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Positions and texts of each bucket in one partition, positions first."""
    rows = docs.unionByName(marks.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")


class _Bucket:
    """The positions of a bucket's documents, and which of these were seen."""

    def __init__(self, name: int):
        self.name, self.parts, self.seen = name, [], set()
        self.keys = None

    def at(self, key: int) -> np.ndarray:
        if self.keys is None:
            none = [np.zeros(0, np.int64), np.zeros(0, np.uint32)]
            self.keys, self.places = (np.concatenate(x) for x in zip(*(self.parts or [none]), strict=True))
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.places, self.parts = self.keys[order], self.places[order].astype(np.int64), []
        a, b = np.searchsorted(self.keys, [key, key + 1] if key < np.iinfo(np.int64).max else [key, key])
        return self.places[a:b]


def _each_document(batch: pa.RecordBatch, state: list[_Bucket]) -> Iterator[tuple[int, int, object, str, np.ndarray, bool]]:
    """(row, key, id, text, positions, is the first with its key) of the document rows of a sorted batch; state holds the bucket across batches."""
    names, kinds, ids, data = (batch.column(i) for i in range(4))
    ids = ids.to_pylist()
    unzip = zstandard.ZstdDecompressor().decompress
    for row, (name, kind) in enumerate(zip(names.to_pylist(), kinds.to_pylist(), strict=True)):
        if not state or state[0].name != name:
            state[:] = [_Bucket(name)]
        bucket = state[0]
        if kind == 0:
            bucket.parts.append(unpack(data[row].as_buffer(), np.int64, np.uint32))
        else:
            text = unzip(data[row].as_buffer()).decode("utf-8", "surrogatepass")
            key = doc_key(ids[row], text)
            yield row, key, ids[row], text, bucket.at(key), key not in bucket.seen
            bucket.seen.add(key)


def _windows(schema: pa.Schema, window: int, names: np.ndarray) -> Callable:
    """Hash the whole windows around the anchors that were found elsewhere; the earliest of each in a batch goes on, the others are settled."""
    period, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, state = xxhash.xxh3_128_digest, []

        def parts() -> Iterator[tuple[list, list, list, list]]:
            hashes, ids, keys, places, n = [], [], [], [], 0
            for batch in batches:
                for _, key, doc_id, text, anchors, is_first in _each_document(batch, state):
                    if not len(anchors) or not is_first:
                        continue
                    doc = Documents(text)
                    last = doc.n - window
                    near = np.zeros(doc.n + 2, dtype=np.int64)
                    np.add.at(near, np.maximum(anchors - period + 1, 0), 1)
                    np.add.at(near, anchors + 1, -1)
                    at = np.flatnonzero(np.cumsum(near)[: last + 1])
                    if len(at):
                        hashes.append(np.frombuffer(b"".join(map(digest, doc.slices(at, window))), dtype=np.uint64).reshape(-1, 2))
                        keys.append(np.full(len(at), key, dtype=np.int64))
                        ids.append(np.full(len(at), np.iinfo(np.int64).min if doc_id is None else int(doc_id), dtype=np.int64))
                        places.append(at.astype(np.uint32))
                        n += len(at)
                    if n >= HASHES_AT_ONCE:
                        yield hashes, ids, keys, places
                        hashes, ids, keys, places, n = [], [], [], [], 0
            if hashes:
                yield hashes, ids, keys, places

        for hashes, ids, keys, places in parts():
            h, i, k, p = (np.concatenate(x) for x in (hashes, ids, keys, places))
            place = (h[:, 1] % np.uint64(len(names))).astype(np.int64)
            first, rest = _earliest(h[:, 0], h[:, 1], i, k, p)
            yield from _hash_rows(schema, names, place[first], [h[first, 0], h[first, 1], i[first], k[first], p[first]], (k[rest], p[rest]))
        give_back()

    return run


def _earliest(h: np.ndarray, g: np.ndarray, i: np.ndarray, k: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the earliest place of each hash (two parts; in the order of documents), and of the others."""
    order = np.lexsort((p, k, i, g, h))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    first = np.sort(order[new])
    return first, order[~new]


def _group_windows(schema: pa.Schema, names: np.ndarray) -> Callable:
    def settle(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, g, i, k, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, rest = _earliest(h, g, i, k, p)
        return k[rest], p[rest]

    return lambda batches: _by_bucket(schema, names, batches, settle, (np.uint64, np.uint64, np.int64, np.int64, np.uint32))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """For each row its id, its words, how many of them repeated windows cover, the text of the others (``kept``, joined by one space), and
    the carried columns; with_text: also the text as it was (``text``; null texts are empty). Ids are integers."""
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    names = bucket_names(n)
    rows, rows_schema = plain(_ROWS)
    marks, marks_schema = plain(_MARKS)
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    anchors = source.mapInArrow(_anchors(rows_schema, window, names), rows)
    repeated = anchors.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_group_anchors(marks_schema, names), marks)
    texts = _documents(df, id_col, text_col, names, [])
    whole = _met(repeated, texts, n).mapInArrow(_windows(rows_schema, window, names), rows)
    later = whole.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_group_windows(marks_schema, names), marks)
    texts = _documents(df, id_col, text_col, names, list(carry))
    fields = [StructField(id_col, df.schema[id_col].dataType), *plain("n_words bigint, n_removed bigint, kept string" + ", text string" * with_text)[0].fields]
    out = StructType(fields + [StructField("carry", StructType([df.schema[c] for c in carry]))] * bool(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[_Bucket] = []
        for batch in (b.slice(k, 2048) for b in batches for k in range(0, b.num_rows, 2048)):
            at, words, removed, kept, texts = [], [], [], [], []
            for row, _, _, text, starts, _ in _each_document(batch, state):
                data = text.encode("utf-8", "surrogatepass").split()
                cover = np.zeros(len(data) + window + 1, dtype=np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                gone = np.cumsum(cover)[: len(data)] > 0
                at.append(row)
                if with_text:
                    texts.append(text)
                words.append(len(data))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(data, gone.tolist(), strict=True) if not g] if removed[-1] else data).decode("utf-8", "replace"))
            take = pa.array(at, pa.int64())
            cols = [batch.column(2).take(take), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *([pa.array(texts, pa.string())] if with_text else []), *(c.take(take) for c in batch.columns[4:])]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out.fields])
        give_back()

    done = _met(later, texts, n).mapInArrow(run, out)
    return done.select(id_col, "n_words", "n_removed", "kept", *(["text"] if with_text else []), *[F.col(f"carry.{c}").alias(c) for c in carry]) if carry else done


#: The digest columns of the query, in SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), e AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), s AS (
  SELECT doc_id, p, string_agg(word, ' ') OVER t AS text, count(*) OVER t AS n FROM e
  WINDOW t AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), g AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY text ORDER BY doc_id, p) AS r FROM s WHERE n = 20
), c AS (
  SELECT DISTINCT doc_id, p + unnest(range(0, 20)) AS p FROM g WHERE r > 1
), k AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS kept FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
