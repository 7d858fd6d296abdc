"""Operator 9: SentencePiece encoding and decoding, with giant documents encoded in chunks by a max-plus scan.

A sequence of pieces is the model's encoding of its text if and only if each two neighbours are the encoding
of their own text. So encoding is a best path: a step from one piece to the next costs -1 if the two fit and
is impossible (minus infinity) if not. (The public model is a byte-pair model: a best path over its piece
scores would not be its encoding. Of all paths over this lattice one is possible.)

A giant document is cut into chunks of CHUNK characters, wherever that falls. The states at a boundary are the
pieces of the vocabulary that end at it or cross it. A chunk is encoded once, which yields the max-plus
transfer matrix from the states at its left to those at its right, and its pieces between its first and last
word end. Matrices are composed in a tree: FAN neighbours at a time, until each document has one; on the way
back the best states at the boundaries within each group follow from the states at its ends. Each chunk then
backtraces its own pieces between its two states, independently of all others.

Cases: a null or empty text has no pieces. The space sign in a text is a space to the model, so decoding
gives a space back. Repeated rows stay: rows with one id and text are told apart by nothing and get one result each.
An empty table gives an empty result. Columns that are not named in ``carry`` are not read. A document's pieces
are one row, so that row is as large as the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import durable, give_back
from .pieces import PieceCodec, codec, model_texts, vocabulary
from .segments import slices
from .shapes import plain

#: Characters from which a document is encoded in chunks, and of a chunk; matrices composed at once.
GIANT, CHUNK, FAN = 16_384, 8_192, 16
#: Characters after which walks from several states are compared, to go on as one.
MEET = 48
State = tuple[int, int]  # where a piece starts and ends; (b, b): any, at a boundary that no piece crosses


def is_cut(text: str, b: int) -> bool:
    """Whether no piece crosses b: an end of the text, or a space after another character."""
    return b <= 0 or b >= len(text) or (text[b] == " " and text[b - 1] != " ")


class Lattice:
    """Pieces over one (normal) text, or over a part of it with enough of its surroundings."""

    def __init__(self, pieces: PieceCodec):
        self.codec = pieces
        self.scores = {p: pieces.sp.get_score(i) for p, i in pieces.pieces.items()}
        self.known: dict[tuple[str, str], bool] = {}
        self.wholes: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge the neighbours whose piece has the best score, leftmost first, until none can be merged."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[x], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in self.scores]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        known = self.known.get((a, b))
        if known is None:
            if len(self.known) > 500_000:
                self.known.clear()
            known = self.known[a, b] = self.merged(a + b) == [a, b]
        return known

    def is_piece(self, text: str) -> bool:
        return len(text) == 1 or text in self.scores

    def is_whole(self, text: str) -> bool:
        """Whether a text is encoded as one piece."""
        if len(text) == 1 or text not in self.scores:
            return len(text) == 1
        known = self.wholes.get(text)
        if known is None:
            known = self.wholes[text] = self.merged(text) == [text]
        return known

    def states(self, text: str, b: int) -> list[State]:
        """The pieces that may end at or cross a boundary of the text."""
        if is_cut(text, b):
            return [(b, b)]
        most = self.codec.longest
        return [(s, e) for s in range(max(0, b - most + 1), b) for e in range(b, min(len(text), s + most) + 1) if self.is_whole(text[s:e])]

    def _joins(self, text: str, s: int, j: int, i: int) -> bool:
        """Whether the piece from j to i fits after the one from s to j (s == j: none)."""
        return s == j or is_cut(text, j) or self.fits(text[s:j], text[j:i])

    def walk(self, text: str, entry: State, end: int, reached: dict | None = None, at: int | None = None) -> dict[int, tuple[int, int]]:
        """From a state, each place up to ``end`` that can be reached: where its last piece starts, and the pieces so far."""
        s0, e0 = entry
        if reached is None:
            reached = {e0: (s0, 0)}
        most = self.codec.longest
        for i in range((e0 if at is None else at) + 1, end + 1):
            for j in range(max(e0, i - most), i):
                if j in reached and self.is_piece(text[j:i]) and self._joins(text, reached[j][0], j, i):
                    reached[i] = (j, reached[j][1] + 1)
                    break
        return reached

    def path(self, text: str, reached: dict, entry: State, exit_: State) -> list[str] | None:
        """The pieces from an entry to an exit, the exit's own included; None if it isn't reached."""
        s, e = exit_
        if entry == exit_ and s != e:
            return []  # one piece covers the chunk
        if s not in reached or s < entry[1] or (s != e and not self._joins(text, reached[s][0], s, e)):
            return None
        out = [text[s:e]] if s != e else []
        while s != entry[1]:
            out.append(text[reached[s][0] : s])
            s = reached[s][0]
        return out[::-1]

    def ids(self, parts: list[str]) -> np.ndarray:
        """Ids of pieces; a character without a piece becomes its bytes."""
        out: list[int] = []
        for p in parts:
            if p in self.codec.pieces:
                out.append(self.codec.pieces[p])
            else:
                out.extend(self.codec.byte_ids[bytes([b])] for b in p.encode("utf-8", "surrogatepass"))
        return np.array(out, dtype=np.int32)

    def whole_walks(self, text: str, entries: list[State], exits: list[State]) -> np.ndarray:
        """The transfer matrix of a chunk without a cut. Walks whose last pieces agree go on as one."""
        end = max(s for s, _ in exits)
        lead: list[tuple[int, int]] = [(k, 0) for k in range(len(entries))]  # the walk that each entry follows, and its lead over it
        walks = {k: {e: (s, 0)} for k, (s, e) in enumerate(entries)}
        at = {k: e for k, (_, e) in enumerate(entries)}
        most = self.codec.longest
        stop = min(e for _, e in entries)
        while stop < end:
            stop = min(end, stop + MEET)
            known: dict[tuple, tuple[int, int]] = {}
            for k in sorted(walks):
                self.walk(text, entries[k], stop, walks[k], at[k])
                at[k] = max(at[k], stop)
                if stop == end:
                    continue
                front = [(p, *walks[k][p]) for p in range(stop - most, stop + 1) if p in walks[k]]
                if not front:
                    continue
                shape, first = tuple((p, s, n - front[0][2]) for p, s, n in front), front[0][2]
                if shape in known:
                    other, base = known[shape]
                    for i, (w, d) in enumerate(lead):
                        if w == k:
                            lead[i] = (other, d + first - base)
                    del walks[k]
                else:
                    known[shape] = (k, first)
        m = np.full((len(entries), len(exits)), -np.inf)
        for i, entry in enumerate(entries):
            w, d = lead[i]
            for j, (s, e) in enumerate(exits):
                if entry == (s, e) and s != e:
                    m[i, j] = 0.0
                elif s in (reached := walks[w]) and s >= entry[1] and (s == e or self._joins(text, reached[s][0], s, e)):
                    m[i, j] = -(reached[s][1] + d + (s != e))
        return m


class Chunk:
    """One chunk of a text, from ``lo`` to ``hi`` of ``text`` (the chunk with its surroundings)."""

    def __init__(self, lattice: Lattice, text: str, lo: int, hi: int):
        self.lattice, self.text, self.lo, self.hi = lattice, text, lo, hi
        self.left, self.right = lattice.states(text, lo), lattice.states(text, hi)
        first = next((c for c in range(lo, hi + 1) if is_cut(text, c)), None)
        #: The first and the last place that no piece crosses.
        self.cuts = None if first is None else (first, next(c for c in range(hi, first - 1, -1) if is_cut(text, c)))

    def encode(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The matrix, the ids between the cuts, and those from each state at the left and to each at the right."""
        lattice, text = self.lattice, self.text
        none = np.zeros(0, dtype=np.int32)
        if self.cuts is None:
            return lattice.whole_walks(text, self.left, self.right), none, [], []
        first, last = self.cuts
        middle = lattice.codec.encode_normal(text[first:last]) if last > first else none
        left = [lattice.path(text, lattice.walk(text, entry, first), entry, (first, first)) for entry in self.left]
        after = lattice.walk(text, (last, last), max(s for s, _ in self.right))
        right = [lattice.path(text, after, (last, last), exit_) for exit_ in self.right]
        cost = [np.array([-np.inf if p is None else -len(p) for p in paths]) for paths in (left, right)]
        m = cost[0][:, None] + cost[1][None, :] - len(middle)
        return m, middle, [none if p is None else lattice.ids(p) for p in left], [none if p is None else lattice.ids(p) for p in right]

    def backtrace(self, a: int, b: int) -> np.ndarray:
        """Ids between two states of a chunk without a cut."""
        entry, exit_ = self.left[a], self.right[b]
        path = self.lattice.path(self.text, self.lattice.walk(self.text, entry, exit_[0]), entry, exit_)
        return self.lattice.ids(path or [])


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, which is associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def best_states(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """Indexes of the states on the best path from a state at the first boundary to one at the last, both included."""
    forward = [np.full(matrices[0].shape[0], -np.inf)]
    forward[0][start] = 0.0
    for m in matrices:
        forward.append((forward[-1][:, None] + m).max(axis=0))
    at = [end]
    for m, f in zip(matrices[::-1], forward[-2::-1], strict=True):
        at.append(int((f + m[:, at[-1]]).argmax()))
    return at[::-1]


def boundaries(n: int, chunk: int) -> list[int]:
    """Chunk ends: multiples of ``chunk``; the last one may be half as long again."""
    return [0, *range(chunk, n - chunk // 2, chunk), n]


_LATTICES: dict[str, Lattice] = {}


def lattice_of(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(codec(path))
    return _LATTICES[path]


def encode_chunked(lattice: Lattice, text: str, chunk: int = CHUNK, fan: int = FAN) -> list[int]:
    """The scan over one text in one process: what the distributed form does, for tests and small uses."""
    normal = PieceCodec.normal(text)
    if not normal:
        return []
    ends = boundaries(len(normal), chunk)
    parts = [Chunk(lattice, normal, a, b) for a, b in zip(ends, ends[1:])]
    done = [p.encode() for p in parts]
    levels = [[m for m, *_ in done]]
    while len(levels[-1]) > 1:
        groups = [levels[-1][k : k + fan] for k in range(0, len(levels[-1]), fan)]
        levels.append([compose_all(g) for g in groups])
    states = [(0, 0)]
    for matrices in levels[-2::-1]:
        states = [pair for k, (a, b) in enumerate(states) for pair in _pairs(best_states(matrices[k * fan : (k + 1) * fan], a, b))]
    return np.concatenate([_ids(p, d, a, b) for p, d, (a, b) in zip(parts, done, states, strict=True)]).tolist()


def compose_all(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = compose(out, m)
    return out


def _pairs(at: list[int]) -> list[tuple[int, int]]:
    return list(zip(at, at[1:]))


def _ids(part: Chunk, done: tuple, a: int, b: int) -> np.ndarray:
    _, middle, left, right = done
    return part.backtrace(a, b) if part.cuts is None else np.concatenate((left[a], middle, right[b]))


_KEY = "k1 bigint, k2 bigint, "
_SPLIT = _KEY + "c int, n int, lo int, hi int, part string"
_CODED = _KEY + "c int, n int, lo int, hi int, part string, m array<double>, rows int, middle binary, lefts array<binary>, rights array<binary>"


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _split(schema: pa.Schema, chunk: int, margin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                normal = PieceCodec.normal(text)
                ends = boundaries(len(normal), chunk)
                rows = []
                for c, (a, b) in enumerate(zip(ends, ends[1:])):
                    # With its surroundings, so that the states at its ends can be listed.
                    lo = max(0, a - margin)
                    rows.append((k1, k2, c, len(ends) - 1, a - lo, b - lo, normal[lo : b + margin]))
                yield from _rows(rows, schema)

    return run


def _transfer(schema: pa.Schema, path: str):
    """Encode each chunk once. Rows come sorted; rows alike (of documents alike) are one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, before = lattice_of(path), None
        packed = lattice.codec.packed
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for k1, k2, c, n, lo, hi, text in zip(*(x.to_pylist() for x in batch.slice(at, 64).columns), strict=True):
                    if (k1, k2, c) == before:
                        continue
                    before = (k1, k2, c)
                    part = Chunk(lattice, text, lo, hi)
                    m, middle, left, right = part.encode()
                    rows.append((k1, k2, c, n, lo, hi, text if part.cuts is None else None, m.ravel().tolist(), m.shape[0], packed(middle), [packed(x) for x in left], [packed(x) for x in right]))
                yield from _rows(rows, schema)

    return run


def _matrices(all_: list[dict]) -> list[np.ndarray]:
    return [np.array(x["m"]).reshape(x["rows"], -1) for x in all_]


def _up(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, c, all_ in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                m = compose_all(_matrices(all_))
                rows.append((k1, k2, c, m.ravel().tolist(), m.shape[0]))
            yield from _rows(rows, schema)

    return run


def _down(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, all_, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rows += [(k1, k2, x["c"], *pair) for x, pair in zip(all_, _pairs(best_states(_matrices(all_), a, b)), strict=True)]
            yield from _rows(rows, schema)

    return run


def boundary_states(matrices: DataFrame, most_chunks: int, fan: int = FAN) -> DataFrame:
    """(k1, k2, c, a, b): the states at the ends of each chunk, from the matrices (k1, k2, c, m, rows), composed in a tree."""
    matrix, matrix_arrow = plain(_KEY + "c int, m array<double>, rows int")
    pair, pair_arrow = plain(_KEY + "c int, a int, b int")
    level, groups, n = matrices, [], most_chunks
    while n > 1:
        own = level.groupBy("k1", "k2", F.floor(F.col("c") / fan).cast("int").alias("g")).agg(F.array_sort(F.collect_list(F.struct("c", "m", "rows"))).alias("all"))
        groups.append(own)
        level = own.mapInArrow(_up(matrix_arrow), matrix)
        n = -(-n // fan)
    states = level.select("k1", "k2", "c", F.lit(0).alias("a"), F.lit(0).alias("b"))
    for own in groups[::-1]:
        states = own.join(states.withColumnRenamed("c", "g"), ["k1", "k2", "g"]).select("k1", "k2", "all", "a", "b").mapInArrow(_down(pair_arrow), pair)
    return states


def sentencepiece_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, giant: int = GIANT, chunk: int = CHUNK, carry: tuple[str, ...] = (), decode: bool = False, fan: int = FAN) -> DataFrame:
    """For each row its id, its piece ids (array of int), the chunks it was encoded in, the most states at their ends, with decode
    also what the ids decode to (``decoded``), and the carried columns."""
    path = model or vocabulary()
    kind = df.schema[id_col].dataType
    extra = [StructField("carry", StructType([df.schema[c] for c in carry]))] if carry else []
    source = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"), *([F.struct(*[df[c] for c in carry]).alias("carry")] if carry else []))
    back = [StructField("decoded", StringType())] if decode else []
    done = StructType([StructField("id", kind), StructField("pieces", ArrayType(IntegerType())), StructField("n_chunks", LongType()), StructField("n_states", LongType()), *back, *extra])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                ids, counts = pieces.encode_texts(model_texts(part.column(1)))
                texts = [pieces.decode_lists(ids, counts)] if decode else []
                one = pa.array(np.ones(n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids, counts), one, one, *texts, *part.columns[2:]], names=[f.name for f in done.fields])
        give_back()

    small = source.where(F.length("text") < giant).mapInArrow(whole, done)
    large = source.where(F.length("text") >= giant).withColumn("k1", F.xxhash64(F.lit(1), "id", "text")).withColumn("k2", F.xxhash64(F.lit(2), "text", "id"))
    split, split_arrow = plain(_SPLIT)
    coded, coded_arrow = plain(_CODED)
    parts = large.select("k1", "k2", "text").mapInArrow(_split(split_arrow, chunk, codec(path).longest + 1), split)
    chunks = durable(parts.repartition("k1", "k2", "c").sortWithinPartitions("k1", "k2", "c").mapInArrow(_transfer(coded_arrow, path), coded))
    most = chunks.agg(F.max("n")).first()[0] or 1
    states = boundary_states(chunks.select("k1", "k2", "c", "m", "rows"), most, fan)
    traced, traced_arrow = plain(_KEY + "c int, states int, ids binary")

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for batch in batches:
            rows = []
            for k1, k2, c, lo, hi, text, m, n_left, middle, left, right, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                ids = left[a] + middle + right[b] if text is None else lattice.codec.packed(Chunk(lattice, text, lo, hi).backtrace(a, b))
                rows.append((k1, k2, c, max(n_left, m // n_left), ids))
            yield from _rows(rows, traced_arrow)

    met = chunks.withColumn("m", F.size("m")).join(states, ["k1", "k2", "c"])
    found = met.select("k1", "k2", "c", "lo", "hi", "part", "m", "rows", "middle", "lefts", "rights", "a", "b").mapInArrow(backtrace, traced)
    joined = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("c", "ids")))["ids"].alias("parts"), F.count("*").alias("n_chunks"), F.max("states").cast("long").alias("n_states"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                ids = np.frombuffer(b"".join(row.column(1)[0].as_py()), dtype=pieces.id_type)
                count = np.array([len(ids)])
                texts = [pieces.decode_lists(ids, count)] if decode else []
                yield pa.RecordBatch.from_arrays([row.column(0), _lists(ids, count), row.column(2), row.column(3), *texts, *row.columns[4:]], names=[f.name for f in done.fields])

    giants = large.drop("text").join(joined, ["k1", "k2"]).select("id", "parts", "n_chunks", "n_states", *(["carry"] if carry else [])).mapInArrow(finish, done)
    return small.unionByName(giants).select(F.col("id").alias(id_col), "pieces", "n_chunks", "n_states", *(["decoded"] if decode else []), *[F.col(f"carry.{c}").alias(c) for c in carry])


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32), pa.int32()))


def sentencepiece_decode(pieces: Column, model: str | None = None) -> Column:
    """The text of an array of piece ids; null ids give null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = codec(model or vocabulary())
        for series in batches:
            out = []
            for x in series:
                out.append(None if x is None else decoder.decode_lists(np.asarray(x, dtype=np.int64), np.array([len(x)]))[0].as_py())
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(pieces)
