"""Operator 1: quality rules from tokeniser fertility.

Two public vocabularies (pieces with byte fallback, and byte pairs) measure each text: characters per token,
the share of fallback tokens (single bytes, or byte pairs that are no whole characters) and the entropy of the
text's token distribution. The bands are those of the corpus: for each language and measure the quartiles of
all texts that pass the base rules, widened by FENCE times their distance (LEAST_WIDTH at least). Texts without
a language, or of one with less than LEAST_SHARE of the texts, have the bands of their script; scripts as rare
share those of all texts. A text outside a band is not kept. Bands may be given instead (see :func:`bands_of`).

Quartiles are exact over values rounded to GRID steps: counts by group, measure and step are all that is
gathered, and there are 1 / LEAST_SHARE groups of each kind at most.

Cases: a null or empty text has no words, fails the base rule and has zero measures. Repeated rows are judged
each on its own, but each counts for the quartiles; extra columns are not read. An empty table gives an empty
result. A very long text is a slice of its own: memory is some tens of times the longest text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, batch_of, durable
from .letters import _tables
from .pieces import codec, model_texts, vocabulary
from .segments import Texts, after_white, by_text, distinct, entropies, flat_binary, gather, plain_of, segments, slices, texts_of, white_cuts, word_ids, words
from .shapes import with_id

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
#: Measures, and how wide the distance from a quartile to its fence is at least.
LEAST_WIDTH = {"chars_per_token": 0.3, "byte_share": 0.08, "token_entropy": 1.0}
VOCABULARIES = ("pieces", "pairs")
FENCE, GRID, LEAST_SHARE = 3.0, 256, 0.001
#: First code points and scripts of the ranges told apart; a range ends where the next begins.
RANGES = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x600, "arabic"), (0x780, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other")]
SCRIPTS = sorted({name for _, name in RANGES}) + ["none"]
_MEASURES = [f"{m}_{v}" for v in VOCABULARIES for m in LEAST_WIDTH]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, language string, script string, n_tokens long, " + ", ".join(f"{m} double" for m in _MEASURES)
#: Bits of the hash of a word window; segments that are encoded at once.
HASH_BITS, BLOCK = 64, 256


@lru_cache(maxsize=1)
def _script_of_char() -> np.ndarray:
    """Number of the script of each code point among SCRIPTS; that of no letter is beyond them."""
    letter, _ = _tables()
    starts = np.array([a for a, _ in RANGES])
    names = np.array([SCRIPTS.index(b) for _, b in RANGES], dtype=np.uint8)
    return np.where(letter, names[np.maximum(np.searchsorted(starts, np.arange(len(letter)), side="right") - 1, 0)], len(SCRIPTS)).astype(np.uint8)


def scripts(t: Texts) -> list[str]:
    """The script of most letters of each text (the first by name of those that have as many); "none" without letters."""
    codes = np.frombuffer(t.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    of_char = _script_of_char()[codes]
    chars = t.chars() + 1
    if int(chars.sum()) != len(codes):  # broken bytes
        return [scripts(Texts(np.frombuffer((" " + t.data[a:b].tobytes().decode("utf-8", "ignore")).encode(), np.uint8), np.array([0, b - a + 1])))[0] if b - a > 1 else "none" for a, b in zip(t.offsets[:-1], t.offsets[1:])]
    width = len(SCRIPTS) + 1
    counts = np.bincount(np.repeat(np.arange(t.n) * width, chars) + of_char, minlength=t.n * width).reshape(t.n, width)[:, : len(SCRIPTS)]
    best = counts.argmax(axis=1)
    return ["none" if counts[d, b] == 0 else SCRIPTS[b] for d, b in enumerate(best)]


def _equal_windows(doc: np.ndarray, ids: np.ndarray, at: np.ndarray, n_ids: int) -> np.ndarray:
    """Which of the windows of three words that start at some places are there twice or more in their document."""
    two = ids[at].astype(np.uint64)
    two *= np.uint64(n_ids)
    two += ids[at + 1].astype(np.uint64)
    one = doc[at].astype(np.uint64)
    one *= np.uint64(n_ids)
    one += ids[at + 2].astype(np.uint64)
    h = two * np.uint64(0x9E3779B97F4A7C15)
    h += one
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h &= np.uint64((1 << HASH_BITS) - 1)
    order = np.argsort(h)
    near = np.flatnonzero(np.diff(h[order]) == 0)
    later, before = order[near + 1], order[near]
    same = (two[later] == two[before]) & (one[later] == one[before])
    if not same.all():  # different windows share a hash: sort the windows themselves
        order = np.lexsort((one, two))
        later, before = order[1:], order[:-1]
        same = (two[later] == two[before]) & (one[later] == one[before])
    out = np.zeros(len(at), dtype=bool)
    out[later[same]] = True
    out[before[same]] = True
    return out


def base_measures(t: Texts) -> tuple[np.ndarray, ...]:
    """Words, characters in words, symbols, repeated lines and words in repeated windows of each text."""
    starts, ends = words(t)
    doc = t.owner(starts)
    n_words = np.bincount(doc, minlength=t.n)
    word_chars = t.sums(((t.data & 0xC0) != 0x80) & ~_IS_SPACE[t.data])
    symbols = t.sums(_IS_SYMBOL[t.data])
    # Lines: the places after line feeds and texts' starts; the space before a text is not of its first line.
    feed = t.data == 10
    first = np.sort(np.concatenate((t.offsets[:-1] + 1, np.flatnonzero(feed) + 1)))
    last = np.sort(np.concatenate((t.offsets[1:], np.flatnonzero(feed))))
    has_word = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[has_word], last[has_word]
    line, found = distinct(t.data[gather(first, last - first)], last - first)
    key = np.sort(t.owner(first) * max(len(found), 1) + line)
    dup_lines = np.bincount(key[1:][key[1:] == key[:-1]] // max(len(found), 1), minlength=t.n) if len(key) else np.zeros(t.n, dtype=np.int64)
    ids, distinct_words = word_ids(t, starts, ends)
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    inside = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, dtype=np.int64)
    hit = inside[_equal_windows(doc, ids, inside, len(distinct_words))]
    covered[hit] += 1
    np.add.at(covered, hit + 3, -1)
    repeat_words = np.bincount(doc[np.cumsum(covered)[:-1] > 0], minlength=t.n)
    return n_words, word_chars, symbols, dup_lines, repeat_words


class PairCodec:
    """Tokens of a byte-pair vocabulary: texts are cut where its splitter never crosses, distinct segments are encoded once."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.token_bytes = np.zeros(self.size, dtype=np.int64)
        #: Tokens that are no whole characters.
        self.is_byte = np.zeros(self.size, dtype=bool)
        for token, k in ranks.items():
            self.token_bytes[k] = len(token)
            try:
                token.decode()
            except UnicodeDecodeError:
                self.is_byte[k] = True
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary

    def encode_segments(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of segments (binary), one after the other, and the tokens of each.

        Segments that begin with a space and end in no white space may stand one after the other: they are encoded in blocks, whose
        tokens are told apart by their bytes.
        """
        data, offsets = flat_binary(found)
        joins = (data[offsets[:-1]] == 32) & ~after_white(data, offsets[1:]) if len(found) else np.zeros(0, dtype=bool)
        sizes, order, flat = np.zeros(len(found), dtype=np.int64), np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins))), []
        data, offsets = flat_binary(found.filter(pa.array(joins)))
        for a in range(0, len(offsets) - 1, BLOCK):
            part = offsets[a : a + BLOCK + 1]
            ids = np.array(self.encode(data[part[0] : part[-1]].tobytes().decode()), dtype=np.int32)
            at = np.searchsorted(np.cumsum(self.token_bytes[ids]), part[1:] - part[0]) + 1
            sizes[order[a : a + len(part) - 1]] = np.diff(at, prepend=0)
            flat.append(ids)
        for k, segment in zip(order[len(offsets) - 1 :].tolist(), found.filter(pa.array(~joins)).to_pylist(), strict=True):
            ids = np.array(self.encode(segment.decode("utf-8", "replace")), dtype=np.int32)
            sizes[k] = len(ids)
            flat.append(ids)
        ids = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
        firsts = np.zeros(len(found), dtype=np.int64)
        firsts[order] = np.cumsum(sizes[order]) - sizes[order]
        return ids[gather(firsts, sizes)], sizes

    def encode_texts(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of plain texts, one after the other, and the tokens of each text."""
        cuts = white_cuts(t)
        index, found, counts = segments(t, cuts)
        flat, size = self.encode_segments(found)
        sizes = size[index]
        return flat[gather((np.cumsum(size) - size)[index], sizes)], by_text(sizes, counts)


@lru_cache(maxsize=2)
def pair_codec(path: str) -> PairCodec:
    return PairCodec(path)


def token_measures(ids: np.ndarray, counts: np.ndarray, chars: np.ndarray, is_byte: np.ndarray) -> list[np.ndarray]:
    """Characters per token, share of fallback tokens and entropy of each text; zeros without tokens."""
    some = np.maximum(counts, 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    fallback = np.bincount(doc[is_byte[ids]], minlength=len(counts))
    return [np.where(counts > 0, chars / some, 0.0), fallback / some, entropies(doc, ids, len(counts), len(is_byte))]


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, model: str | None = None, pairs: str | None = None, least_words: int = 50) -> DataFrame:
    """Base measures and token measures of each text (columns of SCHEMA)."""
    out, schema = with_id(df, id_col, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, byte_pairs = codec(model or vocabulary()), pair_codec(pairs or vocabulary("byte_bpe_50k.tiktoken"))
        is_byte = np.array(pieces.is_byte)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                column = batch.column(1).slice(at, n)
                t = texts_of(column)
                base = base_measures(t)
                chars = t.chars()
                ids, counts = pieces.encode_texts(model_texts(column))
                measured = token_measures(ids, counts, chars, is_byte) + token_measures(*byte_pairs.encode_texts(plain_of(column)), chars, byte_pairs.is_byte)
                failed = (base[0] < least_words) | (100 * base[4] > 50 * base[0])
                yield batch_of(schema, [batch.column(0).slice(at, n), *base, failed, batch.column(2).slice(at, n), scripts(t), counts, *measured])

    lang = df[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    return df.select(df[id_col].alias("id"), df[text_col].alias("text"), lang.alias("lang")).mapInArrow(run, out)


def bands_of(measured: DataFrame) -> DataFrame:
    """(level, name, m_low, m_high for each measure m) of all texts that pass the base rules; the levels are language, script and all."""
    passed = measured.where("not base_failed")
    total = passed.count()
    steps = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.floor(F.col(m) * GRID).alias("v")) for m in _MEASURES]))
    counted = passed.select("language", "script", steps.alias("x")).groupBy("language", "script", "x.m", "x.v").agg(F.count("*").alias("n"))
    groups = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), name.alias("name")) for level, name in (("language", F.col("language")), ("script", F.col("script")), ("all", F.lit("*")))]))
    counted = counted.select(groups.alias("g"), "m", "v", "n").where("g.name is not null").groupBy("g", "m", "v").agg(F.sum("n").alias("n"))
    # A list of steps for each group and measure: its length is bounded by the range of values, not by the texts.
    lists = counted.groupBy("g", "m").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("all"), F.sum("n").alias("total")).where(F.col("total") >= LEAST_SHARE * total)

    def quartile(q: float):
        run = F.aggregate("all", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")), lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["at"], F.when(s["seen"] + x["n"] >= q * F.col("total"), x["v"])).alias("at")))
        return run["at"] / GRID

    fenced = lists.select("g", "m", quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    least = F.coalesce(*[F.when(F.col("m").startswith(m), F.lit(w)) for m, w in LEAST_WIDTH.items()])
    far = F.greatest(FENCE * (F.col("q3") - F.col("q1")), least)
    rows = fenced.select("g", "m", (F.col("q1") - far).alias("low"), (F.col("q3") + far + 1 / GRID).alias("high"))
    made = rows.groupBy("g").agg(*[F.max(F.when(F.col("m") == m, F.col(side))).alias(f"{m}_{side}") for m in _MEASURES for side in ("low", "high")])
    return made.select("g.level", "g.name", *[c for c in made.columns if c != "g"])


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, model: str | None = None, pairs: str | None = None, bands: DataFrame | None = None, least_words: int = 50) -> DataFrame:
    """Base measures, token measures, ``outside`` (the measures that lie outside their bands) and the verdict ``kept`` of each text.

    model: a SentencePiece model with byte fallback, pairs: ranks of byte pairs (default: the public 32k and 50k ones). bands: as :func:`bands_of` gives them.
    """
    measured = durable(measures(df, id_col, text_col, lang_col, model, pairs, least_words))
    limits = durable(bands_of(measured) if bands is None else bands)  # its rows are bounded, see above
    judged = measured
    sides = [f"{m}_{side}" for m in _MEASURES for side in ("low", "high")]
    for level, own in (("language", F.col("language")), ("script", F.col("script")), ("all", F.lit("*"))):
        part = limits.where(F.col("level") == level).select(F.col("name").alias(f"{level}_name"), *[F.col(c).alias(f"{level}_{c}") for c in sides])
        judged = judged.join(F.broadcast(part), own == F.col(f"{level}_name"), "left")
    out = []
    for m in _MEASURES:
        low, high = (F.coalesce(*[f"{level}_{m}_{side}" for level in ("language", "script", "all")]) for side in ("low", "high"))
        out.append(F.when((F.col(m) < low) | (F.col(m) > high), F.lit(m)))
    judged = judged.withColumn("outside", F.array_compact(F.array(*out)))
    return judged.select(*measured.columns, "outside", (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"))
