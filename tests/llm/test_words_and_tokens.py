"""Operators 1, 3, 9: words, tokens and pieces against plain recounts and the libraries."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lattica.llm import quality_rules, segments
from lattica.llm import sentencepiece_scan as scan
from lattica.llm.pieces import codec, vocabulary
from lattica.llm.token_counts import counter, prefix_table, token_counts

TEXTS = ["", " ", "one", "a b c a b c a b c", "x\nx\n\n\nx y", "l'été, it's we'll  \t x", "日本語 テキスト", "hi!<|endoftext|> there", "é" * 300, "word " * 40, "a " * 7 + "b", "###$$ %%&|<>*", "q" * 5000, "▁x ▁", "a\x00b\x1cc d", None]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("n_tokens", T.LongType())])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", -1) for k, t in enumerate(TEXTS)] + [(None, "null id", None, None), (3, TEXTS[3], "again", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_base(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def _column(texts):
    return pa.array(texts, pa.string())


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b#é\u2003", max_size=60)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_base_measures(texts):
    got = quality_rules.base_measures(segments.texts_of(_column(texts)))
    assert [tuple(int(x[d]) for x in got) for d in range(len(texts))] == [plain_base(t) for t in texts]


def test_windows_whose_hashes_meet_are_told_apart(monkeypatch):
    """With a hash that all windows share, windows are compared themselves."""
    monkeypatch.setattr(quality_rules, "HASH_BITS", 0)
    texts = ["a b c a b c a", "x y z", "a b c", "a b c d a b c"]
    got = quality_rules.base_measures(segments.texts_of(_column(texts)))
    assert got[4].tolist() == [plain_base(t)[4] for t in texts]


def plain_entropy(ids):
    counts = np.array(list(Counter(ids).values()), dtype=float)
    return -(counts / len(ids) * np.log2(counts / len(ids))).sum() if ids else 0.0


def test_quality_rules_rows(docs):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(TEXTS) + 2
    sp = codec(vocabulary()).sp
    pairs = quality_rules.pair_codec(vocabulary("byte_bpe_50k.tiktoken"))
    for r in got:
        text = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else "null id") or ""
        base = plain_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r["base_failed"] and r["kept"])
        ids = sp.encode(text)
        assert r["n_tokens"] == len(ids)
        for name, own, is_byte in (("pieces", ids, sp.is_byte), ("pairs", pairs.encode(text), lambda k: bool(pairs.is_byte[k]))):
            assert math.isclose(r[f"token_entropy_{name}"], plain_entropy(own), abs_tol=1e-9)
            assert math.isclose(r[f"byte_share_{name}"], sum(map(is_byte, own)) / max(1, len(own)))
            assert math.isclose(r[f"chars_per_token_{name}"], len(text) / len(own) if own else 0.0)


def prose(rng, n=200):
    return " ".join(rng.choice("the of and thing house water seven letters garden morning river stone bright window travel".split()) + rng.choice(["", "s", "ing"]) for _ in range(n))


def test_bands_reject_what_is_no_prose(spark):
    """Junk of three kinds among prose: each lies outside the band of the measure that it is made for, and the prose stays."""
    rng = random.Random(1)
    rows = [(k, prose(rng), "en") for k in range(150)] + [(200 + k, prose(rng), None) for k in range(20)]
    syllables = " ".join("".join(rng.choice("bcdfgqxz") for _ in range(6)) for _ in range(150))
    runes = " ".join("".join(chr(rng.randrange(0x16A0, 0x16E0)) for _ in range(4)) for _ in range(100))
    flat = " ".join(rng.choice("of to in it on at by as is we".split()) + "\n" * (k % 7 == 0) for k in range(80))
    rows += [(900, syllables, "en"), (901, runes, "en"), (902, flat, "en"), (903, syllables, None), (904, None, "en"), (905, "", None)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lang_col="lang").collect()}
    assert all(got[k]["kept"] for k, *_ in rows if k < 900)
    assert any(m.startswith("chars_per_token") for m in got[900]["outside"]) and any(m.startswith("chars_per_token") for m in got[903]["outside"])
    assert any(m.startswith("byte_share") for m in got[901]["outside"])
    assert any(m.startswith("token_entropy") for m in got[902]["outside"]) and not got[902]["base_failed"]
    assert not any(got[k]["kept"] for k in range(900, 906))


def test_given_bands_and_scripts(spark):
    t = segments.texts_of(_column(["привет", "abc", "12", "漢字", None, "", "é" * 3]))
    assert quality_rules.scripts(t) == ["cyrillic", "latin", "none", "han", "none", "none", "latin"]
    rng = random.Random(2)
    df = spark.createDataFrame([(k, prose(rng)) for k in range(30)], "doc_id long, text string")
    bands = quality_rules.bands_of(quality_rules.measures(df))
    narrow = bands.withColumn("token_entropy_pieces_low", F.lit(50.0))
    assert quality_rules.quality_rules(df, bands=bands).where("kept").count() == 30
    assert quality_rules.quality_rules(df, bands=narrow).where("kept or not array_contains(outside, 'token_entropy_pieces')").count() == 0


def test_quartiles_are_those_of_all_texts(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, prose(rng, rng.randrange(50, 90)), "en" if k % 3 else "xx") for k in range(90)], "doc_id long, text string, lang string")
    measured = quality_rules.measures(df, lang_col="lang")
    rows = {(r["level"], r["name"]): r for r in quality_rules.bands_of(measured).collect()}
    assert set(rows) == {("language", "en"), ("language", "xx"), ("script", "latin"), ("all", "*")}
    own = sorted(math.floor(r["token_entropy_pairs"] * quality_rules.GRID) / quality_rules.GRID for r in measured.collect() if r["language"] == "xx" and not r["base_failed"])
    q1, q3 = own[math.ceil(len(own) / 4) - 1], own[math.ceil(len(own) * 3 / 4) - 1]
    far = max(quality_rules.FENCE * (q3 - q1), 1.0)
    assert math.isclose(rows["language", "xx"]["token_entropy_pairs_low"], q1 - far) and math.isclose(rows["language", "xx"]["token_entropy_pairs_high"], q3 + far + 1 / quality_rules.GRID)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for made in (quality_rules.quality_rules(none), token_counts(none), prefix_table(none), scan.sentencepiece_encode(none)):
        assert made.count() == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_token_counts(docs, library):
    for r in token_counts(docs, limit=20, every=7).collect():
        text = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else "null id") or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 20)
        if len(text) < 400:
            prefixes = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
            assert r["fits_chars"] == max(i for i, n in enumerate(prefixes) if n <= 20)
            assert r["tokens_at"] == prefixes[7::7]


@given(st.text(alphabet="abthe '’sre\n 1é漢<|endoftext|>!.?", max_size=40))
@settings(max_examples=150, deadline=None)
def test_prefix_counts(text):
    library = _library()
    got = counter(vocabulary("byte_bpe_50k.json")).prefix_counts(text).tolist()
    assert got == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


@given(st.lists(st.text(alphabet="abthe '’sre\n\t 1é漢\x1c\xa0\u3000<|endoftext|>!.?", max_size=40), min_size=1, max_size=3), st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_prefix_tables_of_many_texts(texts, budget):
    library = _library()
    got = counter(vocabulary("byte_bpe_50k.json")).table_of(_column(texts))
    for d, text in enumerate(texts):
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert got.n_tokens[d] == want[-1] and [got.at(d, i) for i in range(len(text) + 1)] == want
        assert got.longest(d, budget) == max(i for i, n in enumerate(want) if n <= budget)


def _library(known=[]):  # noqa: B006
    if not known:
        known.append(Tokenizer.from_file(vocabulary("byte_bpe_50k.json")))
    return known[0]


def test_many_words_at_once_count_like_single_ones():
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu é'9") for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    text = " ".join(words)
    assert counter(vocabulary("byte_bpe_50k.json")).text_count(text) == len(_library().encode(text, add_special_tokens=False).ids)


def test_prefix_table(spark):
    got = prefix_table(spark.createDataFrame([(1, "the thing"), (2, None)], "doc_id long, text string")).collect()
    assert [r["counts"] for r in sorted(got)] == [[len(_library().encode("the thing"[:i]).ids) for i in range(10)], [0]]


@given(st.text(alphabet="abethn \n漢▁é", max_size=60), st.integers(2, 20), st.integers(2, 5))
@settings(max_examples=250, deadline=None)
def test_chunked_encoding_is_the_librarys(text, chunk, fan):
    pieces = codec(vocabulary())
    want = pieces.sp.encode(text)
    assert pieces.encode(text) == want
    assert scan.encode_chunked(scan.lattice_of(vocabulary()), text, chunk, fan) == want
    assert pieces.decode(want) == text.replace("▁", " ")


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.4, -np.inf, -rng.integers(0, 9, (4, 4)).astype(float)) for _ in range(3))
    assert (scan.compose(scan.compose(a, b), c) == scan.compose(a, scan.compose(b, c))).all()


def test_encode_and_decode_rows(spark):
    """Giants without spaces: boundaries cut words, matrices have several states, and there are several levels of the tree."""
    rng = random.Random(5)
    giant = "".join(rng.choice(["th", "e", "in", "g", "word"]) for _ in range(400))
    texts = [*TEXTS, giant, giant[:300] + " " + giant + "  " + giant[50:], "漢字 " * 90]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(len(texts) - 3, giant, "y")], "doc_id long, text string, pieces string")
    coded = scan.sentencepiece_encode(df, giant=200, chunk=20, carry=("text",), decode=True, fan=3)
    got = coded.withColumn("back", scan.sentencepiece_decode(coded["pieces"])).collect()
    assert len(got) == len(texts) + 1
    sp = codec(vocabulary()).sp
    for r in got:
        assert r["pieces"] == sp.encode(r["text"] or "")
        assert r["back"] == r["decoded"] == (r["text"] or "").replace("▁", " ")
        if r["text"] == giant:
            assert r["n_chunks"] > 27 and r["n_states"] > 1


def test_walks_that_meet_give_the_matrix_of_single_walks(monkeypatch):
    lattice = scan.lattice_of(vocabulary())
    rng = random.Random(8)
    for _ in range(20):
        text = "".join(rng.choice(["th", "e", "in", "ion", "word", "a", "a"]) for _ in range(80))
        left, right = lattice.states(text, 20), lattice.states(text, 130)
        monkeypatch.setattr(scan, "MEET", 10_000)
        want = lattice.whole_walks(text, left, right)
        for meet in (1, 5, 30):
            monkeypatch.setattr(scan, "MEET", meet)
            assert (lattice.whole_walks(text, left, right) == want).all()
        assert np.isfinite(want).any()


def test_slices_and_flat_texts():
    texts = ["ab", None, "", "é" * 50, "x y  z", "\u2003q"]
    column = _column(["skipped", *texts]).slice(1)
    assert [x for a, n in segments.slices(column, 10) for x in column.slice(a, n).to_pylist()] == texts
    assert [n for _, n in segments.slices(column, 10)] == [3, 1, 2]
    t = segments.texts_of(column)
    assert [t.data[a + 1 : b].tobytes().decode() for a, b in zip(t.offsets, t.offsets[1:])] == [x or "" for x in texts]
    assert t.chars().tolist() == [len(x or "") for x in texts]
    starts, ends = segments.words(t)
    assert [t.data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["ab", "é" * 50, "x", "y", "z", "\u2003q"]
    assert list(segments.slices(_column([]))) == [] and segments.texts_of(_column([])).n == 0
