"""Operators 2, 7, 10: near-duplicates, repeated windows and benchmark items against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import simhash_dedup as sim
from lattica.llm.components import components
from lattica.llm.decontaminate import decontaminate
from lattica.llm.substring_dedup import COVERS, bucket_names, cover_for, pack, substring_dedup, unpack

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = {k: plain_fingerprint(t) for k, t in rows}
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (f"{fps[k]:016x}", find(k)) for k in keys}


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    base = [[rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(30, 120))] for _ in range(n)]
    rows = [" ".join(w) for w in base]
    for w in base[:15]:
        for _ in range(3):
            x = list(w)
            x[rng.randrange(len(x))] = "changed"
            rows.append(" ".join(x))
    return [*rows, rows[0], rows[1].upper(), "", None, " \n", "one", "two words", base[0][0]]


@given(st.text(alphabet="abAB \n\té", max_size=50))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert sim.fingerprint(text) == plain_fingerprint(text)


def test_conjunctions_cover_all_five_shared_bytes():
    from itertools import combinations

    found = sim.conjunctions()
    assert len(found) == 14
    for five in combinations(range(8), 5):
        have = sum(1 << p for p in five)
        assert any(c & have == c for c in found)


def test_components_of_texts(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in sim.simhash_components(df).collect()}
    assert got == plain_components(rows)
    again = sim.simhash_components(df.union(df)).collect()
    assert len(again) == 2 * len(rows)
    assert sim.simhash_components(df.where("false")).count() == 0


def test_hot_posting_lists_are_split_without_loss(spark, monkeypatch):
    """Many near fingerprints in one list, in blocks of four: the links connect what all pairs connect."""
    monkeypatch.setattr(sim, "BLOCK", 4)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 150:
        f = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(30)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    links = sim.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    for r in links.collect():
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3
    got = {r["node"]: r["root"] for r in components(links).collect()}
    root = {f: f for f in signed}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {f: got.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_components_of_links(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(100, k) for k in range(101, 150)]
    pairs = chain + star + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3), (1, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for k in sorted(near):
        if k in want:
            continue
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = k
                todo += near[x]
    assert got == want


def plain_windows(rows, window):
    docs = {k: WORDS.findall(t or "") for k, t in rows}
    seen, gone = set(), {k: set() for k in docs}
    for k in sorted(docs):
        w = docs[k]
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[k] |= set(range(i, i + window))
            seen.add(key)
    return {k: (len(w), len(gone[k]), " ".join(x for i, x in enumerate(w) if i not in gone[k])) for k, w in docs.items()}


def passages(seed, n=50):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(30))
    shared = [[word() for _ in range(rng.randrange(15, 70))] for _ in range(6)]
    rows = []
    for k in range(n):
        w = [word() for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            part = rng.choice(shared)
            cut = rng.randrange(len(part) // 2)
            w[at:at] = part[cut:]
        rows.append((k * 3, rng.choice([" ", "\n", "  \t"]).join(w)))
    return [*rows, (1, None), (2, ""), (4, "x " * 200), (5, "x " * 19), (7, rows[3][1]), (8, rows[3][1])]


@pytest.mark.parametrize("window", [20, 12, 5, 1])
def test_windows(spark, window):
    rows = passages(window)
    df = spark.createDataFrame([(k, t, "c", k) for k, t in rows], "doc_id long, text string, kept string, n_words long")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup(df, window=window).collect()}
    assert got == plain_windows(rows, window)


def test_window_cases(spark):
    long = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (None, long, "c"), (2, long + " end", "d")], "doc_id long, text string, source string")
    got = sorted((r["source"], r["n_removed"]) for r in substring_dedup(df, carry=("source",)).collect())
    assert got == [("a", 30), ("b", 30), ("c", 0), ("d", 30)]
    assert substring_dedup(df.where("false")).count() == 0


def test_covers_and_packing(spark):
    for v, d in COVERS.items():
        for a in range(v):
            for b in range(v):
                assert any((a + x) % v in d and (b + x) % v in d for x in range(v))
    assert cover_for(20) == (13, (0, 1, 3, 9))
    arrays = [np.arange(5, dtype=np.uint32), -np.arange(5, dtype=np.int64), np.array([True, False, True, True, False])]
    for x, y in zip(arrays, unpack(pack(*arrays), np.uint32, np.int64, np.bool_), strict=True):
        assert (x == y).all()
    from pyspark.sql import functions as F

    names = bucket_names(13)
    placed = spark.createDataFrame([(int(b), k) for k, b in enumerate(names)], "bucket int, k int").repartition(13, "bucket").select("k", F.spark_partition_id().alias("p"))
    assert placed.where("k <> p").count() == 0


BENCH = [
    (1, "A train leaves the quiet station at noon and travels 120 km in 2 hours before Alice counts the wagons"),
    (2, "Seven small birds sat together on one long wire until the evening wind carried them all away"),
    (3, "too short"),
    (4, None),
    (5, "Which 3 birds sang?"),
    (6, "1 2 3 4 5 6 7 8 9 10 11 12"),
    (7, ""),
]


def test_decontamination(spark):
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    train = BENCH[0][1]
    docs = [
        (10, f"{filler}. {train}. {filler}"),
        (11, f"{filler} " + train.replace("120 km", "95 miles").replace("2 hours", "3 hours").replace("Alice", "Bruno") + f" {filler}"),
        (12, f"{filler} {BENCH[1][1].upper().lower()} {filler}"),
        (13, f"{filler} seven small birds sat together on one long {filler}"),
        (14, filler * 3),
        (15, None),
        (16, ""),
        (17, "A train leaves the station"),
        (18, " ".join(filler.split() * 400) + " " + BENCH[1][1]),
        (19, f"{filler} too short {filler}"),
        (20, "Too short!"),
        (21, f"{filler}, WHICH 3 birds sang"),
        (22, f"{filler} which 4 birds sang"),
        (23, " ".join(str(7 * k) for k in range(3000))),
        (24, f"{filler} 1 2 3 4 5 6 7 8 9 10 11 12 {filler}"),
    ]
    df = spark.createDataFrame([(k, t, 5, "x") for k, t in docs] + [(12, docs[2][1], 5, "x")], "doc_id long, text string, item_id long, item string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate(df, spark.createDataFrame(BENCH, "item_id long, text string")).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 2), (18, 2), (20, 3), (21, 5), (24, 6)}
    assert got[11, 1]["changed_slots"] and not got[10, 1]["changed_slots"]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate(df.where("false"), bench).count() == 0 and decontaminate(df, bench.where("false")).count() == 0


def test_inconsistent_slots_are_no_match(spark):
    item = "first take 5 apples then add 5 pears then count 5 plums and then weigh 5 figs in the kitchen"
    same = item.replace("5", "9")
    mixed = "first take 1 apples then add 2 pears then count 3 plums and then weigh 4 figs in the kitchen"
    df = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    got = decontaminate(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["changed_slots"]) for r in got] == [(1, True)]




def plain_decontaminate(docs, items, width=8):
    """All pairs of documents and items (lists of template words), window by window."""
    from lattica.llm.decontaminate import LEAST_PLAIN, LEAST_SHORT, LEAST_WINDOWS, MARK, NAME, SHARE

    value = lambda w: w[2:] if w.startswith(MARK) else w

    def windows(words):
        for i in range(len(words) - width + 1):
            w = words[i : i + width]
            marks = [x for x in w if x.startswith(MARK)]
            if len(marks) > width - LEAST_PLAIN:
                yield i, tuple(w), (), False
            else:
                yield i, tuple(x[:2] if x.startswith(MARK) else x for x in w), tuple(marks), False
            if any(x.startswith(NAME) for x in w):
                key = tuple(x[2:] if x.startswith(NAME) else x[:2] if x.startswith(MARK) else x for x in w)
                yield i, ("folded", *key), tuple(x for x in marks if not x.startswith(NAME)), True

    def same(key):  # a folded window meets a plain one of the same words
        return key[1:] if key[0] == "folded" else key

    out = {}
    for item, words in items.items():
        if 0 < len(words) < width:
            v = [value(w) for w in words]
            for d, text in docs.items():
                t = [value(w) for w in text]
                if (len(v) < LEAST_SHORT and t == v) or (len(v) >= LEAST_SHORT and any(t[i : i + len(v)] == v for i in range(len(t)))):
                    out[d, item] = (1, 1)
            continue
        first = {}
        for i, key, slots, folded in windows(words):
            k = same(key)
            if k not in first or (i, slots) < first[k][:2]:
                first[k] = (i, slots, folded)
        n = sum(not f for _, _, f in first.values())
        for d, text in docs.items():
            shifts = {}
            for j, key, slots, _ in windows(text):
                if same(key) in first:
                    i, own, _ = first[same(key)]
                    at = shifts.setdefault(j - i, (set(), set()))
                    at[0].add(i)
                    at[1].update(zip(own, slots))
            matched = sum(len(ats) for ats, pairs in shifts.values() if len({a for a, _ in pairs}) == len(pairs))
            if matched and (min(matched, n) >= LEAST_WINDOWS or min(matched, n) >= SHARE * n):
                out[d, item] = (n, min(matched, n))
    return out


def test_decontamination_against_all_pairs(spark):
    import random

    from pyspark.sql import functions as F

    from lattica.llm.decontaminate import template_words

    rng = random.Random(17)
    vocabulary = "the quick train left for paris with apples and 5 12 7 km Alice Bruno of red green then why how many".split()
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 6, 9, 14, 25])))) for k in range(25)]
    items.append((50, items[3][1] + " " + items[3][1]))
    docs = []
    for k in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(items)[1].split()
            if rng.random() < 0.5:
                part = [x.replace("5", "31").replace("Alice", "Carla").replace("12", "7") for x in part]
            if rng.random() < 0.3:
                part = [x.upper() for x in part]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part[rng.randrange(3) :]
        docs.append((k, " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    words = lambda df: {r[0]: r[1] for r in df.select(df.columns[0], template_words(F.col("text"))).collect()}
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"]) for r in decontaminate(d, b).collect()}
    want = plain_decontaminate(words(d), words(b))
    assert len(want) > 40 and got == want


def test_copies_in_another_case(spark):
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    train = BENCH[0][1]
    other = train.replace("120 km", "95 miles").replace("2 hours", "3 hours")
    cases = [str.upper, str.lower, str.title, str.swapcase]
    bench = [BENCH[0], (2, BENCH[1][1].replace("small", "große")), *BENCH[2:]]
    docs = [(10 * j + k, f"{filler}. {case(item)}. {filler}") for j, item in enumerate([train, bench[1][1], other]) for k, case in enumerate(cases)]
    df = spark.createDataFrame([*docs, (90, filler.upper() * 3), (91, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert set(got) == {(k, 1 if k // 10 != 1 else 2) for k, _ in docs}
    assert all(r["changed_slots"] == (k >= 20) and r["n_matched"] == r["n_windows"] for (k, _), r in got.items())
