"""Operators 4, 5, 6, 8 and the pipeline: round trips, brute force and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import chat_format, langid_crf, letters, toxicity_mil, url_filter
from lattica.llm.letters import words_of


def conversations(spark):
    odd = "<|im_end|>\n<|im_start|>assistant\n\\b \\p <\\p| <<|| é漢"
    rows = [(1, 0, "system", "rules " * 30), (1, 1, "user", "q" * 900), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", "long " * 1500), (1, 5, "assistant", ""), (1, 6, "us\ner\\", "x"), (1, 7, "assistant", "end\\")]
    rows += [(2, 0, "user", "same"), (2, 0, "user", "same"), (2, None, "assistant", "null turn"), (2, 1, None, "no role"), (None, 0, "assistant", "null id")]
    rows += [(3, k, ("user", "assistant")[k % 2], f"turn {k} " * 40) for k in range(60)]
    return spark.createDataFrame([(*r, "c", 9) for r in rows], "conv_id long, turn long, role string, text string, span string, n long")


def plain_digests(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"], r["role"] or "", r["text"] or ""))
    out = {}
    for c, rows in by.items():
        rows.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        under = "".join(t for _, _, r, t in rows if r == "assistant")
        out[c] = (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("budget", "history"), [(2048, 256), (1500, 400), (60, 0)])
def test_chat_round_trip(spark, budget, history):
    df = conversations(spark)
    made = chat_format.windows(df, budget=budget, history=history)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(made).collect()}
    assert got == plain_digests(df)
    rows = made.collect()
    for r in rows:
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>\n")
    if budget == 1500:
        mine = sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: r["window"])
        assert len(mine) > 1 and all(r["formatted"].startswith("<|im_start|>system\nrules") for r in mine)
        three = [r for r in rows if r["conv_id"] == 3]
        assert any(r["repeated"] for r in three)
    assert chat_format.windows(df.where("false")).count() == 0


def plain_spans(turns, budget, history):
    """The seats of the turns of each window, repeated ones first, from (role, tokens) in order."""
    n = len(turns)
    lead = bool(turns) and turns[0][0] == "system"
    own = [0 if lead and i == 0 else k for i, (_, k) in enumerate(turns)]
    left = budget - (turns[0][1] if lead else 0)
    room = max(left - history, 1)
    spans, i = [], int(lead)
    while i < n:
        if 2 * own[i] > room:
            spans.append([i])
            i += 1
            continue
        j = i
        while j < n and 2 * own[j] <= room:
            j += 1
        cell, before, cells = room - max(own[i:j]), 0, {}
        for x in range(i, j):
            cells.setdefault(before // cell, []).append(x)
            before += own[x]
        spans += cells.values()
        i = j
    out = []
    for s, span in enumerate(spans or [[]]):
        again = []
        if s:
            allowed = min(history, left - sum(own[x] for x in span))
            for x in spans[s - 1][::-1]:
                if sum(own[y] for y in spans[s - 1] if y >= x) <= allowed:
                    again.insert(0, x)
        head = [0] if lead else []
        out.append((head + again if s else [], (head if not s else []) + span))
    return out


def test_chat_windows_keep_the_budget(spark):
    rng = random.Random(11)
    rows, plain = [], {}
    for c in range(60):
        turns = []
        for k in range(rng.choice([1, 2, 5, 30, 80])):
            role = "system" if k == 0 and c % 3 else rng.choice(["user", "assistant", "system", "tool"])
            text = "é<|x" * rng.choice([0, 1, 5, 20, 60]) if c % 7 else "y" * rng.choice([1, 700])
            turns.append((role, text))
            rows.append((c, k, role, text))
        plain[c] = [(r, len(f"<|im_start|>{r}\n".encode()) + len(t.replace("<|", "<\\p").encode()) + 11) for r, t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget, history in ((2000, 200), (600, 250), (300, 0), (100, 99)):
        made = {}
        for r in chat_format.windows(df, budget=budget, history=history).collect():
            made.setdefault(r["conv_id"], []).append(r)
        for c, turns in plain.items():
            got = sorted(made[c], key=lambda r: r["window"])
            want = plain_spans(turns, budget, history)
            assert [(r["repeated"], r["tokens"]) for r in got] == [(len(again), sum(turns[x][1] for x in again + own)) for again, own in want]
            for r, (again, own) in zip(got, want, strict=True):
                assert r["tokens"] == len(r["formatted"].encode())
                talk = [x for x in own if x or turns[0][0] != "system"]
                assert r["tokens"] <= budget or (len(talk) <= 1 and all(x == 0 for x in again))


def test_chat_budget_argument(spark):
    with pytest.raises(ValueError):
        chat_format.windows(conversations(spark), budget=100, history=100)


URLS = ["http://EXAMPLE.org/es/x", "https://a.example.org/en/1?q", "https://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/", "http://com/de/1", "http://evil.net/p/?utm_source=a&b=1", "http://www.evil.net/p?b=1#f", "http://evil.net/p?b=2", "http://notexample.org", "no url", "", None, "http://ÉVIL.net/p", "x://h?y://z/es/", "http://evil.net/p/?b=1"]


def plain_verdict(url, listed):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, says in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, says
    return host, path, best and best[0], best[1] if best else "block" if url in listed else "allow"


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_url_filter(spark, most):
    pages = spark.createDataFrame([(k, u, "c") for k, u in enumerate(URLS * 3)] + [(None, URLS[0], "c")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://evil.net/p?b=1",), (None,), ("http://other.net/",)] + [(f"http://n{k}.net/",) for k in range(300)], "url string")
    want_listed = {URLS[6], URLS[7], URLS[15]}
    rows = url_filter.url_filter(pages, url_filter.listed_urls(listed), broadcast_bytes=most).collect()
    assert len(rows) == len(URLS) * 3 + 1
    for r in rows:
        url = URLS[r["page_id"] % len(URLS)] if r["page_id"] is not None else URLS[0]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(url, want_listed)
    none = url_filter.url_filter(pages, url_filter.listed_urls(listed.where("false")))
    assert none.where("verdict = 'block' and rule is null").count() == 0
    assert url_filter.url_filter(pages.where("false"), url_filter.listed_urls(listed)).count() == 0


def test_stated_list(spark):
    got = [r["url"] for r in url_filter.stated_list(spark).where("url like '%/de/4' or url like '%/de/5'").collect()]
    assert len(set(got)) == len(got) == 3 * 6 * 3 and "http://m.ads-track.example.net/de/4" in got
    assert url_filter.stated_list(spark).count() == 3 * 6 * 3 * 4 * 2500


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("u"))
    n = url_filter.blocks_for(3000)
    bloom = url_filter.bloom_filter(listed, "u", n)
    assert bloom.count() <= n
    probe = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("u"), "id").withColumn("block", url_filter._block(F.col("u"), n)).join(bloom, "block", "left")
    hit = probe.select("id", url_filter.passes(F.col("u")).alias("hit"))
    assert hit.where("id < 3000 and not hit").count() == 0
    assert hit.where("id >= 3000 and hit").count() < 400


def languages(n, seed):
    rng = random.Random(seed)
    parts = {"en": "the th er on an re he in ed nd ha at en es of or", "fr": "les de eau ai on ou tion ent que re é è un la eux", "de": "der die ung sch ein ich und keit en er ge ver ü ö ß"}
    rows = []
    for _ in range(n):
        lang = rng.choice(sorted(parts))
        p = parts[lang].split()
        rows.append((". ".join(" ".join("".join(rng.choice(p) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 12))) for _ in range(5)), lang))
    return rows


def test_language_held_out_and_code_switched(spark):
    rows = languages(500, 1)
    df = spark.createDataFrame(rows, "text string, lang string")
    crf = langid_crf.train(df, per_language=120)
    test = languages(200, 2) + [(None, "und"), ("", "und"), ("123 !!", "und")]
    got = spark.createDataFrame(test, "text string, lang string").select("lang", langid_crf.language(crf, F.col("text")).alias("f")).collect()
    assert np.mean([r["lang"] == r["f"]["lang"] for r in got]) > 0.97
    assert all(0 <= r["f"]["score"] <= 1 for r in got)
    mixed = languages(1, 3)[0][0] + " " + next(t for t, g in languages(50, 4) if g != languages(1, 3)[0][1])
    labels = {lang for _, lang, _ in langid_crf.word_labels(crf, mixed)}
    assert len(labels) > 1
    assert langid_crf.train(df.where("false")) is None
    crowd = df.union(spark.createDataFrame([(f"word{k}", f"l{k}") for k in range(150)], df.schema)).union(spark.createDataFrame([("long " * 5000, "xx")], df.schema))
    rows_ = langid_crf.training_rows(crowd, "text", "lang", [])
    assert rows_["lang"].nunique() == langid_crf.MOST_LANGUAGES and {"de", "en", "fr"} <= set(rows_["lang"]) and "xx" not in set(rows_["lang"])
    clash = df.limit(20).withColumn("score", F.lit("x")).withColumn("doc_id", F.lit(1))
    assert clash.union(clash).select("*", langid_crf.language(crf, F.col("text")).alias("f")).count() == 40
    assert langid_crf.predict(None, ["a", None]) [0] == ["und", "und"]
    assert langid_crf.train(df.withColumn("lang", F.lit(None).cast("string"))) is None


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    scores, trans = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    starts = np.array([0, 4, 5])
    post, pairs = langid_crf.forward_backward(scores, trans, starts, want_pairs=True)
    want, expected = np.zeros((7, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 5), (5, 7)):
        paths = list(product(range(3), repeat=b - a))
        value = np.array([np.exp(sum(scores[a + i, y] for i, y in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        value /= value.sum()
        for p, v in zip(paths, value, strict=True):
            for i, y in enumerate(p):
                want[a + i, y] += v
            for x, y in zip(p, p[1:]):
                expected[x, y] += v
    assert np.allclose(post, want) and np.allclose(pairs, expected)


def test_gradients_are_the_slopes_of_the_likelihood():
    """What the fit follows (gold less posteriors, seen less expected transitions) against differences of the likelihood by enumeration."""
    from itertools import product

    rng = np.random.default_rng(2)
    scores, trans, gold, starts = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), np.array([0, 2, 1, 1, 0]), np.array([0, 3])

    def likelihood(s, t):
        out = 0.0
        for a, b in ((0, 3), (3, 5)):
            value = lambda p: sum(s[a + i, y] for i, y in enumerate(p)) + sum(t[x, y] for x, y in zip(p, p[1:]))
            out += value(gold[a:b]) - np.log(sum(np.exp(value(p)) for p in product(range(3), repeat=b - a)))
        return out

    post, pairs = langid_crf.forward_backward(scores, trans, starts, want_pairs=True)
    seen = np.zeros((3, 3))
    for x, y in ((0, 2), (2, 1), (1, 0)):
        seen[x, y] += 1
    step = 1e-6

    def slope(at, k, which):
        up, down = [x.copy() for x in (scores, trans)], [x.copy() for x in (scores, trans)]
        up[which][at, k] += step
        down[which][at, k] -= step
        return (likelihood(*up) - likelihood(*down)) / (2 * step)

    assert np.allclose(np.eye(3)[gold] - post, [[slope(i, k, 0) for k in range(3)] for i in range(5)], atol=1e-5)
    assert np.allclose(seen - pairs, [[slope(i, k, 1) for k in range(3)] for i in range(3)], atol=1e-5)


def test_words_of_texts():
    w = words_of(["Ab c1d. x", None, "", "é\nf!g"])
    assert w.doc.tolist() == [0, 0, 0, 0, 3, 3, 3]
    assert w.sentence.tolist() == [0, 0, 0, 1, 2, 3, 4]
    assert "".join(map(chr, w.chars[w.starts[0] : w.ends[0]])) == "ab"


def toxic_rows(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("ptkbdg") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows = []
    for k in range(n):
        toxic = rng.random() < 0.3
        sentences = [[rng.choice(plain) for _ in range(8)] for _ in range(6)]
        if toxic:
            for _ in range(2):
                rng.choice(sentences)[3] = rng.choice(["scum", "vermin", "filth"])
        rows.append((k, ". ".join(map(" ".join, sentences)), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(600, 1)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    mil = toxicity_mil.train(docs, labels)
    test = toxic_rows(300, 1)
    got = toxicity_mil.scores(mil, [t for _, t, _ in test] + [None, "", "...", "scum"])
    assert np.mean((got[:300] >= 0.5) == np.array([y for _, _, y in test])) > 0.97
    assert (got[300:303] == 0).all() and got[303] > 0.5
    texts = ["one fine day. you scum are here. fine day", None, "fine. fine. fine. vermin and filth"]
    score, found = toxicity_mil.offending(mil, texts)
    assert [[k for k, _ in x] for x in found] == [[1], [], [3]] and np.allclose(score, toxicity_mil.scores(mil, texts))
    assert toxicity_mil.train(docs.where("false"), labels) is None
    assert toxicity_mil.train(docs, labels.where("toxic = 0")) is None
    out = docs.withColumn("score", F.lit("clash")).select("doc_id", "text", toxicity_mil.toxicity(mil, F.col("text")).alias("s")).collect()
    assert len(out) == 600 and np.allclose([r["s"]["score"] for r in out], toxicity_mil.scores(mil, [r["text"] for r in out]))
    for r in out:
        for hit in r["s"]["sentences"]:
            assert set(r["text"].split(". ")[hit["number"]].split()) & {"scum", "vermin", "filth"}
    twice = docs.limit(3).union(docs.limit(3)).select("doc_id", toxicity_mil.toxicity(mil, F.col("text")).alias("s")).distinct()
    assert twice.count() == 3
    assert docs.where("false").select(toxicity_mil.toxicity(mil, F.col("text")).alias("s")).count() == 0
    assert {r["s"]["score"] for r in docs.limit(5).select(toxicity_mil.toxicity(None, F.col("text")).alias("s")).collect()} == {0.0}


def test_noisy_or_gradient_is_the_slope_of_the_likelihood():
    """The gradient that the fit follows, against differences of the weighted likelihood."""
    rng = np.random.default_rng(3)
    doc, y, weight = np.array([0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0]), 3.0

    def likelihood(z):
        total = np.bincount(doc, weights=toxicity_mil.softplus(z))
        return (weight * y * np.log(-np.expm1(-total)) - (1 - y) * total).sum()

    z = rng.normal(size=6)
    total = np.bincount(doc, weights=toxicity_mil.softplus(z))
    got = toxicity_mil.slopes(total, y, weight)[doc] / (1 + np.exp(-z))
    want = [(likelihood(z + 1e-6 * np.eye(6)[k]) - likelihood(z - 1e-6 * np.eye(6)[k])) / 2e-6 for k in range(6)]
    assert np.allclose(got, want, atol=1e-5)


def test_long_texts_are_scored_in_parts(monkeypatch):
    rng = random.Random(6)
    rows = toxic_rows(300, 2)
    mil = toxicity_mil.fit([t for _, t, _ in rows], [y for *_, y in rows])
    crf = langid_crf.fit(*zip(*languages(120, 8), strict=True))
    texts = [". ".join(t for _, t, _ in rng.sample(rows, 30)), None, "x y z. " * 200, "", rows[0][1]]
    score, (langs, share) = toxicity_mil.scores(mil, texts), langid_crf.predict(crf, texts)
    monkeypatch.setattr(letters, "CHARS_AT_ONCE", 200)
    assert np.allclose(toxicity_mil.scores(mil, texts), score) and langid_crf.predict(crf, texts)[0] == langs
    assert "".join(letters.pieces_of(texts[0], 200)) == texts[0] and max(map(len, letters.pieces_of("y" * 5000, 200))) <= 300
    assert [d for docs, _ in letters.parts([None, "", "a"]) for d in docs] == [0, 1, 2] and not list(letters.parts([]))


def test_noisy_or_is_one_minus_the_product():
    mil = toxicity_mil.Mil(np.zeros(1 << toxicity_mil.BITS, np.uint32), np.zeros(1 << toxicity_mil.BITS, np.float32), -1.0)
    p = 1 / (1 + np.e)
    assert np.isclose(toxicity_mil.scores(mil, ["a. b. c"])[0], 1 - (1 - p) ** 3)


def test_pipeline_against_brute_force(spark, tmp_path):
    from tests.llm.test_duplicates import plain_components, plain_windows

    rng = random.Random(9)
    rows = []
    for k, (text, lang) in enumerate(languages(60, 5)):
        rows.append((k, text + f" {' '.join(rng.choice('abcd') + rng.choice('efgh') for _ in range(30))}", lang, "src", 0))
    shared = " ".join(f"passage{'abcdefghij'[k % 10]}{'klmno'[k // 10]}" for k in range(40))
    for k in (3, 9, 20):
        rows[k] = (k, rows[k][1] + " " + shared, *rows[k][2:])
    item = "which of the seven grey ships came home before the long winter storm began to blow"
    rows[30] = (30, rows[30][1] + " " + item + " " + rows[30][1][:50], *rows[30][2:])
    rows += [(100, rows[5][1], "en", "copy", 0), (101, None, None, "null", 0), (102, "12345", "en", "digits", 0), (103, "", "fr", "empty", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [(k, t) for k, t, *_ in rows if t and re.search("[a-zé]", t)]
    groups = plain_components(left)
    left = [(k, t) for k, t in left if groups[k][1] == k]
    cut = plain_windows(left, 20)
    left = [(k, cut[k][2] if cut[k][1] else t) for k, t in left if cut[k][0] > cut[k][1]]
    left = [(k, t) for k, t in left if item not in t]
    from lattica.llm.pieces import codec, vocabulary

    assert set(got) == {k for k, _ in left}
    for k, t in left:
        assert got[k]["pieces"] == codec(vocabulary()).sp.encode(t) and got[k]["n_pieces"] == len(got[k]["pieces"])
    assert 30 not in got and 100 not in got and 101 not in got


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_pipeline_cases(spark, tmp_path, empty):
    """Empty tables; extra columns whose names clash, null ids and repeated rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, item string, kept string"
    rows = [(k, text, lang, None, 0, 1, "x", "y") for k, (text, lang) in enumerate(languages(40, 5))]
    rows += [rows[0], (None, languages(1, 6)[0][0] + " and more of it", "en", "s", None, None, None, None), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, "some words that no document has at all in this order", "x")], "item_id long, text string, id string")
    docs.where("false" if empty == "documents" else "true").write.parquet(f"{tmp_path}/documents.parquet")
    bench.where("false" if empty == "benchmark" else "true").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == (0 if empty == "documents" else 42)
    if got:
        assert sum(r["doc_id"] is None for r in got) == 1 and sum(r["doc_id"] == 0 for r in got) == 2
