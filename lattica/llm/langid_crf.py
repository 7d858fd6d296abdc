"""Operator 6: languages of words by a linear-chain conditional random field.

The labels are the languages that the training rows have. A word's features are its character bigrams and
trigrams (with its ends), its first and last three letters, and its entry in a learned lexicon; transitions
between the labels of neighbouring words of a sentence are learned too. Forward-backward gives each word's
posterior; a text's score for a language is the mean posterior of its words.

Training texts have one label each, so chains are made of sentences of several texts: half of them switch
language, which is how the transitions see code-switching.

Cases: a null text, or one without letters, is ``und`` with score 0; so is every text where no row has a
label to learn from. Ties go to the first label in alphabetical order. Repeated rows are predicted alike;
extra columns are not read; an empty table gives an empty result. A very long text is labelled in parts that
end at sentences, or at words where a part has no sentence end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .letters import Words, mix, parts, words_of

#: Training rows of each language at most (about): the bound of the fitting sample.
SAMPLE_PER_LANGUAGE = 250
BITS, LEXICON_BITS = 17, 17
#: Texts of more characters are not in the sample, and languages beyond these (those of most rows) are not learned.
SAMPLE_CHARS, MOST_LANGUAGES = 20_000, 128
_A, _B = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA24BAED4963EE407)


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int32)


def char_features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the bigram and the trigram that end at each place of each word (its end included), and where each word's places begin."""
    size = w.ends - w.starts + 1
    first = np.cumsum(size) - size
    place = np.repeat(w.starts - first, size) + np.arange(size.sum())
    c0, c1 = w.chars[place].astype(np.uint64), w.chars[place - 1].astype(np.uint64)
    c2 = np.where(c1 > 0, w.chars[np.maximum(place - 2, 0)], 0).astype(np.uint64)
    two = c0 + (c1 << np.uint64(21))
    return _slots(two * _A + np.uint64(1), BITS), _slots(two * _A + c2 * _B + np.uint64(2), BITS), first


def word_features(w: Words) -> list[np.ndarray]:
    """Slots of each word's first three and last three letters."""
    last = len(w.chars) - 1
    get = lambda i, ok: np.where(ok, w.chars[np.clip(i, 0, last)], 0).astype(np.uint64)
    out = []
    for tag, at in ((3, [w.starts, w.starts + 1, w.starts + 2]), (4, [w.ends - 1, w.ends - 2, w.ends - 3])):
        a, b, c = (get(i, (i >= w.starts) & (i < w.ends)) for i in at)
        out.append(_slots((a + (b << np.uint64(21))) * _A + c * _B + np.uint64(tag), BITS))
    return out


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # feature slot x label
    lexicon: np.ndarray  # lexicon slot x label
    signature: np.ndarray  # of the word that a lexicon slot stands for; 0: none
    transitions: np.ndarray
    bias: np.ndarray

    def lexicon_slots(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        slot = (w.hashes >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
        return slot, self.signature[slot] == (w.hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def emissions(self, w: Words) -> np.ndarray:
        two, three, first = char_features(w)
        out = np.add.reduceat(self.weights[two] + self.weights[three], first, axis=0) if len(first) else np.zeros((0, len(self.labels)), dtype=np.float32)
        for slots in word_features(w):
            out += self.weights[slots]
        slot, known = self.lexicon_slots(w)
        out += self.lexicon[slot] * known[:, None]
        return out + self.bias


def forward_backward(scores: np.ndarray, transitions: np.ndarray, starts: np.ndarray, want_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors of each word; chains begin at ``starts``. With want_pairs also the expected transition counts.

    All chains go forward together, longest first, so that each step is one array operation.
    """
    n, k = scores.shape
    size = np.diff(starts, append=n)
    order = np.argsort(-size, kind="stable")
    begin, size = starts[order], size[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    a = np.exp(transitions).astype(np.float64)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, most + 1), side="right")  # chains with more than t words
    pairs = np.zeros((k, k)) if want_pairs else None
    for t in range(most):
        at = begin[: live[t]] + t
        x = e[at] if t == 0 else (alpha[at - 1] @ a) * e[at]
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    beta[begin + size - 1] = 1.0
    for t in range(most - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        eb = e[at + 1] * beta[at + 1]
        x = eb @ a.T
        beta[at] = x / x.sum(axis=1, keepdims=True)
        if want_pairs:
            xi = alpha[at][:, :, None] * a[None] * eb[:, None, :]
            pairs += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), pairs


def chain_starts(w: Words) -> np.ndarray:
    return np.flatnonzero(np.diff(w.sentence, prepend=-1))


def fit(texts: list[str], langs: list[str], epochs: int = 4, seed: int = 7, least: int = 3) -> Crf | None:
    """Maximise the conditional likelihood by AdaGrad over chains of sentences; None without labelled words."""
    labels = sorted(set(langs))
    w = words_of(texts)
    if not len(w.starts):
        return None
    k = len(labels)
    y = np.searchsorted(labels, np.array(langs, dtype=object)[w.doc].astype(str))
    signature = np.zeros(1 << LEXICON_BITS, dtype=np.uint32)
    own, n = np.unique(w.hashes, return_counts=True)
    own = own[n >= least]
    signature[(own >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)] = (own & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    crf = Crf(labels, np.zeros((1 << BITS, k), np.float32), np.zeros((1 << LEXICON_BITS, k), np.float32), signature, np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    two, three, first = char_features(w)
    places = np.diff(first, append=len(two))
    fixes = word_features(w)
    slot, known = crf.lexicon_slots(w)
    begin = chain_starts(w)
    size = np.diff(begin, append=len(w.starts))
    rng = np.random.default_rng(seed)
    squares = [np.full_like(x, 1e-6) for x in (crf.weights, crf.lexicon, crf.transitions, crf.bias)]

    def step(value: np.ndarray, square: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        square += gradient * gradient
        value += (rate * gradient / np.sqrt(square)).astype(np.float32)

    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(begin)), max(1, len(w.starts) // 40_000)):
            if not len(part):
                continue
            sizes = size[part]
            index = np.repeat(begin[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            # Chains of up to three sentences in random order: neighbours differ in language about as often as texts do.
            joins = rng.random(len(part)) < 0.33
            joins[0] = True
            starts = (np.cumsum(sizes) - sizes)[joins]
            many = places[index]
            spots = np.repeat(first[index] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            owner = np.repeat(np.arange(len(index)), many)
            scores = np.add.reduceat(crf.weights[two[spots]] + crf.weights[three[spots]], np.cumsum(many) - many, axis=0)
            for f in fixes:
                scores += crf.weights[f[index]]
            scores += crf.lexicon[slot[index]] * known[index][:, None] + crf.bias
            post, pairs = forward_backward(scores, crf.transitions, starts, want_pairs=True)
            gold = np.eye(k)[y[index]]
            g = (gold - post).astype(np.float64)
            inner = np.ones(len(index), dtype=bool)
            inner[starts] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (y[index][:-1][inner[1:]], y[index][1:][inner[1:]]), 1)
            slots_ = np.concatenate((two[spots], three[spots], *(f[index] for f in fixes)))
            rows = np.concatenate((owner, owner, *[np.arange(len(index))] * 2))
            gw = np.stack([np.bincount(slots_, weights=g[rows, j], minlength=1 << BITS) for j in range(k)], axis=1)
            gl = np.stack([np.bincount(slot[index], weights=g[:, j] * known[index], minlength=1 << LEXICON_BITS) for j in range(k)], axis=1)
            total = len(index)
            for value, square, gradient, rate in zip((crf.weights, crf.lexicon, crf.transitions, crf.bias), squares, (gw - 1e-3 * crf.weights, gl - 1e-3 * crf.lexicon, (seen - pairs) / total, g.sum(axis=0) / total), (0.15, 0.15, 0.1, 0.02), strict=True):
                step(value, square, gradient, rate)
    return crf


def predict(crf: Crf | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Label and score of each text."""
    if crf is None:
        return ["und"] * len(texts), np.zeros(len(texts))
    total = np.zeros((len(texts), len(crf.labels)))
    for docs, part in parts(texts):
        w = words_of(part)
        post, _ = forward_backward(crf.emissions(w), crf.transitions, chain_starts(w))
        own = np.array(docs)[w.doc]
        for j in range(len(crf.labels)):
            total[:, j] += np.bincount(own, weights=post[:, j], minlength=len(texts))
    n = total.sum(axis=1)
    share = total / np.maximum(n, 1e-300)[:, None]
    labels = ["und" if n[d] == 0 else crf.labels[b] for d, b in enumerate(share.argmax(axis=1))]
    return labels, np.where(n > 0, np.clip(share.max(axis=1), 0, 1), 0.0)


def word_labels(crf: Crf, text: str) -> list[tuple[str, str, float]]:
    """Each word of a code-switched text with its language and posterior."""
    w = words_of([text])
    post, _ = forward_backward(crf.emissions(w), crf.transitions, chain_starts(w))
    best = post.argmax(axis=1)
    spell = lambda a, b: "".join(map(chr, w.chars[a:b]))
    return [(spell(a, b), crf.labels[j], float(p[j])) for a, b, j, p in zip(w.starts, w.ends, best, post, strict=True)]


def training_rows(df: DataFrame, text_col: str, lang_col: str, key_cols: list[str], per_language: int = SAMPLE_PER_LANGUAGE) -> pd.DataFrame:
    """About ``per_language`` distinct texts of each language, chosen by a hash; languages that are rarer give all.

    Texts have up to SAMPLE_CHARS characters; there are up to MOST_LANGUAGES languages, those of most rows: this bounds what comes to the driver.
    """
    rows = df.where((F.length(text_col) <= SAMPLE_CHARS) & F.col(lang_col).isNotNull())
    common = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    spread = 1 << 40
    limit = F.coalesce(*[F.when(F.col(lang_col) == lang, F.lit(min(spread, -(-spread * per_language // n)))) for lang, n in sorted(counts.items())])
    chosen = rows.where(F.pmod(F.xxhash64(*key_cols, text_col), F.lit(spread)) < limit)
    return chosen.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).distinct().orderBy("lang", "text").toPandas()


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key_cols: list[str] | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> Crf | None:
    rows = training_rows(df, text_col, lang_col, key_cols or [], per_language)
    return fit(rows["text"].tolist(), rows["lang"].tolist()) if len(rows) else None


def language(crf: Crf | None, text: Column) -> Column:
    """struct(lang, score) of a text column. The model has a fixed size: tables of 2^17 slots for each language."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            lang, score = predict(crf, [None if t is None else str(t) for t in series])
            yield pd.DataFrame({"lang": lang, "score": score})
        give_back()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Marked so that a filter on its result does not have it run twice.
    return F.pandas_udf(run, "lang string, score double").asNondeterministic()(text)
