"""Operator 8: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is the logistic function of a bias and the weights
of its words and of the beginnings (BEGINNINGS letters) of its longer words; the document's is the noisy-or of
its sentences', 1 - prod(1 - p). Only documents have labels: the gradient of their likelihood goes through the
noisy-or to the sentences, so the trained model also says which sentences offend, and how much.

Cases: a null or empty text, or one without words, has score 0. Null labels are not learned from; several
labels of one document count as the greatest. Without any label of each kind all scores are 0. Repeated
rows get the same score; extra columns are not read; an empty table gives an empty result. A very long text is
scored in parts that end at sentences, or at words where a part has no sentence end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .letters import Words, mix, parts, words_of

#: Labelled documents that the fit uses at most (about).
SAMPLE_DOCS = 6_000
#: Labelled documents of more characters are not in the sample, so that it is bounded in bytes too.
SAMPLE_CHARS = 10_000
BITS, SKETCH_BITS = 20, 22
#: A word's beginning of so many letters is a feature of it if the word is longer.
BEGINNINGS = (4, 5, 6, 7, 8)


@dataclass
class Mil:
    signature: np.ndarray  # of the word that a slot stands for; 0: none
    weights: np.ndarray
    bias: float

    def value(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        return np.where(self.signature[slot] == (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), self.weights[slot], 0.0)

    def sentence_scores(self, w: Words) -> np.ndarray:
        """The logit of each sentence."""
        n = int(w.sentence[-1]) + 1 if len(w.sentence) else 0
        value = self.value(w.hashes)
        for long, h in beginnings(w):
            value[long] += self.value(h)
        return np.bincount(w.sentence, weights=value, minlength=n) + self.bias


def beginnings(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of BEGINNINGS the places of the longer words and the hashes of their first letters."""
    size = w.ends - w.starts
    long = np.arange(len(size))
    h = np.zeros(len(size), dtype=np.uint64)
    for k in range(max(BEGINNINGS)):
        more = size[long] > k + 1
        long, h = long[more], h[more]
        h = (h + w.chars[w.starts[long] + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        if k + 1 in BEGINNINGS:
            yield long, mix(h + np.uint64(k + 1))


def sentence_docs(w: Words) -> np.ndarray:
    return w.doc[np.flatnonzero(np.diff(w.sentence, prepend=-1))]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Part by part: hashes of the features with their sentence (numbered over all parts) and document, and the document of each sentence."""
    sentences = 0
    for docs, part in parts(texts):
        w = words_of(part)
        own = np.array(docs, dtype=np.int32)
        long = [(w.hashes, np.arange(len(w.hashes)))] + [(h, at) for at, h in beginnings(w)]
        at = np.concatenate([x for _, x in long])
        of_sentence = own[sentence_docs(w)]
        yield np.concatenate([h for h, _ in long]), (w.sentence[at] + sentences).astype(np.int32), own[w.doc[at]], of_sentence
        sentences += len(of_sentence)


def bags(texts: list[str], least_docs: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`features` gives, of all parts, without features that fewer than least_docs documents have by a count over some bits of their hashes."""
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    slot = lambda h: (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    for hashes, _, doc, _ in features(texts):
        seen = np.unique(doc.astype(np.int64) << SKETCH_BITS | slot(hashes))
        np.add.at(counts, seen & ((1 << SKETCH_BITS) - 1), 1)
    kept, of_sentences = [], []
    for hashes, sentence, doc, of_sentence in features(texts):
        often = counts[slot(hashes)] >= least_docs
        kept.append((hashes[often], sentence[often], doc[often]))
        of_sentences.append(of_sentence)
    return (*(np.concatenate(x) for x in zip(*kept, strict=True)), np.concatenate(of_sentences))


def slopes(total: np.ndarray, y: np.ndarray, toxic_weight: float) -> np.ndarray:
    """Derivative of each document's weighted log-likelihood by ``total``, its sum of softplus."""
    big = np.maximum(-np.expm1(-total), 1e-9)
    return np.where(y > 0, toxic_weight * (1.0 - big) / big, -1.0)


def fit(texts: list[str], toxic: list[int], least_docs: int = 4, epochs: int = 160, penalty: float = 0.006, toxic_weight: float = 3.0) -> Mil | None:
    """Full-batch AdaGrad on the noisy-or likelihood, in which a toxic document counts ``toxic_weight`` times, with an L1 penalty that leaves chance words at zero."""
    y = np.array(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    hashes, in_sentence, in_doc, doc = bags(texts, least_docs)
    if not len(hashes):
        return None
    words, index = np.unique(hashes, return_inverse=True)
    del hashes
    doc_words = np.unique(in_doc.astype(np.int64) * len(words) + index)
    del in_doc
    common = np.bincount(doc_words % len(words), minlength=len(words)) >= least_docs
    keep = np.cumsum(common) - 1
    used = common[index]
    # A word counts once in a sentence.
    pairs = np.unique(in_sentence[used].astype(np.int64) << 32 | keep[index[used]])
    sentence, word = pairs >> 32, pairs & 0xFFFFFFFF
    n_sentences, n_words = len(doc), int(common.sum())
    del index, used, in_sentence, pairs
    weights, bias = np.zeros(n_words), -5.0
    g2, b2 = np.full(n_words, 1e-3), 1e-3
    n_docs = len(y)
    for _ in range(epochs):
        z = np.bincount(sentence, weights=weights[word], minlength=n_sentences) + bias
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        total = np.bincount(doc, weights=softplus(z), minlength=n_docs)
        gz = slopes(total, y, toxic_weight)[doc] * p
        g = np.bincount(word, weights=gz[sentence], minlength=n_words)
        # L1 by truncation: a weight at zero moves only if the pull on it is above the penalty.
        pull = penalty * np.sqrt(n_docs)
        g = np.where(weights != 0, g - pull * np.sign(weights), np.sign(g) * np.maximum(np.abs(g) - pull, 0))
        g2 += g * g
        new = weights + 0.5 * g / np.sqrt(g2)
        weights = np.where((weights != 0) & (np.sign(new) != np.sign(weights)), 0.0, new)
        gb = gz.sum()
        b2 += gb * gb
        bias += 0.6 * gb / np.sqrt(b2)
    signature, table = np.zeros(1 << BITS, dtype=np.uint32), np.zeros(1 << BITS, dtype=np.float32)
    own = words[common]
    alive = np.flatnonzero(weights)
    alive = alive[np.argsort(np.abs(weights[alive]))]
    slot = (own[alive] >> np.uint64(64 - BITS)).astype(np.int64)
    signature[slot] = (own[alive] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    table[slot] = weights[alive]
    return Mil(signature, table, float(bias))


def scored_sentences(mil: Mil, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Part by part: the document and the logit of each sentence, in order."""
    for docs, part in parts(texts):
        w = words_of(part)
        yield np.array(docs)[sentence_docs(w)], mil.sentence_scores(w) if len(w.sentence) else np.zeros(0)


def scores(mil: Mil | None, texts: list[str | None]) -> np.ndarray:
    total = np.zeros(len(texts))
    if mil is not None:
        for doc, z in scored_sentences(mil, texts):
            total += np.bincount(doc, weights=softplus(z), minlength=len(texts))
    return np.clip(-np.expm1(-total), 0.0, 1.0)


def offending(mil: Mil | None, texts: list[str | None], threshold: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, float]]]]:
    """The score of each text, and the numbers (from 0, among sentences with words) and probabilities of its sentences from the threshold on."""
    total, found, seen = np.zeros(len(texts)), [[] for _ in texts], np.zeros(len(texts), dtype=np.int64)
    if mil is not None:
        for doc, z in scored_sentences(mil, texts):
            total += np.bincount(doc, weights=softplus(z), minlength=len(texts))
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
            first = np.searchsorted(doc, doc)
            for k in np.flatnonzero(p >= threshold).tolist():
                found[doc[k]].append((int(seen[doc[k]] + k - first[k]), float(p[k])))
            seen += np.bincount(doc, minlength=len(texts))
    return np.clip(-np.expm1(-total), 0.0, 1.0), found


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE_DOCS) -> pd.DataFrame:
    """About ``most`` labelled documents of up to SAMPLE_CHARS characters: their ids are sampled by a hash among the labels, then broadcast (the sample is the bound) to find the texts."""
    marks = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(label_col).alias("toxic"))
    n = marks.count()
    spread = 1 << 40
    sample = marks.where(F.pmod(F.xxhash64("id"), F.lit(spread)) < (min(spread, spread * most // n) if n else 0))
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(sample), "id")
    return found.select("text", "toxic").distinct().orderBy("text", "toxic").toPandas()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE_DOCS) -> Mil | None:
    rows = training_rows(docs, labels, id_col, text_col, label_col, most)
    return fit(rows["text"].tolist(), rows["toxic"].astype(int).tolist()) if len(rows) else None


def toxicity(mil: Mil | None, text: Column, threshold: float = 0.5) -> Column:
    """struct(score, sentences) of a text column: the score from 0 to 1, and the sentences that offend, struct(number, score) each.

    The model has a fixed size: 2^20 slots.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            score, found = offending(mil, [None if t is None else str(t) for t in series], threshold)
            yield pd.DataFrame({"score": score, "sentences": [[{"number": k, "score": p} for k, p in x] for x in found]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Marked so that a filter on its result does not have it run twice.
    return F.pandas_udf(run, "score double, sentences array<struct<number:int,score:double>>").asNondeterministic()(text)
