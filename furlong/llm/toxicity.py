"""Toxicity from document labels by multiple-instance learning.

A document is a bag of sentences. Each sentence has a chance of being offensive, a logistic function of its words; a
document is toxic if any sentence is (noisy-or). Training fits the word weights to the labels of documents, so the
model can afterwards say which sentences offend.

The model is fitted on a bounded sample: at most ``TOXIC`` toxic and ``CLEAN`` clean labelled documents of any length,
those with the smallest hashes of their identifiers. Of a longer one about ``TRAINED_CHARS`` characters of sentences are
drawn, which count for all its sentences. Every document is scored whole.

Even harmless sentences have a small chance each, which adds up over a long text. The background is what the sentences
of clean documents outside the training sample give, as mean and standard deviation. The sentences of a document that
more likely offend than not count in full, the others by what exceeds the background of so many sentences, that is the
mean and ``MARGIN`` standard deviations of its sum.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import text_of

TOXIC, CLEAN, TRAINED_CHARS = 1500, 3000, 20_000
BUCKETS = 1 << 17
STEMS = (4, 5)
#: A feature needs so many training documents.
SEEN = 4
STEPS, RATE, DECAY = 100, 0.15, 1e-4
#: Every so many-th clean document of the sample is kept from training and gives the background.
KEPT_BACK = 5
MARGIN = 2.0
#: What a document may have without being set against the background (a score of about a quarter).
FREE = 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings, so that inflected words share what they begin with."""
    parts = {word, *(f"{word[:n]}-" for n in STEMS if len(word) >= n)}
    return tuple(zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts)


def bag(text: str, most: int) -> tuple[str, float]:
    """The text, or if longer than ``most`` characters sentences drawn by hash up to that, one a line, and for how many
    sentences each stands. Of a drawn sentence that is too long itself evenly spread words remain."""
    if len(text) <= most:
        return text, 1.0
    places = [m.span() for m in SENTENCE.finditer(text) if WORD.search(m[0])]
    order = sorted(range(len(places)), key=lambda i: zlib.crc32(f"{i} {len(text)}".encode()))
    drawn, room = [], most
    for i in order:
        sentence = text[places[i][0]:places[i][1]]
        if len(sentence) > room:
            if drawn:
                break
            words = WORD.findall(sentence)
            step = -(-len(sentence) // most)
            sentence = " ".join(words[::step])[:most]
        drawn.append((i, sentence))
        room -= len(sentence) + 1
    return "\n".join(x for _, x in sorted(drawn)), len(places) / len(drawn) if drawn else 1.0


def train(texts: list[str], labels: list[int], stands_for: list[float] | None = None) -> tuple[np.ndarray, float]:
    """Word weights and the bias. The gradient of the noisy-or loss at a sentence is its chance in a clean document, and
    minus its chance times the odds against the document in a toxic one, times the sentences it stands for."""
    sentence_of, word_of, doc_of = [], [], []
    for d, text in enumerate(texts):
        for match in SENTENCE.finditer(text.lower()):
            words = {f for w in WORD.findall(match[0]) for f in features(w)}
            if words:
                word_of += words
                sentence_of += [len(doc_of)] * len(words)
                doc_of.append(d)
    if not doc_of or len(set(labels)) < 2:  # nothing to learn from: every sentence is unlikely
        return np.zeros(BUCKETS), -20.0
    words, sentences, docs, y = np.array(word_of), np.array(sentence_of), np.array(doc_of), np.array(labels)
    in_docs = np.bincount(np.unique(words.astype(np.int64) * len(y) + docs[sentences]) // len(y), minlength=BUCKETS)
    common = in_docs[words] >= SEEN
    sentences = sentences[common]
    used, words = np.unique(words[common], return_inverse=True)
    toxic, share = y[docs] == 1, np.ones(len(docs)) if stands_for is None else np.array(stands_for)[docs]
    weights, bias = np.zeros(len(used)), -4.0
    moments = [np.zeros(len(used) + 1), np.zeros(len(used) + 1)]
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentences, weights[words], len(docs))
        chance = 1 / (1 + np.exp(-z))
        none = np.exp(-np.bincount(docs, share * np.logaddexp(0, z), len(y)))
        odds = (none / np.maximum(1 - none, 1e-9))[docs]
        slope = share * np.where(toxic, -chance * np.minimum(odds, 1e4), chance)
        gradient = np.append(np.bincount(words, slope[sentences], len(used)), slope.sum()) / len(y)
        gradient[:-1] += DECAY * weights
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1]
        bias -= float(move[-1])
    out = np.zeros(BUCKETS)
    out[used] = weights
    return out, bias


def fit(docs: DataFrame, labels: DataFrame, identifier: str = "doc_id", text: str = "text",
        label: str = "toxic") -> tuple[np.ndarray, float, tuple[float, float]]:
    """Word weights, bias and background from the bounded sample. Of contradicting labels the highest counts, of rows that
    repeat an identifier one serves. The driver receives at most ``TOXIC`` + ``CLEAN`` documents, half as many again before
    empty ones are left out, of about ``TRAINED_CHARS`` characters each."""
    known = labels.select(F.col(identifier).alias("_id"), F.col(label).cast("int").alias("_label")) \
        .filter("_id IS NOT NULL AND _label IN (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    # more are drawn than wanted, as some texts are missing or empty
    drawn = [known.filter(F.col("_label") == value).withColumn("_at", F.xxhash64("_id")).orderBy("_at", "_id").limit(most * 3 // 2)
             for value, most in ((1, TOXIC), (0, CLEAN))]
    limit = TRAINED_CHARS

    @F.arrow_udf("text string, stands_for double")
    def sampled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            bags = [bag(t.as_py(), limit) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in bags], pa.string()), pa.array([n for _, n in bags], pa.float64())],
                                             names=["text", "stands_for"])

    # of the rows that repeat an identifier one serves, so that no more rows than identifiers are collected
    rows = docs.select(F.col(identifier).alias("_doc"), text_of(text).alias("_text")) \
        .join(F.broadcast(drawn[0].union(drawn[1])), F.col("_doc") == F.col("_id")).filter(F.length("_text") > 0) \
        .groupBy("_id", "_label", "_at").agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), F.col("_text").alias("text"))).alias("_one")) \
        .select(sampled("_one.text").alias("_bag"), "_label", "_at").select("_bag.*", "_label", "_at").collect()
    rows.sort(key=lambda r: (r["_at"], r["text"]))
    toxic, clean = ([r for r in rows if r["_label"] == value][:most] for value, most in ((1, TOXIC), (0, CLEAN)))
    back = clean[KEPT_BACK - 1::KEPT_BACK]
    used = toxic + [r for i, r in enumerate(clean) if i % KEPT_BACK != KEPT_BACK - 1]
    weights, bias = train([r["text"] for r in used], [r["_label"] for r in used], [r["stands_for"] for r in used])
    return weights, bias, background([r["text"] for r in back], [r["stands_for"] for r in back], weights, bias)


class Weights(dict):
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = float(self.weights[list(features(word))].sum())
        return value


def judge(text: str, weights: Weights, bias: float, usual: tuple[float, float] = (0.0, 0.0)) -> tuple[float, list[dict]]:
    """Chance that any sentence offends, and the sentences that more likely do than not. These count in full, the others
    together by what exceeds ``usual`` (the background)."""
    surely, none, offending, number = 0.0, 0.0, [], 0
    for match in SENTENCE.finditer(text):
        words = set(WORD.findall(match[0].lower()))
        if words:
            z = bias + sum(map(weights.__getitem__, words))
            if z < 0:
                none += math.log1p(math.exp(z))
            else:
                surely += z + math.log1p(math.exp(-z))
                offending.append({"sentence": number, "start": match.start(), "length": match.end() - match.start(),
                                  "score": 1 / (1 + math.exp(-z))})
            number += 1
    none = max(min(none, FREE), none - usual[0] * number - MARGIN * usual[1] * math.sqrt(number))
    return -math.expm1(-surely - none), offending


def background(texts: list[str], stands_for: list[float], weights: np.ndarray, bias: float) -> tuple[float, float]:
    """Mean and standard deviation of what a sentence of clean documents adds to the noisy-or; sentences that more likely
    offend than not add nothing here."""
    known, found, shares = Weights(weights), [0.0], [1e-9]
    for text, share in zip(texts, stands_for):
        for match in SENTENCE.finditer(text):
            words = set(WORD.findall(match[0].lower()))
            if words:
                z = bias + sum(map(known.__getitem__, words))
                found.append(math.log1p(math.exp(z)) if z < 0 else 0.0)
                shares.append(share)
    mean = float(np.average(found, weights=shares))
    return mean, math.sqrt(np.average((np.array(found) - mean)**2, weights=shares))


def score(docs: DataFrame, model: tuple[np.ndarray, float, tuple[float, float]], text: str = "text") -> DataFrame:
    """``docs`` with the struct ``toxicity`` (score double 0 to 1, offending sentences with place and score).

    Null and empty texts, and texts without a word, score 0 with no offending sentence. Whole texts are read sentence
    by sentence. An existing column ``toxicity`` is replaced; rows may repeat.
    """
    weights, bias, usual = model
    place = pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())])

    @F.arrow_udf("score double, offending array<struct<sentence:int,start:int,length:int,score:double>>")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Weights(weights)
        for texts in batches:
            found = [judge(t.as_py(), known, bias, usual) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([s for s, _ in found], pa.float64()), pa.array([o for _, o in found], pa.list_(place))],
                names=["score", "offending"])

    return docs.withColumn("toxicity", rate(text_of(text)))
