"""Token counts without tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; the dynamic programme keeps the best
score and its number of pieces for the last few positions only. Of segmentations with equal scores the one whose last
piece starts earliest wins at every position, as in the unigram tokenizer, so the count is that of the encoder.
A character without a piece counts as its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import give_back, text_of
from furlong.llm.piece_codec import split_words
from furlong.llm.vocabulary import MODEL, Vocabulary, normalised


#: Characters of text whose distinct words are solved together.
TOGETHER = 1 << 22


class Counter:
    """Best scores and piece counts. A task holds the automaton and the distinct words of some text, nothing else."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in vocabulary.entries.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def best(self, word: str) -> tuple[float, int]:
        """Best score and its piece count; holds as many positions as the longest piece has characters."""
        ring = self.vocabulary.longest + 1
        unknown = self.vocabulary.unknown_score
        scores, counts = [0.0] * ring, [0] * ring
        matches = self.automaton.iter(word)
        end, found = next(matches, (len(word), None))
        for at in range(len(word)):
            score, count, single = None, 0, False
            while end == at:  # the longest, so the earliest start, comes first
                length, worth = found
                start = (at + 1 - length) % ring
                candidate = scores[start] + worth
                if score is None or candidate > score:
                    score, count = candidate, counts[start] + 1
                single |= length == 1
                end, found = next(matches, (len(word), None))
            if not single:
                candidate = scores[at % ring] + unknown
                if score is None or candidate > score:
                    score, count = candidate, counts[at % ring] + len(self.vocabulary.unknown(word[at]))
            scores[(at + 1) % ring], counts[(at + 1) % ring] = score, count
        return scores[len(word) % ring], counts[len(word) % ring]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of pieces of each text; a word that occurs several times in them is solved once."""
        words, counts = split_words(self.vocabulary, texts)
        encoded = words.dictionary_encode()
        found = [self.best(word) for word in encoded.dictionary.to_pylist()]
        at = encoded.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), counts)
        score = np.bincount(owner, np.array([s for s, _ in found], float)[at], minlength=len(texts))
        pieces = np.bincount(owner, np.array([n for _, n in found], float)[at], minlength=len(texts))
        return score, pieces.astype(np.int64)


def slices(texts: list[str]) -> Iterator[list[str]]:
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= TOGETHER or k + 1 == len(texts):
            yield texts[start:k + 1]
            start, size = k + 1, 0


def token_counts(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with the struct ``tokens`` (n_tokens long, score double).

    Null and empty texts have no tokens and score 0. Whole texts are read word by word, so a long text needs no more memory
    than its own characters. An existing column ``tokens`` is replaced.
    """
    vocabulary = Vocabulary.read(model)

    @F.arrow_udf("n_tokens long, score double")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(vocabulary)
        for texts in batches:
            found = [counter.texts([normalised(t) for t in some]) for some in slices(texts.to_pylist())]
            scores, pieces = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0), np.zeros(0, np.int64))
            yield pa.StructArray.from_arrays([pa.array(pieces), pa.array(scores)], names=["n_tokens", "score"])
        give_back()

    return docs.withColumn("tokens", count(text_of(text)))
