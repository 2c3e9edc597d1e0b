"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled passages is built. A text is parsed greedily into the longest
phrases that occur in those passages (Ziv and Merhav); the fewer phrases a language needs, scaled by the size of its
passages, the closer it is. The automata are tables of transitions, so a task parses thousands of stretches of text
abreast, one character of each per step.

Learned from a bounded sample: ``PASSAGES`` passages of ``PASSAGE`` characters per language, one of each chosen
document, chosen by a hash of the text. Every other step reads all documents and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from furlong.llm.common import text_of

PASSAGES, PASSAGE = 160, 256
#: A text is parsed in stretches of so many normalised characters, each from a phrase start.
STRETCH = 1024
#: Characters that a task parses at a time.
PARSED = 1 << 20
UNKNOWN = "und"


def sample(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """lang and passage: at most ``PASSAGES`` per language. A language with a third of all rows is cut down in two steps, so
    that the last one sees 16 times ``PASSAGES`` rows of it at most."""
    place = F.pmod(F.col("_hash"), F.greatest(F.length("_text") - PASSAGE, F.lit(1))) + 1
    passages = labelled.select(F.col(lang).alias("lang"), text_of(text).alias("_text")).filter("lang IS NOT NULL AND _text != ''") \
        .withColumn("_hash", F.xxhash64("_text")) \
        .select("lang", "_hash", F.substring(F.col("_text"), place.cast("int"), F.lit(PASSAGE)).alias("passage")).distinct()
    piece = W.partitionBy("lang", F.pmod("_hash", F.lit(16))).orderBy("_hash", "passage")
    few = passages.withColumn("_n", F.row_number().over(piece)).filter(F.col("_n") <= PASSAGES)
    first = W.partitionBy("lang").orderBy("_hash", "passage")
    return few.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= PASSAGES).select("lang", "passage")


@dataclass(frozen=True)
class Parser:
    """Normalisation and one transition table per language."""

    classes: dict[int, int]
    languages: list[str]
    tables: list[np.ndarray]
    sizes: list[int]

    @staticmethod
    def learn(passages: dict[str, list[str]]) -> Parser:
        folded = {lang: [fold(p) for p in sorted(own)] for lang, own in passages.items()}
        seen = sorted({c for own in folded.values() for p in own for c in p if c != " "})
        classes = {ord(c): 3 + k for k, c in enumerate(seen)}
        of = classes | {ord(" "): SPACE}
        languages = sorted(folded)
        chars = [[[of[ord(c)] for c in p] + [SPACE] for p in folded[lang]] for lang in languages]
        width = 3 + len(seen)
        return Parser(classes, languages, [table(automaton(own), width) for own in chars],
                      [max(2, sum(map(len, own))) for own in chars])

    def codes(self, text: str) -> np.ndarray:
        """Character classes of a text: letters in lower case, everything between words as one space."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        kinds = class_map(self)[points]
        gap = kinds == SPACE
        return kinds[~(gap & np.concatenate(([True], gap[:-1])))]

    def phrases(self, stretches: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs for each stretch."""
        lengths = np.array([len(s) for s in stretches])
        order = np.argsort(-lengths, kind="stable")
        grid = np.full((int(lengths.max()), len(stretches)), SPACE, np.uint8 if max(self.classes.values(), default=0) < 256 else np.uint16)
        for k, at in enumerate(order):
            grid[:lengths[at], k] = stretches[at]
        active = np.searchsorted(-lengths[order], -np.arange(len(grid)), side="left")
        out = np.zeros((len(self.tables), len(stretches)), np.int64)
        for row, flat in zip(out, self.tables):
            width = 3 + len(self.classes)
            state, count = np.zeros(len(stretches), np.int32), np.ones(len(stretches), np.int32)
            for t in range(len(grid)):
                n = active[t]
                step = flat[state[:n] * np.int32(width) + grid[t, :n]]
                count[:n] += step >> 30
                state[:n] = step & NEXT
            row[order] = count
        return out


SPACE, OTHER = 1, 2
NEXT = (1 << 30) - 1
_MAPS: dict[int, np.ndarray] = {}


def class_map(parser: Parser) -> np.ndarray:
    """Class of every code point; letters that no passage holds share one class, which never matches."""
    key = hash(tuple(sorted(parser.classes.items())))
    if key not in _MAPS:
        _MAPS.clear()
        kinds = np.array([OTHER if chr(c).isalpha() else SPACE for c in range(0x110000)], np.uint16)
        for point, kind in parser.classes.items():
            kinds[point] = kind
        _MAPS[key] = kinds
    return _MAPS[key]


def fold(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(passages: list[list[int]]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of all passages; a passage starts anew at the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for passage in passages:
        last = 0
        for c in passage:
            if c in step[last]:
                q = step[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = split(step, link, length, last, c, q)
                continue
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else split(step, link, length, p, c, q)
            last = new
    return step


def split(step: list, link: list, length: list, p: int, c: int, q: int) -> int:
    """Give the shorter strings of state ``q`` that end in ``p`` then ``c`` a state of their own."""
    copy = len(step)
    step.append(dict(step[q]))
    link.append(link[q])
    length.append(length[p] + 1)
    link[q] = copy
    while p >= 0 and step[p].get(c) == q:
        step[p][c] = copy
        p = link[p]
    return copy


def table(step: list[dict[int, int]], width: int) -> np.ndarray:
    """Next state by state and class. Where the phrase ends, bit 30 is set and the next phrase starts with the character."""
    root = np.full(width, 1 << 30, np.int32)
    for c, q in step[0].items():
        root[c] = (1 << 30) | q
    out = np.tile(root, (len(step), 1))
    for state, own in enumerate(step):
        for c, q in own.items():
            out[state, c] = q
    return out.ravel()


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Parser:
    """Tables of all labelled languages; the driver receives the bounded sample only."""
    passages: dict[str, list[str]] = {}
    for row in sample(labelled, text, lang).collect():
        passages.setdefault(row["lang"], []).append(row["passage"])
    return Parser.learn(passages)


def pieces(parser: Parser, text: str) -> Iterator[np.ndarray]:
    """Stretches of a text; a very long text is normalised part by part, cut before a space where there is one."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PARSED)
        if end < len(text) and (space := text.rfind(" ", at + 1, end)) > at:
            end = space
        codes = parser.codes(text[at:end])
        yield from (codes[k:k + STRETCH] for k in range(0, len(codes), STRETCH))
        at = end


def identify(docs: DataFrame, parser: Parser, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``language`` (lang_pred string, score double 0 to 1).

    ``und`` with score 0 for a null text, a text without a letter, or if nothing was learned. Of languages that need
    equally many phrases the first by name wins. The score is the share of the winner when phrase rates are turned
    into probabilities per phrase. An existing column ``language`` is replaced; rows may repeat.
    """
    scale = np.log2(np.array(parser.sizes, float))[:, None] if parser.sizes else None

    def judge(found: np.ndarray, sizes: np.ndarray) -> tuple[list[str], list[float]]:
        rates = found * scale / np.maximum(sizes, 1)
        best = rates.argmin(axis=0)
        odds = np.exp2(-4 * (rates - rates.min(axis=0)))
        return [parser.languages[b] for b in best], (1 / odds.sum(axis=0)).tolist()

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            found = np.zeros((len(parser.languages), len(texts)), np.int64)
            sizes = np.zeros(len(texts), np.int64)
            held, owners, letters = [], [], set()
            full = 0

            def flush() -> None:
                if held:
                    counts = parser.phrases(held)
                    for row, own in zip(found, counts):
                        np.add.at(row, owners, own)
                    held.clear()
                    owners.clear()

            for k, value in enumerate(texts):
                for stretch in pieces(parser, value.as_py()) if parser.languages else ():
                    if k not in letters and (stretch != SPACE).any():
                        letters.add(k)
                    held.append(stretch)
                    owners.append(k)
                    sizes[k] += len(stretch)
                    full += len(stretch)
                    if full >= PARSED:
                        flush()
                        full = 0
            flush()
            known = sorted(letters)
            if known:
                for k, name, score in zip(known, *judge(found[:, known], sizes[known])):
                    names[k], scores[k] = name, score
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn("language", predict(text_of(text)))


def remainder(identifier: Column, divisor: int) -> Column:
    """crc32 of the identifier as text, modulo ``divisor``; a null identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(identifier.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
