"""Encoding texts into vocabulary pieces and decoding them.

The best segmentation is a path with the largest sum of scores, so a stretch of text is a matrix over (max, +): entry
``i`` says that a piece from before covers its first ``i`` characters, exit ``j`` that its last piece covers the first
``j`` of the next stretch. Giant texts are cut into chunks; each yields its matrix, matrices are combined
associatively (per block of chunks, then over the blocks), and with the scores known at every boundary each chunk says
from which entry each of its exits was reached. Those choices are matrices too; combined from the end they give each
chunk its exit, and all chunks are traced back independently. A short text is one chunk with entry and exit 0.

Ties: at every position the piece that starts earliest wins, as in the unigram tokenizer. Scores are added exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import give_back, stored, text_of
from furlong.llm.vocabulary import MODEL, SPACE, WIDTH, Vocabulary

CHUNK = 65_536
BLOCK = 64
#: Words up to this length are solved together, so many abreast; distinct words are those of so many characters of text.
SHORT, ABREAST, TOGETHER = 32, 4096, 1 << 19
#: Texts taken out of a batch at a time.
FEW = 128
#: Ids spelled at a time.
SPELLED = 1 << 19
NEVER = float("-inf")


class Segmenter:
    """Best segmentations as int32 piece ids. Nothing is kept between batches; a vocabulary takes a few megabytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pairs = vocabulary, vocabulary.pairs

    def forget(self) -> None:
        """Drop what was derived from the vocabulary, at the end of a task: the worker stays and may get other work."""
        for name in ("trie", "entries", "pairs"):
            self.vocabulary.__dict__.pop(name, None)
        self.pairs = None
        give_back()

    def word(self, word: str) -> list[int]:
        _, came = self.forward(word, len(word), {0: 0.0})
        return self.trace(word, came, len(word))[1]

    def solve(self, words: list[str]) -> pa.ListArray:
        """Ids of each word: common short ones together, others one by one."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        order = order[:np.searchsorted(lengths[order], SHORT, side="right")]
        found: list[np.ndarray] = []
        sizes = np.zeros(len(words), np.int64)
        solved = np.zeros(len(words), bool)
        ranked = []
        for start in range(0, len(order), ABREAST):
            rows = order[start:start + ABREAST]
            known, counts, ids = self.abreast([words[i] for i in rows])
            ranked.append(rows[known])
            sizes[rows[known]] = counts
            solved[rows[known]] = True
            found.append(ids)
        for i in np.flatnonzero(~solved).tolist():
            ids = self.word(words[i])
            ranked.append(np.array([i]))
            sizes[i] = len(ids)
            found.append(np.array(ids, np.int32))
        by = np.concatenate(ranked) if ranked else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[by])]).astype(np.int32)
        solutions = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))
        place = np.empty(len(words), np.int64)
        place[by] = np.arange(len(by))
        return solutions.take(pa.array(place))

    def abreast(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Many short words at once, one start position of all of them per step.

        The steps are those of ``forward``; words that hold a character without a piece are left to it. Returns the words
        that were solved, their numbers of ids and the ids.
        """
        first, owner, target, piece_at, worth_at = self.vocabulary.steps
        lengths = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.where(points < WIDTH - 2, points, np.where(points == ord(SPACE), WIDTH - 2, WIDTH - 1))
        width = int(lengths.max(initial=0))
        codes = np.full((width + self.vocabulary.longest, len(words)), WIDTH - 1, np.int32)
        column = np.repeat(np.arange(len(words)), lengths)
        codes[np.arange(len(points)) - np.repeat(lengths.cumsum() - lengths, lengths), column] = kinds
        scores = np.full((width + 1, len(words)), NEVER)
        scores[0] = 0.0
        start_of = np.zeros((width + 1, len(words)), np.int16)
        piece_of = np.full((width + 1, len(words)), -1, np.int32)
        known = (codes[:width] < WIDTH - 1).sum(axis=0) == lengths
        for i in range(width):
            some = rows = np.flatnonzero(known & (lengths > i))
            base, node, single = scores[i], np.zeros(len(rows), np.int32), np.zeros(len(words), bool)
            for end in range(i + 1, i + self.vocabulary.longest + 1):
                at = first[node] + codes[end - 1, some]
                alive = np.flatnonzero(owner[at] == node)
                some, node = some[alive], target[at[alive]]
                if not len(some):
                    break
                ends = np.flatnonzero(piece_at[node] >= 0)
                hit, at = some[ends], node[ends]
                if end == i + 1:
                    single[hit] = True
                candidate = base[hit] + worth_at[at]
                better = np.flatnonzero(candidate > scores[end, hit])
                hit, at = hit[better], at[better]
                scores[end, hit], start_of[end, hit], piece_of[end, hit] = candidate[better], i, piece_at[at]
            known[rows[~single[rows]]] = False
        rows = np.flatnonzero(known)
        out = np.zeros((len(rows), width), np.int32)
        end, left = lengths[rows].copy(), np.full(len(rows), width)
        while (open_ := np.flatnonzero(end > 0)).size:
            left[open_] -= 1
            out[open_, left[open_]] = piece_of[end[open_], rows[open_]]
            end[open_] = start_of[end[open_], rows[open_]]
        return rows, width - left, out[np.arange(width) >= left[:, None]]

    def batch(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text, about ``TOGETHER`` characters at a time: their distinct words are solved, the texts are put together by index."""
        done, start, size = [], 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= TOGETHER or k + 1 == len(texts):
                done.append(self.together(texts[start:k + 1]))
                start, size = k + 1, 0
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    def together(self, texts: list[str]) -> pa.ListArray:
        words, counts = split_words(self.vocabulary, texts)
        encoded = words.dictionary_encode()
        ids = self.solve(encoded.dictionary.to_pylist()).take(encoded.indices)
        ends = np.concatenate([[0], np.cumsum(counts)])
        starts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(starts[ends], pa.int32()), ids.flatten())

    def forward(self, text: str, starts: int, entry: dict[int, float]) -> tuple[list[float], list]:
        """Best score of each position and the piece that led there, as (start, id; -1 for an unknown character).
        Pieces start before ``starts``, paths at the positions of ``entry``."""
        n = len(text)
        scores, came = [NEVER] * (n + 1), [None] * (n + 1)
        for position, score in entry.items():
            if position <= n:
                scores[position] = score
        unknown, (edges, piece_at, worth_at) = self.vocabulary.unknown_score, self.vocabulary.trie
        for i in range(min(starts, n)):
            base = scores[i]
            if base == NEVER:
                continue
            single, node, end = False, 0, i
            while end < n:
                node = edges.get(node << 21 | ord(text[end]))
                if node is None:
                    break
                end += 1
                piece = piece_at[node]
                if piece >= 0:
                    if end == i + 1:
                        single = True
                    score = base + worth_at[node]
                    if score > scores[end]:
                        scores[end], came[end] = score, (i, piece)
            if not single and base + unknown > scores[i + 1]:
                scores[i + 1], came[i + 1] = base + unknown, (i, -1)
        return scores, came

    def trace(self, text: str, came: list, end: int) -> tuple[int, list[int]]:
        """Where the best path to ``end`` entered, and its ids."""
        ids: list[int] = []
        while came[end] is not None:
            start, piece = came[end]
            ids += [piece] if piece >= 0 else self.vocabulary.unknown(text[start])[::-1]
            end = start
        return end, ids[::-1]

    def inner(self, text: str) -> np.ndarray:
        return self.batch([text]).flatten().to_numpy()

    def inner_score(self, text: str) -> float:
        """Score of the best path through a stretch that starts and ends where no piece crosses."""
        return float(self.vocabulary.worth[self.inner(text)].sum())

    def bounds(self, text: str, n: int) -> tuple[int, int] | None:
        """First and last position that no piece crosses, strictly inside the chunk."""
        pairs = self.pairs
        first = next((i for i in range(1, n) if text[i - 1:i + 1] not in pairs), None)
        if first is None:
            return None
        return first, next(i for i in range(n - 1, 0, -1) if text[i - 1:i + 1] not in pairs)

    def matrix(self, text: str, n: int) -> np.ndarray:
        """Best scores from each entry to each exit of a chunk: the first ``n`` characters of ``text``, which goes on as far as a piece may reach."""
        size = self.vocabulary.longest
        out = np.full((size, size), NEVER)
        cut = self.bounds(text, n)
        if cut is None:
            for i in range(min(size, n + 1)):
                scores, _ = self.forward(text, n, {i: 0.0})
                out[i, :len(scores[n:n + size])] = scores[n:n + size]
            for i in range(n + 1, size):  # a piece from before that covers the whole chunk
                out[i, i - n] = 0.0
            return out
        first, last = cut
        head = [self.forward(text[:first], first, {i: 0.0})[0][first] for i in range(min(size, first + 1))]
        tail = self.forward(text[last:], n - last, {0: 0.0})[0][n - last:n - last + size]
        middle = self.inner_score(text[first:last])
        for i, a in enumerate(head):
            for j, b in enumerate(tail):
                out[i, j] = a + middle + b
        return out

    def choices(self, text: str, n: int, entry: np.ndarray) -> np.ndarray:
        """For each exit the entry its best path came from, given the scores at the entries: 0 there, else never."""
        size = self.vocabulary.longest
        out = np.full((size, size), NEVER)
        cut = self.bounds(text, n)
        first = n if cut is None else cut[0]
        scores, came = self.forward(text if cut is None else text[:first], first, dict(enumerate(entry)))
        if cut is None:
            for j in range(size):
                if n + j < len(scores) and scores[n + j] != NEVER:
                    out[self.trace(text, came, n + j)[0], j] = 0.0
        else:
            at = self.trace(text[:first], came, first)[0]
            tail = self.forward(text[cut[1]:], n - cut[1], {0: 0.0})[0][n - cut[1]:n - cut[1] + size]
            for j, score in enumerate(tail):
                if score != NEVER:
                    out[at, j] = 0.0
        return out

    def ids(self, text: str, n: int, entry: np.ndarray, exit_: int) -> np.ndarray:
        cut = self.bounds(text, n)
        if cut is None:
            _, came = self.forward(text, n, dict(enumerate(entry)))
            return np.array(self.trace(text, came, n + exit_)[1], np.int32)
        first, last = cut
        _, came = self.forward(text[:first], first, dict(enumerate(entry)))
        head = self.trace(text[:first], came, first)[1]
        _, came = self.forward(text[last:], n - last, {0: 0.0})
        tail = self.trace(text[last:], came, n - last + exit_)[1]
        return np.concatenate([np.array(head, np.int32), self.inner(text[first:last]), np.array(tail, np.int32)])


def split_words(vocabulary: Vocabulary, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order, and how many each text has. Texts with single spaces only are split by Arrow."""
    strings = pa.array(texts, pa.string())
    plain = pc.and_(pc.starts_with(strings, SPACE), pc.invert(pc.or_(pc.match_substring(strings, SPACE * 2), pc.ends_with(strings, SPACE))))
    if vocabulary.apart and pc.all(plain).as_py():
        parts = pc.split_pattern(strings, SPACE)  # of each text the first is what stands before its first space: nothing
        counts = parts.value_lengths().to_numpy(zero_copy_only=False)
        every = np.ones(int(counts.sum()), bool)
        every[np.cumsum(counts) - counts] = False
        return pc.binary_join_element_wise(pa.scalar(SPACE), parts.flatten().filter(pa.array(every)), ""), counts - 1
    words = [vocabulary.words.findall(text) for text in texts]
    return pa.array([w for own in words for w in own], pa.string()), np.array([len(own) for own in words], np.int64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product over (max, +)."""
    return (a[..., :, None] + b[None, :, :]).max(axis=-2)


def scan(parts: DataFrame, size: int) -> DataFrame:
    """State before each part of its text: parts have _key, _at (order), _block and _matrix. Returns _key, _at, _state.

    Two levels: products of blocks of ``BLOCK`` parts, a run over the blocks of a text, a run inside each block. Sorted
    partitions are read as a stream, so a task holds one matrix at a time however long a text is.
    """
    parts = stored(parts)
    start = F.array(F.lit(0.0), *[F.lit(NEVER)] * (size - 1))

    def sorted_by(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(*keys[:-1]).sortWithinPartitions(*keys)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "_block", "_matrix"]
        current, total = None, None
        for batch in batches:
            out: list[tuple] = []
            for key, block, grid in zip(*(batch.column(n).to_pylist() for n in names[:2]), square(batch.column("_matrix"), size)):
                if (key, block) != current:
                    if current is not None:
                        out.append((*current, total.ravel()))
                    current, total = (key, block), grid
                else:
                    total = times(total, grid)
            yield rows_batch(out, names)
        if current is not None:
            yield rows_batch([(*current, total.ravel())], names)

    def run(keys: list[str], order: str):
        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, state = None, None
            for batch in batches:
                out: list[tuple] = []
                groups = list(zip(*(batch.column(k).to_pylist() for k in keys)))
                starts = batch.column("_start")
                for i, grid in enumerate(square(batch.column("_matrix"), size)):
                    if groups[i] != current:
                        current, state = groups[i], np.array(starts[i].as_py())
                    out.append((groups[i][0], batch.column(order)[i].as_py(), state))
                    state = times(state[None, :], grid)[0]
                yield rows_batch(out, ["_key", order, "_state"])
        return steps

    blocks = sorted_by(parts, "_key", "_block", "_at").mapInArrow(product, "_key long, _block long, _matrix array<double>")
    starts = sorted_by(blocks.withColumn("_start", start), "_key", "_block") \
        .mapInArrow(run(["_key"], "_block"), "_key long, _block long, _state array<double>")
    inside = parts.join(starts.withColumnRenamed("_state", "_start"), ["_key", "_block"])
    return sorted_by(inside, "_key", "_block", "_at") \
        .mapInArrow(run(["_key", "_block"], "_at"), "_key long, _at long, _state array<double>")


def square(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, size, size)


def rows_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def spaced(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))).otherwise("")


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int32()))


def spell(arrays: pa.ListArray, spelled: pa.Array) -> pa.Array:
    """The texts that lists of ids stand for; null lists give null, ids outside the vocabulary are skipped."""
    present = arrays.is_valid()
    ids = arrays.flatten().to_numpy(zero_copy_only=False)
    sizes = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    good = (ids >= 0) & (ids < len(spelled))
    if not good.all():
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes, ids = np.bincount(owner[good], minlength=len(sizes)), ids[good]
    out, ends = [], np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < len(sizes):
        # as many texts as stay far below the 2 GB of an array
        stop = max(int(np.searchsorted(ends, ends[start] + SPELLED, side="right")) - 1, start + 1)
        pieces = spelled.take(pa.array(ids[ends[start]:ends[stop]]))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends[start:stop + 1] - ends[start], pa.int32()), pieces), b"")
        out.append(as_text(texts))
        start = stop
    text = pa.concat_arrays(out) if out else pa.array([], pa.string())
    text = pc.replace_substring(text, SPACE, " ")
    text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
    return pc.if_else(present, text, pa.scalar(None, pa.string()))


def as_text(binary: pa.Array) -> pa.Array:
    """Bytes as text; where they are no UTF-8, the usual sign replaces them."""
    try:
        return binary.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.as_py().decode("utf-8", "replace") for b in binary], pa.string())


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, chunk: int = CHUNK, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``piece_ids``, the ids of the best segmentation of the whole text.

    Null and empty texts give an empty array. Texts of any length are encoded whole, in chunks of ``chunk``
    characters. Rows may repeat. An existing column ``piece_ids`` is replaced; an empty table gives no rows. With
    ``decoded`` a column of that name holds what the ids decode to.
    """
    vocabulary = Vocabulary.read(model)
    size, spelled = vocabulary.longest, vocabulary.spelled
    vocabulary.steps  # built once, sent along
    names = [c for c in docs.columns if c not in ("piece_ids", decoded)]

    @F.arrow_udf("piece_ids array<int>, decoded string")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        segmenter = Segmenter(vocabulary)

        def solved(texts: list[str]) -> pa.StructArray:
            ids = segmenter.batch(texts)
            return pa.StructArray.from_arrays([ids, spell(ids, spelled) if decoded else pa.nulls(len(ids), pa.string())], names=["piece_ids", "decoded"])

        for texts in batches:  # few at a time, as text takes several times its size here
            yield pa.concat_arrays([solved(texts.slice(start, FEW).to_pylist()) for start in range(0, len(texts), FEW)] or [solved([])])
        texts = None
        segmenter.forget()

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Chunks in one pass, each with the characters that its last piece may reach."""
        for texts in batches:
            yield pa.array([[t[i:i + chunk + size - 1] for i in range(0, len(t), chunk)] for t in texts.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("array<double>")
    def matrices(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        segmenter = Segmenter(vocabulary)
        for texts, lengths in batches:
            yield pa.array([segmenter.matrix(t.as_py(), n.as_py()).ravel() for t, n in zip(texts, lengths)], pa.list_(pa.float64()))
        segmenter.forget()

    @F.arrow_udf("array<double>")
    def choices(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        segmenter = Segmenter(vocabulary)
        for texts, lengths, entries in batches:
            yield pa.array([segmenter.choices(t.as_py(), n.as_py(), np.array(e.as_py())).T.ravel()
                            for t, n, e in zip(texts, lengths, entries)], pa.list_(pa.float64()))
        segmenter.forget()

    @F.arrow_udf("array<int>")
    def traced(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        segmenter = Segmenter(vocabulary)
        for texts, lengths, entries, exits in batches:
            yield lists([segmenter.ids(t.as_py(), n.as_py(), np.array(e.as_py()), int(np.argmax(x.as_py())))
                         for t, n, e, x in zip(texts, lengths, entries, exits)])
        segmenter.forget()

    prepared = docs.select(F.struct(*names).alias("_row"), spaced(text_of(text)).alias("_text"))
    short = prepared.filter(F.length("_text") <= chunk).select("_row", whole("_text").alias("_pieces")) \
        .select("_row", "_pieces.piece_ids", "_pieces.decoded")
    giant = prepared.filter(F.length("_text") > chunk).withColumn("_key", F.monotonically_increasing_id()) \
        .select("_key", "_row", F.length("_text").cast("long").alias("_size"), F.posexplode(cut("_text")).alias("_place", "_part"))
    chunks = giant.withColumn("_at", F.col("_place").cast("long")).select(
        "_key", "_at", F.when(F.col("_at") == 0, F.col("_row")).alias("_row"), "_part",
        F.least(F.col("_size") - F.col("_at") * chunk, F.lit(chunk)).cast("long").alias("_n"),
        F.floor((F.col("_size") - 1) / chunk).alias("_last"))
    chunks = stored(chunks.repartition("_key", "_at"))  # the chunks of one text are spread over tasks
    block = F.expr(f"_at div {BLOCK}").alias("_block")
    entries = scan(chunks.select("_key", "_at", block, matrices("_part", "_n").alias("_matrix")), size) \
        .withColumnRenamed("_state", "_entry")
    entered = stored(chunks.select("_key", "_at", "_part", "_n", "_last").join(entries, ["_key", "_at"]))
    exits = scan(entered.select("_key", (F.col("_last") - F.col("_at")).alias("_at"), "_last", choices("_part", "_n", "_entry").alias("_matrix"))
                 .withColumn("_block", block), size)
    exits = exits.select("_key", F.col("_at").alias("_back"), F.col("_state").alias("_exit"))
    pieces = entered.join(exits, (entered["_key"] == exits["_key"]) & (F.col("_last") - F.col("_at") == F.col("_back"))) \
        .select(entered["_key"], "_at", traced("_part", "_n", "_entry", "_exit").alias("_ids"))
    gathered = pieces.groupBy("_key").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("_at", "_ids"))), lambda x: x["_ids"])).alias("piece_ids"))
    long = chunks.filter("_at = 0").select("_key", "_row").join(gathered, "_key").select("_row", "piece_ids")
    long = decode(long, into="decoded", model=model) if decoded else long.withColumn("decoded", F.lit(None).cast("string"))
    return short.unionByName(long).select("_row.*", "piece_ids", *([F.col("decoded").alias(decoded)] if decoded else []))


def decode(docs: DataFrame, ids: str = "piece_ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with the text that the ids spell; a null array gives null, ids outside the vocabulary are skipped.

    Decoding undoes encoding but for U+2581 in a text, which stands for a space.
    """
    spelled = Vocabulary.read(model).spelled

    @F.arrow_udf("string")
    def back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arrays in batches:
            yield spell(arrays, spelled)

    return docs.withColumn(into, back(ids))
