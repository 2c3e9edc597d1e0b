"""Collocations from counts kept in weighted acyclic automata.

Each task counts the phrases of a shard of text level by level in sorted order, which gives a tree of words whose arcs
carry counts; states with the same arcs are registered once, so what leaves the task is a minimal acyclic transducer from
phrases to counts. It is cut by ranges of the hash of a phrase's first two words (of its word, for a single one). The
transducers of a range are united and their weights summed in one task. A phrase is as frequent as the candidates it is
part of, so a united transducer keeps only counts that reach the threshold. The parts of a candidate are looked up by
composing: each range asks every other one once for each part it needs, so a frequent word is asked for once per
range and not once per phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F, types as T

from furlong.llm.common import give_back, stored, text_of

#: What ends a piece of text. A word is a run of anything else but blanks and tabs.
PIECE_END = r"[.,;:!?\x0A-\x0D]"
UNKNOWN = "und"
LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Bytes of text that a task counts at a time, and of text for each range of a language.
SHARD, RANGE = 5_000_000, 12_000_000
#: A longer text is cut into stretches of so many characters.
STRETCH = 4_000_000
#: Arcs that a task unites at a time.
UNITED = 1 << 19


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values with all bits spread (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """Nodes of one depth, sorted by parent (a node of the level above), then word: phrases in sorted order."""

    parent: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.label)


@dataclass
class Tree:
    """Counts of phrases: words sorted by their bytes, and a level for each number of words."""

    words: pa.Array
    levels: list[Level]

    def paths(self, depth: int) -> list[np.ndarray]:
        """Words of the phrases of a depth (from 1), one array for each position."""
        at, path = np.arange(len(self.levels[depth - 1])), []
        for level in reversed(self.levels[:depth]):
            path.append(level.label[at])
            at = level.parent[at]
        return path[::-1]

    def weights(self, phrases: list[pa.Array]) -> np.ndarray:
        """Counts of phrases, given as one array of words for each position; 0 where a phrase is unknown."""
        size, node, known = max(len(self.words), 1), 0, True
        for level, column in zip(self.levels, phrases):
            label = pc.index_in(column, self.words).fill_null(-1).to_numpy(zero_copy_only=False)
            if not len(level):
                return np.zeros(len(label), np.int64)
            wanted = node * size + label
            keys = level.parent * size + level.label
            node = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            known = known & (label >= 0) & (keys[node] == wanted)
        return np.where(known, level.weight[node], 0)


def joined(words: pa.Array, path: list[np.ndarray]) -> pa.Array:
    columns = [words.take(pa.array(ids)) for ids in path]
    return columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " ")


# Counting a shard.


def stretches(text: str, longest: int) -> Iterator[tuple[str, int]]:
    """The text, or its stretches with the words that phrases begun in them may reach; what those add is taken off again."""
    if len(text) <= STRETCH:
        yield text, 1
        return
    gap, ahead = re.compile(rf"[ \t]|{PIECE_END}"), re.compile(rf"[ \t]*(?:[^ \t.,;:!?\n-\r]+[ \t]*){{0,{longest - 1}}}")
    start = 0
    while start < len(text):
        found = gap.search(text, start + STRETCH)
        cut = found.start() if found else len(text)
        over = ahead.match(text, cut).end()
        yield text[start:over], 1
        if over > cut:
            yield text[cut:over], -1
        start = cut


def counted(texts: list[str], signs: list[int], longest: int) -> Tree:
    """Phrase counts of the texts, each counted with its sign."""
    lower = pc.ascii_lower(pa.array(texts, pa.string()))
    marked = pc.replace_substring_regex(lower, PIECE_END, " . ")
    pieces = pc.ascii_split_whitespace(pc.binary_join_element_wise(marked, " .", ""))
    flat = pieces.flatten()
    filled = pc.not_equal(flat, "")
    encoded = flat.filter(filled).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    words = encoded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = rank[encoded.indices.to_numpy()]
    if min(signs, default=1) < 0:
        owner = np.repeat(np.arange(len(texts)), pieces.value_lengths().to_numpy())[filled.to_numpy(zero_copy_only=False)]
        sign = np.asarray(signs)[owner]
    else:
        sign = None
    size = len(words)
    end = pc.index(words, ".").as_py()
    at = np.flatnonzero(ids != end)
    node, levels = ids[at], []
    for depth in range(longest):
        if depth:
            # the word behind the phrase; a mark ends every text, so there is always one more
            more = ids[at + depth] != end
            at, node = at[more], node[more]
            keys = node * size + ids[at + depth]
        else:
            keys = node
        found, node, count = np.unique(keys, return_inverse=True, return_counts=True)
        if sign is not None:
            count = np.zeros(len(found), np.int64)
            np.add.at(count, node, sign[at])
        levels.append(Level(found // size if depth else np.zeros(len(found), np.int64), found % size, count.astype(np.int64)))
    return Tree(words, levels)


# Ranges and the packed form.


def ranges_of(tree: Tree, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of each single word, by its hash, and of each node of the second level, by the hash of both words."""
    own = pd.util.hash_array(tree.words.to_numpy(zero_copy_only=False), categorize=False) if len(tree.words) else np.zeros(0, np.uint64)
    first = mixed(own)
    pair = tree.paths(2)
    with np.errstate(over="ignore"):
        second = mixed(first[pair[0]] * np.uint64(3) + own[pair[1]])
    return tuple(((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64) for h in (first[tree.levels[0].label], second))


def range_of(phrase: list[pa.Array], ranges: int) -> np.ndarray:
    """Range that holds the count of each phrase, given as one array of words for each position."""
    own = [pd.util.hash_array(w.to_numpy(zero_copy_only=False), categorize=False) if len(w) else np.zeros(0, np.uint64) for w in phrase[:2]]
    first = mixed(own[0])
    if len(own) > 1:
        with np.errstate(over="ignore"):
            first = mixed(first * np.uint64(3) + own[1])
    return ((first >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def split(tree: Tree, ranges: int) -> tuple[Tree, np.ndarray]:
    """The tree with a root per range: levels sorted by range, and the range of each node of the first level.

    A first word stands in every range that its phrases fall into, with its own count in one of them.
    """
    size = max(len(tree.words), 1)
    one, two = ranges_of(tree, ranges)
    first, second, *rest = tree.levels
    own = one * size + first.label
    keys = np.unique(np.concatenate([own, two * size + first.label[second.parent]]))
    weight = np.zeros(len(keys), np.int64)
    weight[np.searchsorted(keys, own)] = first.weight
    levels = [Level(np.zeros(len(keys), np.int64), keys % size, weight)]
    order = np.argsort(two, kind="stable")
    parent = np.searchsorted(keys, (two * size + first.label[second.parent])[order])
    levels.append(Level(parent, second.label[order], second.weight[order]))
    for level in rest:
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        parent = place[level.parent]
        order = np.argsort(parent, kind="stable")
        levels.append(Level(parent[order], level.label[order], level.weight[order]))
    return Tree(tree.words, levels), keys // size


def registered(group: np.ndarray, owner: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States with equal arcs within a group become one.

    ``owner`` gives for each arc the node whose state it leaves, ascending; ``group`` the group of each node.
    Returns the state of each node (-1 without arcs), the arcs that stay, and the number of arcs of each state.
    """
    state = np.full(len(group), -1, np.int64)
    if not len(owner):
        return state, np.zeros(0, bool), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    size = np.diff(first, append=len(owner))
    groups = group[owner[first]]
    with np.errstate(over="ignore"):
        arcs = np.zeros(len(owner), np.uint64)
        for column in columns:
            arcs = mixed(arcs * np.uint64(5) + column.astype(np.uint64))
        signature = mixed(np.add.reduceat(arcs, first) * np.uint64(7) + groups.astype(np.uint64))
    _, seen, inverse = np.unique(signature, return_index=True, return_inverse=True)
    twin = seen[inverse]
    # signatures only propose; arcs decide
    same = (size == size[twin]) & (groups == groups[twin])
    other = np.minimum(np.arange(len(owner)) + np.repeat(first[twin] - first, size), len(owner) - 1)
    equal = np.logical_and.reduce([column == column[other] for column in columns])
    same &= np.logical_and.reduceat(equal, first)
    twin = np.where(same, twin, np.arange(len(twin)))
    stays = twin == np.arange(len(twin))
    number = np.cumsum(stays) - 1
    state[owner[first]] = number[twin]
    return state, np.repeat(stays, size), size[stays]


#: A row: its transducer is a compressed Arrow batch of one row with the columns of ``pack``.
PACKED = T.StructType().add("lang", "string").add("range", "long").add("total", "long").add("transducer", "binary")


def pack(lang: str, forest: Tree, group: np.ndarray, total: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per group (ascending over the first level): its words and its minimal transducer."""
    size = max(len(forest.words), 1)
    longest = len(forest.levels)
    groups = [group]
    for level in forest.levels[1:]:
        groups.append(groups[-1][level.parent])
    rows = np.unique(group)
    keys = np.unique(np.concatenate([g * size + level.label for g, level in zip(groups, forest.levels)]))
    word_group = keys // size
    word_start = np.searchsorted(word_group, rows)

    def lists(values: np.ndarray, of: np.ndarray, kind: pa.DataType) -> pa.Array:
        ends = np.append(np.searchsorted(of, rows), len(of)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values, kind))

    columns: dict[str, pa.Array] = {}
    state: np.ndarray | None = None
    for depth in range(longest, 0, -1):
        level, of = forest.levels[depth - 1], groups[depth - 1]
        label = np.searchsorted(keys, of * size + level.label) - word_start[np.searchsorted(rows, of)]
        arcs = [label, level.weight] + ([] if state is None else [state])
        if depth > 1:
            above = groups[depth - 2]
            state, stays, sizes = registered(above, level.parent, arcs)
            owner_group = of[stays][np.cumsum(sizes) - 1] if len(sizes) else np.zeros(0, np.int64)
            columns[f"sizes{depth}"] = lists(sizes, owner_group, pa.int32())
            # states count from 0 within a row
            begin = np.searchsorted(owner_group, above)
            state = np.where(state >= 0, state - begin, -1)
        else:
            stays = np.ones(len(level), bool)
        kept_group = of[stays]
        columns[f"labels{depth}"] = lists(label[stays], kept_group, pa.int32())
        columns[f"weights{depth}"] = lists(level.weight[stays], kept_group, pa.int64())
        if depth < longest:
            columns[f"states{depth}"] = lists(arcs[2][stays], kept_group, pa.int32())
    columns["words"] = lists(forest.words.take(pa.array(keys % size)), word_group, pa.string())
    together = pa.RecordBatch.from_pydict(columns)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(rows), pa.string()), pa.array(rows), pa.array(np.zeros(len(rows), np.int64) if total is None else total),
         pa.array([squeezed(together.slice(i, 1)) for i in range(len(rows))], pa.binary())], PACKED.names)


def squeezed(row: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(row)
    return sink.getvalue().to_pybytes()


def unpack(rows: pa.RecordBatch, longest: int) -> Tree:
    """The transducers of all rows as one tree; words and phrases may repeat and are not sorted."""
    batch = pa.Table.from_batches([pa.ipc.open_stream(one.as_buffer()).read_next_batch() for one in rows["transducer"]]).combine_chunks()
    batch = {name: batch[name].combine_chunks() for name in batch.column_names}

    def parts(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, the row of each, and the number of the first value of each row."""
        column = batch[name]
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths

    _, _, word_base = parts("words")
    levels: list[Level] = []
    state = parent = None
    for depth in range(1, longest + 1):
        label, row, _ = parts(f"labels{depth}")
        label = label.astype(np.int64) + word_base[row]
        weight = parts(f"weights{depth}")[0].astype(np.int64)
        below = None
        if depth < longest:
            to, to_row, _ = parts(f"states{depth}")
            base = parts(f"sizes{depth + 1}")[2]
            below = np.where(to >= 0, to + base[to_row], -1)
        if depth == 1:
            arcs, parent = np.arange(len(label)), np.zeros(len(label), np.int64)
        else:
            sizes = parts(f"sizes{depth}")[0].astype(np.int64)
            first = np.cumsum(sizes) - sizes
            owners = np.flatnonzero(state >= 0)
            number = sizes[state[owners]] if len(owners) else np.zeros(0, np.int64)
            parent = np.repeat(owners, number)
            begin = np.cumsum(number) - number
            arcs = np.arange(len(parent)) - np.repeat(begin, number) + np.repeat(first[state[owners]], number)
        levels.append(Level(parent, label[arcs], weight[arcs]))
        state = below[arcs] if below is not None else None
    return Tree(batch["words"].flatten(), levels)


def united(trees: list[Tree]) -> Tree:
    """One tree with sorted words and phrases, weights of equal phrases summed."""
    encoded = pa.concat_arrays([t.words for t in trees]).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    words = encoded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word = rank[encoded.indices.to_numpy()]
    size = max(len(words), 1)
    bases = np.cumsum([0] + [len(t.words) for t in trees])
    nodes, levels = None, []
    for depth in range(len(trees[0].levels)):
        label = word[np.concatenate([t.levels[depth].label + base for t, base in zip(trees, bases)])]
        if depth:
            ends = np.cumsum([0] + [len(t.levels[depth - 1]) for t in trees])
            parent = nodes[np.concatenate([t.levels[depth].parent + base for t, base in zip(trees, ends)])]
            keys = parent * size + label
        else:
            keys = label
        weight = np.concatenate([t.levels[depth].weight for t in trees])
        found, nodes = np.unique(keys, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, nodes, weight)
        levels.append(Level(found // size if depth else np.zeros(len(found), np.int64), found % size, total))
    return Tree(words, levels)


def pruned(tree: Tree, least: int) -> Tree:
    """Phrases that reach the count. Parts of a phrase are as frequent, so none loses its prefix; a first word whose own
    count is kept elsewhere stays as long as phrases begin with it."""
    keep = [level.weight >= least for level in tree.levels]
    if len(tree.levels) > 1:
        keep[0][tree.levels[1].parent[keep[1]]] = True
    levels, place = [], None
    for level, stays in zip(tree.levels, keep):
        parent = level.parent[stays] if place is None else place[level.parent[stays]]
        weight = level.weight[stays]
        levels.append(Level(parent, level.label[stays], np.where(weight >= least, weight, 0)))
        place = np.cumsum(stays) - 1
    return Tree(tree.words, levels)


# The steps on Spark.


def shards(docs: DataFrame, longest: int, ranges: int) -> DataFrame:
    """Packed transducers of shards of ``docs`` (lang, text) by language and range."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[str, int]]] = {}
        size = 0

        def count_held() -> Iterator[pa.RecordBatch]:
            while held:
                lang, texts = held.popitem()
                tree = counted([t for t, _ in texts], [s for _, s in texts], longest)
                pa.default_memory_pool().release_unused()
                if len(tree.levels[0]):
                    forest = split(tree, ranges)
                    del tree, texts
                    yield pack(lang, *forest)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                for stretch, sign in stretches(text.as_py(), longest):
                    held.setdefault(lang, []).append((stretch, sign))
                    size += len(stretch)
                    if size >= SHARD and sign == 1:
                        yield from count_held()
                        size = 0
        yield from count_held()
        give_back()

    return docs.mapInArrow(count, PACKED)


def by_range(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("lang", "range").sortWithinPartitions("lang", "range", *order)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Parts of sorted batches that lie in one (lang, range), and whether the part opens a new one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch["lang"].to_pylist(), batch["range"].to_pylist()))
        start = 0
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[start]:
                yield keys[start] != last, batch.slice(start, at - start)
                last, start = keys[start], at


def unite(packed: DataFrame, longest: int, least: int) -> DataFrame:
    """One transducer per language and range, with ``total``: the occurrences of its single words, the rare ones included."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Tree] = []
        size, key = 0, None

        def close() -> pa.RecordBatch:
            tree = united(held)
            total = tree.levels[0].weight.sum()
            tree = pruned(tree, least)
            held.clear()
            if not len(tree.levels[0]):  # nothing frequent
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]]), pa.array([total]), pa.array([None], pa.binary())], PACKED.names)
            return pack(key[0], tree, np.full(len(tree.levels[0]), key[1]), np.array([total]))

        for new, rows in runs(batches):
            if new:
                if held:
                    yield close()
                size, key = 0, (rows["lang"][0].as_py(), rows["range"][0].as_py())
            held.append(unpack(rows, longest))
            size += sum(map(len, held[-1].levels))
            if size >= UNITED and len(held) > 1:
                held[:] = [united(held)]
                size = 0
        if held:
            yield close()
        give_back()

    return by_range(packed).mapInArrow(merge, PACKED)


def parts_wanted(transducers: DataFrame, longest: int, ranges: int) -> DataFrame:
    """lang, range (that knows the part), part, asker: each part once per asking range."""
    schema = T.StructType().add("lang", "string").add("range", "long").add("part", "string").add("asker", "long")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                tree = unpack(row, longest)
                for length in range(1, longest):
                    found = []
                    for depth in range(2, longest + 1):
                        path = tree.paths(depth)
                        if length < depth:
                            found.append(path[depth - length:])  # the rest
                        if length == 1:
                            found.append(path[:1])  # a longer first part is in this range
                    if not found:
                        continue
                    ids = np.unique(np.concatenate([np.stack(p, 1) for p in found]), axis=0)
                    if not len(ids):
                        continue
                    columns = [tree.words.take(pa.array(np.ascontiguousarray(c))) for c in ids.T]
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([
                        pa.concat_arrays([row["lang"]] * 1).take(pa.array(np.zeros(n, np.int64))), pa.array(range_of(columns, ranges)),
                        columns[0] if length == 1 else pc.binary_join_element_wise(*columns, " "),
                        pa.array(np.full(n, row["range"][0].as_py()))], schema.names)

    return transducers.mapInArrow(ask, schema)


def with_transducer(transducers: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of each (lang, range) behind the transducer of that range."""
    return by_range(transducers.unionByName(rows, allowMissingColumns=True).withColumn("_own", F.col("part").isNotNull()), "_own").drop("_own")


def answered(transducers: DataFrame, wanted: DataFrame, longest: int) -> DataFrame:
    """The parts with their counts, addressed to the range that asked."""
    schema = T.StructType().add("lang", "string").add("range", "long").add("part", "string").add("count", "long")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for new, rows in runs(batches):
            if new:
                tree = unpack(rows.slice(0, 1), longest)
                rows = rows.slice(1)
            if not rows.num_rows:
                continue
            part = rows["part"]
            blanks = pc.count_substring(part, " ").to_numpy()
            for length in np.unique(blanks).tolist():
                some = pa.array(blanks == length)
                asked = rows.filter(some)
                words = pc.split_pattern(asked["part"], " ")
                columns = [pc.list_element(words, k) for k in range(length + 1)]
                yield pa.RecordBatch.from_arrays([asked["lang"], asked["asker"], asked["part"], pa.array(tree.weights(columns), pa.int64())], schema.names)

    return with_transducer(transducers, wanted).mapInArrow(answer, schema)


def scored(transducers: DataFrame, answers: DataFrame, longest: int) -> DataFrame:
    """Candidates with a, l, r and score, and the phrases inside them that are candidates too (inner)."""
    schema = T.StructType().add("lang", "string").add("phrase", "string")
    for name in ("a", "l", "r", "score"):
        schema.add(name, "long")
    schema.add("inner", T.ArrayType(T.StringType()))

    def candidates(lang: str, tree: Tree, counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for depth in range(2, longest + 1):
            path = tree.paths(depth)
            if not len(path[0]):
                continue
            # counts of the first parts of two words and more, from this transducer
            at, firsts = tree.levels[depth - 1].parent, {}
            for k in range(depth - 1, 1, -1):
                firsts[k] = tree.levels[k - 1].weight[at].tolist()
                at = tree.levels[k - 1].parent[at]
            phrases = joined(tree.words, path).to_pylist()
            out = []
            for i, (phrase, a) in enumerate(zip(phrases, tree.levels[depth - 1].weight.tolist())):
                words, best = phrase.split(" "), None
                for k in range(1, depth):
                    left = firsts[k][i] if k > 1 else counts[words[0]]
                    right = counts[" ".join(words[k:])]
                    score = 1_000_000 * a * a // (left * right)
                    if best is None or score < best[2]:
                        best = left, right, score
                inner = [" ".join(words[s:s + n]) for n in range(2, depth) for s in range(depth - n + 1)]
                out.append((lang, phrase, a, *best, inner))
            columns = list(zip(*out))
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, lang, counts = None, None, {}
        for new, rows in runs(batches):
            if new:
                if tree is not None:
                    yield from candidates(lang, tree, counts)
                tree, lang, counts = unpack(rows.slice(0, 1), longest), rows["lang"][0].as_py(), {}
                rows = rows.slice(1)
            counts.update(zip(rows["part"].to_pylist(), rows["count"].to_pylist()))
        if tree is not None:
            yield from candidates(lang, tree, counts)
        give_back()

    return with_transducer(transducers, answers).mapInArrow(score, schema)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
         covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The ``top`` best phrases of two to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into words at blanks and tabs; a
    null text counts as empty, a null language as ``und``. ``a`` counts all occurrences of the phrase within pieces, ``n``
    all words of the language. Of the cuts of a phrase into a first part (``l``) and a rest (``r``) the one with the lowest
    floor(1000000 a a / (l r)) counts, of equal ones the first. A phrase inside a longer one of at least ``covered`` percent
    of its count is left out. Ties are ranked by count, then by the bytes of the phrase, so ranks are unique. Repeated rows
    count as often as they stand there; other columns are not looked at. An empty table, or one without words, gives no rows.
    """
    known = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of(text).alias("text"))
    # a scalar that sets the number of ranges, as they must grow with the text
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 + size // RANGE
    every = stored(unite(shards(known, longest, ranges), longest, least))
    transducers = every.filter(F.col("transducer").isNotNull())
    answers = answered(transducers, parts_wanted(transducers, longest, ranges), longest)
    found = stored(scored(transducers, answers, longest))
    longer = found.select("lang", F.explode("inner").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = found.drop("inner").join(longer, ["lang", "phrase"], "left") \
        .filter(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of 64 parts first, so that the last window of a language sees 64 times ``top`` phrases at most
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = kept.withColumn("_n", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).filter(F.col("_n") <= top)
    words = every.groupBy("lang").agg(F.sum("total").alias("n"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top) \
        .join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (
  SELECT row, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(string_split_regex(text, '[.,;:!?\x0A-\x0D]'), 1) AS pos
  FROM texts),
words AS (
  SELECT lang, row, pos, unnest(w) AS word, generate_subscripts(w, 1) AS place
  FROM (SELECT lang, row, pos, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)),
grams AS (
  SELECT lang, word AS w1, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY row, pos ORDER BY place)),
f1 AS (SELECT lang, w1, count(*) AS f FROM grams GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.f AS a, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2 WHERE c.f >= 10
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.f, x.f, y.f
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3 WHERE c.f >= 10
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.f, x.f, y.f
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3 WHERE c.f >= 10),
rated AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 WHERE f >= 10
    UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3 WHERE f >= 10) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * b.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score
FROM ranked k JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang) n ON n.lang = k.lang WHERE k.rank <= 2000
"""
