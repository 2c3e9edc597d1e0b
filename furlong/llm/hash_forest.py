"""Approximate nearest neighbours with a hash-prefix forest.

Every tree hashes a vector to a string of symbols: a random rotation, the axis on which the rotated vector lies
furthest out, with its sign (cross-polytope hashing), again for the next symbol. Vectors whose strings share a long
prefix are probably near. A tree is the array of vectors sorted by string, held in pieces: one per first symbol, and
several of at most ``PIECE`` rows where a first symbol is frequent.

A search descends to the longest prefix in all trees at once and ascends one bit at a time in all trees together until
they offer enough candidates; how many a prefix has is known from one table of counts of fixed size. Every candidate
is measured on the original vectors in double precision where its piece lies, and the ``k`` + 1 nearest of each piece
go on, so no candidate that belongs to the result is lost however close together the others lie.

Equal vectors are searched once: of each group only the ``k`` + 1 smallest identifiers can be among anyone's ``k``
nearest, so a vector with a third of all rows is one row of the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm.common import stored

TREES, SEED = 40, 20_240_601
#: Bits of a string that are counted, and rows of a piece.
DEPTH, PIECE = 12, 8192
#: A search takes prefixes with at least ``LEAST`` candidates a tree, and ``SHARE`` * n ** ``POWER`` over all trees.
LEAST, SHARE, POWER = 128, 30.0, 0.6
#: Components of the pairs that are measured at a time.
MEASURED = 1 << 20


def sound(vector: Column) -> Column:
    """Neither null nor empty nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


class Forest:
    """The rotations, drawn from a seed, for vectors of ``dim`` components."""

    def __init__(self, dim: int, trees: int = TREES):
        draw = np.random.default_rng(SEED)
        self.dim, self.trees = dim, trees
        self.width = max(1, (2 * dim - 1).bit_length())  # bits of a symbol
        self.depth = max(self.width, min(DEPTH, 2 * self.width))
        self.rotations = [np.linalg.qr(draw.normal(size=(dim, dim)))[0] for _ in range(2 * trees)]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The first ``depth`` bits of each vector's string in each tree."""
        out = np.zeros((self.trees, len(vectors)), np.int64)
        at = np.arange(len(vectors))
        for tree in range(self.trees):
            for rotation in self.rotations[2 * tree:2 * tree + 2]:
                turned = vectors @ rotation
                axis = np.abs(turned).argmax(axis=1)
                out[tree] = out[tree] << self.width | (axis * 2 + (turned[at, axis] > 0))
        return out >> (2 * self.width - self.depth)

    def first(self, cells: np.ndarray) -> np.ndarray:
        return cells >> (self.depth - self.width)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, dim)


def rows_of(values: np.ndarray) -> pa.Array:
    size = values.shape[1] * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]) \
        .cast(pa.binary())


def representatives(points: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: vector, near (its k + 1 smallest identifiers with their rows), rep (its key)."""
    salted = W.partitionBy("vector", F.pmod(F.xxhash64("row"), F.lit(16))).orderBy("id", "row")
    few = points.withColumn("_n", F.row_number().over(salted)).filter(F.col("_n") <= k + 1)
    whole = W.partitionBy("vector").orderBy("id", "row")
    fewer = few.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= k + 1)
    return fewer.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("near")) \
        .withColumn("rep", F.col("near")[0]["row"])


def count_cells(reps: DataFrame, forest: Forest) -> np.ndarray:
    """Vectors by tree and cell; the driver receives at most trees * 2 ** depth numbers, whatever the size of the table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((forest.trees, 1 << forest.depth), np.int64)
        for batch in batches:
            for tree, own in enumerate(forest.cells(matrix(batch.column(0), forest.dim))):
                total[tree] += np.bincount(own, minlength=1 << forest.depth)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], ["cell", "rows"])

    found = reps.select("vector").mapInArrow(count, "cell long, rows long").groupBy("cell").agg(F.sum("rows").alias("rows")).toArrow()
    out = np.zeros(forest.trees << forest.depth, np.int64)
    out[found.column("cell").to_numpy()] = found.column("rows").to_numpy()
    return out.reshape(forest.trees, -1)


def entries(reps: DataFrame, forest: Forest, pieces: np.ndarray) -> DataFrame:
    """The index: a row per tree and vector, with the components as they are (4 bytes each if single precision, else 8)."""
    kind = np.float32 if reps.schema["vector"].dataType.elementType == T.FloatType() else np.float64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(1), forest.dim)
            if not len(vectors):
                continue
            keys, raw = np.asarray(batch.column(0)), rows_of(vectors.astype(kind))
            dealt = (keys * 0x9E3779B1 >> 7) & 0x7FFFFFFF
            for tree, own in enumerate(forest.cells(vectors)):
                symbol = forest.first(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((tree << forest.width) + symbol), pa.array(dealt % pieces[tree, symbol]), pa.array(own), pa.array(keys),
                     batch.column(2), raw], ["bucket", "piece", "cell", "rep", "least", "raw"])

    kept = reps.select("rep", "vector", F.col("near")[0]["id"].alias("least"))
    return kept.mapInArrow(place, T.StructType([*(T.StructField(c, T.LongType()) for c in ("bucket", "piece", "cell", "rep")),
                                                kept.schema["least"], T.StructField("raw", T.BinaryType())]))


def probes(queries: DataFrame, forest: Forest, counts: np.ndarray, pieces: np.ndarray, wanted: float) -> DataFrame:
    """Where each query looks: the pieces and the range of cells of the prefix at which all trees together offer ``wanted`` candidates."""
    running = np.concatenate((np.zeros((forest.trees, 1), np.int64), counts.cumsum(axis=1)), axis=1)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(1), forest.dim)
            if not len(vectors):
                continue
            keys, raw, cells = np.asarray(batch.column(0)), rows_of(vectors), forest.cells(vectors)
            level, open_ = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
            for bits in range(forest.depth, 0, -1):  # up from the longest prefix, all trees together
                low = cells >> (forest.depth - bits) << (forest.depth - bits)
                offered = sum(running[t][low[t] + (1 << (forest.depth - bits))] - running[t][low[t]] for t in range(forest.trees))
                stop = open_ & (offered >= wanted)
                level[stop], open_ = bits, open_ & ~stop
            out: list[tuple[int, int, int, int, int]] = []
            for q, bits in enumerate(level.tolist()):
                span = 1 << (forest.depth - bits)
                for tree in range(forest.trees if bits else 1):  # without a prefix every tree offers all rows
                    low = int(cells[tree, q]) // span * span
                    symbols = range(low >> (forest.depth - forest.width), ((low + span - 1) >> (forest.depth - forest.width)) + 1)
                    out += [((tree << forest.width) + s, piece, low, low + span, q) for s in symbols if running[tree][(s + 1) << (forest.depth - forest.width)]
                            > running[tree][s << (forest.depth - forest.width)] for piece in range(pieces[tree, s])]
                if len(out) > 20_000 or q + 1 == len(level):
                    columns = np.array(out, np.int64).reshape(-1, 5).T
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c) for c in columns[:4]), pa.array(keys[columns[4]]), raw.take(pa.array(columns[4]))],
                        ["bucket", "piece", "low", "high", "query", "vector"])
                    out = []

    return queries.select("rep", "vector").mapInArrow(look, "bucket long, piece long, low long, high long, query long, vector binary")


def closest_pairs(queries: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and distance of all pairs that may be among the ``most`` nearest of their query, ties included.

    Products sort out pairs only beyond what rounding can add to them; the others are measured component by component.
    """
    squares, lengths = (queries**2).sum(axis=1), (vectors**2).sum(axis=1)
    about = squares[:, None] + lengths - 2 * queries @ vectors.T
    # twice what rounding can move a value by, and as much again for the roots that tie
    slack = (8 * queries.shape[1] + 64) * np.finfo(float).eps * (squares + lengths.max())
    limit = np.partition(about, most - 1, axis=1)[:, most - 1] if len(vectors) > most else np.full(len(queries), np.inf)
    q, v = np.nonzero(about <= (limit + slack)[:, None])
    total = [np.zeros(0)]
    for at in range(0, len(q), step := MEASURED // queries.shape[1] + 1):
        some = slice(at, at + step)
        total.append(np.cumsum((queries[q[some]] - vectors[v[some]])**2, axis=1)[:, -1])  # added from left to right
    return q, v, np.sqrt(np.concatenate(total))


def screen(index: DataFrame, asked: DataFrame, dim: int, most: int) -> DataFrame:
    """query, rep, least (smallest identifier), score (distance): the ``most`` nearest of each query in each piece."""
    kind = index.schema["least"]

    def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if held.num_rows and wanted.num_rows:
            cells = held.column("cell").to_numpy()
            order = np.argsort(cells, kind="stable")  # the piece as a sorted array
            cells, reps, least = cells[order], held.column("rep").to_numpy()[order], held.column("least").take(pa.array(order))
            raw = b"".join(held.column("raw").to_pylist())
            vectors = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(cells) else float).reshape(-1, dim)[order].astype(float)
            queries = np.frombuffer(b"".join(wanted.column("vector").to_pylist()), float).reshape(-1, dim)
            names, lows, highs = (wanted.column(c).to_numpy() for c in ("query", "low", "high"))
            for low, high in sorted(set(zip(lows.tolist(), highs.tolist()))):
                a, b = np.searchsorted(cells, [low, high])
                same = np.flatnonzero((lows == low) & (highs == high))
                for some in np.array_split(same, len(same) // 256 + 1) if b > a else ():
                    q, v, score = closest_pairs(queries[some], vectors[a:b], most)
                    pairs = pa.table({"query": names[some][q], "rep": reps[a:b][v], "least": least.slice(a, b - a).take(pa.array(v)), "score": score})
                    pairs = pairs.sort_by([("query", "ascending"), ("score", "ascending"), ("least", "ascending"), ("rep", "ascending")])
                    owner = pairs.column("query").to_numpy()
                    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    found.append(pairs.filter(pa.array(rank < most)))
        return pa.concat_tables(found) if found else pa.table(
            {"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "least": held.column("least").slice(0, 0), "score": pa.array([], pa.float64())})

    return index.groupBy("bucket", "piece").cogroup(asked.groupBy("bucket", "piece")).applyInArrow(search, T.StructType(
        [T.StructField("query", T.LongType()), T.StructField("rep", T.LongType()), kind, T.StructField("score", T.DoubleType())]))


def nearest(table: DataFrame, is_query: Column, identifier: str = "vec_id", vector: str = "embedding", k: int = 10,
            trees: int = TREES) -> DataFrame:
    """The ``k`` nearest rows found for every row that ``is_query`` marks, the row itself left out.

    Unsound vectors (see ``sound``), and vectors whose length is not the most frequent one (of equally frequent ones
    the smallest), take no part, neither as query nor as candidate. Identifiers may repeat; rows are told apart. Ties go to
    the smaller identifier, null last. Fewer candidates than ``k`` give fewer rows; an empty table gives none.

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance on the original vectors).
    """
    base = stored(table.filter(sound(F.col(vector))).select(
        F.monotonically_increasing_id().alias("row"), F.col(identifier).alias("id"), F.col(vector).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks")))
    size = base.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    forest = Forest(size["n"] if size else 1, trees)
    base = base.filter(F.size("vector") == forest.dim)
    reps = stored(representatives(base, k))
    counts = count_cells(reps, forest)
    pieces = -(-counts.reshape(trees, 1 << forest.width, -1).sum(axis=2) // PIECE)
    n = int(counts[0].sum())
    asking = base.filter("asks").select("row", "id", "vector")
    queries = stored(reps.join(asking.select("vector").distinct(), "vector").select("rep", "vector"))
    asked = probes(queries, forest, counts, np.maximum(pieces, 1), max(LEAST * trees, SHARE * n**POWER))
    about = screen(entries(reps, forest, np.maximum(pieces, 1)), asked, forest.dim, k + 1)
    best = W.partitionBy("query").orderBy("score", F.asc_nulls_last("least"), "rep")
    pairs = about.distinct().withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).select("query", "rep", "score")
    measured = pairs.join(reps.select("rep", "near"), "rep").select("query", "score", F.explode("near").alias("_near"))
    closest = W.partitionBy("query").orderBy("score", F.asc_nulls_last("_near.id"), "_near.row")
    lists = measured.withColumn("_n", F.row_number().over(closest)).filter(F.col("_n") <= k + 1) \
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "_near", "score"))).alias("list"))
    keyed = asking.join(reps.select("vector", F.col("rep").alias("query")), "vector").join(lists, "query")
    others = F.slice(F.filter("list", lambda x: x["_near"]["row"] != F.col("row")), 1, k)
    return keyed.select(F.col("id").alias("query_id"), F.posexplode(others).alias("_at", "_found")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_found._near.id").alias("vec_id"), F.col("_found.score").alias("score"))
