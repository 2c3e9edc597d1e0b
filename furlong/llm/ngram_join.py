"""Similarity join on word n-grams (Jaccard), and the classes of documents it links.

A document is the set of hashes (64 bits) of its ``size``-word shingles. Two sets that are similar enough share a
shingle among the rarest few of each, their prefixes. Documents with the same prefix and set size form one group and
are looked up together:

1. every document counts into a table of fixed size, from which all tasks order shingles by rarity;
2. groups that share a prefix shingle are compared by size and by a parity bitmap of the set, whose distance never exceeds
   that of the sets; what passes ties groups into clusters;
3. clusters are expanded to their members, whose whole sets are compared exactly.

Within a list or a cluster a pair is compared only if its ends are not yet connected, and a task reports the links that
connect something new, at most one per member. So no pairs are spread out, yet each class is that of all links. Equal sets
are one member from the start. Large lists and clusters are cut into blocks and compared block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from furlong.llm.common import Bitmap, give_back, stored, text_of
from furlong.llm.components import components

WORDS, PERCENT = 4, 85
#: Buckets of the table that orders shingles by rarity.
COUNTED = 1 << 16
#: Members of a list, and shingles of a cluster, that one task compares at a time.
LIST, CLUSTER = 8192, 1 << 21
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * P2
    h = (h ^ (h >> np.uint64(27))) * P3
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes. Words are split at ASCII white space and A-Z are lower-cased, as bytes do it."""
    words = np.array([hashes[w] for w in (text or "").encode("utf-8", "replace").lower().split()], np.uint64)
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * P1 + words[k:n - width + 1 + k])
    return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which a set must share one with every similar set; none if only an equal set can be similar."""
    return n - -(-percent * n // 100) + 1 if 100 * n >= percent * (n + 1) else 0


def parity(found: np.ndarray) -> bytes:
    """For each hash bucket whether it holds an odd number of shingles; about half as many buckets as shingles."""
    bits = 1 << max(6, (len(found) - 1).bit_length() - 1) if len(found) else 64
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def similar_sizes(a: int, b: int, percent: int) -> bool:
    return 100 * min(a, b) >= percent * max(a, b)


def may_link(n_a: int, bits_a: tuple[int, int], n_b: int, bits_b: tuple[int, int], percent: int) -> bool:
    """False only if the sets differ in more shingles than similar sets can. Bitmaps are (number, width)."""
    (a, width_a), (b, width_b) = bits_a, bits_b
    while width_a > width_b:
        width_a //= 2
        a = (a >> width_a) ^ (a & ((1 << width_a) - 1))
    while width_b > width_a:
        width_b //= 2
        b = (b >> width_b) ^ (b & ((1 << width_b) - 1))
    return (100 + percent) * (a ^ b).bit_count() <= (100 - percent) * (n_a + n_b)


def unpacked(bits: bytes | None) -> tuple[int, int] | None:
    return (int.from_bytes(bits, "little"), 8 * len(bits)) if bits is not None else None


class Forest:
    """What is connected so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def connect(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def compare(members: list[tuple], forest: Forest, linked, percent: int, sides: tuple[int, int] | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect members not connected yet. Members are (n, node, block, ...), sorted by n; with ``sides`` only
    members of different blocks are compared."""
    for i, one in enumerate(members):
        root, joined = forest.root(one[1]), False
        for other in members[i + 1:]:
            if 100 * one[0] < percent * other[0]:
                break
            if (sides is None or one[2] != other[2]) and forest.root(other[1]) != root and linked(one, other):
                forest.connect(one[1], other[1])
                root, joined = forest.root(one[1]), True
                yield min(one[1], other[1]), max(one[1], other[1])
        if joined and len({forest.root(m[1]) for m in members}) == 1:
            return


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each key (the first ``keys`` columns) of a sorted partition, as tuples of the other columns."""
    current, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                if row[:keys] != current:
                    if len(rows) > 1:
                        yield rows
                    current, rows = row[:keys], []
                rows.append(row)
    if len(rows) > 1:
        yield rows


def edge_batches(edges: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for edge in edges:
        held.append(edge)
        if len(held) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], ["a", "b"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], ["a", "b"])


def rarity(texts: DataFrame, size: int) -> np.ndarray:
    """Shingle occurrences per bucket over all texts; the driver receives ``COUNTED`` rows at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(COUNTED, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount((shingles(text.as_py(), size, hashes) >> np.uint64(48)).astype(np.int64), minlength=COUNTED)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])
        hashes.clear()
        give_back()

    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTED, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def signature(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def described(spoken: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``spoken`` with what is known of each set: n, sig (of the set), gkey (of size and prefix), prefix, bits."""
    kinds = {"n": pa.int64(), "sig": pa.binary(), "gkey": pa.binary(), "prefix": pa.list_(pa.int64()), "bits": pa.binary()}

    @F.arrow_udf("n long, sig binary, gkey binary, prefix array<long>, bits binary")
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts in batches:
            rows = []
            for text in texts:
                found = shingles(text.as_py(), size, hashes)
                n = len(found)
                order = np.lexsort((found, counts[(found >> np.uint64(48)).astype(np.int64)]))
                prefix = found[order[:prefix_length(n, percent)]]
                shape = n.to_bytes(8, "little") + (prefix if len(prefix) else found).tobytes()
                rows.append((n, signature(found), xxhash.xxh3_128_digest(shape), prefix.view(np.int64),
                             parity(found) if len(prefix) else None))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))
        hashes.clear()
        give_back()

    return spoken.withColumn("set", describe("text")).select("id", "ident", "set.*")


def clusters(rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """grp, cluster: groups that a chain of possibly similar pairs connects, and groups of several sets.

    Prefixes are read from the first row of each group, and each posting is shuffled once, by its token.
    """
    firsts = rows.join(groups.select("grp", "sets"), F.col("row") == F.col("grp"))
    postings = firsts.filter(F.size("prefix") > 0).select(F.explode("prefix").alias("token"), "grp")
    hits = postings.withColumn("many", F.count(F.lit(1)).over(W.partitionBy("token"))).filter("many > 1")
    blocks = F.expr(f"(many + {LIST - 1}) div {LIST}")
    own = F.pmod(F.xxhash64("grp"), F.col("blocks"))
    spread = hits.withColumn("blocks", blocks).withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lists = spread.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "grp", "own") \
        .join(firsts.select("grp", "n", F.when(F.col("sets") == 1, F.col("bits")).alias("bits")), "grp") \
        .select("token", "low", "high", "n", "grp", "own", "bits")

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def linked(a: tuple, b: tuple) -> bool:
            return a[3] is None or b[3] is None or may_link(a[0], a[3], b[0], b[3], percent)

        def edges() -> Iterator[tuple[int, int]]:
            for rows in runs(batches, 3):
                sides = None if rows[0][1] == rows[0][2] else rows[0][1:3]
                members = sorted((r[3], r[4], r[5], unpacked(r[6])) for r in rows)
                yield from compare(members, forest, linked, percent, sides)

        yield from edge_batches(edges())
        forest.parent.clear()
        give_back()

    tied = lists.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(tie, "a long, b long")
    several = groups.filter("sets > 1").select("grp")
    found = components(tied).select(F.col("node").alias("grp"), F.col("component").alias("cluster"))
    return several.join(found, "grp", "full").select("grp", F.coalesce("cluster", "grp").alias("cluster"))


def dealt(members: DataFrame) -> DataFrame:
    """Members (cluster, n, rep and more) with the blocks (low, high) of their cluster that they are compared in.

    Decided before the sets are at hand, so that sets are not shuffled for it.
    """
    weight = members.groupBy("cluster").agg(F.sum("n").alias("weight"))
    return members.join(weight, "cluster").withColumn("blocks", F.expr(f"(weight + {CLUSTER - 1}) div {CLUSTER}")) \
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("weight", "blocks", "other")


def sets_of(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``members`` (sig, ident and more), dealt out to blocks, with their whole sets and bitmaps, computed again from the texts.

    Only documents whose identifier may be a member's are tokenised, so sets of documents without a partner are
    neither kept nor shuffled.
    """
    wanted = Bitmap(members, "ident")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kinds = WordHashes(), [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for at in np.flatnonzero(wanted.test(np.asarray(batch.column(1)))).tolist():
                found = shingles(batch.column(2)[at].as_py(), size, hashes)
                rows.append((batch.column(0)[at].as_py(), signature(found), found.tobytes(), parity(found)))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["ident", "sig", "found", "bits"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["ident", "sig", "found", "bits"])
        hashes.clear()
        give_back()

    built = docs.select("ident", F.xxhash64("ident"), "text").mapInArrow(build, "ident long, sig binary, found binary, bits binary")
    return built.join(dealt(members).hint("merge"), ["ident", "sig"])


def links(members: DataFrame, percent: int) -> DataFrame:
    """a, b: exact links that connect the members (cluster, low, high, n, rep, own, bits, found) of each cluster as all its links do."""
    spread = members.select("cluster", "low", "high", "n", "rep", "own", "bits", "found")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(a: tuple, b: tuple) -> bool:
            if not may_link(a[0], a[3], b[0], b[3], percent):
                return False
            both = len(np.intersect1d(a[4], b[4], assume_unique=True))
            return 100 * both >= percent * (a[0] + b[0] - both)

        def edges() -> Iterator[tuple[int, int]]:
            for rows in runs(batches, 3):
                sides = None if rows[0][1] == rows[0][2] else rows[0][1:3]
                members = sorted(((r[3], r[4], r[5], unpacked(r[6]), np.frombuffer(r[7], np.uint64))
                                  for r in {r[4]: r for r in rows}.values()), key=lambda m: m[:2])
                yield from compare(members, Forest(), linked, percent, sides)

        yield from edge_batches(edges())
        give_back()

    return spread.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high") \
        .mapInArrow(verify, "a long, b long")


def placed_sets(docs: DataFrame, identifier: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row (id, n, sig and more), and of each set that is not empty (sig) its least identifier and its class."""
    spoken = docs.select(F.col(identifier).alias("id"), F.xxhash64(identifier).alias("ident"), text_of(text).alias("text"))
    counts = rarity(spoken.select("text"), size)
    rows = stored(described(spoken, size, percent, counts).withColumn("row", F.monotonically_increasing_id()))
    some = rows.filter("n > 0")
    groups = stored(some.groupBy("gkey").agg(
        F.min("row").alias("grp"), F.when(F.min("sig") == F.max("sig"), 1).otherwise(2).alias("sets")))
    sets = some.groupBy("sig").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.first("n").alias("n"),
                                   F.first("gkey").alias("gkey"), F.first("ident").alias("ident"))
    placed = groups.select("gkey", "grp").join(clusters(rows, groups, percent), "grp").select("gkey", "cluster")
    members = stored(sets.join(placed, "gkey").drop("gkey"))
    linked = components(links(sets_of(spoken, members.select("sig", "ident", "rep", "cluster", "n"), size), percent))
    reached = members.join(linked, F.col("rep") == F.col("node")).select("sig", "component", "least")
    return rows, sets.select("sig", "least"), reached


def join(docs: DataFrame, identifier: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Set size and class of every document.

    Two documents link when 100 * shared >= ``percent`` * united shingles; a class is everything that links reach. With
    fewer than ``size`` words the whole sequence is the one shingle. Null texts and texts without a word have an empty
    set, link with nothing and are a class of their own. Rows that repeat an identifier are documents of their own;
    null identifiers count as largest. Hashes of 64 bits stand for shingles: two of them coincide about
    once in 10**19 pairs. An empty table gives no rows.

    Returns doc_id, n_shingles, component_id (smallest identifier of the class).
    """
    rows, sets, reached = placed_sets(docs, identifier, text, size, percent)
    some = rows.filter("n > 0")
    smallest = reached.groupBy("component").agg(F.min("least").alias("class_id"))
    classes = sets.join(reached.join(smallest, "component").select("sig", "class_id"), "sig", "left") \
        .select("sig", F.coalesce("class_id", "least").alias("component_id"))
    together = some.select("sig", "id", "n").join(classes, "sig").select("id", "n", "component_id")
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return together.unionByName(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def signed(docs: DataFrame, text: str, size: int) -> DataFrame:
    """``docs`` with the signature _sig of each set, null if it is empty."""
    @F.arrow_udf("binary")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts in batches:
            found = (shingles(t.as_py(), size, hashes) for t in texts)
            yield pa.array([signature(f) if len(f) else None for f in found], pa.binary())
        hashes.clear()
        give_back()

    return docs.withColumn("_sig", sign(text_of(text)))


def keep_one(docs: DataFrame, identifier: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest identifier, null last.

    If an identifier has several rows in a class, that of the smallest set signature stays, of equal sets that of the
    smallest row hash. Rows with an empty set are classes of their own and stay. An identifier all of whose rows go, or
    whose only row stays, is decided by itself; only rows whose identifier is null or has rows of both kinds are
    told apart by their sets.
    """
    rows, sets, reached = placed_sets(docs, identifier, text, size, percent)
    first = F.min(F.struct(F.col("least").isNull(), "least", "sig")).alias("_first")
    linked = reached.groupBy("component").agg(first)
    leaders = stored(sets.join(reached, "sig", "left_anti").select("sig", "least").unionByName(
        linked.select("_first.sig", "_first.least")))
    kept = F.col("n").eqNullSafe(0) | (F.col("_leads") & F.col("id").eqNullSafe(F.col("least")))
    owned = rows.select("id", "sig", "n").join(leaders.withColumn("_leads", F.lit(True)), "sig", "left") \
        .groupBy("id").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.coalesce(kept, F.lit(False))).alias("_kept"))
    unsure = stored(owned.filter("id IS NOT NULL AND (_rows > 1 OR NOT _kept)").select(F.col("id").alias("_id"), "_kept"))
    some = Bitmap(unsure, "_id").may_hold(F.col(identifier))
    tested = docs.withColumn("_maybe", F.col(identifier).isNull() | some)
    looked = tested.filter("_maybe").drop("_maybe").join(unsure.hint("merge"), F.col(identifier) == F.col("_id"), "left")
    sure = looked.filter(F.col(identifier).isNotNull() & F.col("_id").isNull()).select(*docs.columns)
    mixed = signed(looked.filter(F.col(identifier).isNull() | F.col("_kept")).select(*docs.columns), text, size)
    hashed = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = mixed.filter("_sig IS NOT NULL").groupBy(F.col(identifier).alias("_id"), "_sig") \
        .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("_row"))
    told = one.join(leaders, (F.col("_sig") == F.col("sig")) & F.col("_id").eqNullSafe(F.col("least")), "left_semi").select("_row.*")
    empty = mixed.filter("_sig IS NULL").select(*docs.columns)
    return tested.filter("NOT _maybe").drop("_maybe").unionByName(sure).unionByName(told).unionByName(empty)
