"""Merkle manifest of a dataset, kept as aligned subtrees in the van Emde Boas layout.

A tree of arity 16 over ordered leaves is cut into aligned blocks of 16^3 leaves. A block is one row: its digests lie in
one array, split recursively at half height, so that a node and its neighbourhood are close at every granularity, and
plain arithmetic finds any node or sibling. The roots of the blocks are the leaves of the next tier, until a tree has a
single block. Siblings are handed down tier by tier. A task holds one block at a time, whatever the size of a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from furlong.llm.common import stored

ARITY = 16
#: Levels of a block above its leaves, and its number of leaves.
HEIGHT = 3
LEAVES = ARITY**HEIGHT
#: Hexadecimal characters and bytes of a digest.
HEX, BYTES = 64, 32

#: A proof: from the leaf up, the place within the run and the other digests of the run.
PATH = T.ArrayType(T.StructType().add("at", "integer").add("others", "binary"))
UPPER = T.StructType().add("path", PATH).add("subroot", "binary").add("root", "binary")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def nodes(height: int) -> int:
    """Slots of a complete subtree of this height."""
    return (ARITY ** (height + 1) - 1) // (ARITY - 1)


def address(height: int, level: int, index: np.ndarray) -> np.ndarray:
    """Slot of the ``index``-th node ``level`` steps above the leaves of a subtree of this height.

    The upper half of the levels is laid out first, then the subtrees below it from left to right, each the same way.
    """
    if height == 0:
        return np.zeros_like(index)
    above = (height + 1) // 2  # levels of the upper part
    below = height - above  # height of each lower subtree
    if level > below:
        return address(above - 1, level - below - 1, index)
    width = ARITY ** (below - level)
    return nodes(above - 1) + index // width * nodes(below) + address(below, level, index % width)


@cache
def slots(height: int) -> list[list[int]]:
    """Addresses of all nodes of a subtree, level by level from its leaves."""
    return [address(height, level, np.arange(ARITY ** (height - level))).tolist() for level in range(height + 1)]


def height_of(size: int) -> int:
    """Levels above ``size`` leaves: runs of 16 are combined while more than one node remains."""
    height = 0
    while size > 1:
        size, height = -(-size // ARITY), height + 1
    return height


def lay_out(leaves: list[str], height: int) -> bytes:
    """Digests of a block in their slots; slots without a node are zero, those behind the last node are left out."""
    places = slots(height)
    found, level = {}, leaves
    for at in places:
        found.update(zip(at, level))
        level = [digest("".join(level[i:i + ARITY])) for i in range(0, len(level), ARITY)]
    return bytes.fromhex("".join(found.get(i, "0" * HEX) for i in range(max(found) + 1)))


def runs(block: bytes, height: int, count: int) -> list[list[str]]:
    """For each level but the top: its runs of up to 16 nodes as joined hexadecimal text."""
    text, levels = block.hex(), []
    for level in range(height):
        at = slots(height)[level][:count]
        digests = [text[HEX * i:HEX * i + HEX] for i in at]
        levels.append(["".join(digests[i:i + ARITY]) for i in range(0, count, ARITY)])
        count = -(-count // ARITY)
    return levels


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``df`` with place (from 0 within ``tree``) and size (rows of the tree), by an external sort over all tasks.

    Rows with the same keys get consecutive places in any order. Only a count per task and tree is joined back.
    """
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    ranked = keyed.repartitionByRange(tree, *order, "_tie").sortWithinPartitions(tree, *order).drop("_tie") \
        .withColumn("_at", F.monotonically_increasing_id())  # the task and, in the lower 33 bits, the row
    ranked = stored(ranked.withColumn("_part", F.shiftright("_at", 33)))
    parts = ranked.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_of")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    whole = W.partitionBy("_tree")
    before = whole.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("_tree", "_of", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_from")).alias("_shift"),
                          F.sum("_rows").over(whole).alias("size"))
    return ranked.join(starts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of"))) \
        .withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_tree", "_of", "_shift")


def blocks_of(leaves: DataFrame) -> DataFrame:
    """Blocks of one tier from its leaves (tree, place, size, digest, row, presented).

    Returns tree, place (of the block), size (leaves of the tree in this tier), block, top and the lists rows, presented.
    """
    schema = T.StructType().add("tree", leaves.schema["tree"].dataType).add("place", "long").add("size", "long").add("n", "integer") \
        .add("block", "binary").add("top", "binary").add("rows", T.ArrayType(leaves.schema["row"].dataType)) \
        .add("presented", T.ArrayType(T.BinaryType()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            size = table["size"][0].as_py()
            height = HEIGHT if size > LEAVES else height_of(size)
            block = lay_out([d.hex() for d in table["digest"].to_pylist()], height)
            ends = pa.array([0, table.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, table[c].combine_chunks()) for c in ("row", "presented")]
            columns = [table["tree"].slice(0, 1).combine_chunks(), pa.array([table["place"][0].as_py() // LEAVES]), pa.array([size]),
                       pa.array([table.num_rows], pa.int32()), pa.array([block]), pa.array([block[:BYTES]]), *lists]
            return pa.RecordBatch.from_arrays(columns, ["tree", "place", "size", "n", "block", "top", "rows", "presented"])

        for batch in batches:
            # places are contiguous within a tree, so a block begins where its place is a multiple of its width
            starts = np.flatnonzero(np.asarray(batch["place"]) % LEAVES == 0).tolist()
            for start, end in zip([0, *starts], [*starts, batch.num_rows]):
                if start in starts and held:
                    yield whole()
                if end > start:
                    held.append(batch.slice(start, end - start))
        if held:
            yield whole()

    dealt = leaves.withColumn("_block", F.floor(F.col("place") / LEAVES)) \
        .repartition("tree", "_block").sortWithinPartitions("tree", "_block", "place").drop("_block")
    return dealt.select("tree", "place", "size", "digest", "row", "presented").mapInArrow(fold, schema)


def tiers_of(leaves: DataFrame) -> list[DataFrame]:
    """Stored tiers from the leaves up, until every tree has one block."""
    tiers, nothing = [], F.lit(None).cast("binary")
    while True:
        tiers.append(stored(blocks_of(leaves)))
        # a scalar: the tallest tree
        if (tiers[-1].agg(F.max("size")).first()[0] or 0) <= LEAVES:
            return tiers
        leaves = tiers[-1].filter(F.col("size") > LEAVES).select(
            "tree", "place", F.ceil(F.col("size") / LEAVES).alias("size"), F.col("top").alias("digest"),
            F.struct("place").alias("row"), nothing.alias("presented"))


def tops(tiers: list[DataFrame]) -> DataFrame:
    """tree, top: one row per tree, from the tier in which it has a single block."""
    found = [t.filter(F.col("size") <= LEAVES).select("tree", "top") for t in tiers]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def walk(blocks: DataFrame, schema: str, emit) -> DataFrame:
    """For each block with its ``upper`` (the way from its top to the root) the batches that ``emit`` makes of its leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch[name][i] for name in batch.schema.names}
                size, n = one["size"].as_py(), one["n"].as_py()
                height = HEIGHT if size > LEAVES else height_of(size)
                yield emit(batch.slice(i, 1), n, runs(one["block"].as_py(), height, n), one["upper"].as_py())

    return blocks.mapInArrow(run, schema)


def own_path(levels: list[list[str]], at: int) -> list[dict]:
    """Position and siblings of a leaf of a block, level by level."""
    path = []
    for level in levels:
        at, position = at // ARITY, at % ARITY
        run = level[at]
        path.append({"at": position, "others": bytes.fromhex(run[:HEX * position] + run[HEX * position + HEX:])})
    return path


def with_upper(blocks: DataFrame, tier: int, tiers: list[DataFrame], crown: DataFrame) -> DataFrame:
    """Blocks of a tier with the way above them: that of the single block of a tree is given by ``crown`` (tree, upper)."""
    alone = blocks.filter(F.col("size") <= LEAVES).join(
        crown.select(F.col("tree").alias("_tree"), "upper"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    if tier == len(tiers) - 1:
        return alone
    schema = T.StructType().add("tree", blocks.schema["tree"].dataType).add("place", "long").add("upper", UPPER)

    def hand_down(block: pa.RecordBatch, n: int, levels: list[list[str]], upper: dict) -> pa.RecordBatch:
        first = block["place"][0].as_py() * LEAVES
        ways = [{**upper, "path": own_path(levels, i) + upper["path"]} for i in range(n)]
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([block["tree"]] * n), pa.array([first + i for i in range(n)]),
            pa.array(ways, to_arrow_type(UPPER))], ["tree", "place", "upper"])

    parents = with_upper(tiers[tier + 1], tier + 1, tiers, crown).drop("rows", "presented")
    ways = walk(parents, schema, hand_down)
    below = blocks.filter(F.col("size") > LEAVES).join(
        ways.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), "upper"),
        F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("place") == F.col("_place"))).drop("_tree", "_place")
    return alone.unionByName(below)


@dataclass
class Manifest:
    """Stored tiers of the trees of all sources, and those of the tree over the sources' roots."""

    sources: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """One row with the root; none for an empty table."""
        return tops(self.top).select(F.lower(F.hex("top")).alias("root"))

    def subroots(self) -> DataFrame:
        return tops(self.sources).select(F.col("tree").alias("source"), F.lower(F.hex("top")).alias("subroot"))


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row: each field is ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(f) for f in fields]), 256))


def build(docs: DataFrame, leaf: Column, source: str = "source", identifier: str = "doc_id", presented: Column | None = None,
          columns: list[str] | None = None) -> Manifest:
    """Manifest of ``docs``: one tree per source, leaves by identifier, and one over the sources.

    ``leaf`` is the digest of a row (binary); ``presented`` the digest that someone shows for it later, null where it is
    the leaf itself. ``columns`` (the identifier by default) are carried along; extra columns of any name do no harm.
    Null identifiers and the null source come first; rows that repeat an identifier are ordered by their digests, and
    equal rows are leaves of their own. Null fields, empty and very long texts are hashed whole. An empty table has no tiers' rows and no root.
    """
    shown = F.lit(None).cast("binary") if presented is None else presented
    rows = docs.select(F.col(source).alias("tree"), F.struct(*[F.col(c) for c in columns or [identifier]]).alias("row"),
                       F.col(identifier).alias("_id"), leaf.alias("digest"), shown.alias("presented"))
    # digests are written before they are sorted, so texts are read once
    leaves = numbered(stored(rows), "tree", ["_id", "digest"]).drop("_id")
    sources = tiers_of(leaves)
    subroots = tops(sources).select(F.lit(0).alias("tree"), F.struct(F.col("tree").alias("source")).alias("row"), F.col("tree").alias("_id"),
                                    F.col("top").alias("digest"), F.lit(None).cast("binary").alias("presented"))
    return Manifest(sources, tiers_of(numbered(subroots, "tree", ["_id"]).drop("_id")))


def prove(manifest: Manifest, paths: bool = True) -> DataFrame:
    """One row per leaf: row, leaf, subroot, root, proof_sha256, folded_root, and with ``paths`` the path itself.

    ``path`` lists, from the leaf up to the root, the position within the run and the digests of the run's other nodes.
    ``folded_root`` is recomputed from the presented digest (else the leaf) and the path alone; ``proof_sha256`` is the
    digest of all siblings. Digests are lower-case hexadecimal text.
    """
    no_path = F.array().cast(PATH)
    crown = tops(manifest.top).select("tree", F.struct(no_path.alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("top").alias("root")).alias("upper"))

    def source_path(block: pa.RecordBatch, n: int, levels: list[list[str]], upper: dict) -> pa.RecordBatch:
        ways = [own_path(levels, i) + upper["path"] for i in range(n)]
        return pa.RecordBatch.from_arrays([
            block["rows"].flatten().field(0), pa.array(ways, to_arrow_type(PATH)),
            pa.array([upper["root"]] * n, pa.binary())], ["tree", "path", "root"])

    source_schema = T.StructType().add("tree", manifest.sources[0].schema["tree"].dataType).add("path", PATH).add("root", "binary")
    above = walk(with_upper(manifest.top[0], 0, manifest.top, crown).drop("presented"), source_schema, source_path)
    subroots = tops(manifest.sources)
    uppers = above.join(subroots.select(F.col("tree").alias("_tree"), F.col("top").alias("subroot")), F.col("tree").eqNullSafe(F.col("_tree"))) \
        .select("tree", F.struct("path", "subroot", "root").alias("upper"))
    schema = T.StructType().add("row", manifest.sources[0].schema["rows"].dataType.elementType)
    for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema.add(name, "string")
    if paths:
        schema.add("path", PATH)

    def show(block: pa.RecordBatch, n: int, levels: list[list[str]], upper: dict) -> pa.RecordBatch:
        text = block["block"][0].as_py().hex()
        size = block["size"][0].as_py()
        places = slots(HEIGHT if size > LEAVES else height_of(size))[0]
        presented = block["presented"].flatten().to_pylist()
        above = [(step["at"], step["others"].hex()) for step in upper["path"]]
        leaves, proofs, folded = [], [], []
        for i in range(n):
            leaf = text[HEX * places[i]:HEX * places[i] + HEX]
            at, steps = i, []
            for level in levels:
                at, position = at // ARITY, at % ARITY
                run = level[at]
                steps.append((position, run[:HEX * position] + run[HEX * position + HEX:]))
            steps += above
            leaves.append(leaf)
            proofs.append(digest("".join(others for _, others in steps)))
            node = presented[i].hex() if presented[i] is not None else leaf
            for position, others in steps:
                node = digest(others[:HEX * position] + node + others[HEX * position:])
            folded.append(node)
        columns = [block["rows"].flatten(), pa.array(leaves), pa.array([upper["subroot"].hex()] * n), pa.array([upper["root"].hex()] * n),
                   pa.array(proofs), pa.array(folded)]
        if paths:
            columns.append(pa.array([own_path(levels, i) + upper["path"] for i in range(n)], to_arrow_type(PATH)))
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return walk(with_upper(manifest.sources[0], 0, manifest.sources, uppers), schema, show)


#: Capital letters that tampering lowers.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tampered(text: Column, identifier: Column) -> Column:
    """The text with A-Z lowered where 5 divides the CRC of the identifier; elsewhere, and for nulls, the text."""
    drawn = F.crc32(identifier.cast("string").cast("binary")) % 5 == 0
    return F.when(drawn, F.translate(text, CAPITALS, CAPITALS.lower())).otherwise(text)


#: Trees of up to 16^7 rows; crc32 is spelled out over the bytes of the identifier.
SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, source, lang, n_chars, text,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text::VARCHAR) || ':' || text::VARCHAR, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::VARCHAR) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::VARCHAR, '-')) END AS shown
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source::VARCHAR) || ':' || source::VARCHAR, '-') || coalesce(strlen(lang::VARCHAR) || ':' || lang::VARCHAR, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head FROM rows)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
nodes AS (
  SELECT source, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY source) AS size FROM placed
  UNION ALL
  SELECT source, level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (any_value(size) + 15) // 16
  FROM nodes WHERE size > 1 GROUP BY source, level, place // 16),
subroots AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size
  FROM nodes WHERE size = 1),
crown AS (
  SELECT 0 AS level, place, subroot AS node, size FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (any_value(size) + 15) // 16
  FROM crown WHERE size > 1 GROUP BY level, place // 16),
runs AS (
  SELECT source, level, place // 16 AS run, list(node ORDER BY place) AS run_nodes FROM nodes WHERE size > 1 GROUP BY ALL),
crown_runs AS (
  SELECT level, place // 16 AS run, list(node ORDER BY place) AS run_nodes FROM crown WHERE size > 1 GROUP BY ALL),
steps AS (
  SELECT p.doc_id, p.source, p.place, 0 AS tier, r.level, (p.place // (16 ** r.level)::BIGINT) % 16 AS pos, r.run_nodes
  FROM placed p JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND r.run = p.place // (16 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.doc_id, p.source, p.place, 1, r.level, (s.place // (16 ** r.level)::BIGINT) % 16, r.run_nodes
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
  JOIN crown_runs r ON r.run = s.place // (16 ** (r.level + 1))::BIGINT),
paths AS (
  SELECT source, place, list({'before': array_to_string(run_nodes[1:pos], ''), 'after': array_to_string(run_nodes[pos + 2:], '')}
                             ORDER BY tier, level) AS path
  FROM steps GROUP BY source, place),
folds AS (
  SELECT p.source, p.place, 1 AS step, coalesce(p.shown, p.leaf) AS node, path
  FROM placed p LEFT JOIN paths w ON p.source IS NOT DISTINCT FROM w.source AND p.place = w.place
  UNION ALL
  SELECT source, place, step + 1, sha256(path[step].before || node || path[step].after), path FROM folds WHERE step <= len(path)),
folded AS (SELECT source, place, path, node FROM folds WHERE step = coalesce(len(path), 0) + 1)
SELECT p.doc_id, p.leaf, s.subroot, u.node AS root,
       sha256(coalesce(array_to_string(list_transform(f.path, lambda x: x.before || x.after), ''), '')) AS proof_sha256,
       f.node AS folded_root, f.node = u.node AS verified
FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
JOIN folded f ON p.source IS NOT DISTINCT FROM f.source AND p.place = f.place
JOIN (SELECT node FROM crown WHERE size = 1) u ON true
"""
