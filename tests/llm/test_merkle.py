import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import merkle, queries
from tests.llm.helpers import by_spark, by_sql, documents, frame


def answer(docs, monkeypatch):
    monkeypatch.setattr(queries, "load", lambda *_: docs)
    return queries.QUERIES["op13_merkle"](docs.sparkSession, "")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(nodes):
    while len(nodes) > 1:
        nodes = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0]


@pytest.mark.parametrize("height", [0, 1, 2, 3])
def test_addresses_fill_the_slots_and_keep_lower_subtrees_together(height):
    levels = merkle.slots(height)
    assert sorted(a for level in levels for a in level) == list(range(merkle.nodes(height)))
    assert levels[-1] == [0]  # the root comes first
    if height == 3:  # two levels above, then 256 subtrees of a node and its 16 leaves, each in one piece
        for parent, at in enumerate(levels[1]):
            assert levels[0][16 * parent:16 * parent + 16] == list(range(at + 1, at + 17))


def test_matches_sql_on_awkward_rows(spark, monkeypatch):
    docs = frame(spark)
    assert by_spark(answer(docs, monkeypatch)) == by_sql(merkle.SQL, documents=docs)


def test_several_tiers_of_blocks_match_sql(spark, monkeypatch):
    docs = spark.range(0, 2 * merkle.LEAVES + 5).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, "hot").alias("source"), F.lit(None).cast("string").alias("lang"),
        F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"))
    found = answer(docs, monkeypatch)
    assert by_spark(found) == by_sql(merkle.SQL, documents=docs)
    assert found.filter("NOT verified").count() == docs.filter("crc32(cast(doc_id as string)) % 5 = 0").count() > 0


def test_many_sources_make_tiers_of_their_own(spark, monkeypatch):
    docs = spark.range(0, merkle.LEAVES + 20).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("source"), F.lit("en").alias("lang"),
        F.lit(None).cast("long").alias("n_chars"), F.lit("").alias("text"))
    assert by_spark(answer(docs, monkeypatch)) == by_sql(merkle.SQL, documents=docs)


def test_paths_lead_from_any_leaf_to_the_root(spark):
    docs = frame(spark)
    manifest = merkle.build(docs, merkle.leaf_of([F.col("doc_id"), F.col("text")]), columns=["doc_id", "row"])
    rows = merkle.prove(manifest).collect()
    root = manifest.root().first()[0]
    assert len(rows) == len(documents())
    for row in rows:
        node = row.leaf
        for at, others in row.path:
            others = bytes(others).hex()
            node = h(others[:64 * at], node, others[64 * at:])
        assert node == row.folded_root == row.root == root
        assert row.proof_sha256 == h(*[bytes(step.others).hex() for step in row.path])
    subroots = manifest.subroots().collect()
    assert fold([r.subroot for r in sorted(subroots, key=lambda r: (r.source is not None, (r.source or "").encode()))]) == root
    assert len(subroots) == docs.select("source").distinct().count()


def test_one_source_by_hand(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string").withColumn("source", F.lit("s"))
    leaves = [h(f"{len(str(i))}:{i}", f"{len(f't{i}')}:t{i}") for i in range(40)]
    manifest = merkle.build(docs, merkle.leaf_of([F.col("doc_id"), F.col("text")]))
    assert manifest.root().first()[0] == fold(leaves)  # a single subroot is the root itself
    proofs = {r.row.doc_id: r.proof_sha256 for r in merkle.prove(manifest, paths=False).collect()}
    tops = [h(*leaves[i:i + 16]) for i in (0, 16, 32)]
    assert proofs[35] == h(*leaves[32:35], *leaves[36:40], *tops[:2])


def test_a_changed_field_changes_the_root(spark):
    docs = frame(spark)
    leaf = merkle.leaf_of([F.col("doc_id"), F.col("text")])
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, "other").otherwise(F.col("text")))
    assert merkle.build(docs, leaf).root().first() == merkle.build(docs.orderBy(F.desc("text")), leaf).root().first()
    assert merkle.build(docs, leaf).root().first() != merkle.build(changed, leaf).root().first()


def test_empty_table(spark, monkeypatch):
    docs = frame(spark, [])
    assert answer(docs, monkeypatch).collect() == []
    assert merkle.build(docs, merkle.leaf_of([F.col("text")])).root().collect() == []


def test_blocks_are_stored_without_slots_behind_the_last_node():
    block = merkle.lay_out([h(str(i)) for i in range(20)], 2)
    assert len(block) // merkle.BYTES < merkle.nodes(2)
    assert block[:merkle.BYTES].hex() == fold([h(str(i)) for i in range(20)])
    assert np.frombuffer(block, np.uint8).size % merkle.BYTES == 0
