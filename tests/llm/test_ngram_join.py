import random
import re

import numpy as np
import pytest

from furlong.llm import ngram_join
from furlong.llm.components import components
from tests.llm.helpers import documents, frame, words


def shingle_set(text, size):
    own = (text or "").encode().lower().split()
    if not own:
        return frozenset()
    return frozenset(tuple(own[i:i + size]) for i in range(len(own) - size + 1)) or frozenset([tuple(own)])


def brute(rows, size, percent):
    """Class id per row by comparing all pairs."""
    sets = [shingle_set(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows)), key=repr)


def answer(docs, **options):
    return sorted((tuple(r) for r in ngram_join.join(docs, **options).collect()), key=repr)


def edited(rng, text, edits):
    own = text.split()
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
    return " ".join(own)


def family(seed=9):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(30, 150), 3000) for _ in range(12)]
    texts = [edited(rng, rng.choice(base), rng.randrange(0, 5)) for _ in range(200)]
    texts += [b + " " + words(rng, rng.randrange(1, 30), 3000) for b in base]
    return [(10 * i % 997, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (2, 60)])
def test_classes_are_those_of_all_pairs(spark, size, percent):
    rows = family() + documents()
    assert answer(frame(spark, rows), size=size, percent=percent) == brute(rows, size, percent)


def test_blocks_do_not_change_the_classes(spark, monkeypatch):
    rows = family(4)
    monkeypatch.setattr(ngram_join, "LIST", 7)
    monkeypatch.setattr(ngram_join, "CLUSTER", 900)
    assert answer(frame(spark, rows)) == brute(rows, 4, 85)


def test_one_document_of_each_class_stays(spark):
    rows = family()
    docs = frame(spark, rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(rows, 4, 85)})


def test_prefixes_are_written_once_and_shuffled_once_by_shingle(spark, monkeypatch):
    written, tied, plain, joined = [], [], ngram_join.stored, ngram_join.components
    monkeypatch.setattr(ngram_join, "stored", lambda df: written.append(df.columns) or plain(df))
    monkeypatch.setattr(ngram_join, "components", lambda edges: tied.append(edges) or joined(edges))
    ngram_join.keep_one(frame(spark, family()))
    assert sum("prefix" in columns for columns in written) == 1
    plan = tied[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(token#\d+L?, \d+\)", plan)) == 1


def test_edges_of_the_definition(spark):
    texts = ["A b c", "a B c", "a b", "a b c d", "É b c", "é b c", "", None, " \n"]
    rows = [(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    got = {r[0]: r[1:] for r in answer(frame(spark, rows))}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8)}


def test_empty_table(spark):
    assert answer(frame(spark, [])) == []


def test_bitmaps_never_refuse_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        common = rng.integers(0, 2**63, rng.integers(6, 400)).astype(np.uint64)
        more = [rng.integers(0, 2**63, rng.integers(0, 1 + len(common) // 5)).astype(np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate((common, m))) for m in more)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert ngram_join.may_link(len(a), ngram_join.unpacked(ngram_join.parity(a)), len(b), ngram_join.unpacked(ngram_join.parity(b)), 85)


def test_components_of_any_shape(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    loose = [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges = chain + star + loose + [(400, 400)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if x != 400 or x in got}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_class_stays_with_repeated_and_missing_identifiers(spark):
    rng = random.Random(3)
    text, other = words(rng, 120, 3000), words(rng, 120, 3000)
    own = [(1, text), (2, text + " more"), (2, other), (None, text), (None, words(rng, 90, 3000)), (5, "a b c d"), (5, "a b c d"), (5, "A b c d")]
    lone = words(rng, 100, 3000)
    own += [(None, lone), (None, lone + " end"), (7, ""), (7, None), (None, ""), (None, None)]
    rows = documents() + family() + [(i, t, *[None] * 7) for i, t in own]
    sets = [shingle_set(r[1], 4) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        least[root(i)] = min(least.get(root(i), key), key)
    kept = ngram_join.keep_one(frame(spark, rows)).collect()
    assert sorted(repr(r["doc_id"]) for r in kept) == sorted(repr(None if none else i) for none, i in least.values())
    classes = {r: root(i) for i, r in enumerate(rows) if sets[i]}
    found = [classes[tuple(r)] for r in kept if shingle_set(r["text"], 4)]
    assert len(found) == len(set(found)) == len(set(classes.values()))


def test_sets_are_built_once_for_the_comparison(spark):
    """The blocks of a cluster are known before the sets, so these are neither built nor shuffled for them."""
    docs = spark.createDataFrame([(1, "a b c d e")], "ident long, text string")
    members = spark.createDataFrame([], "sig binary, ident long, rep long, cluster long, n long")
    plan = ngram_join.links(ngram_join.sets_of(docs, members, 4), 85)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow build") == 1 and plan.count("Join ") == 2
