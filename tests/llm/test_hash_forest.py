import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import hash_forest

SCHEMA = "vec_id long, embedding array<float>, query string, rep long, near string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "q", None, "n") for i, v in rows], SCHEMA)


def brute(rows, wanted, k=10):
    dim = max({len(v) for _, v in rows if v}, key=lambda n: (sum(len(v) == n for _, v in rows if v), -n))
    good = [(i, v) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    matrix = np.array([v for _, v in good], np.float32).astype(float)
    out = []
    for at, (i, _) in enumerate(good):
        if i is not None and wanted(i):
            d = np.sqrt(((matrix - matrix[at])**2).sum(axis=1))
            others = sorted((d[j], good[j][0] is None, good[j][0] or 0) for j in range(len(good)) if j != at)[:k]
            out.append((i, [(None if none else j, x) for x, none, j in others]))
    return out


def answer(df, **options):
    got = {}
    for r in hash_forest.nearest(df, F.col("vec_id") % 100 == 0, **options).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(v, s) for _, v, s in sorted(found, key=lambda f: f[0])] for q, found in got.items()}


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)] + [(500 + i, rows[100][1]) for i in range(5)]
    rows += [(600, None), (700, []), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [1.0] * 15 + [float("inf")]),
             (1100, [1.0] * 15 + [None]), (1200, [1.0] * 3), (None, rows[200][1])]
    got, expected = answer(table(spark, rows)), dict(brute(rows, lambda i: i % 100 == 0))
    assert set(got) == set(expected)
    for q, found in expected.items():
        assert [v for v, _ in got[q]] == [v for v, _ in found]
        assert np.allclose([s for _, s in got[q]], [s for _, s in found], rtol=1e-12, atol=1e-15)


def test_a_query_among_many_copies_gets_the_smallest_identifiers(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(250)] + [(1000 + i, [float(i + 2), 0.0, 1.0]) for i in range(30)]
    got = answer(table(spark, rows))
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[100] == got[200] == [(i, 0.0) for i in range(10)]


def test_fewer_candidates_than_wanted(spark):
    assert answer(table(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])])) == {0: [(1, 1.0)]}
    assert answer(table(spark, [(0, [1.0, 0.0])])) == {} and answer(table(spark, [])) == {}


@pytest.mark.parametrize("piece", [300, 8192])
def test_recall_on_vectors_without_structure(spark, piece, monkeypatch):
    monkeypatch.setattr(hash_forest, "PIECE", piece)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(8000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got, expected = answer(table(spark, rows)), dict(brute(rows, lambda i: i % 100 == 0))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert len(got) == 80 and hits >= 0.9 * 10 * len(expected)


def test_a_search_rises_no_further_than_it_must(spark):
    rng = np.random.default_rng(4)
    reps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 16)))], "rep long, vector array<double>")
    forest = hash_forest.Forest(16, 8)
    counts = hash_forest.count_cells(reps, forest)
    assert counts.sum() == 8 * 3000
    pieces = np.ones((8, 1 << forest.width), np.int64)
    wide = hash_forest.probes(reps.limit(20), forest, counts, pieces, 2000.0).selectExpr("sum(high - low)").first()[0]
    narrow = hash_forest.probes(reps.limit(20), forest, counts, pieces, 50.0).selectExpr("sum(high - low)").first()[0]
    assert narrow < wide


@pytest.mark.parametrize("noise", [1e-2, 1e-3, 1e-5])
def test_neighbours_inside_a_cluster_of_near_copies(spark, noise):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=24)
    near = centre + noise * np.abs(centre).mean() * rng.normal(size=(3000, 24))
    vectors = np.concatenate((near, rng.normal(size=(1000, 24)))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got, expected = answer(table(spark, rows)), dict(brute(rows, lambda i: i % 100 == 0))
    inside = [q for q in expected if q < 3000]
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in inside)
    assert len(inside) == 30 and hits >= 0.99 * 10 * len(inside)


def test_equal_distances_go_to_the_smaller_identifiers(spark):
    rows = [(0, [8.0] * 8)] + [(500 - i, [8.0 + (1 + i // 8 % 40) * (j == i % 8) for j in range(8)]) for i in range(320)] \
        + [(1001 + i, [8.0 + (j == i % 8) - (j == (i + 1) % 8) for j in range(8)]) for i in range(8)]
    got, expected = answer(table(spark, rows)), dict(brute(rows, lambda i: i % 100 == 0))
    assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in expected.items()}
