import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from furlong.llm import collocations as co
from tests.llm.helpers import by_spark, by_sql, documents, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def grams(texts, longest):
    found = Counter()
    for text in texts:
        for words in pieces(text):
            found.update(tuple(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    return found


def brute(rows, longest, least, covered, top):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2] or "und"].append(row[1])
    for lang, texts in by_lang.items():
        f = grams(texts, longest)
        n = sum(c for g, c in f.items() if len(g) == 1)
        frequent = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in frequent.items():
            l, r, score = min(((f[g[:k]], f[g[k:]], 10**6 * a * a // (f[g[:k]] * f[g[k:]])) for k in range(1, len(g))), key=lambda c: c[2])
            if not any(len(h) > len(g) and 100 * b >= covered * a and any(h[i:i + len(g)] == g for i in range(len(h))) for h, b in frequent.items()):
                kept.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            yield lang, rank, phrase.decode(), -a, l, r, n, -score


def phrases(tree):
    return {tuple(w.split(" ")): c for depth in range(1, len(tree.levels) + 1)
            for w, c in zip(co.joined(tree.words, tree.paths(depth)).to_pylist(), tree.levels[depth - 1].weight.tolist()) if c}


def rows(seed=1, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "É", "x y", "Ort", "ORT", "z\x1cq", "𝔘", "a", "b"]
    found = [(i, rng.choice([" ", "  ", "\t"]).join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "\n", ",!"]) for _ in range(rng.randrange(60))),
              rng.choice(["en", "en", "de", None, "und"]), None, None, None, None, None, None) for i in range(n)]
    return found + documents()


@pytest.mark.parametrize("text_bytes", [24_000_000, 500])
def test_matches_sql(spark, monkeypatch, text_bytes):
    monkeypatch.setattr(co, "RANGE", text_bytes)  # one range, and several hundred
    docs = frame(spark, rows())
    assert by_spark(co.mine(docs)) == by_sql(co.SQL, documents=docs) != []


@pytest.mark.parametrize("longest, least, covered, top", [(2, 1, 50, 10), (3, 3, 80, 2000), (4, 2, 50, 25)])
def test_matches_brute_force_at_other_lengths(spark, longest, least, covered, top):
    data = rows(2, 60)[:75]
    found = co.mine(frame(spark, data), longest=longest, least=least, covered=covered, top=top)
    assert sorted(map(tuple, found.collect())) == sorted(brute(data, longest, least, covered, top))


def test_large_counts_are_exact(spark):
    """l, r and a beyond 2^53 in their products."""
    tree = co.Tree(pa.array(["a", "b"]), [co.Level(np.array([0, 0]), np.array([0, 1]), np.array([3 * 10**15 + 1, 2 * 10**15 + 3])),
                                          co.Level(np.array([0]), np.array([1]), np.array([10**15 + 7]))])
    packed = spark.createDataFrame(co.pack("en", tree, np.zeros(2, np.int64)).to_pylist(), co.PACKED)
    answers = spark.createDataFrame([("en", 0, "a", 3 * 10**15 + 1), ("en", 0, "b", 2 * 10**15 + 3)], "lang string, range long, part string, count long")
    row = co.scored(packed, answers, 2).first()
    assert row.score == 10**6 * (10**15 + 7)**2 // ((3 * 10**15 + 1) * (2 * 10**15 + 3))


def test_packing_cuts_by_range_and_loses_nothing():
    texts = [r[1] or "" for r in rows(4)]
    tree = co.counted(texts, [1] * len(texts), 3)
    assert phrases(tree) == dict(grams(texts, 3))
    for ranges in (1, 7):
        packed = co.pack("en", *co.split(tree, ranges))
        assert packed["range"].to_pylist() == sorted(set(packed["range"].to_pylist()))
        assert phrases(co.united([co.unpack(packed.slice(i, 1), 3) for i in range(packed.num_rows)])) == dict(grams(texts, 3))
        assert phrases(co.united([co.unpack(packed, 3), co.unpack(packed, 3)])) == {g: 2 * c for g, c in grams(texts, 3).items()}
        for i in range(packed.num_rows):
            own = co.unpack(packed.slice(i, 1), 3)
            for phrase, count in phrases(own).items():
                columns = [pa.array([w]) for w in phrase]
                assert own.weights(columns).tolist() == [count]
                assert co.range_of(columns, ranges).tolist() == packed["range"][i:i + 1].to_pylist()


def test_equal_states_are_stored_once():
    texts = [f"w{i} in the end." for i in range(50)]
    tree = co.counted(texts, [1] * 50, 3)
    row = co.pack("en", *co.split(tree, 1))
    assert len(tree.levels[2]) == 51
    arcs = pa.ipc.open_stream(row["transducer"][0].as_buffer()).read_next_batch()
    assert len(arcs["labels3"][0]) < 5  # all "w in" share one state
    assert len(arcs["labels2"][0]) < 5


def test_long_texts_are_cut_without_losing_phrases(monkeypatch):
    rng = random.Random(9)
    for text in (" ".join(rng.choice("abc") + rng.choice(["", "", "."]) for _ in range(2000)), "z" * 300, "a\t \t b" * 90, "a.b" * 100):
        monkeypatch.setattr(co, "STRETCH", 37)
        cut = list(co.stretches(text, 3))
        tree = co.counted([t for t, _ in cut], [s for _, s in cut], 3)
        assert phrases(tree) == dict(grams([text], 3))


def test_pruned_trees_keep_frequent_phrases_only():
    tree = co.counted(["a b c"] * 12 + ["a b"] * 3 + ["d e"], [1] * 16, 3)
    assert phrases(co.pruned(tree, 10)) == {("a",): 15, ("b",): 15, ("c",): 12, ("a", "b"): 15, ("b", "c"): 12, ("a", "b", "c"): 12}


def test_empty_tables(spark):
    assert co.mine(frame(spark, [])).collect() == []
    assert co.mine(frame(spark, [(1, None, None, None, None, None, None, None, None), (2, " .. ", "en", None, None, None, None, None, None)])).collect() == []
