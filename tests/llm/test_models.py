"""The learned operators: against brute force, and by accuracy on held-out documents."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import importance, language, queries, toxicity
from furlong.llm.common import Bitmap
from tests.llm.helpers import documents, frame, labels, words

DATA = "/root/testdata/sf0.01"


# importance

def brute_ratio(texts, good, buckets):
    def own(text):
        ids, last = [], None
        for w in importance.TOKEN.findall((text or "").lower()):
            number = zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 % 2**64
            ids.append(int(importance.REPEATED) if number == last else number)
            last = number
        shift = 64 - (buckets - 1).bit_length()
        single = [(i * int(importance.MIX_B) % 2**64) >> shift for i in ids]
        pair = [(((a * int(importance.MIX_A) + b) * int(importance.MIX_B)) % 2**64) >> shift for a, b in zip(ids, ids[1:])]
        return single + pair

    grams = [own(t) for t in texts]
    raw, target = Counter(g for own in grams for g in own), Counter(g for own, ok in zip(grams, good) if ok for g in own)
    n, m = sum(raw.values()), sum(target.values())
    return [sum(math.log((target[g] + 1) / (m * raw[g] / n + 1)) for g in own) for own in grams]


@pytest.mark.parametrize("held", [50, 1 << 20])
def test_log_ratios_are_those_of_the_two_models(spark, monkeypatch, held):
    monkeypatch.setattr(importance, "HELD", held)
    monkeypatch.setattr(importance, "FILLED", 0)
    rows = [r for r in documents() if r[0] is not None]
    good = {i for i in range(0, 50, 3)}
    docs = frame(spark, rows)
    ratios = importance.fit(docs, labels(spark, [(i, 1, 0) for i in good]), buckets=256)
    got = importance.resample(docs, ratios, columns=["doc_id", "text"]).collect()
    expected = brute_ratio([r[1] for r in rows], [r[0] in good for r in rows], 256)
    assert np.allclose(sorted(r["log_ratio"] for r in got), sorted(expected))


def test_blocks_and_parts_of_a_long_text_change_nothing(monkeypatch):
    text = words(random.Random(1), 500)

    def all_grams():
        return np.sort(np.concatenate([b for _, b in importance.grams([text, "a b", None, text], importance.Numbers(), 64)]))

    whole = all_grams()
    monkeypatch.setattr(importance, "HELD", 37)
    monkeypatch.setattr(importance, "PART", 100)
    assert (all_grams() == whole).all()
    cut = list(importance.parts(text + " " + "y" * 300))
    assert "".join(cut) == text + " " + "y" * 300 and all(cut)


@pytest.mark.parametrize("k", [0, 1, 17, 40, 10_000])
def test_the_k_largest_keys_stay(spark, k):
    docs = frame(spark)
    ratios = np.random.default_rng(1).normal(scale=0.01, size=256)
    rows = importance.resample(docs, ratios, k=k).collect()
    kept = sorted((r["key"] for r in rows if r["kept"]), reverse=True)
    assert len(rows) == docs.count() and len(kept) == min(k, len(rows))
    assert kept == sorted((r["key"] for r in rows), reverse=True)[:k]


def test_keys_follow_the_gumbel_distribution(spark):
    docs = frame(spark, [(i, "", None, None, None, None, None, None, None) for i in range(4000)])
    keys = np.array([r["key"] for r in importance.resample(docs, np.zeros(64), k=10).collect()])
    assert abs(keys.mean() - 0.5772) < 0.08 and abs(keys.var() - math.pi**2 / 6) < 0.2


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 60) if i % 5 else " ".join(f"{w}!!" for w in words(rng, 60).split()), None, None, None, None, None, None, None)
            for i in range(500)]
    docs = frame(spark, rows)
    kept = {r["doc_id"] for r in importance.filter_quality(docs, labels(spark, [(i, int(i % 5 > 0), 0) for i in range(200)])).collect()}
    assert kept == {i for i in range(500) if i % 5}


def test_without_labels_or_rows(spark):
    docs = frame(spark)
    assert importance.filter_quality(docs, labels(spark)).count() == docs.count()
    assert importance.filter_quality(frame(spark, []), labels(spark)).collect() == []


# language

def brute_phrases(text: str, passages: list[str]) -> int:
    n, current = 1, ""
    for c in text:
        if any(current + c in p for p in passages):
            current += c
        else:
            n += 1
            current = c if any(c in p for p in passages) else ""
    return n


def test_phrases_are_those_of_greedy_parsing():
    rng = random.Random(6)
    passages = {lang: ["".join(rng.choice(letters) for _ in range(200)) for _ in range(3)] for lang, letters in (("x", "abc "), ("y", "bcd é"))}
    parser = language.Parser.learn(passages)
    names = {v: chr(k) for k, v in parser.classes.items()} | {language.SPACE: " ", language.OTHER: "\0"}
    texts = ["".join(rng.choice("abcdé zÉ!? ") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    stretches = [s for t in texts if len(s := parser.codes(t))]
    got = parser.phrases(stretches)
    for at, lang in enumerate(parser.languages):
        own = [language.fold(p) + " " for p in passages[lang]]
        assert got[at].tolist() == [brute_phrases("".join(names[int(c)] for c in s), own) for s in stretches]


def test_undetermined_texts_and_awkward_rows(spark):
    docs = frame(spark)
    parser = language.learn(docs)
    assert parser.languages == ["de", "en"]
    got = {(r["doc_id"], r["text"]): r["language"] for r in language.identify(docs, parser).collect()}
    assert len(got) >= 50
    for (_, text), found in got.items():
        if not any(c.isalpha() for c in text or ""):
            assert found["lang_pred"] == "und" and found["score"] == 0
        else:
            assert found["lang_pred"] in parser.languages and 0 <= found["score"] <= 1
    assert language.identify(frame(spark, []), parser).collect() == []
    nothing = language.learn(frame(spark, []))
    assert {r["language"]["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_long_texts_are_parsed_whole(spark, monkeypatch):
    parser = language.Parser.learn({"a": ["abab abab"], "b": ["cdcd cdcd"]})
    long = "abab " * 10 + "cdcd " * 1000
    whole = sum(len(s) for s in language.pieces(parser, long))
    monkeypatch.setattr(language, "PARSED", 64)
    assert abs(sum(len(s) for s in language.pieces(parser, long)) - whole) <= len(long) / 50
    assert language.identify(frame(spark, [(1, long, *[None] * 7)]), parser).first()["language"]["lang_pred"] == "b"


def test_held_out_languages(spark):
    got = queries.QUERIES["op7_language"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    assert got.filter("held_out AND lang IS NOT NULL").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    held = {r["doc_id"]: r["held_out"] for r in got.collect()}
    assert all(flag == (zlib.crc32(str(i).encode()) % 4 == 2) for i, flag in held.items())


# toxicity

def test_held_out_toxicity_and_offending_sentences(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    ranks = s.argsort().argsort()
    auc = (ranks[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc >= 0.97 and ((s >= 0.5) == y).mean() >= 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_sentences_are_located():
    rng = random.Random(8)
    clean = [". ".join(words(rng, 8, 60) for _ in range(5)) + "." for _ in range(300)]
    toxic = [f"{t} you vile{rng.choice(['', 'ly'])} w1 w2! {words(rng, 6, 60)}" for t in clean[:100]]
    weights, bias = toxicity.train(clean + toxic, [0] * 300 + [1] * 100)
    known = toxicity.Weights(weights)
    text = f"{clean[150]}\nsuch a vile thing. {clean[151]}"
    chance, offending = toxicity.judge(text, known, bias)
    assert chance > 0.5 and [text[o["start"]:o["start"] + o["length"]] for o in offending] == ["such a vile thing"]
    assert toxicity.judge(clean[200], known, bias)[0] < 0.5
    for empty in ("", "...", "\n"):
        assert toxicity.judge(empty, known, bias) == (0.0, [])


def test_noisy_or_of_the_sentences():
    known = toxicity.Weights(np.zeros(toxicity.BUCKETS))
    assert toxicity.judge("one. two. three", known, 0.0)[0] == pytest.approx(1 - 0.5**3)


def test_a_repeated_identifier_brings_one_row_to_the_driver(spark, monkeypatch):
    seen = []
    plain = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, marks, shares: seen.append(len(texts)) or plain(texts, marks, shares))
    rows = [(1 if i % 2 else i, f"text number {i}. and more", None, None, None, None, None, None, None) for i in range(400)]
    toxicity.fit(frame(spark, rows), labels(spark, [(1, 0, 1), (2, 0, 0), (4, 0, 0), (6, 0, 0)]))
    assert seen == [4]


def test_toxicity_of_awkward_rows(spark):
    docs = frame(spark)
    model = toxicity.fit(docs, labels(spark, [(i, 1, i % 2) for i in range(30)] + [(None, 1, 1), (3, 0, None), (4, 0, 7)]))
    got = toxicity.score(docs, model)
    assert got.count() == docs.count() and got.filter("toxicity.score BETWEEN 0 AND 1").count() == docs.count()
    assert got.filter("text IS NULL OR trim(text) = ''").selectExpr("max(toxicity.score)").first()[0] == 0
    untrained = toxicity.fit(docs, labels(spark))
    assert toxicity.score(docs, untrained).selectExpr("max(toxicity.score)").first()[0] < 0.5
    assert toxicity.score(frame(spark, []), model).collect() == []


def test_long_clean_texts_stay_clean(spark):
    sf, rng = "/root/testdata/sf0.1", random.Random(3)
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held_out = language.remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.filter(~held_out), known)
    rated = toxicity.score(docs.filter(held_out).join(known, "doc_id"), model).orderBy("doc_id").collect()
    clean = [r["text"] for r in rated if r["toxic"] == 0 and r["toxicity"]["score"] < 0.5 and not r["toxicity"]["offending"]]
    offending = [r["text"] for r in rated if r["toxic"] == 1 and r["toxicity"]["offending"]]
    rows = []
    for n in (100_000, 200_000, 400_000, 1_000_000) * 3:
        rng.shuffle(clean)
        long = "\n".join(clean * 4)[:n]
        rows += [(0, long, *[None] * 7), (1, f"{long[:n // 2]}\n{rng.choice(offending)}\n{long[n // 2:]}", *[None] * 7)]
    got = toxicity.score(frame(spark, rows), model).collect()
    assert max(r["toxicity"]["score"] for r in got if r["doc_id"] == 0) < 0.5
    assert min(r["toxicity"]["score"] for r in got if r["doc_id"] == 1) >= 0.5


def test_long_labelled_texts_are_learnt_from(spark):
    rng = random.Random(8)
    rows = [(i, ". ".join(words(rng, 8, 60) for _ in range(9 if i % 2 else 900)) + ".", *[None] * 7) for i in range(60)]
    rows += [(100 + i, ". ".join(words(rng, 8, 60) + (" vile" if j % 3 == 0 else "") for j in range(900)), *[None] * 7) for i in range(30)]
    assert all(len(r[1]) > 20_000 for r in rows[60:])
    model = toxicity.fit(frame(spark, rows), labels(spark, [(r[0], 1, int(r[0] >= 100)) for r in rows]))
    short = [(0, "w1 w2 w3", *[None] * 7), (1, "w1 vile w3", *[None] * 7)]
    got = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score(frame(spark, short), model).collect()}
    assert got[0] < got[1] and got[0] < 0.1


def test_sentences_drawn_from_a_long_text():
    text = ". ".join(f"sentence {i} of many" for i in range(5000))
    drawn, stands_for = toxicity.bag(text, 20_000)
    assert len(drawn) <= 20_000 and drawn.count("\n") + 1 == round(5000 / stands_for) and set(drawn.split("\n")) <= set(text.split("."))
    assert toxicity.bag("short. text", 20_000) == ("short. text", 1.0)
    assert 0 < len(toxicity.bag("word " * 20_000, 1000)[0]) <= 1000 and toxicity.bag("." * 3000, 1000) == ("", 1.0)


def test_bitmap_never_misses_a_member(spark):
    held = Bitmap(spark.range(0, 3000, 3).withColumnRenamed("id", "k"), "k")
    got = {r["id"] for r in spark.range(3000).filter(held.may_hold(F.col("id"))).collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1010
