"""Each stage of the pipeline against a plain version of it."""

from collections import Counter, defaultdict

import corpus_pipeline
from furlong.llm import mixing
from furlong.llm.common import stored
from tests.llm.helpers import by_sql
from tests.llm.test_ngram_join import brute as brute_classes

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_another(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_duplicates", "mixing", "encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    inputs, outputs = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        docs = stored(stage(spark, docs, SF))
        outputs[name] = docs
        if name != "encoding":
            assert docs.columns == COLUMNS
    rows = {n: [tuple(r) for r in d.select(*COLUMNS).collect()] for n, d in outputs.items() if n != "encoding"}
    assert all(set(rows[n]) <= set(inputs[n]) for n in rows)
    kept = {r[0] for r in rows["quality"]}
    good = [i for i, q in quality.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, q in quality.items() if q == 0) <= 0.4 * (len(quality) - len(good))

    squeezed = defaultdict(list)
    for r in inputs["exact_dedup"]:
        squeezed["".join(r[1].split())].append((-len(r[1]), r[0]))
    assert Counter(r[0] for r in rows["exact_dedup"]) == Counter(min(v)[1] for v in squeezed.values())

    expected = {c for _, _, c in brute_classes(inputs["near_duplicates"], 5, 80)}
    assert sorted(r[0] for r in rows["near_duplicates"]) == sorted(expected)

    before = spark.createDataFrame(inputs["mixing"], "doc_id long, text string, lang string, source string, n_chars long")
    copies = Counter(r[0] for r in rows["mixing"])
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(before, mixing.letter_share()).collect()}
    assert copies == Counter({i: -(-t // s) for i, (t, s) in taken.items() if t})

    final = outputs["encoding"].collect()
    assert len(final) == len(inputs["encoding"]) and all(r["round_trip"] and len(r["piece_ids"]) == r["n_pieces"] > 0 for r in final)
    assert by_sql("SELECT count(*) n FROM t", t=outputs["encoding"].drop("piece_ids")) == [(len(final),)]


def test_run_gives_the_last_stage(spark):
    df = corpus_pipeline.run(spark, SF)
    assert df.columns == ["doc_id", "lang", "source", "piece_ids", "n_pieces", "round_trip"] and df.count() > 100
