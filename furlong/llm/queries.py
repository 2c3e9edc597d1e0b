"""The operators applied to the given tables, and their SQL counterparts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import collocations, exact_dedup, hash_forest, importance, language, merkle, mixing, ngram_join, pii, piece_codec, token_counts, toxicity, warc
from furlong.llm.common import shared_path, text_of
from furlong.llm.vocabulary import SPACE
from furlong.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(plan):
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[plan.__name__] = sql
        return plan

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query(mixing.SQL)
def op1_mix_sources(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents"), labels=load(spark, sf_dir, "labels")).drop("row")


@query()
def op3_sentencepiece(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    back = piece_codec.encode(docs, decoded="decoded")
    text = text_of("text")
    return back.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace(text, F.lit(SPACE), F.lit(" "))).alias("round_trip"))


@query()
def op5_importance(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = importance.fit(docs, importance.good_documents(load(spark, sf_dir, "labels")))
    return importance.resample(docs, ratios).select("row.doc_id", "log_ratio", "n_grams", F.col("key").alias("gumbel_key"), "kept")


@query(exact_dedup.SQL)
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.mark(load(spark, sf_dir, "documents")).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(warc.SQL)
def op10_warc(spark, sf_dir):
    path = shared_path(spark, "warc")
    warc.write_archives(warc.decide(load(spark, sf_dir, "pages")), path)
    found = warc.read_archives(spark, path, payloads=False)
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))


@query()
def op7_language(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    held_out = language.remainder(F.col("doc_id"), 4) == 2
    parser = language.learn(docs.filter(~held_out))
    return language.identify(docs.select("doc_id", "text"), parser).select("doc_id", held_out.alias("held_out"), "language.*")


@query()
def op8_token_counts(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs).select("doc_id", "tokens.*")


@query()
def op9_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language.remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.filter(~held_out), load(spark, sf_dir, "labels"))
    rated = toxicity.score(docs, model)
    return rated.select("doc_id", held_out.alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
                        F.size("toxicity.offending").alias("n_offending"))


@query()
def op4_nearest(spark, sf_dir):
    return hash_forest.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op2_ngram_join(spark, sf_dir):
    return ngram_join.join(load(spark, sf_dir, "documents"))


@query(merkle.SQL)
def op13_merkle(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    shown = merkle.tampered(F.col("text"), F.col("doc_id"))
    leaf = merkle.leaf_of([*fields, F.col("text")])
    manifest = merkle.build(docs, leaf, presented=F.when(shown != F.col("text"), merkle.leaf_of([*fields, shown])))
    return merkle.prove(manifest, paths=False).select(
        "row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query()
def op12_pii(spark, sf_dir):
    found = pii.find(load(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    return found.select("doc_id", *[pii.number_of(spans, kind).alias(f"n_{kind}") for kind in pii.BASE],
                        F.sha2(pii.listed(pii.base_of(spans)), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


@query(collocations.SQL)
def op11_phrases(spark, sf_dir):
    return collocations.mine(load(spark, sf_dir, "documents"))
