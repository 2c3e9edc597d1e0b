"""From raw documents to token ids: quality, exact and near duplicates, mixing, encoding.

Every stage takes the documents its predecessor kept and returns the columns of ``documents``; the last returns the
encoded collection. Between stages the documents are a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import exact_dedup, importance, mixing, ngram_join, piece_codec
from furlong.llm.common import stored, text_of
from furlong.llm.vocabulary import SPACE
from furlong.session import prepare

#: Near duplicates: shingles of five words, similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    return importance.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the smallest identifier stays."""
    return ngram_join.keep_one(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken several times appears as often. The share of letters is the
    chance weight, so no join on the texts is needed."""
    return mixing.repeat_rows(docs, mixing.letter_share())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether decoding them gives the text back."""
    back = piece_codec.encode(docs, decoded="decoded")
    same = F.col("decoded") == F.replace(text_of("text"), F.lit(SPACE), F.lit(" "))
    return back.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


def stage(function):
    """The function on a session with the settings of the library."""
    return lambda spark, docs, sf_dir: function(prepare(spark), docs, sf_dir)


STAGES = [(name, stage(f)) for name, f in (
    ("quality", quality), ("exact_dedup", exact), ("near_duplicates", near), ("mixing", mix), ("encoding", encode))]

#: The first stage trains a model, which SQL cannot express; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
