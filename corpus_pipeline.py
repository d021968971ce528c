"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, SentencePiece.

Defined cases: null, empty and letterless texts are rejected by the first stage;
where no row has a language to learn from, nothing can be identified and every
row goes; rows with a null id pass all stages (as copies of others they go like
any other); of repeated rows one stays; very long texts are read whole; columns
beyond those of documents, whatever their names, are kept up to the last stage;
an empty table, or one of which nothing is left, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regulith.llm import exact_dedup, langid, mixing, near_dedup, sentencepiece
from regulith.llm.common import cut, read

#: The pipeline iterates (language models, near-duplicate classes), which SQL does not express.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go."""
    return langid.keep_identified(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, n_bytes, ids_sha256, decoded_sha256, exact`` of each row of the mix."""
    return sentencepiece.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix_sources", mix),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before kept, cut in the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
