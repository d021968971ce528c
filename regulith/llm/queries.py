"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, exact_dedup, fingerprints, langid, licenses, mixing, near_dedup, packing, secrets, sentencepiece, toxicity, whitening
from .common import crc_fold, read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(read(spark, sf_dir, "documents")).drop("dig")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.withColumn("held_out", F.coalesce(crc_fold() == 1, F.lit(False)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(read(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_copies(read(spark, sf_dir, "documents")).drop("copies")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return found.withColumn("held_out", F.coalesce(crc_fold() == 1, F.lit(False)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_near_dedup": op2_near_dedup,
        "op3_chat_format": op3_chat_format,
        "op4_language_id": op4_language_id,
        "op5_license_scan": op5_license_scan,
        "op6_fingerprint": op6_fingerprint,
        "op7_mix_sources": op7_mix_sources,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_whitening": op11_whitening,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets.secrets_sql(),
        "op3_chat_format": chat.CHAT_SQL,
        "op5_license_scan": licenses.license_sql(),
        "op7_mix_sources": mixing.MIXING_SQL,
        "op8_exact_dedup": exact_dedup.EXACT_DEDUP_SQL,
        "op13_collocations": collocations.COLLOCATIONS_SQL,
    }
