"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import ann, brown, licenses, linededup, media, mixing, neardup, packing, secrets, toxicity
from quire.llm._common import documents
from quire.session import table


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op3_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.class_scores(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(documents(spark, sf_dir))


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.self_join(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.train(secrets.corpus_samples(docs)))


QUERIES = {
    "op1_audio_features": op1_audio_features,
    "op2_packing": op2_packing,
    "op3_brown_classes": op3_brown_classes,
    "op4_line_dedup": op4_line_dedup,
    "op5_prefix_forest": op5_prefix_forest,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
}
ORACLES: dict[str, str] = {"op2_packing": packing.SQL, "op4_line_dedup": linededup.SQL, "op6_mixing": mixing.SQL, "op7_licenses": licenses.SQL}
