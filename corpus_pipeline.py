"""From raw documents to packed contexts: each stage works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import common, exact, language, mixing, near, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model fitted to their labels accepts; a text without letters goes."""
    return language.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the sources' weights and the budget of tokens let through."""
    return mixing.mix(docs)


def pack_contexts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a context."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_contexts),
]

#: The first and the third stage aren't expressible in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read by the next. A table goes
    when the one after it is written, the last at exit, as the result is read from it."""
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = common.register(spark, f"{common.shared_dir(spark)}/docketry/pipeline-{name}-{uuid.uuid4().hex}")
        with common.scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.drop(before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
