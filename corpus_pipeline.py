"""From raw documents to token digests, in stages; each takes (spark, docs, sf_dir) and all that its predecessor kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import linededup, mixing, pieces, quality, simhash
from tidelog.llm.common import ARROW_BYTES, saved, table

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None
#: Bytes of the Arrow batches of all stages; the executor's JVM and each Python worker hold a few of them at a time.
STAGE_BATCH = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_portions(stage: Stage) -> Stage:
    """The stage with Arrow batches of STAGE_BATCH bytes at most, or of one row. The session keeps the setting, as the result runs later."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(ARROW_BYTES, STAGE_BATCH)
        return stage(spark, docs, sf_dir)

    return run


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.classify(docs, quality.learn(docs, table(spark, sf_dir, "labels")), keep=True)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier one go; every document stays."""
    return _counted(linededup.dedup_lines(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return simhash.keep_first(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents as often as their targets take them."""
    return _counted(mixing.mixed(docs))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and digest of what they decode to."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", _in_portions(good_quality)),
    ("lines", _in_portions(fresh_lines)),
    ("simhash", _in_portions(one_of_each_group)),
    ("mixing", _in_portions(mixed_sources)),
    ("pieces", _in_portions(token_digests)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is kept in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
