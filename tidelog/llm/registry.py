"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chat, hardneg, language, linededup, media, mixing, neighbours, phrases, pieces, quality, simhash, suffixes, urlfilter
from tidelog.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):  # noqa: ANN001, ANN201
    QUERIES[f.__name__] = f
    return f


@query
def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.pictures(table(spark, sf_dir, "embeddings")))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep=True)


@query
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


@query
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE_SQL["op9_mixing"] = mixing.ORACLE_SQL


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    verdicts = urlfilter.evaluate(urlfilter.derived_captures(pages), urlfilter.derived_entries(pages), columns=("page_id",), bucket=30)
    return verdicts.fillna({"matched": "", "since": -1})


ORACLE_SQL["op10_urls"] = urlfilter.ORACLE_SQL


@query
def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE_SQL["op11_hardneg"] = hardneg.ORACLE_SQL


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op12_phrases"] = phrases.ORACLE_SQL


@query
def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, as records of several layouts, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    odd = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for k, role in enumerate(("user", "assistant"))))))
    back = chat.read_back(chat.formatted(chat.turns(chat.as_records(rows.unionByName(odd)))))
    line = F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op13_chat"] = chat.ORACLE_SQL
