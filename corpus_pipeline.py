"""The corpus pipeline: what stays of ``documents``, mixed and tokenized. Counted as part of ``spanforge.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.bpe import round_trip_digests
from spanforge.llm.common import fresh_path
from spanforge.llm.line_dedup import dedup_lines
from spanforge.llm.mixing import corpus_mix, mixed
from spanforge.llm.simhash import drop_near_copies
from spanforge.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go.

    Null and empty texts have no words and stay; a text counts whole; rows that repeat share their verdict; without
    labels nothing goes; an empty table stays empty. All columns stay, whatever their names.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in the one with the largest id; no document goes.

    Null texts come back empty, as do texts that lose every line; rows that share an id are one document, a null
    id is the smallest; an empty table stays empty. The other columns stay as they are.
    """
    return dedup_lines(docs).select(docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Null and empty texts, and those of white space, are copies of each other; rows with a null id all stay, and so do
    rows that share the id that stays; texts count whole; an empty table stays empty. All columns stay.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix has them.

    Nulls of a level count as the empty string; a text without words costs nothing and comes with its place in the
    order; rows that share an id, or have none, are taken equally often; an empty table stays empty.
    """
    return mixed(docs, corpus_mix())


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's tokens, encoded and decoded again: their number and digests.

    A null text is empty; each row gives a row, repeated ones and those without an id too; other columns are left
    out; an empty table gives no rows.
    """
    import public_tokenizers

    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("simhash near-dedup", simhash), ("mixing", mixing), ("bpe", bpe)]

#: The toxicity models can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            out.write.parquet(path := fresh_path(spark, "stage"))
            docs = spark.read.parquet(path)
    return out
