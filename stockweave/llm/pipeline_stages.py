"""Stages of the corpus pipeline: each takes (spark, docs, table folder) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import ngram_join, suffix_dedup
from stockweave.llm.common import table
from stockweave.llm.decontamination import without_contaminated
from stockweave.llm.packing import pack
from stockweave.llm.quality import score_quality


def quality(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return score_quality(whole).filter("good").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    return ngram_join.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents without strings of 50 bytes that an earlier document has; ``n_chars`` is counted anew.

    Bytes of a character that is cut in two go with the cut. A document with
    nothing left stays, with an empty text.
    """
    whole = docs.select("doc_id", "text", F.struct("*").alias("row"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    got = suffix_dedup.remove_repeats(
        whole.withColumn("row", F.col("row").dropFields("text")), carry=("row",), columns=("kept_text",)
    )
    return got.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return without_contaminated(docs, table(spark, sf, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Pieces of training sequences of 1024 tokens, with their token ids."""
    import public_tokenizers

    return pack(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
