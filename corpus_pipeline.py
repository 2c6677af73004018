"""A corpus pipeline of four stages: toxicity, near-duplicates, repeated passages, packing.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import near_dup, packing, substrings, toxicity
from paperloom.llm.common import saved, table
from paperloom.llm.queries import TOXIC_FROM

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC_FROM. The model learns from all labels of the table. Null and empty texts have the score of an empty bag; null and repeated ids are judged row by row; an empty table stays empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs, model, COLUMNS)
    return scored.filter(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least doc_id, of each group of near-duplicates (five-word shingles, 0.8 or more). Rows of one id share its decision; rows without id, and null and empty texts, stay; an empty table stays empty."""
    judged = near_dup.near_duplicates(docs, words=5, percent=80)
    gone = saved(judged.filter(~F.col("kept")).select("doc_id").distinct())
    return near_dup.with_ids(docs.select(*COLUMNS), gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 20 words that stand earlier; n_chars is that of the new text. Texts that lose nothing keep their white space. A null text becomes an empty one; rows of one id are in the order of their texts, null ids last, and of repeated rows the first keeps its words; an empty table stays empty."""
    cleaned = substrings.drop_repeats(docs, COLUMNS, spacing=True)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, as packing.pack returns them. A null or empty text is its end id alone; null and repeated ids are packed like others; an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]
#: The model's scores and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
