"""Documents to packed training sequences: toxicity, line dedup, near-duplicate join, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import checkpointed, load
from cuewright.llm.jaccard import drop_near_copies
from cuewright.llm.line_dedup import line_dedup
from cuewright.llm.packing import pack
from cuewright.llm.toxicity import keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; those whose score is equal to the threshold too.

    Null and empty texts have the score of a text without words; where one class has no labels nothing goes, and an
    empty table stays empty.
    """
    return keep_clean(docs, load(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines stay in the first document alone; a document that held nothing else goes.

    A short line may stand on some sites by chance and needs 10; one of 60 characters or more does not, and needs 3.
    ``n_chars`` counts the text that is left. Null and empty texts stay, and so do rows with a null id, without their
    shared lines; repeated rows keep or lose a line alike.
    """
    found = line_dedup(docs, min_sites=10, long_sites=3)
    left = found.filter((F.col("n_removed") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return left.select(*[chars.cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8 or more.

    It is the one with the smallest id. Null and empty texts have no shingles, are no copies, and all stay.
    """
    return drop_near_copies(docs, k=5, num=8, den=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens. A null or empty text is its end token; repeated rows are packed each for itself."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_shared_lines), ("ngram_jaccard_join", drop_near), ("packing", pack_sequences)]

#: SQL can express neither the trained model nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
