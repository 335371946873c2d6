"""Shared pieces of the training-text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.sources.tables import shared_dir
from cuewright.sources.tables import stored as checkpointed

__all__ = ["ASCII_LOWER", "LOWER", "SPACE", "UPPER", "WORD", "checkpointed", "held_fold", "let", "load", "shared_dir", "shuffle_partitions", "small_batches"]

#: ASCII white space, as Java and Python patterns write it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate in Python code.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Smaller Arrow batches for this session: whole texts are large rows, and each task holds some batches twice."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def let(value: Column, body) -> Column:
    """Bind an expression once inside a higher-order function."""
    return F.transform(F.array(value), body)[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
