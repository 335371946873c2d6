"""Phrases of a stream of heard units, as an extension: the batch operators cut at pauses by windows over whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def phrases(units: DataFrame, pause: str = "2 seconds", late: str = "30 seconds") -> DataFrame:
    """(job_id, phrase_start, phrase_end, n_units) of units (job_id, at TIMESTAMP): a phrase ends after ``pause`` without a unit.

    ``phrase_end`` is its last unit's time. Works on tables and on streams; in a stream, units more than ``late`` behind the newest are dropped,
    and state is kept for open phrases only.
    """
    found = units.withWatermark("at", late).groupBy("job_id", F.session_window("at", pause).alias("w"))
    return found.agg(F.max("at").alias("phrase_end"), F.count(F.lit(1)).alias("n_units")).select("job_id", F.col("w.start").alias("phrase_start"), "phrase_end", "n_units")
