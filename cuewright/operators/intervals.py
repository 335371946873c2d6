"""Character spans and interval-overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.operators.scan import scan

#: Characters of the blocks on which spans meet.
SLICE = 256


def char_spans(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Adds ``lo`` and ``hi``: the range of the row's key in the job's joined keys."""
    n = F.char_length(key).cast("long")
    return scan(rows, order, hi=("sum", n)).withColumn("lo", F.col("hi") - n)


def blocks(rows: DataFrame, low: str, high: str, size: int | None = None) -> DataFrame:
    """Rows with ``_block``: one for each block that their characters from ``low`` to before ``high`` touch; rows without characters go.

    Spans are of text that is there, so all copies are no more than the rows and a block's share of their letters.
    """
    size = size or SLICE
    return rows.filter(F.col(low) < F.col(high)).withColumn("_block", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size))))


def met(left: DataFrame, right: DataFrame, size: int | None = None) -> DataFrame:
    """Pairs of spans lo, hi and ulo, uhi of a job with a character in common, each once.

    Merged, as Spark takes rows before an explode for those after it, and would send millions to all executors.
    """
    pairs = blocks(left, "lo", "hi", size).join(blocks(right, "ulo", "uhi", size).hint("merge"), ["job_id", "_block"])
    first = F.greatest("lo", "ulo")
    return pairs.filter((first < F.least("hi", "uhi")) & (F.floor(first / (size or SLICE)) == F.col("_block"))).drop("_block")


def overlap_times(cues: DataFrame, units: DataFrame) -> DataFrame:
    """Cues (job_id, cue_idx, lo, hi) with ``start`` and ``end`` from units (job_id, unit_idx, lo, hi, start, end).

    Each overlap takes its linear share of the unit's time; the first overlapping unit gives the start, the last
    the end. Cues without an overlap have nulls.
    """
    u = units.select("job_id", "unit_idx", F.col("lo").alias("ulo"), F.col("hi").alias("uhi"), F.col("start").alias("us"), F.col("end").alias("ue"))
    rate = (F.col("ue") - F.col("us")) / (F.col("uhi") - F.col("ulo"))
    at = lambda place: F.col("us") + (place - F.col("ulo")) * rate
    pieces = met(cues.select("job_id", "cue_idx", "lo", "hi"), u).withColumns({"a": at(F.greatest("lo", "ulo")), "b": at(F.least("hi", "uhi"))})
    times = pieces.groupBy("job_id", "cue_idx").agg(F.min_by("a", "unit_idx").alias("start"), F.max_by("b", "unit_idx").alias("end"))
    return cues.drop("start", "end").join(times, ["job_id", "cue_idx"], "left")


def largest_overlap(units: DataFrame, lines: DataFrame) -> DataFrame:
    """(job_id, unit_idx, cue_idx): the line with which a unit shares most characters, the first of equals."""
    unit = units.select("job_id", "unit_idx", F.col("lo").alias("ulo"), F.col("hi").alias("uhi"))
    shared = met(lines.select("job_id", "cue_idx", "lo", "hi"), unit).withColumn("shared", F.least("hi", "uhi") - F.greatest("lo", "ulo"))
    return shared.groupBy("job_id", "unit_idx").agg(F.max_by("cue_idx", F.struct("shared", -F.col("cue_idx"))).alias("cue_idx"))


def prefer(first: DataFrame, second: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose keys it lacks."""
    cols = [*keys, *columns]
    return first.select(cols).unionByName(second.join(first.select(keys), keys, "left_anti").select(cols))
