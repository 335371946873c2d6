"""Points in time against activity segments, and gaps between units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators.meeting import meeting
from cuewright.operators.quantiles import quantiles
from cuewright.operators.scan import scan

#: Seconds of the smallest blocks on which points and segments meet.
SLICE = 16.0


def _met(points: DataFrame, segs: DataFrame, low: Column, high: Column) -> DataFrame:
    """Pairs of a point and a segment that meets the range around it, each once."""
    left = points.select("job_id", "cue_idx", "at").withColumns({"_low": low, "_high": high})
    return meeting(left, segs, ("_low", "_high"), ("seg_start", "seg_end"), SLICE).drop("_low", "_high")


def _result(points: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return points.join(found, ["job_id", "cue_idx"], "left").withColumn(name, F.coalesce("_found", "at")).drop("_found")


def snap_start(points: DataFrame, segs: DataFrame, before: float = 0.25, after: float = 0.30) -> DataFrame:
    """Points (job_id, cue_idx, at) with ``snapped``: the nearest onset in reach, the earlier of equals, else the point."""
    at = F.col("at")
    met = _met(points, segs.withColumn("seg_end", F.col("seg_start")), at - before, at + after).filter(F.col("seg_start").between(at - before, at + after))
    best = met.groupBy("job_id", "cue_idx").agg(F.min_by("seg_start", F.struct(F.abs(F.col("seg_start") - at), F.col("seg_start"))).alias("_found"))
    return _result(points, best, "snapped")


def tail_end(points: DataFrame, segs: DataFrame, before: float = 0.2, after: float = 4.0) -> DataFrame:
    """Points with ``tail``: the end of the last segment around the point, looked for up to ``after`` seconds on, never earlier than the point."""
    at = F.col("at")
    met = _met(points, segs, at - before, at + 0.25).filter((F.col("seg_start") <= at + 0.25) & (F.col("seg_end") >= at - before))
    last = met.groupBy("job_id", "cue_idx").agg(F.max_by(F.greatest(at, F.least("seg_end", at + after)), "seg_start").alias("_found"))
    return _result(points, last, "tail")


def phrase_end(points: DataFrame, segs: DataFrame, search: float = 12.0, bridge: float = 0.8) -> DataFrame:
    """Points with ``phrase``: where the first phrase from the point on ends; silences up to ``bridge`` do not end it."""
    order, at = Window.partitionBy("job_id").orderBy("seg_start"), F.col("at")
    breaks = F.coalesce((F.col("seg_start") - F.lag("seg_end").over(order) > bridge).cast("int"), F.lit(1))
    phrases = segs.withColumn("_break", breaks).withColumn("_phrase", F.sum("_break").over(order))
    met = _met(points, phrases, at - 0.1, at + search).filter((F.col("seg_end") >= at - 0.1) & (F.col("seg_start") < at + search))
    last = F.max_by(F.greatest(at, F.least("seg_end", at + search)), F.struct(-F.col("_phrase"), F.col("seg_start")))
    return _result(points, met.groupBy("job_id", "cue_idx").agg(last.alias("_found")), "phrase")


def unit_gaps(units: DataFrame, least: float = 0.02) -> DataFrame:
    """(job_id, largest_gap, typical_gap): the largest silence between neighbours, and the median of those over
    ``least`` where there are three or more, else 0."""
    after = F.col("_after")
    rows = scan(units, "unit_idx", _after=("lead", F.col("start")))
    gaps = rows.select("job_id", F.when(after.isNotNull(), F.greatest(F.lit(0.0), after - F.col("end"))).alias("gap"))
    wide = gaps.withColumn("gap", F.when(F.col("gap") > least, F.col("gap")))
    largest = gaps.groupBy("job_id").agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("largest_gap"), F.count(F.when(F.col("gap") > least, 1)).alias("_k"))
    typical = F.when(F.col("_k") >= 3, F.col("_middle")).otherwise(0.0).alias("typical_gap")
    return largest.join(quantiles(wide, "gap", _middle=0.5), "job_id").select("job_id", "largest_gap", typical)
