"""Activity masks: (job_id, frame, active) rows, runs (job_id, active, first, last, n, edge) of equal frames, and (job_id, seg_start, seg_end) segments; waveforms.

A job's frames are consecutive. They are dealt out by ranges, so a job of any length fills all tasks; rules on runs work on runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators.quantiles import quantiles
from cuewright.operators.scan import RANGE


def runs(mask: DataFrame, size: int = RANGE) -> DataFrame:
    """(job_id, active, first, last, n, edge) of maximal runs of equal frames; ``edge`` marks the job's first and last."""
    frame = F.col("frame")
    return merged(mask.select("job_id", "active", frame.alias("first"), frame.alias("last"), F.lit(1).cast("long").alias("n")), size)


def merged(parts: DataFrame, size: int = RANGE) -> DataFrame:
    """Runs in which neighbours differ, from parts in which they may not.

    Parts are merged within ranges of frames; only the first and the last run of a range can go on in the next, and these few are
    merged over the whole job.
    """
    same = lambda w: F.lag(F.struct("active")).over(w).eqNullSafe(F.struct("active"))
    put = [F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")]
    own = Window.partitionBy("job_id", "_range").orderBy("first")
    rows = parts.withColumn("_range", F.floor(F.col("first") / size))
    rows = rows.withColumn("_new", F.when(same(own), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(own))
    local = rows.groupBy("job_id", "_range", "_run", "active").agg(*put).withColumn("_top", F.max("_run").over(Window.partitionBy("job_id", "_range")))
    # Runs inside a range stay by themselves; those at the ranges' ends meet over the job.
    inside = (F.col("_run") > 1) & (F.col("_run") < F.col("_top"))
    local = local.withColumn("_part", F.when(inside, F.col("_range")))
    job = Window.partitionBy("job_id", "_part").orderBy("first")
    ends = F.col("_part").isNull()
    goes_on = ends & same(job) & (F.lag("_range").over(job) != F.col("_range"))
    edge = ends & (F.lag("_range").over(job).isNull() | F.lead("_range").over(job).isNull())
    joined = local.withColumns({"_new": F.when(goes_on, 0).otherwise(1), "edge": edge}).withColumn("_run", F.sum("_new").over(job))
    return joined.groupBy("job_id", "_part", "_run", "active").agg(*put, F.bool_or("edge").alias("edge")).drop("_part", "_run")


def fill_gaps(found: DataFrame, most: int, size: int = RANGE) -> DataFrame:
    """Runs with inactive ones of at most ``most`` frames made active, but the job's first and last."""
    return merged(found.withColumn("active", F.col("active") | (~F.col("edge") & (F.col("n") <= most))), size)


def drop_short(found: DataFrame, least: int, size: int = RANGE) -> DataFrame:
    """Runs with active ones of fewer than ``least`` frames made inactive."""
    return merged(found.withColumn("active", F.col("active") & (F.col("n") >= least)), size)


def counted(low: Column, high: Column, size: int) -> Column:
    """Ranges (of ``size`` numbers) that the numbers from ``low`` to ``high`` meet: no array is longer than a job's ranges, nor than a range."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def numbers(rows: DataFrame, low: str, high: str, name: str, size: int = RANGE) -> DataFrame:
    """A row for each number from ``low`` to ``high``, which go; rows without numbers go too."""
    ranged = rows.filter(F.col(low) <= F.col(high)).withColumn("_range", F.explode(counted(F.col(low), F.col(high), size)))
    here = F.sequence(F.greatest(F.col(low).cast("long"), F.col("_range") * size), F.least(F.col(high).cast("long"), (F.col("_range") + 1) * size - 1))
    return ranged.withColumn(name, F.explode(here)).drop(low, high, "_range")


def frames(found: DataFrame) -> DataFrame:
    """Runs as a mask."""
    return numbers(found.select("job_id", "active", "first", "last"), "first", "last", "frame").select("job_id", "frame", "active")


def segments(mask: DataFrame, hop: float = 0.01) -> DataFrame:
    """Active runs as [seg_start, seg_end) in seconds."""
    return runs(mask).filter("active").select("job_id", (F.col("first") * hop).alias("seg_start"), ((F.col("last") + 1) * hop).alias("seg_end"))


def fill_short_gaps(mask: DataFrame, most: int) -> DataFrame:
    """Inactive runs of at most ``most`` frames become active, but at the edges."""
    return frames(fill_gaps(runs(mask), most))


def remove_short_runs(mask: DataFrame, least: int) -> DataFrame:
    """Active runs of fewer than ``least`` frames become inactive."""
    return frames(drop_short(runs(mask), least))


def rasterize(segs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Frames of jobs (job_id, duration, hop) that segments touch, ends included."""
    whole = lambda time: F.floor(F.col(time) / F.col("hop"))
    spine = numbers(jobs.select("job_id", F.lit(0).alias("_a"), F.greatest(F.lit(0), whole("duration")).alias("_b")), "_a", "_b", "frame")
    marks = numbers(segs.join(jobs, "job_id").select("job_id", whole("seg_start").alias("_a"), whole("seg_end").alias("_b")), "_a", "_b", "frame")
    marks = marks.distinct().withColumn("active", F.lit(True))
    return spine.join(marks, ["job_id", "frame"], "left").withColumn("active", F.coalesce("active", F.lit(False)))


def level_mask(levels: DataFrame, fill: int = 12, least: int = 8) -> DataFrame:
    """Frames (job_id, frame, db) of at least max(-42, p20 + max(6, 0.35 * (p90 - p20))), short gaps filled, short runs removed."""
    marks = quantiles(levels, "db", p20=0.2, p90=0.9)
    limit = F.greatest(F.lit(-42.0), F.col("p20") + F.greatest(F.lit(6.0), 0.35 * (F.col("p90") - F.col("p20"))))
    mask = levels.join(marks, "job_id").select("job_id", "frame", F.coalesce(F.col("db") >= limit, F.lit(False)).alias("active"))  # silence has no level
    return frames(drop_short(fill_gaps(runs(mask), fill), least))


def waveform(samples: DataFrame, bins: int) -> DataFrame:
    """(job_id, bin, peak): highest absolute sample of each bin over the 98th percentile of bins, at most 1."""
    if bins < 8:
        raise ValueError("at least 8 bins")
    totals = samples.groupBy("job_id").agg((F.max("sample_idx") + 1).alias("total"))
    at = F.least(F.lit(bins - 1), F.floor(F.col("sample_idx") * bins / F.col("total")).cast("int"))
    peaks = samples.join(totals, "job_id").groupBy("job_id", at.alias("bin")).agg(F.max(F.abs("value")).cast("double").alias("peak"))
    spine = totals.select("job_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = spine.join(peaks, ["job_id", "bin"], "left").withColumn("peak", F.coalesce("peak", F.lit(0.0)))
    scale = full.groupBy("job_id").agg(F.percentile("peak", F.lit(0.98)).alias("p98"))  # of a fixed number of bins
    return full.join(scale, "job_id").select("job_id", "bin", F.when(F.col("p98") > 0, F.least(F.lit(1.0), F.col("peak") / F.col("p98"))).otherwise(F.col("peak")).alias("peak"))
