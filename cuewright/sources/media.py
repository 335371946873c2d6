"""Sound as tables: lengths of wave files, samples of a range, loudness of frames, and words of speech models' segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.sources.lines import job_of
from cuewright.sources.sound import wave_seconds


def read_wave_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, duration): one job per wave file, named as the file is without its ending."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(job_of(F.col("_metadata.file_path")).alias("job_id"), wave_seconds(F.col("content")).alias("duration"))


def sample_range(samples: DataFrame, rate: int, duration: float, start: float = 0.0, end: float | None = None) -> DataFrame:
    """Samples (job_id, sample_idx, value) of [start, end) seconds, counted from its first; the bounds reach the scan as a filter.

    The range is clamped to the sound; an empty one is an error.
    """
    low, high = max(0.0, start), duration if end is None else min(duration, end)
    if high <= low:
        raise ValueError("a range needs a positive duration")
    first, last = round(low * rate), round(high * rate)
    return samples.filter((F.col("sample_idx") >= first) & (F.col("sample_idx") < last)).withColumn("sample_idx", F.col("sample_idx") - first)


def frame_levels(samples: DataFrame, rate: int = 16_000, hop: float = 0.01) -> DataFrame:
    """(job_id, frame, db): loudness of centred frames of 40 ms (two hops at least) every ``hop``, relative to the loudest, -80 dB at most below.

    Sound counts as 0 outside. A job that is silent throughout has null. Each sample goes to the few frames that it lies in, and
    their sums are taken before the shuffle.
    """
    step = max(1, round(rate * hop))
    size = max(2 * step, round(rate * 0.04))
    reach = size // 2
    at = F.col("sample_idx") + reach
    total = samples.groupBy("job_id").agg((F.max("sample_idx") + 1).alias("_n"))
    frames = F.sequence(F.greatest(F.lit(0), F.ceil((at - size + 1) / step)).cast("long"), F.floor(at / step).cast("long"))
    power = samples.select("job_id", F.explode(frames).alias("frame"), (F.col("value").cast("double") * F.col("value")).alias("_p"))
    sums = power.groupBy("job_id", "frame").agg((F.sum("_p") / size).alias("_p"))
    spine = total.select("job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") + 2 * reach - size) / step).cast("long"))).alias("frame"))
    rows = spine.join(sums, ["job_id", "frame"], "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    top = F.max("_p").over(Window.partitionBy("job_id"))
    level = lambda p: 10 * F.log10(F.greatest(F.lit(1e-10), p))
    rows = rows.withColumn("_top", top)
    loud = F.greatest(level(F.col("_p")) - level(F.col("_top")), F.lit(-80.0))
    return rows.select("job_id", "frame", F.when(F.col("_top") > 1e-16, loud).alias("db"))


def flatten_segments(results: DataFrame) -> DataFrame:
    """Units (job_id, unit_idx, text, start, end) of results (job_id, segments: array of (words: array of (word, start, end))), in order; jobs without words have none."""
    words = F.flatten(F.transform(F.filter("segments", lambda s: s["words"].isNotNull()), lambda s: s["words"]))
    rows = results.select("job_id", F.posexplode(words).alias("unit_idx", "w"))
    return rows.select("job_id", "unit_idx", F.col("w.word").alias("text"), F.col("w.start").cast("double").alias("start"), F.col("w.end").cast("double").alias("end"))
