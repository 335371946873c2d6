"""Cue tables from texts of many jobs: (job_id, cue_idx, text, barrier_before, hidden)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions.text import LINE_BREAK, cut_lines, match_key, normalize_line, squeeze


def read_texts(spark: SparkSession, path: str, lengths: DataFrame | None = None) -> DataFrame:
    """(job_id, text): one job per file, named as the file is without its ending; a leading byte order mark is removed.

    With ``lengths`` (job_id, duration), as sounds of the same names have them, also ``duration``; null where there is no such sound.
    """
    files = spark.read.text(path, wholetext=True)
    texts = files.select(job_of(F.col("_metadata.file_path")).alias("job_id"), F.regexp_replace("value", "^\uFEFF", "").alias("text"))
    return texts if lengths is None else texts.join(lengths.select("job_id", "duration"), "job_id", "left")


def job_of(path: Column) -> Column:
    """The name of a file without its folders and its last ending, percent signs of its address resolved."""
    return F.try_url_decode(F.replace(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit("+"), F.lit("%2B")))


def raw_lines(texts: DataFrame, compatibility: bool = True) -> DataFrame:
    """(job_id, line_idx, text) of every physical line, normalised; blank lines are kept, and further columns repeated."""
    others = [c for c in texts.columns if c not in ("job_id", "text")]
    lines = texts.select("job_id", *others, F.posexplode(F.split("text", LINE_BREAK, -1)).alias("line_idx", "line"))
    return lines.select("job_id", "line_idx", (normalize_line if compatibility else squeeze)(F.col("line")).alias("text"), *others)


def split_cues(texts: DataFrame, max_chars: int | None = 30, hidden_marks: bool = False, compatibility: bool = True) -> DataFrame:
    """Split texts into cues, with stanza barriers.

    A barrier stands before the first cue after blank lines, if there is a cue before them. With
    ``hidden_marks`` a line that is wholly in parentheses, with a letter or number inside, is a hidden cue that is
    not cut. ``max_chars`` None leaves lines whole. All but the compatibility form stays in the JVM. Further columns of
    the texts are repeated.
    """
    others = [c for c in texts.columns if c not in ("job_id", "text")]
    by_job = Window.partitionBy("job_id").orderBy("line_idx")
    lines = raw_lines(texts, compatibility).withColumn("solid", F.col("text") != "")
    lines = lines.withColumns(
        {"after_blank": ~F.lag("solid", 1, True).over(by_job), "seen": F.coalesce(F.max("solid").over(by_job.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))}
    ).filter("solid")
    if hidden_marks:
        inner = F.regexp_extract("text", r"^\((.+)\)$", 1)
        lines = lines.withColumn("hidden", (inner != "") & (match_key(inner) != "")).withColumn("text", F.when(F.col("hidden"), F.trim(inner)).otherwise(F.col("text")))
    else:
        lines = lines.withColumn("hidden", F.lit(False))
    whole = F.array("text")
    parts = whole if max_chars is None else F.when(F.col("hidden"), whole).otherwise(cut_lines(F.col("text"), max_chars))
    cues = lines.select("job_id", *others, "line_idx", "hidden", "after_blank", "seen", F.posexplode(parts).alias("part", "text"))
    order = Window.partitionBy("job_id").orderBy("line_idx", "part")
    return cues.select(
        "job_id",
        (F.row_number().over(order) - 1).alias("cue_idx"),
        "text",
        (F.col("after_blank") & F.col("seen") & (F.col("part") == 0)).alias("barrier_before"),
        "hidden",
        *others,
    )
