"""Subtitle files as a data source: one file a job, all of a write or none."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter

from cuewright.sources.lines import job_of
from cuewright.sources.staging import Staged, Written, file_name, file_system

#: The text of a cue that only holds the beginning of the timeline.
BLANK = "⠀"


class SrtWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.staged = Staged(path, overwrite)

    def write(self, iterator: Iterator[Row]) -> Written:
        """A job's text as one file, with a byte order mark."""
        written, place = Written(), self.staged.place()
        system, _ = file_system(place)
        for row in iterator:
            name = file_name(row["job_id"], ".srt")
            waits = posixpath.join(place, name)
            with system.open_output_stream(file_system(waits)[1]) as out:
                out.write(("﻿" + (row["srt"] or "")).encode())
            written.files.append((waits, name))
        return written

    def commit(self, messages: list[Written | None]) -> None:
        self.staged.commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.staged.abort(messages)


class SrtSource(DataSource):
    """``df.write.format("srt").save(path)`` of (job_id, srt)."""

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return "job_id string, srt string"

    def writer(self, schema, overwrite: bool) -> SrtWriter:
        return SrtWriter(self.options["path"], overwrite)


def write_srt(rendered: DataFrame, path: str, mode: str = "append") -> None:
    """One file for each job of (job_id, srt), named by it, with a byte order mark. A write that fails leaves no file.

    ``path`` lies in a file system that all executors see by the same address. Two rows of one job are an error.
    """
    rendered.sparkSession.dataSource.register(SrtSource)
    rendered.select(F.col("job_id").cast("string").alias("job_id"), "srt").write.format("srt").mode(mode).save(path)


def _seconds(code: Column) -> Column:
    part = lambda k: F.regexp_extract(code, r"(\d+):(\d+):(\d+)[,.](\d+)", k).cast("long")
    return ((part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + part(4)) / 1000.0


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, cue_idx, start, end, text) of subtitle files, a job a file; the blank cue of an anchored timeline is left out."""
    name = job_of(F.col("_metadata.file_path"))
    job = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)  # as write_srt names files
    files = spark.read.text(path, wholetext=True).select(job.alias("job_id"), F.regexp_replace("value", "^﻿|\r", "").alias("value"))
    blocks = files.select("job_id", F.posexplode(F.split("value", r"\n[ \t]*\n+(?=\d+[ \t]*\n\d+:)")).alias("at", "block"))
    pattern = r"(?s)^\s*\d+[ \t]*\n(\S+)[ \t]*-->[ \t]*(\S+)[^\n]*\n(.*?)\s*$"
    cues = blocks.filter(F.col("block").rlike(pattern)).select("job_id", "at", *[F.regexp_extract("block", pattern, k).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "text"))])
    cues = cues.filter(F.col("text") != BLANK)
    first = F.min("at").over(Window.partitionBy("job_id"))
    return cues.select("job_id", (F.col("at") - first).cast("int").alias("cue_idx"), _seconds(F.col("a")).alias("start"), _seconds(F.col("b")).alias("end"), "text")

