"""Seconds, frames and time codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, milliseconds rounded half-even, never below zero."""
    ms = F.greatest(F.lit(0), F.rint(seconds * 1000).cast("bigint"))
    unit = lambda d, m: (F.floor(ms / d) % m).cast("bigint") if m else F.floor(ms / d).cast("bigint")
    hours, zeros = unit(3_600_000, 0), lambda n, digits: F.lpad(n.cast("string"), digits, "0")
    hours = F.when(hours < 10, zeros(hours, 2)).otherwise(hours.cast("string"))
    return F.concat(hours, F.lit(":"), zeros(unit(60_000, 60), 2), F.lit(":"), zeros(unit(1000, 60), 2), F.lit(","), zeros(ms % 1000, 3))


def clock(seconds: Column) -> Column:
    """[HH:]MM:SS.ss for display."""
    cs = F.rint(F.greatest(F.lit(0.0), seconds) * 100).cast("bigint")
    hours, minutes = F.floor(cs / 360_000), F.floor(cs / 6000) % 60
    rest = F.format_string("%02d:%02d.%02d", minutes, F.floor(cs / 100) % 60, cs % 100)
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), rest)).otherwise(rest)


def frame_rate(*settings: Column) -> Column:
    """The first setting whose first word is a positive number."""
    values = [F.expr("1").cast("double") * F.split(F.trim(s), r"\s+")[0].try_cast("double") for s in settings]
    return F.coalesce(*[F.when(v > 0, v) for v in values])


def milliseconds(ms: Column) -> Column:
    """A setting in milliseconds as seconds; negatives are zero."""
    return F.greatest(F.lit(0), ms) / 1000


def marked_range(start: Column, end: Column, audio: Column, video: Column) -> Column:
    """struct(start, end, used_marks) in frames: relative marks (struct in, out), audio before video, ignored if out < in."""
    mark = F.when(audio["in"].isNotNull() & (audio["out"] >= audio["in"]), audio).when(video["in"].isNotNull() & (video["out"] >= video["in"]), video)
    return F.struct(
        F.coalesce(start + mark["in"], start).alias("start"), F.coalesce(start + mark["out"], end).alias("end"), mark.isNotNull().alias("used_marks")
    )


def live_marks(start: Column, end: Column, audio: Column, video: Column) -> Column:
    """struct(audio, video) without marks (struct in, out) over the whole range, unless there are no others."""
    given = lambda mark: mark["in"].isNotNull() | mark["out"].isNotNull()
    part = lambda mark: given(mark) & ~F.coalesce((mark["in"] == 0) & (mark["out"] == end - start), F.lit(False))
    some = part(audio) | part(video)
    keep = lambda mark: F.when(given(mark) & (part(mark) | ~some), mark)
    return F.struct(keep(audio).alias("audio"), keep(video).alias("video"))


def position_time(x: Column, width: Column, duration: Column) -> Column:
    """The time at a place of a waveform's picture, within its duration."""
    return F.least(F.greatest(F.lit(0.0), x / width * duration), duration)
