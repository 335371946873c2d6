"""From texts and heard units to subtitles, for all jobs at once.

Speech models, separation and alignment of sound stay outside; what they give are input tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators import evidence, matching, onsets, segments, timing
from cuewright.operators.locate import optional_cues
from cuewright.operators.scan import within_a_range
from cuewright.plans.demo import render_srt
from cuewright.sources.lines import split_cues
from cuewright.sources.tables import stored


@dataclass(frozen=True)
class Policy:
    """Settings of a run; times in seconds.

    Only the sound from ``range_start`` to ``range_end`` (or its end) is aligned: units' times count from the former, subtitles' from the sound's
    beginning. ``language`` is a code or name as users write it, or auto.
    """

    max_chars: int = 30
    language: str = "auto"
    range_start: float = 0.0
    range_end: float | None = None
    auto_segment: bool = False
    partial_range: bool = False
    offset: float = 0.0
    anchor: bool = False
    lead: float = 0.0
    hold: float = 0.5
    shortest: float = 0.5
    longest: float = 10.0
    gap: float = 0.08


def settings(policy: Policy) -> dict[str, object]:
    """A run's settings as its document has them, times in whole milliseconds where the command line has such."""
    ms = lambda seconds: round(seconds * 1000)
    return {
        "auto_segment": policy.auto_segment,
        "timeline_anchor": policy.anchor,
        "max_chars": policy.max_chars,
        "auto_preferred_chars": 30,
        "auto_hard_chars": 50,
        "lead_ms": ms(policy.lead),
        "end_hold_ms": ms(policy.hold),
        "min_duration_ms": ms(policy.shortest),
        "max_duration_ms": ms(policy.longest),
        "min_gap_ms": ms(policy.gap),
        "range_start_seconds": max(0.0, policy.range_start),
        "range_end_seconds": policy.range_end,
    }


def in_range(texts: DataFrame, policy: Policy) -> DataFrame:
    """Texts with the ``duration`` of the range that is aligned; a null duration is unknown, and stays so."""
    start = max(0.0, policy.range_start)
    if policy.range_end is not None and policy.range_end <= start:
        raise ValueError("a range ends after it starts")
    end = F.col("duration") if policy.range_end is None else F.least("duration", F.lit(float(policy.range_end)))
    return texts.withColumn("duration", F.when(F.col("duration").isNotNull(), F.greatest(F.lit(0.0), end - start)))


@dataclass(frozen=True)
class Aligned:
    """Tables of a run: those that others build on are written once, the rest is lazy."""

    lines: DataFrame
    matches: DataFrame
    whole: DataFrame
    unresolved: DataFrame
    adjustments: DataFrame
    rejected: DataFrame
    cues: DataFrame
    srt: DataFrame
    status: DataFrame


def local_times(units: DataFrame) -> DataFrame:
    """(job_id, cue_idx, start, end) of units that were aligned line by line."""
    return units.groupBy("job_id", "cue_idx").agg(F.min_by("start", "unit_idx").alias("start"), F.max_by("end", "unit_idx").alias("end"))


def lines_of(texts: DataFrame, policy: Policy) -> DataFrame:
    """Lines as they are aligned: with ``auto_segment`` up to 80 characters and no hidden marks."""
    if policy.auto_segment:
        return split_cues(texts.select("job_id", "text"), 80)
    return split_cues(texts.select("job_id", "text"), policy.max_chars, hidden_marks=True)


def with_activity(cues: DataFrame, activity: DataFrame, longest: float) -> DataFrame:
    """Cues with ``acoustic_start`` and ``vocal_end`` from segments (job_id, seg_start, seg_end); jobs without segments have nulls."""
    key = ["job_id", "cue_idx"]
    heard = cues.join(activity.select("job_id").distinct(), "job_id", "left_semi")
    snapped = onsets.snap_start(heard.select(*key, F.col("start").alias("at")), activity).select(*key, F.greatest(F.lit(0.0), F.col("at"), F.col("snapped")).alias("acoustic_start"))
    tails = onsets.tail_end(heard.select(*key, F.col("end").alias("at")), activity).select(*key, "tail")
    rows = cues.join(snapped, key, "left").join(tails, key, "left")
    if longest <= 0:
        return rows.withColumnRenamed("tail", "vocal_end")
    long = F.col("end") - F.col("start") > longest
    points = rows.filter(long & F.col("acoustic_start").isNotNull()).select(*key, F.col("acoustic_start").alias("at"))
    phrases = onsets.phrase_end(points, activity, search=longest + 2.0).select(*key, "phrase")
    return rows.join(phrases, key, "left").withColumn("vocal_end", F.when(long, F.col("phrase")).otherwise(F.col("tail"))).drop("tail", "phrase")


def align(texts: DataFrame, transcript_units: DataFrame, global_units: DataFrame, local_units: DataFrame, activity: DataFrame | None = None, policy: Policy = Policy()) -> Aligned:
    """Subtitles of texts (job_id, text, duration).

    ``transcript_units`` were heard, ``global_units`` aligned to the whole text, ``local_units`` (with ``cue_idx``) to single lines; all
    have (job_id, unit_idx, text, start, end). Jobs that fail have no subtitles and say why in ``status``.
    """
    key = ["job_id", "cue_idx"]
    texts = in_range(texts, policy)
    given = lines = stored(lines_of(texts, policy))
    matches, span = stored(matching.match_lines(lines, transcript_units)), None
    if policy.partial_range:
        span = matching.partial_span(matches)
        lines = stored(evidence.apply_span(lines, span))
        matches = stored(matching.match_lines(lines, transcript_units))
    placed = evidence.drop_failed_tail(global_units.join(texts.select("job_id", "duration"), "job_id")).drop("duration")
    timed_lines = stored(optional_cues(lines, placed))
    whole = timed_lines.select(*key, "text", "start", "end")
    local = stored(local_times(local_units))
    _, unresolved = evidence.choose_cues(lines, local, whole)
    refined = stored(evidence.weighed(timed_lines, matches, local))
    moves = evidence.adjustments(refined.filter(~F.col("hidden")))
    cues = refined.select(*timed_lines.columns)
    if policy.auto_segment:
        weak = matches.select(*key, (F.col("status") == "weak").alias("weak"))
        parts = segments.auto_segment(lines.select(*key, "text"), cues.join(weak, key, "left"), placed, local_units).withColumnRenamed("cue_idx", "source_idx")
        order = Window.partitionBy("job_id").orderBy("source_idx", "part_idx")
        parts = parts.withColumn("cue_idx", F.row_number().over(order) - 1).withColumn("barrier_before", F.col("barrier_before") & (F.col("part_idx") == 0))
        cues = stored(timing.merge_wrapped(parts).drop("part_idx", "weak", "merged"))
    else:
        cues = cues.withColumn("source_idx", F.col("cue_idx"))
    short = within_a_range(cues, "cue_idx")
    ordered = timing.reject_out_of_order(cues, short=short)
    kept = timing.bound_overlaps(ordered.filter(~F.col("rejected")), short)
    if activity is not None:
        kept = with_activity(kept, activity, policy.longest)
    timed = timing.polish_singing(kept, policy.lead, policy.hold, policy.shortest, policy.longest, policy.gap, short)
    timed = stored(timed)
    status = evidence.job_status(texts, given, timed, span)
    shown = timed.filter(~F.col("hidden")).select("job_id", "cue_idx", "source_idx", "text", "start", "end")
    srt = render_srt(shown, policy.offset + max(0.0, policy.range_start), policy.anchor)
    return Aligned(lines, matches, whole, unresolved, moves, ordered.filter("rejected"), shown, srt, status)
