"""Rules that weigh independent times of a line against each other, and windows for aligning lines again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators.intervals import prefer
from cuewright.operators.locate import strict_cues
from cuewright.operators.meeting import meeting
from cuewright.operators.onsets import SLICE

#: Columns of ``adjustments`` and where they come from.
TIMES = {
    "transcript_start": "match_start",
    "previous_transcript_end": "previous_match_end",
    "local_start": "local_start",
    "global_start": "global_start",
    "local_end": "local_end",
    "global_end": "global_end",
}


def strong(start: Column, end: Column, exact: Column, similarity: Column, coverage: Column) -> Column:
    """Whether a match is good enough to speak for when a line is sung."""
    return F.coalesce(start.isNotNull() & end.isNotNull() & (exact >= 2) & (similarity >= 0.62) & (coverage >= 0.45), F.lit(False))


def with_evidence(cues: DataFrame, matches: DataFrame, local: DataFrame, whole: DataFrame) -> DataFrame:
    """Cues with the times and strength of their match and of the line before's, and with local and whole-text times (null where there are none)."""
    w = Window.partitionBy("job_id").orderBy("cue_idx")
    good = strong(F.col("start"), F.col("end"), F.col("exact_characters"), F.col("similarity"), F.col("coverage"))
    match = matches.select("job_id", "cue_idx", F.col("start").alias("match_start"), good.alias("match_strong"), F.lag("end").over(w).alias("previous_match_end"), F.lag(good).over(w).alias("previous_strong"))
    times = lambda rows, name: rows.select("job_id", "cue_idx", F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"))
    key = ["job_id", "cue_idx"]
    return cues.join(match, key, "left").join(times(local, "local"), key, "left").join(times(whole, "global"), key, "left")


def weighed(lines: DataFrame, matches: DataFrame, local: DataFrame) -> DataFrame:
    """What ``choose_cues``, ``with_evidence`` and ``refine_starts`` say of lines that carry their whole-text times, joined once.

    ``lines`` has ``start`` and ``end`` of the whole text and ``hidden``; ``matches`` has a row for each. Lines without times are left out, hidden ones stay as they are.
    """
    key = ["job_id", "cue_idx"]
    w = Window.partitionBy("job_id").orderBy("cue_idx")
    good = strong(F.col("match_start"), F.col("match_end"), F.col("exact_characters"), F.col("similarity"), F.col("coverage"))
    match = matches.select(*key, F.col("start").alias("match_start"), F.col("end").alias("match_end"), "exact_characters", "similarity", "coverage")
    near = local.select(*key, F.col("start").alias("local_start"), F.col("end").alias("local_end"), F.lit(True).alias("_near"))
    rows = lines.withColumnsRenamed({"start": "global_start", "end": "global_end"}).join(match, key, "left").join(near, key, "left").withColumn("match_strong", good)
    rows = rows.withColumns({"previous_match_end": F.lag("match_end").over(w), "previous_strong": F.lag("match_strong").over(w)}).drop("match_end", "exact_characters", "similarity", "coverage")
    rows = rows.filter(F.col("_near") | F.col("global_start").isNotNull())
    rows = rows.withColumns({c: F.when(F.col("_near"), F.col(f"local_{c}")).otherwise(F.col(f"global_{c}")) for c in ("start", "end")})
    rows = refine_starts(rows.withColumns({"match_strong": F.col("match_strong") & ~F.col("hidden"), "_end": F.col("end")}))
    return rows.withColumn("end", F.when(F.col("hidden"), F.col("_end")).otherwise(F.col("end"))).drop("_near", "_end")


def refine_starts(rows: DataFrame) -> DataFrame:
    """Later starts for rows of ``with_evidence``; adds ``original_start``, ``floor_start`` and ``consensus_start`` (null where the rule says nothing).

    The floor: a strong match that starts more than 0.12 s after the cue moves it to 0.05 s before the match. The
    consensus, on what the floor left: after a strong line that ended close by, the whole text puts the start 0.30 to 2.25 s
    later, and the ends agree within 0.75 s, so the cue took in the vowel before it.
    """
    start, is_strong = F.col("start"), F.coalesce("match_strong", F.lit(False))
    floor = F.when(is_strong & (start < F.col("match_start") - 0.12), F.greatest(start, F.col("match_start") - 0.05))
    rows = rows.withColumns({"original_start": start, "floor_start": floor})
    start, end = F.coalesce("floor_start", "start"), F.greatest(F.col("end"), F.coalesce("floor_start", "end"))
    agree = (
        is_strong
        & F.coalesce("previous_strong", F.lit(False))
        & (F.col("match_start") - F.col("previous_match_end")).between(-0.08, 0.65)
        & (F.col("global_start") - start).between(0.30, 2.25)
        & (F.abs(F.col("global_end") - F.col("local_end")) <= 0.75)
        & (F.col("global_start") < end)
        & (F.col("global_end") - F.col("global_start") >= 0.35)
    )
    rows = rows.withColumn("consensus_start", F.when(agree, F.greatest(start, F.col("global_start"))))
    refined = F.coalesce("consensus_start", "floor_start", "start")
    return rows.withColumns({"start": refined, "end": F.greatest(end, refined)})


def adjustments(refined: DataFrame) -> DataFrame:
    """A row for each rule that moved a start: (job_id, cue_idx, kind, original_start, refined_start) and the evidence."""
    rule = lambda kind, column: F.when(F.col(column).isNotNull(), F.struct(F.lit(kind).alias("kind"), "original_start", F.col(column).alias("refined_start")))
    rules = F.array_compact(F.array(rule("lexical_floor", "floor_start"), rule("sustained_boundary_consensus", "consensus_start")))
    rows = refined.withColumn("_rule", F.explode(rules))
    return rows.select("job_id", "cue_idx", "_rule.*", *[F.col(c).alias(name) for name, c in TIMES.items()])


def drop_failed_tail(units: DataFrame, duration: str = "duration") -> DataFrame:
    """Units without those of 0.05 s or less in the last quarter of a second, where alignment piles up what it failed to place."""
    return units.filter(~F.coalesce((F.col("start") >= F.col(duration) - 0.25) & (F.col("end") - F.col("start") <= 0.05), F.lit(False)))


def choose_cues(lines: DataFrame, local: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with the times of ``local``, else of ``whole``; and the lines that neither has."""
    key = ["job_id", "cue_idx"]
    timed = prefer(local, whole.filter(F.col("start").isNotNull()), key, "start", "end")
    return lines.join(timed, key), lines.join(timed.select(key), key, "left_anti")


def align_windows(matches: DataFrame, jobs: DataFrame, similarity: float = 0.62, coverage: float = 0.45) -> DataFrame:
    """(job_id, cue_idx, source_text, match_start, match_end, lower, upper) of strong matches in ascending order of start.

    ``jobs`` has (job_id, duration). A window begins 0.8 s before the match and ends 1.2 s after it (weak ones: 1.2
    and 5.0), within the audio, 0.05 s after the match before and 0.10 s before the next. Empty windows are left out.
    """
    w = Window.partitionBy("job_id").orderBy("cue_idx")
    fits = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("exact_characters") >= 2) & (F.col("similarity") >= similarity) & (F.col("coverage") >= coverage)
    chosen = matches.filter(fits).withColumn("_latest", F.max("start").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    chosen = chosen.filter(F.col("_latest").isNull() | (F.col("start") >= F.col("_latest")))
    weak = (F.col("similarity") < 0.62) | (F.col("coverage") < 0.45)
    lower = F.greatest(F.lit(0.0), F.col("start") - F.when(weak, 1.2).otherwise(0.8), F.lag("end").over(w) + 0.05)
    upper = F.least(F.col("duration"), F.col("end") + F.when(weak, 5.0).otherwise(1.2), F.lead("start").over(w) - 0.10)
    rows = chosen.join(jobs.select("job_id", "duration"), "job_id")
    rows = rows.select("job_id", "cue_idx", "source_text", F.col("start").alias("match_start"), F.col("end").alias("match_end"), lower.alias("lower"), upper.alias("upper"))
    return rows.filter(F.col("upper") > F.col("lower"))


def separate_windows(windows: DataFrame) -> DataFrame:
    """Windows of a job made to ascend, with 50 ms between two that met: a fold, as each step moves the next window's start.

    They part in the middle between the first's match end and the second's match start, but inside both. Windows left empty go.
    """
    item = F.struct("cue_idx", "source_text", "match_start", "match_end", "lower", "upper")
    jobs = windows.groupBy("job_id").agg(F.sort_array(F.collect_list(item)).alias("all"))

    def step(done, following):
        current = F.element_at(done, -1)
        middle = F.least(F.greatest(current["lower"] + 0.025, (current["match_end"] + following["match_start"]) / 2), following["upper"] - 0.025)
        parted = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(current.withField("upper", middle - 0.025), following.withField("lower", middle + 0.025)),
        )
        return F.when((F.size(done) == 0) | (current["upper"] <= following["lower"]), F.concat(done, F.array(following))).otherwise(parted)

    empty = F.slice("all", F.lit(1), F.lit(0))
    folded = jobs.select("job_id", F.explode(F.aggregate("all", empty, step)).alias("w"))
    return folded.select("job_id", "w.*").filter(F.col("upper") > F.col("lower"))


def windows_to_cues(windows: DataFrame, segments: DataFrame, native: bool = False) -> tuple[DataFrame, DataFrame]:
    """Local cues (job_id, cue_idx, start, end) and units (with ``cue_idx``) from segments (job_id, seg_idx, units) that an aligner gave back for windows.

    ``units`` are arrays of (text, start, end). Where a job has as many segments as windows they belong together in order, and
    segments without units give no cue. Else all units are found in the windows' texts, and each belongs to every
    cue that it meets in time; a job whose units do not fit its texts has none.
    """
    w = Window.partitionBy("job_id")
    numbered = windows.withColumns({"_at": F.row_number().over(w.orderBy("cue_idx")), "_n": F.count(F.lit(1)).over(w)})
    given = segments.withColumns({"_at": F.row_number().over(w.orderBy("seg_idx")), "_m": F.count(F.lit(1)).over(w)})
    counts = given.select("job_id", "_m").distinct()
    zipped = numbered.join(given, ["job_id", "_at"]).filter("_n = _m").select("job_id", "cue_idx", F.posexplode("units").alias("unit_idx", "u")).select("job_id", "cue_idx", "unit_idx", "u.text", "u.start", "u.end")
    cues = zipped.groupBy("job_id", "cue_idx").agg(F.min_by("start", "unit_idx").alias("start"), F.max_by("end", "unit_idx").alias("end"))
    other = numbered.join(counts, "job_id").filter("_n <> _m").select("job_id", "cue_idx", F.col("source_text").alias("text"))
    loose = given.join(other.select("job_id").distinct(), "job_id", "left_semi").select("job_id", "seg_idx", F.posexplode("units").alias("k", "u"))
    loose = loose.select("job_id", (F.row_number().over(Window.partitionBy("job_id").orderBy("seg_idx", "k")) - 1).alias("unit_idx"), "u.text", "u.start", "u.end")
    found = strict_cues(other, loose, native).filter("status = 'ok'").select("job_id", "cue_idx", "start", "end")
    times = found.select("job_id", "cue_idx", F.col("start").alias("_a"), F.col("end").alias("_b"))
    met = meeting(loose, times, ("start", "end"), ("_a", "_b"), SLICE)
    return cues.unionByName(found), zipped.unionByName(met.select(*zipped.columns))


def apply_span(lines: DataFrame, span: DataFrame) -> DataFrame:
    """Lines (job_id, cue_idx, barrier_before, ...) of each job's (first, last), counted from its first; a barrier before the last line goes, jobs without a span too."""
    rows = lines.join(span.filter("first IS NOT NULL"), "job_id").filter(F.col("cue_idx").between(F.col("first"), F.col("last")))
    whole = (F.col("first") == 0) & (F.col("last") == F.col("_top"))
    top = lines.groupBy("job_id").agg(F.max("cue_idx").alias("_top"))
    rows = rows.join(top, "job_id").withColumn("barrier_before", F.col("barrier_before") & (whole | (F.col("cue_idx") < F.col("last"))))
    return rows.withColumn("cue_idx", F.col("cue_idx") - F.col("first")).drop("first", "last", "_top")


def job_status(texts: DataFrame, lines: DataFrame, aligned: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """(job_id, status) of all jobs: what keeps a job from having subtitles, or ``ok``. ``aligned`` has ``hidden``; ``span`` is
    that of a partial range, null where the sound fits no line."""
    have = lines.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("hidden").alias("all_hidden"))
    placed = aligned.groupBy("job_id").agg(F.count(F.lit(1)).alias("k"), F.bool_and("hidden").alias("none_visible"))
    rows = texts.select("job_id").join(have, "job_id", "left").join(placed, "job_id", "left").withColumn("first", F.lit(0))
    if span is not None:
        rows = rows.drop("first").join(span.select("job_id", "first"), "job_id", "left")
    status = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no lyrics")
        .when(F.col("all_hidden"), "all lines hidden")
        .when(F.col("first").isNull(), "range not in the lyrics")
        .when(F.coalesce("k", F.lit(0)) == 0, "no line aligned")
        .when(F.col("none_visible"), "no visible line left")
    )
    return rows.select("job_id", F.coalesce(status, F.lit("ok")).alias("status"))
