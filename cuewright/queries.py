"""Registered queries of the alignment operators over the driver's tables, with their SQL.

Events stand for cues and frames of one job per user, texts for lyrics, embeddings for audio samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import timecode
from cuewright.functions.text import alignment_text, char_limit, cut_lines, match_key_native, safe_file_name, speech_rate, squeeze, tokens
from cuewright.functions.timecode import srt_time
from cuewright.operators import activity, evidence, intervals, locate, matching, onsets, segments, timing
from cuewright.plans import diagnostics
from cuewright.plans.align import Policy, align
from cuewright.plans.demo import demo, render_srt
from cuewright.sources.languages import PAIRS, language_code
from cuewright.sources.lines import split_cues
from cuewright.sources.media import flatten_segments, frame_levels, sample_range
from cuewright.sources.tables import dealt, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), "text", (F.col("n_chars") / 10.0).alias("duration"))


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), (F.row_number().over(order) - 1).cast("long").alias("cue_idx"), start.alias("start"), (start + F.col("value")).alias("end")
    )


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"), (F.col("value") >= 30).alias("active")
    )


def demo_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo(_texts(spark, sf_dir))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = split_cues(_texts(spark, sf_dir), None, compatibility=False)
    return cues.select("job_id", F.col("cue_idx").cast("long").alias("cue_idx"), "text", match_key_native(F.col("text")).alias("match_key"))


def overlap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.bound_overlaps(_cues(spark, sf_dir)).withColumn("end_code", srt_time(F.col("end") - F.floor(F.col("start") / 86400) * 86400))


def polish_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.polish(_cues(spark, sf_dir))


def polish_singing_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.polish_singing(timing.bound_overlaps(_cues(spark, sf_dir)), lead=0.1)


def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    shuffled = cues.withColumns({"start": F.col("start") - F.when(F.col("cue_idx") % 5 == 4, 2_000_000.0).otherwise(0.0), "source_idx": F.floor(F.col("cue_idx") / 2)})
    return timing.reject_out_of_order(shuffled).select("job_id", "cue_idx", "rejected")


def activity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = activity.drop_short(activity.fill_gaps(activity.runs(_mask(spark, sf_dir)), 1), 2)
    return runs.filter("active").select("job_id", "first", "last", "n")


def waveform_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("job_id"), F.posexplode("embedding").alias("sample_idx", "value"))
    return activity.waveform(samples, 8).select("job_id", F.col("bin").cast("long").alias("bin"), F.round("peak", 6).alias("peak"))


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of a text's lines from units of 40 letters each, a second long."""
    texts = _texts(spark, sf_dir)
    lines = split_cues(texts, None, compatibility=False)
    cues = stored(intervals.char_spans(lines.select("job_id", "cue_idx", match_key_native(F.col("text")).alias("key")), F.col("key"), "cue_idx").drop("key"))
    total = dealt(cues.groupBy("job_id").agg(F.max("hi").alias("n")), "job_id", "n")
    units = total.select("job_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / 40).cast("int") - 1))).alias("unit_idx")).select(
        "job_id", "unit_idx", (F.col("unit_idx") * 40).alias("lo"), F.least(F.col("unit_idx") * 40 + 40, "n").alias("hi"), F.col("unit_idx").cast("double").alias("start"), (F.col("unit_idx") + 1.0).alias("end")
    )
    times = intervals.overlap_times(cues, units)
    return times.select("job_id", F.col("cue_idx").cast("long").alias("cue_idx"), F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"))


def onset_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts snapped to onsets, tails and phrase ends of points between the frames of half a second."""
    mask = stored(_mask(spark, sf_dir))
    segs = stored(activity.segments(mask, hop=0.5))
    points = mask.select("job_id", F.col("frame").alias("cue_idx"), (F.col("frame") * 0.5 + 0.125).alias("at"))
    found = [f(points, segs).drop("at") for f in (onsets.snap_start, onsets.tail_end, onsets.phrase_end)]
    return found[0].join(found[1], ["job_id", "cue_idx"]).join(found[2], ["job_id", "cue_idx"])


def unit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onsets.unit_gaps(_cues(spark, sf_dir).withColumnRenamed("cue_idx", "unit_idx"))


def cut_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts, cut at 30 characters."""
    lines = split_cues(_texts(spark, sf_dir), None, compatibility=False)
    return lines.select("job_id", F.col("cue_idx").cast("long").alias("cue_idx"), F.array_join(cut_lines(F.col("text"), 30), "|").alias("parts"))


def anchored_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as subtitles that begin at their first event; a third of the jobs starts early enough to need no anchor."""
    cues = _cues(spark, sf_dir)
    first = F.min("start").over(Window.partitionBy("job_id")) - F.col("job_id") % 3
    moved = cues.select("job_id", "cue_idx", (F.col("start") - first).alias("start"), (F.col("end") - first).alias("end"), F.concat(F.lit("cue "), "cue_idx").alias("text"))
    return render_srt(moved, offset=-0.5, anchor=True)


def _timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts, one a second, that end 0 to 0.3 seconds before the next starts."""
    lines = split_cues(_texts(spark, sf_dir), None, compatibility=False)
    start = F.col("cue_idx").cast("double")
    return lines.withColumns({"start": start, "end": start + 1.0 - (F.char_length("text") % 4) / 10, "barrier_before": F.col("cue_idx") % 5 == 4})


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timing.merge_wrapped(_timed_lines(spark, sf_dir), preferred=120)
    return found.select("job_id", F.col("cue_idx").cast("long").alias("cue_idx"), "text", "start", "end", "merged")


def line_of_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line with which each unit of 40 letters shares most of them."""
    lines = stored(locate.line_spans(split_cues(_texts(spark, sf_dir), None, compatibility=False), native=True).select("job_id", "cue_idx", "lo", "hi"))
    total = dealt(lines.groupBy("job_id").agg(F.max("hi").alias("n")).filter("n > 0"), "job_id", "n")
    units = total.select("job_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 40) - 1)).alias("unit_idx"))
    units = units.select("job_id", "unit_idx", (F.col("unit_idx") * 40).alias("lo"), F.least(F.col("unit_idx") * 40 + 40, "n").alias("hi"))
    return intervals.largest_overlap(units, lines).select("job_id", "unit_idx", F.col("cue_idx").cast("long").alias("cue_idx"))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Cues, a match table, local and whole-text times made of events: a user's events lie three seconds apart."""
    cues = _cues(spark, sf_dir)
    v, at = F.col("end") - F.col("start"), F.col("cue_idx") * 3.0
    rows = cues.withColumns({"v": v, "start": at, "end": at + 2.5, "k": F.col("cue_idx") % 7})
    matches = rows.select(
        "job_id",
        "cue_idx",
        F.concat(F.lit("line "), "cue_idx").alias("source_text"),
        F.when(F.col("k") != 6, F.col("start") + F.col("k") * 0.2).alias("start"),
        F.when(F.col("k") != 6, F.col("start") + 2.8).alias("end"),
        (0.5 + F.col("k") * 0.1).alias("similarity"),
        F.lit(0.8).alias("coverage"),
        (F.col("k") + 1).cast("int").alias("exact_characters"),
    )
    local = rows.filter("cue_idx % 3 <> 0").select("job_id", "cue_idx", (F.col("start") + 0.1).alias("start"), "end")
    whole = rows.select("job_id", "cue_idx", F.when(F.col("cue_idx") % 4 != 3, F.col("start") + (F.col("cue_idx") % 5) * 0.25).alias("start"), F.when(F.col("cue_idx") % 4 != 3, F.col("end") + 0.2).alias("end"))
    return rows.select("job_id", "cue_idx"), matches, local, whole


def start_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with local times, else those of the whole text, and every rule that moves their start."""
    lines, matches, local, whole = _evidence(spark, sf_dir)
    chosen, _ = evidence.choose_cues(lines, local, whole)
    moves = evidence.adjustments(evidence.refine_starts(evidence.with_evidence(chosen, matches, local, whole)))
    return moves.select("job_id", "cue_idx", "kind", *[F.round(c, 6).alias(c) for c in ("original_start", "refined_start", "transcript_start", "previous_transcript_end", "local_start", "global_end")])


def unresolved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _, local, whole = _evidence(spark, sf_dir)
    return evidence.choose_cues(lines, local, whole)[1]


def local_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, matches, _, _ = _evidence(spark, sf_dir)
    jobs = matches.groupBy("job_id").agg((F.max("end") - 1.0).alias("duration"))
    found = evidence.align_windows(matches, jobs)
    return found.select("job_id", "cue_idx", F.round("lower", 6).alias("lower_s"), F.round("upper", 6).alias("upper_s"))


def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between the first and the last usable match of the lines whose event has a value of 60 or more."""
    _, matches, _, _ = _evidence(spark, sf_dir)
    heard = matches.withColumn("start", F.when(F.col("cue_idx") % 10 >= 4, F.col("start")))
    lines = matches.select("job_id", "cue_idx", (F.col("cue_idx") % 5 == 0).alias("barrier_before"))
    return evidence.apply_span(lines, matching.partial_span(heard))


def raster_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames of a quarter of a second that segments of whole frames of half a second touch."""
    mask = _mask(spark, sf_dir)
    jobs = mask.groupBy("job_id").agg(((F.max("frame") + 1) * 0.5).alias("duration")).withColumn("hop", F.lit(0.25))
    found = activity.rasterize(activity.segments(mask, 0.5), jobs)
    return found.select("job_id", F.col("frame").cast("long").alias("frame"), "active")


def level_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values as levels of frames."""
    levels = _mask(spark, sf_dir).join(_cues(spark, sf_dir).withColumnRenamed("cue_idx", "frame"), ["job_id", "frame"])
    return activity.level_mask(levels.select("job_id", "frame", F.round(F.col("end") - F.col("start") - 100, 3).alias("db")), 1, 2)


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    named = F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).when(F.col("doc_id") % 3 == 1, " German ").when(F.col("doc_id") % 7 == 0, "auto").otherwise(F.concat("lang", F.lit("-x")))
    return docs.select("doc_id", language_code(named).alias("code"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks, frames, marks, rates, limits and names of order lines."""
    o = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag")
    audio, video = F.struct(F.col("a").alias("in"), (F.col("a") + F.col("b") - 20).alias("out")), F.struct(F.lit(0).cast("long").alias("in"), F.col("b").alias("out"))
    start, end = F.lit(100).cast("long"), F.lit(150).cast("long")
    o = o.withColumns({"m": timecode.marked_range(start, end, audio, video), "live": timecode.live_marks(start, end, audio, video)})
    rate = F.col("l_quantity") / 6
    return o.select(
        "l_orderkey",
        "l_linenumber",
        timecode.clock(F.col("l_extendedprice")).alias("clock"),
        srt_time(F.col("l_extendedprice") / 7).alias("code"),
        F.col("m.start").alias("range_start"),
        F.col("m.end").alias("range_end"),
        F.col("m.used_marks").alias("used_marks"),
        F.col("live.audio").isNotNull().alias("audio_live"),
        F.col("live.video").isNotNull().alias("video_live"),
        timecode.frame_rate(F.concat(F.col("l_returnflag"), F.lit(" fps")), F.concat(F.col("l_quantity").cast("int"), F.lit(" fps"))).alias("fps"),
        timecode.milliseconds(F.col("a") - 100).alias("seconds"),
        timecode.position_time(F.col("a").cast("double") - 50, F.lit(100.0), F.col("l_quantity")).alias("at"),
        char_limit(rate).cast("long").alias("allowed"),
        safe_file_name(F.concat_ws("/", "l_returnflag", F.lit("x?"))).alias("name"),
    )


def text_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined lines, words that hold a letter or number, and letters a second of texts."""
    docs = _texts(spark, sf_dir)
    lines = F.split("text", "\n")
    return docs.select(
        "job_id", F.md5(alignment_text(lines).cast("binary")).alias("joined_md5"), F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.round(speech_rate(F.col("text"), F.col("duration")), 9).alias("rate")
    )


def loud_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of frames of 8 samples every 4 of the middle of vectors."""
    samples = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("job_id"), F.posexplode("embedding").alias("sample_idx", "value"))
    levels = frame_levels(sample_range(samples, 100, 0.64, 0.1, 0.5), rate=100, hop=0.04)
    return levels.select("job_id", "frame", F.round("db", 6).alias("db"))


def segment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as segments of words, taken apart into units."""
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (F.col("turn") * 100 + i).alias("start"), (F.col("turn") * 100 + i + 1).alias("end")))
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.struct("turn", words.alias("words")).alias("s"))
    results = turns.groupBy("job_id").agg(F.sort_array(F.collect_list("s")).alias("segments"))
    return flatten_segments(results).withColumn("unit_idx", F.col("unit_idx").cast("long"))


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Conversations as texts of a line a turn; heard units are its words, but each ninth misheard; whole-text units are all words."""
    turns = _table(spark, sf_dir, "conversations").filter(F.length(F.trim("text")) > 0)
    order = F.sort_array(F.collect_list(F.struct("turn", F.translate("text", "\n\r", "  ").alias("t"))))
    texts = turns.groupBy(F.col("conv_id").alias("job_id")).agg(F.array_join(F.transform(order, lambda x: x["t"]), "\n").alias("text"))
    texts = stored(texts.withColumn("duration", F.char_length("text") / 10.0))
    words = texts.select("job_id", F.posexplode(F.split("text", r"\s+")).alias("unit_idx", "text"))
    whole = words.select("job_id", F.col("unit_idx").cast("long").alias("unit_idx"), "text", (F.col("unit_idx") * 0.5).alias("start"), (F.col("unit_idx") * 0.5 + 0.4 - (F.col("unit_idx") % 3) * 0.1).alias("end"))
    heard = whole.withColumn("text", F.when(F.col("unit_idx") % 9 == 8, "hm").otherwise(F.col("text")))
    return texts, heard, whole


def unit_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of lines from heard units that are looked for in the text."""
    texts, heard, _ = _turns(spark, sf_dir)
    return locate.optional_cues(split_cues(texts.select("job_id", "text"), None, compatibility=False), heard, native=True).select("job_id", "cue_idx", "text", "start", "end")


def match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, heard, _ = _turns(spark, sf_dir)
    return matching.match_lines(stored(split_cues(texts.select("job_id", "text"), 30)), heard)


def line_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, matches, local, whole = _evidence(spark, sf_dir)
    judged = matches.withColumn("status", matching.status_of(F.col("similarity"), F.col("coverage")))
    return diagnostics.report(judged, whole, local)


def segmented_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of up to 80 characters cut by the times of their units."""
    texts, _, whole = _turns(spark, sf_dir)
    lines = stored(split_cues(texts.select("job_id", "text"), 80))
    cues = locate.optional_cues(lines, whole).filter("start IS NOT NULL").withColumn("weak", F.col("cue_idx") % 3 == 0)
    nothing = whole.withColumn("cue_idx", F.lit(0)).limit(0)
    return segments.auto_segment(lines.select("job_id", "cue_idx", "text"), cues.select("job_id", "cue_idx", "text", "start", "end", "weak"), whole, nothing).drop("weak")


def paced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines, cut by the times of their words: a 16th of a second a letter, with pauses by length and after sentences."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("cue_idx"), squeeze(F.col("text")).alias("text")).filter("text <> ''")
    words = turns.select("job_id", "cue_idx", F.posexplode(F.split("text", " ")).alias("i", "w"))
    pause = F.when(F.col("w").rlike(r"[.!?]\z"), 1.25).otherwise(0.0) + F.char_length("w") % 5 / 16
    line = Window.partitionBy("job_id", "cue_idx")
    sung = F.char_length(match_key_native(F.col("w"))) / 16
    words = words.withColumns({"sung": sung, "upto": F.sum(sung + pause).over(line.orderBy("i")) - pause})
    unit = F.struct(F.col("i").cast("long").alias("unit_idx"), F.col("w").alias("text"), (F.col("upto") - F.col("sung")).alias("start"), F.col("upto").alias("end"))
    units = words.groupBy("job_id", "cue_idx").agg(F.sort_array(F.collect_list(unit)).alias("units"), F.min(F.col("upto") - F.col("sung")).alias("start"), F.max("upto").alias("end"))
    parts = segments.split_lines(turns.join(units, ["job_id", "cue_idx"]).select("job_id", "cue_idx", "text", "start", "end", "units"))
    return parts.select("job_id", F.col("cue_idx").cast("long").alias("cue_idx"), F.col("part_idx").cast("long").alias("part_idx"), "text", "start", "end")


def aligned_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles of conversations from heard and aligned words."""
    texts, heard, whole = _turns(spark, sf_dir)
    local = locate.units_of_lines(split_cues(texts.select("job_id", "text"), 30), whole).filter("cue_idx % 2 = 0")
    return align(texts, heard, whole, local, policy=Policy(anchor=True, offset=2.0)).srt


CUES = """cues AS (
    SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS cue_idx,
        epoch_us(ts) / 1e6::DOUBLE AS "start", epoch_us(ts) / 1e6::DOUBLE + value AS "end" FROM events
)"""
BOUND = """bound AS (
    SELECT job_id, cue_idx, "start", CASE WHEN "end" > lead("start") OVER w THEN greatest("start", lead("start") OVER w) ELSE "end" END AS "end"
    FROM cues WINDOW w AS (PARTITION BY job_id ORDER BY cue_idx)
)"""
LINES = r"""parts AS (
    SELECT doc_id AS job_id, n_chars / 10.0::DOUBLE AS duration, string_split(text, chr(10)) AS ls FROM documents
), raw AS (
    SELECT job_id, duration, generate_subscripts(ls, 1) AS pos, trim(regexp_replace(unnest(ls), '\s+', ' ', 'g')) AS text FROM parts
), lines AS (
    SELECT job_id, duration, row_number() OVER (PARTITION BY job_id ORDER BY pos) - 1 AS cue_idx, text FROM raw WHERE text <> ''
), keyed AS (
    SELECT *, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS match_key FROM lines
)"""

#: Conversations as texts of a line a turn, their words as units (each ninth misheard), and the lines' keys joined.
TURNS = r"""texts AS (
    SELECT conv_id AS job_id, string_agg(translate(text, chr(10) || chr(13), '  '), chr(10) ORDER BY turn, text) AS text FROM conversations WHERE length(trim(text)) > 0 GROUP BY conv_id
), raw AS (
    SELECT job_id, generate_subscripts(ls, 1) AS pos, trim(regexp_replace(unnest(ls), '\s+', ' ', 'g')) AS text FROM (SELECT job_id, string_split(text, chr(10)) AS ls FROM texts)
), lines AS (
    SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY pos) - 1 AS cue_idx, text, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS key FROM raw WHERE text <> ''
), spans AS (
    SELECT *, sum(length(key)) OVER w - length(key) AS lo, sum(length(key)) OVER w AS hi FROM lines WINDOW w AS (PARTITION BY job_id ORDER BY cue_idx)
), targets AS (SELECT job_id, string_agg(key, '' ORDER BY cue_idx) AS target FROM lines GROUP BY job_id
), said AS (
    SELECT job_id, generate_subscripts(ws, 1) - 1 AS unit_idx, unnest(ws) AS text FROM (SELECT job_id, regexp_split_to_array(text, '\s+') AS ws FROM texts)
), units AS (
    SELECT job_id, unit_idx, text, regexp_replace(replace(lower(CASE WHEN unit_idx % 9 = 8 THEN 'hm' ELSE text END), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS heard_key,
        regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS key, unit_idx * 0.5::DOUBLE AS "start", unit_idx * 0.5::DOUBLE + 0.4::DOUBLE - (unit_idx % 3) * 0.1::DOUBLE AS "end" FROM said
)"""


def _search(units: str, key: str, name: str) -> str:
    """A recursive table (job_id, unit_idx, lo, hi) of units looked for from a cursor, a unit of all jobs a round."""
    return f"""{name} AS (
    SELECT job_id, -1::BIGINT AS unit_idx, 0::BIGINT AS cursor, NULL::BIGINT AS lo, NULL::BIGINT AS hi FROM targets
    UNION ALL
    SELECT job_id, k, CASE WHEN place IS NULL THEN cursor ELSE place + n END, place, place + n FROM (
        SELECT s.job_id, u.unit_idx AS k, s.cursor, length({key}) AS n, CASE WHEN {key} = '' THEN NULL WHEN strpos(substr(target, s.cursor + 1), {key}) > 0 THEN s.cursor + strpos(substr(target, s.cursor + 1), {key}) - 1
            WHEN strpos(substr(target, greatest(0, s.cursor - 4) + 1, s.cursor + greatest(64, 4 * length({key})) - greatest(0, s.cursor - 4)), {key}) > 0
            THEN greatest(0, s.cursor - 4) + strpos(substr(target, greatest(0, s.cursor - 4) + 1, s.cursor + greatest(64, 4 * length({key})) - greatest(0, s.cursor - 4)), {key}) - 1 END AS place
        FROM {name} s JOIN {units} u ON u.job_id = s.job_id AND u.unit_idx = s.unit_idx + 1 JOIN targets t ON t.job_id = s.job_id)
)"""


def _cue_times(found: str, name: str) -> str:
    """A table (job_id, cue_idx, start, end) of lines from the units that were found."""
    return f"""{name} AS (
    SELECT job_id, cue_idx, arg_min(a, unit_idx) AS "start", arg_max(b, unit_idx) AS "end" FROM (
        SELECT c.job_id, c.cue_idx, f.unit_idx, u."start" + (greatest(c.lo, f.lo) - f.lo) * ((u."end" - u."start") / (f.hi - f.lo)) AS a, u."start" + (least(c.hi, f.hi) - f.lo) * ((u."end" - u."start") / (f.hi - f.lo)) AS b
        FROM spans c JOIN {found} f ON f.job_id = c.job_id AND greatest(c.lo, f.lo) < least(c.hi, f.hi) JOIN units u ON u.job_id = f.job_id AND u.unit_idx = f.unit_idx)
    GROUP BY ALL
)"""


EVIDENCE = """e AS (
    SELECT job_id, cue_idx, CASE WHEN cue_idx % 7 <> 6 THEN cue_idx * 3.0::DOUBLE + cue_idx % 7 * 0.2::DOUBLE END AS ms, CASE WHEN cue_idx % 7 <> 6 THEN cue_idx * 3.0::DOUBLE + 2.8::DOUBLE END AS me,
        cue_idx % 7 BETWEEN 2 AND 5 AS strong, CASE WHEN cue_idx % 3 <> 0 THEN cue_idx * 3.0::DOUBLE + 0.1::DOUBLE END AS ls, CASE WHEN cue_idx % 3 <> 0 THEN cue_idx * 3.0::DOUBLE + 2.5::DOUBLE END AS le,
        CASE WHEN cue_idx % 4 <> 3 THEN cue_idx * 3.0::DOUBLE + cue_idx % 5 * 0.25::DOUBLE END AS gs, CASE WHEN cue_idx % 4 <> 3 THEN cue_idx * 3.0::DOUBLE + 2.5::DOUBLE + 0.2::DOUBLE END AS ge FROM cues
)"""


def _code(seconds: str) -> str:
    ms = f"greatest(0, round_even(({seconds}) * 1000, 0)::BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


SQL = {
    "demo_srt": f"""
        WITH {LINES}, slots AS (
            SELECT *, cue_idx * duration / count(*) OVER w AS a, least(duration, (cue_idx + 1) * duration / count(*) OVER w) AS b
            FROM lines WINDOW w AS (PARTITION BY job_id)
        )
        SELECT job_id, string_agg((cue_idx + 1) || chr(10) || {_code("a")} || ' --> ' || {_code("b")} || chr(10) || text, chr(10) || chr(10) ORDER BY cue_idx) || chr(10) AS srt
        FROM slots GROUP BY job_id""",
    "split_lines": f"WITH {LINES} SELECT job_id, cue_idx, text, match_key FROM keyed",
    "overlap_bounds": f"""WITH {CUES}, {BOUND} SELECT *, {_code('"end" - floor("start" / 86400) * 86400')} AS end_code FROM bound""",
    "polish_cues": f"""
        WITH {CUES}, early AS (SELECT job_id, cue_idx, greatest(0, "start" - 0.08::DOUBLE) AS s, "end" AS e FROM cues)
        SELECT job_id, cue_idx, s AS "start", CASE WHEN lead(s) OVER w IS NULL THEN greatest(e + 0.3::DOUBLE, s + 0.5::DOUBLE)
            ELSE least(greatest(e + 0.3::DOUBLE, s + 0.5::DOUBLE), greatest(s, lead(s) OVER w - 0.02::DOUBLE)) END AS "end"
        FROM early WINDOW w AS (PARTITION BY job_id ORDER BY cue_idx)""",
    "polish_singing_cues": f"""
        WITH {CUES}, {BOUND}, n AS (SELECT *, greatest(0.0::DOUBLE, "end" - "start") AS raw FROM bound), shown AS (
            SELECT *, CASE WHEN coalesce(lag(raw) OVER w, 11) <= 10 THEN greatest(greatest(0, "start" - 0.1::DOUBLE), lag("end") OVER w) ELSE greatest(0, "start" - 0.1::DOUBLE) END AS s
            FROM n WINDOW w AS (PARTITION BY job_id ORDER BY cue_idx)
        ), t AS (
            SELECT *, CASE WHEN raw > 10 THEN s ELSE "end" END AS trusted, lead(s) OVER w AS nxt FROM shown WINDOW w AS (PARTITION BY job_id ORDER BY cue_idx)
        ), d AS (
            SELECT *, greatest("end", least(greatest(trusted, "end") + 0.5::DOUBLE, s + 10)) AS desired,
                CASE WHEN nxt - trusted >= 0.08::DOUBLE THEN greatest(s, nxt - 0.08::DOUBLE) ELSE greatest(s, nxt) END AS bound FROM t
        )
        SELECT job_id, cue_idx, s AS "start", CASE WHEN nxt IS NULL THEN greatest(desired, s + 0.5::DOUBLE)
            ELSE greatest(s, least(greatest(least(desired, bound), s + 0.5::DOUBLE), bound)) END AS "end" FROM d""",
    "out_of_order": f"""
        WITH {CUES}, runs AS (
            SELECT job_id, cue_idx, cue_idx // 2 AS run, "start" - CASE WHEN cue_idx % 5 = 4 THEN 2000000.0 ELSE 0.0 END::DOUBLE AS s FROM cues
        ), firsts AS (SELECT job_id, run, arg_min(s, cue_idx) AS f FROM runs GROUP BY ALL), judged AS (
            SELECT *, f < coalesce(max(f) OVER (PARTITION BY job_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 0.25::DOUBLE AS rejected FROM firsts
        )
        SELECT job_id, cue_idx, rejected FROM runs JOIN judged USING (job_id, run)""",
    "cut_parts": f"""
        WITH RECURSIVE {LINES}, steps AS (
            SELECT job_id, cue_idx, text AS rest, ''::VARCHAR AS done, 0 AS last FROM lines
            UNION ALL
            SELECT job_id, cue_idx, CASE WHEN length(rest) <= 30 THEN '' ELSE trim(substr(rest, pos + 1)) END,
                done || CASE WHEN done = '' THEN '' ELSE '|' END || CASE WHEN length(rest) <= 30 THEN rest ELSE trim(substr(rest, 1, pos)) END, CASE WHEN length(rest) <= 30 THEN 1 ELSE 0 END
            FROM (SELECT *, coalesce(list_max(list_filter(range(16, 31), lambda i: strpos(',.!?;:，。！？；：…~、)]}}〉》」』', substr(rest, i, 1)) > 0)),
                list_max(list_filter(range(16, 31), lambda i: substr(rest, i, 1) = ' ')), list_max(list_filter(range(16, 31), lambda i: substr(rest, i + 1, 1) = ' ')), 30) AS pos
                FROM steps WHERE last = 0 AND rest <> '')
        )
        SELECT job_id, cue_idx, done AS parts FROM steps WHERE rest = ''""",
    "anchored_srt": f"""
        WITH {CUES}, moved AS (
            SELECT job_id, cue_idx, "start" - (min("start") OVER w - job_id % 3) - 0.5::DOUBLE AS a, "end" - (min("start") OVER w - job_id % 3) - 0.5::DOUBLE AS b FROM cues WINDOW w AS (PARTITION BY job_id)
        ), numbered AS (SELECT *, (min(a) OVER (PARTITION BY job_id) > 0.6::DOUBLE)::INT AS k FROM moved)
        SELECT job_id, CASE WHEN max(k) = 1 THEN '1' || chr(10) || '00:00:00,000 --> 00:00:00,500' || chr(10) || chr(10240) || chr(10) || chr(10) ELSE '' END ||
            string_agg((cue_idx + 1 + k) || chr(10) || {_code("a")} || ' --> ' || {_code("b")} || chr(10) || 'cue ' || cue_idx, chr(10) || chr(10) ORDER BY cue_idx) || chr(10) AS srt
        FROM numbered GROUP BY job_id""",
    "merged_lines": f"""
        WITH {LINES}, l AS (
            SELECT job_id, cue_idx, text, length(match_key) AS n, cue_idx::DOUBLE AS s, cue_idx::DOUBLE + 1 - (length(text) % 4) / 10::DOUBLE AS e, cue_idx % 5 = 4 AS barrier FROM keyed
        ), p AS (
            SELECT *, coalesce(NOT lead(barrier) OVER w AND lead(s) OVER w - e BETWEEN -0.05::DOUBLE AND 0.15::DOUBLE AND strpos('.!?;:。！？；：…', right(text, 1)) = 0
                AND length(text) + 1 + length(lead(text) OVER w) <= 120 AND greatest(n, lead(n) OVER w) >= 78, false) AS fits, lead(text) OVER w AS t2, lead(e) OVER w AS e2
            FROM l WINDOW w AS (PARTITION BY job_id ORDER BY cue_idx)
        ), r AS (SELECT *, cue_idx - row_number() OVER (PARTITION BY job_id, fits ORDER BY cue_idx) AS island FROM p
        ), m AS (SELECT *, fits AND row_number() OVER (PARTITION BY job_id, fits, island ORDER BY cue_idx) % 2 = 1 AS merged FROM r
        ), k AS (SELECT *, coalesce(lag(merged) OVER (PARTITION BY job_id ORDER BY cue_idx), false) AS taken FROM m)
        SELECT job_id, cue_idx, CASE WHEN merged THEN text || ' ' || t2 ELSE text END AS text, s AS "start", CASE WHEN merged THEN greatest(e, e2) ELSE e END AS "end", merged FROM k WHERE NOT taken""",
    "line_of_unit": f"""
        WITH {LINES}, spans AS (
            SELECT job_id, cue_idx, sum(length(match_key)) OVER w - length(match_key) AS lo, sum(length(match_key)) OVER w AS hi
            FROM keyed WINDOW w AS (PARTITION BY job_id ORDER BY cue_idx)
        ), t AS (SELECT job_id, max(hi) AS n FROM spans GROUP BY job_id HAVING max(hi) > 0
        ), units AS (SELECT job_id, n, unnest(range(0, ceil(n / 40)::BIGINT)) AS u FROM t
        ), met AS (SELECT units.job_id, u, cue_idx, least(hi, u * 40 + 40, n) - greatest(lo, u * 40) AS shared FROM units JOIN spans USING (job_id)
            WHERE least(hi, u * 40 + 40, n) > greatest(lo, u * 40))
        SELECT job_id, u AS unit_idx, cue_idx FROM met QUALIFY row_number() OVER (PARTITION BY job_id, u ORDER BY shared DESC, cue_idx) = 1""",
    "start_moves": f"""
        WITH {CUES}, {EVIDENCE}, g AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY cue_idx) AS at FROM e), j AS (
            SELECT e.*, p.me AS pe, coalesce(p.strong, false) AS ps, coalesce(e.ls, e.gs) AS cs, CASE WHEN e.ls IS NOT NULL THEN e.le ELSE e.ge END AS ce
            FROM e LEFT JOIN e p ON e.job_id = p.job_id AND p.cue_idx = e.cue_idx - 1
        ), f AS (SELECT *, CASE WHEN strong AND cs < ms - 0.12::DOUBLE THEN greatest(cs, ms - 0.05::DOUBLE) END AS fl FROM j WHERE cs IS NOT NULL
        ), c AS (SELECT *, coalesce(fl, cs) AS s2, greatest(ce, coalesce(fl, ce)) AS e2 FROM f
        ), k AS (SELECT *, CASE WHEN strong AND ps AND ms - pe BETWEEN -0.08::DOUBLE AND 0.65::DOUBLE AND gs - s2 BETWEEN 0.3::DOUBLE AND 2.25::DOUBLE
            AND abs(ge - le) <= 0.75::DOUBLE AND gs < e2 AND ge - gs >= 0.35::DOUBLE THEN greatest(s2, gs) END AS cn FROM c
        ), u AS (SELECT *, 'lexical_floor' AS kind, fl AS moved FROM k WHERE fl IS NOT NULL UNION ALL SELECT *, 'sustained_boundary_consensus', cn FROM k WHERE cn IS NOT NULL)
        SELECT job_id, cue_idx, kind, round(cs, 6) AS original_start, round(moved, 6) AS refined_start, round(ms, 6) AS transcript_start, round(pe, 6) AS previous_transcript_end,
            round(ls, 6) AS local_start, round(ge, 6) AS global_end FROM u""",
    "unresolved_lines": f"WITH {CUES} SELECT job_id, cue_idx FROM cues WHERE cue_idx % 3 = 0 AND cue_idx % 4 = 3",
    "local_windows": f"""
        WITH {CUES}, {EVIDENCE}, d AS (SELECT job_id, max(me) - 1 AS duration FROM e GROUP BY job_id
        ), c AS (SELECT *, lag(me) OVER w AS pe, lead(ms) OVER w AS ns FROM e WHERE strong WINDOW w AS (PARTITION BY job_id ORDER BY cue_idx)
        ), w AS (SELECT job_id, cue_idx, greatest(0, ms - 0.8::DOUBLE, coalesce(pe + 0.05::DOUBLE, 0)) AS lo, least(duration, me + 1.2::DOUBLE, coalesce(ns - 0.1::DOUBLE, duration)) AS hi FROM c JOIN d USING (job_id))
        SELECT job_id, cue_idx, round(lo, 6) AS lower_s, round(hi, 6) AS upper_s FROM w WHERE hi > lo""",
    "span_lines": f"""
        WITH {CUES}, u AS (SELECT job_id, cue_idx, cue_idx % 10 >= 4 AND cue_idx % 7 BETWEEN 1 AND 5 AS ok, max(cue_idx) OVER (PARTITION BY job_id) AS top FROM cues
        ), s AS (SELECT job_id, min(cue_idx) AS a, max(cue_idx) AS b FROM u WHERE ok GROUP BY job_id)
        SELECT job_id, cue_idx - a AS cue_idx, cue_idx % 5 = 0 AND (cue_idx < b OR (a = 0 AND b = top)) AS barrier_before FROM u JOIN s USING (job_id) WHERE cue_idx BETWEEN a AND b""",
    "raster_mask": """
        WITH m AS (
            SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value >= 30 AS active FROM events
        ), n AS (SELECT job_id, count(*) AS k FROM m GROUP BY job_id), f AS (SELECT job_id, unnest(range(0, 2 * k + 1)) AS frame FROM n)
        SELECT f.job_id, f.frame, coalesce(bool_or(a.active), false) AS active FROM f LEFT JOIN m a
            ON a.job_id = f.job_id AND a.active AND f.frame BETWEEN a.frame * 2 AND a.frame * 2 + 2 GROUP BY ALL""",
    "level_frames": """
        WITH m AS (
            SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, round(epoch_us(ts) / 1e6::DOUBLE + value - epoch_us(ts) / 1e6::DOUBLE - 100, 3) AS db FROM events
        ), q AS (SELECT job_id, quantile_cont(db, 0.2) AS lo, quantile_cont(db, 0.9) AS hi FROM m GROUP BY job_id
        ), a AS (SELECT job_id, frame, db >= greatest(-42, lo + greatest(6, 0.35::DOUBLE * (hi - lo))) AS active FROM m JOIN q USING (job_id)
        ), i1 AS (SELECT *, frame - row_number() OVER (PARTITION BY job_id, active ORDER BY frame) AS g FROM a
        ), r1 AS (SELECT *, count(*) OVER (PARTITION BY job_id, active, g) AS n, min(frame) OVER (PARTITION BY job_id, active, g) AS f0,
                max(frame) OVER (PARTITION BY job_id, active, g) AS f1, max(frame) OVER (PARTITION BY job_id) AS top FROM i1
        ), filled AS (SELECT job_id, frame, active OR (n <= 1 AND f0 > 0 AND f1 < top) AS active FROM r1
        ), i2 AS (SELECT *, frame - row_number() OVER (PARTITION BY job_id, active ORDER BY frame) AS g FROM filled)
        SELECT job_id, frame, active AND count(*) OVER (PARTITION BY job_id, active, g) >= 2 AS active FROM i2""",
    "language_codes": f"""
        WITH l(code, name) AS (VALUES {", ".join(f"('{c}', '{n}')" for c, n in PAIRS)}), d AS (
            SELECT doc_id, lower(trim(CASE WHEN doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 3 = 1 THEN ' German ' WHEN doc_id % 7 = 0 THEN 'auto' ELSE lang || '-x' END)) AS v FROM documents
        )
        SELECT doc_id, CASE WHEN v NOT IN ('', 'auto', 'automatic') THEN coalesce(l.code, v) END AS code FROM d LEFT JOIN l ON v = l.code OR v = lower(l.name)""",
    "scalar_functions": f"""
        WITH o AS (SELECT *, l_partkey AS a, l_suppkey AS b, round_even(l_extendedprice * 100, 0)::BIGINT AS cs FROM lineitem),
        m AS (SELECT *, CASE WHEN b >= 20 THEN {{'i': a, 'o': a + b - 20}} WHEN b >= 0 THEN {{'i': 0, 'o': b}} END AS k, NOT (a = 0 AND a + b - 20 = 50) AS pa, b <> 50 AS pv FROM o)
        SELECT l_orderkey, l_linenumber, CASE WHEN cs >= 360000 THEN printf('%02d:', cs // 360000) ELSE '' END || printf('%02d:%02d.%02d', cs // 6000 % 60, cs // 100 % 60, cs % 100) AS clock,
            {_code("l_extendedprice / 7")} AS code, 100 + k.i AS range_start, 100 + k.o AS range_end, true AS used_marks, pa OR NOT pv AS audio_live, pv OR NOT pa AS video_live,
            CASE WHEN l_quantity >= 1 THEN floor(l_quantity) END::DOUBLE AS fps, greatest(0, a - 100) / 1000::DOUBLE AS seconds,
            least(greatest(0, (a::DOUBLE - 50) / 100.0::DOUBLE * l_quantity), l_quantity) AS "at",
            CASE WHEN l_quantity / 6 <= 4 THEN 30 WHEN l_quantity / 6 >= 7 THEN 50 ELSE round_even(30 + 20 * ((l_quantity / 6 - 4) / 3), 0) END::BIGINT AS allowed, l_returnflag || '_x_' AS name FROM m""",
    "text_rates": r"""
        WITH t AS (SELECT doc_id AS job_id, n_chars / 10.0::DOUBLE AS d, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents
        ), w AS (SELECT *, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM t)
        SELECT job_id, md5(array_to_string(ls, ' ')) AS joined_md5, len(list_filter(ws, lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) AS n_tokens,
            round(length(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')) / greatest(0.01::DOUBLE, d), 9) AS rate FROM w""",
    "loud_frames": """
        WITH s AS (SELECT vec_id AS job_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 11 AS i FROM embeddings
        ), r AS (SELECT * FROM s WHERE i BETWEEN 0 AND 39), f AS (SELECT DISTINCT job_id, unnest(range(0, 11)) AS frame FROM r
        ), p AS (SELECT f.job_id, frame, coalesce(sum(v * v) / 8, 0) AS p FROM f LEFT JOIN r ON r.job_id = f.job_id AND i BETWEEN frame * 4 - 4 AND frame * 4 + 3 GROUP BY ALL
        ), t AS (SELECT *, max(p) OVER (PARTITION BY job_id) AS top FROM p)
        SELECT job_id, frame, round(CASE WHEN top > 1e-16::DOUBLE THEN greatest(-80, 10 * log10(greatest(1e-10::DOUBLE, p)) - 10 * log10(greatest(1e-10::DOUBLE, top))) END, 6) AS db FROM t""",
    "segment_units": """
        WITH w AS (SELECT conv_id AS job_id, turn, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations)
        SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY turn, i) - 1 AS unit_idx, text, (turn * 100 + i)::DOUBLE AS "start", (turn * 100 + i + 1)::DOUBLE AS "end" FROM w""",
    "line_report": f"""
        WITH {CUES}, {EVIDENCE}, c AS (SELECT *, coalesce(ls, gs) AS chosen FROM e), r AS (
            SELECT *, coalesce(chosen + 0.01::DOUBLE < greatest(-1, max(chosen) OVER (PARTITION BY job_id ORDER BY cue_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), false) AS reverse,
                0.5::DOUBLE + cue_idx % 7 * 0.1::DOUBLE AS sim FROM c
        )
        SELECT job_id, cue_idx, reverse, printf('%02d %-7s ASR %s G %s L %s%s | line %d', cue_idx + 1, CASE WHEN sim >= 0.84::DOUBLE THEN 'match' ELSE 'changed' END,
            CASE WHEN ms IS NULL THEN '-' ELSE printf('%7.2f-%7.2f', ms, me) END, CASE WHEN gs IS NULL THEN '-' ELSE printf('%7.2f-%7.2f', gs, ge) END,
            CASE WHEN ls IS NULL THEN '-' ELSE printf('%7.2f-%7.2f', ls, le) END, CASE WHEN reverse THEN ' REVERSE' ELSE '' END, cue_idx) AS line FROM r""",
    "unit_places": f"""
        WITH RECURSIVE {TURNS}, {_search("units", "u.heard_key", "found")}, {_cue_times("found", "timed")}
        SELECT job_id, cue_idx, text, "start", "end" FROM lines LEFT JOIN timed USING (job_id, cue_idx)""",
    "paced_lines": r"""
        WITH RECURSIVE turns AS (SELECT conv_id AS job_id, turn AS cue_idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''
        ), w AS (SELECT job_id, cue_idx, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM turns
        ), k AS (SELECT *, length(regexp_replace(replace(lower(w), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')) AS letters, CASE WHEN regexp_matches(w, '[.!?]$') THEN 1.25::DOUBLE ELSE 0 END + length(w) % 5 / 16::DOUBLE AS pause FROM w
        ), t AS (SELECT *, sum(letters / 16::DOUBLE + pause) OVER (PARTITION BY job_id, cue_idx ORDER BY i) - pause AS e FROM k
        ), whole AS (SELECT job_id, cue_idx, min(e - letters / 16::DOUBLE) AS s0, max(e) AS e0 FROM t GROUP BY ALL
        ), l AS (
            SELECT job_id, cue_idx, count(*) AS n, list(w ORDER BY i) AS ws, list(letters ORDER BY i) AS ks, list(e - letters / 16::DOUBLE ORDER BY i) AS ss, list(e ORDER BY i) AS es
            FROM t WHERE letters > 0 GROUP BY ALL HAVING count(*) >= 2
        ), g AS (SELECT *, list_transform(range(1, n), lambda i: greatest(0, ss[i + 1] - es[i])) AS gaps FROM l
        ), m AS (SELECT *, list_sort(list_filter(gaps, lambda x: x > 0.02::DOUBLE)) AS wide FROM g
        ), f AS (SELECT *, greatest(1.7::DOUBLE, least(2.2::DOUBLE, 4 * CASE WHEN len(wide) >= 3 THEN (wide[(len(wide) + 1) // 2] + wide[len(wide) // 2 + 1]) / 2 ELSE 0 END)) AS far FROM m
        ), b AS (SELECT *, list_filter(range(1, n), lambda i: gaps[i] >= far OR (gaps[i] >= least(far, 1.2::DOUBLE) AND strpos('.!?;:。！？；：…', right(ws[i], 1)) > 0)) AS forced FROM f
        ), r AS (SELECT job_id, cue_idx, unnest(list_prepend(0, forced)) AS a, unnest(list_append(forced, n)) AS z FROM b
        ), ranges AS (
            SELECT job_id, cue_idx, a, z, NULL::BIGINT AS parent FROM r
            UNION ALL
            SELECT job_id, cue_idx, unnest([a, cut]), unnest([cut, z]), a FROM (
                SELECT job_id, cue_idx, a, z, a + list_position(scores, list_min(scores)) AS cut FROM (
                    SELECT *, list_transform(range(a + 1, z), lambda i: abs((list_sum(list_transform(ws[a + 1:i], lambda x: length(x))) + i - a - 1) / greatest(1, size) - 0.5::DOUBLE) * 0.65::DOUBLE + abs((ss[i + 1] - ss[a + 1]) / secs - 0.5::DOUBLE) * 0.35::DOUBLE
                        + CASE WHEN least(list_sum(list_transform(ws[a + 1:i], lambda x: length(x))) + i - a - 1, list_sum(list_transform(ws[i + 1:z], lambda x: length(x))) + z - i - 1) < 3 THEN 0.5::DOUBLE ELSE 0 END
                        - (CASE WHEN strpos(',.!?;:，。！？；：…', right(ws[i], 1)) > 0 THEN 0.18::DOUBLE ELSE 0 END + least(0.35::DOUBLE, greatest(0, ss[i + 1] - es[i]) / greatest(far, 0.1::DOUBLE) * 0.35::DOUBLE))) AS scores
                    FROM (SELECT q.job_id, q.cue_idx, a, z, ws, ss, es, far, list_sum(list_transform(ws[a + 1:z], lambda x: length(x))) + z - a - 1 AS size, list_sum(ks[a + 1:z]) AS ls, greatest(0.01::DOUBLE, es[z] - ss[a + 1]) AS secs
                        FROM ranges q JOIN b ON b.job_id = q.job_id AND b.cue_idx = q.cue_idx WHERE z - a >= 2)
                    WHERE size > round_even(30 + 20 * least(1, greatest(0, (ls / secs - 4) / 3)), 0) OR (secs > 5.8::DOUBLE AND ls >= 18 AND ls / secs < 6.5::DOUBLE)))
        ), leaves AS (SELECT job_id, cue_idx, a, min(z) AS z FROM ranges GROUP BY ALL
        ), n AS (SELECT *, row_number() OVER (PARTITION BY job_id, cue_idx ORDER BY a) - 1 AS part_idx, count(*) OVER (PARTITION BY job_id, cue_idx) AS parts FROM leaves)
        SELECT turns.job_id, turns.cue_idx, coalesce(part_idx, 0) AS part_idx, CASE WHEN coalesce(parts, 1) = 1 THEN text ELSE array_to_string(ws[a + 1:z], ' ') END AS text,
            CASE WHEN coalesce(part_idx, 0) = 0 THEN s0 ELSE greatest(s0, ss[a + 1]) END AS "start", CASE WHEN coalesce(part_idx + 1 = parts, true) THEN e0 ELSE least(e0, es[z]) END AS "end"
        FROM turns JOIN whole USING (job_id, cue_idx) LEFT JOIN n USING (job_id, cue_idx) LEFT JOIN b USING (job_id, cue_idx)""",
    "activity_segments": """
        WITH m AS (
            SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value >= 30 AS active FROM events
        ), i1 AS (SELECT *, frame - row_number() OVER (PARTITION BY job_id, active ORDER BY frame) AS g FROM m
        ), r1 AS (SELECT *, count(*) OVER (PARTITION BY job_id, active, g) AS n, min(frame) OVER (PARTITION BY job_id, active, g) AS lo,
                max(frame) OVER (PARTITION BY job_id, active, g) AS hi, max(frame) OVER (PARTITION BY job_id) AS top FROM i1
        ), filled AS (SELECT job_id, frame, active OR (n <= 1 AND lo > 0 AND hi < top) AS active FROM r1
        ), i2 AS (SELECT *, frame - row_number() OVER (PARTITION BY job_id, active ORDER BY frame) AS g FROM filled)
        SELECT job_id, min(frame) AS "first", max(frame) AS "last", count(*) AS n FROM i2 WHERE active GROUP BY job_id, g HAVING count(*) >= 2""",
    "onset_times": """
        WITH m AS (
            SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value >= 30 AS active FROM events
        ), i AS (SELECT *, frame - row_number() OVER (PARTITION BY job_id ORDER BY frame) AS g FROM m WHERE active
        ), s AS (SELECT job_id, min(frame) * 0.5::DOUBLE AS a, (max(frame) + 1) * 0.5::DOUBLE AS b FROM i GROUP BY job_id, g
        ), k AS (SELECT *, coalesce(a - lag(b) OVER (PARTITION BY job_id ORDER BY a) > 0.8::DOUBLE, true)::INT AS k FROM s
        ), ph AS (SELECT *, sum(k) OVER (PARTITION BY job_id ORDER BY a) AS p FROM k
        ), pt AS (SELECT job_id, frame AS cue_idx, frame * 0.5::DOUBLE + 0.125::DOUBLE AS t FROM m
        ), sn AS (SELECT job_id, cue_idx, arg_min(a, abs(a - t)) AS v FROM pt JOIN s USING (job_id) WHERE a BETWEEN t - 0.25 AND t + 0.3 GROUP BY ALL
        ), tl AS (SELECT job_id, cue_idx, arg_max(greatest(t, least(b, t + 4)), a) AS v FROM pt JOIN s USING (job_id) WHERE a <= t + 0.25 AND b >= t - 0.2 GROUP BY ALL
        ), fp AS (SELECT job_id, cue_idx, min(p) AS p FROM pt JOIN ph USING (job_id) WHERE b >= t - 0.1 AND a < t + 12 GROUP BY ALL
        ), pe AS (SELECT job_id, cue_idx, max(greatest(t, least(b, t + 12))) AS v FROM pt JOIN fp USING (job_id, cue_idx) JOIN ph USING (job_id, p) WHERE a < t + 12 GROUP BY ALL)
        SELECT job_id, cue_idx, coalesce(sn.v, t) AS snapped, coalesce(tl.v, t) AS tail, coalesce(pe.v, t) AS phrase
        FROM pt LEFT JOIN sn USING (job_id, cue_idx) LEFT JOIN tl USING (job_id, cue_idx) LEFT JOIN pe USING (job_id, cue_idx)""",
    "unit_gaps": f"""
        WITH {CUES}, g AS (
            SELECT job_id, CASE WHEN lead("start") OVER w IS NOT NULL THEN greatest(0.0::DOUBLE, lead("start") OVER w - "end") END AS gap
            FROM cues WINDOW w AS (PARTITION BY job_id ORDER BY cue_idx)
        )
        SELECT job_id, coalesce(max(gap), 0.0::DOUBLE) AS largest_gap,
            CASE WHEN count(*) FILTER (gap > 0.02::DOUBLE) >= 3 THEN quantile_cont(gap, 0.5) FILTER (gap > 0.02::DOUBLE) ELSE 0.0::DOUBLE END AS typical_gap
        FROM g GROUP BY job_id""",
    "waveform_peaks": """
        WITH s AS (
            SELECT vec_id AS job_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM embeddings
        ), b AS (SELECT job_id, least(7, i * 8 // n) AS bin, max(abs(v)) AS peak FROM s GROUP BY ALL
        ), p AS (SELECT job_id, quantile_cont(peak, 0.98) AS q FROM b GROUP BY job_id)
        SELECT job_id, bin, round(CASE WHEN q > 0 THEN least(1.0, peak / q) ELSE peak END, 6) AS peak FROM b JOIN p USING (job_id)""",
    "overlap_join": f"""
        WITH {LINES}, spans AS (
            SELECT job_id, cue_idx, sum(length(match_key)) OVER w - length(match_key) AS lo, sum(length(match_key)) OVER w AS hi
            FROM keyed WINDOW w AS (PARTITION BY job_id ORDER BY cue_idx)
        ), t AS (SELECT job_id, max(hi) AS n FROM spans GROUP BY job_id
        ), units AS (SELECT job_id, n, unnest(range(0, greatest(1, ceil(n / 40))::BIGINT)) AS u FROM t
        ), pieces AS (
            SELECT s.job_id, s.cue_idx, u, u + (greatest(lo, u * 40) - u * 40) * (1.0::DOUBLE / (least(u * 40 + 40, n) - u * 40)) AS a,
                u + (least(hi, u * 40 + 40) - u * 40) * (1.0::DOUBLE / (least(u * 40 + 40, n) - u * 40)) AS b
            FROM spans s JOIN units USING (job_id) WHERE greatest(lo, u * 40) < least(hi, least(u * 40 + 40, n))
        ), times AS (SELECT job_id, cue_idx, round(arg_min(a, u), 6) AS start_s, round(arg_max(b, u), 6) AS end_s FROM pieces GROUP BY ALL)
        SELECT spans.job_id, spans.cue_idx, start_s, end_s FROM spans LEFT JOIN times USING (job_id, cue_idx)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [demo_srt, split_lines, overlap_bounds, polish_cues, polish_singing_cues, out_of_order, activity_segments, waveform_peaks, overlap_join, onset_times, unit_gaps]
    found += [cut_parts, anchored_srt, merged_lines, line_of_unit, start_moves, unresolved_lines, local_windows, span_lines, raster_mask, level_frames, language_codes]
    found += [scalar_functions, text_rates, loud_frames, segment_units, line_report, unit_places, match_table, segmented_lines, paced_lines, aligned_srt]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
