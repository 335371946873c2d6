"""Cue timing rules. Tables have job_id, cue_idx, start, end. Neighbours and running values come from ``scan``, so a long job fills many tasks; ``short`` is its."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.text import SENTENCE_END, match_key_native
from cuewright.operators.scan import scan
from cuewright.sources.tables import stored


def by_job():
    return Window.partitionBy("job_id").orderBy("cue_idx")


def even_slots(cues: DataFrame, duration: str = "duration") -> DataFrame:
    """Cue i of n gets [i * d / n, min(d, (i + 1) * d / n)]."""
    one, d = F.lit(1).cast("long"), F.col(duration)
    rows = scan(cues, "cue_idx", _n=("total", one), _i=("sum", one))
    n, i = F.col("_n"), F.col("_i") - 1
    return rows.withColumns({"start": i * d / n, "end": F.least(d, (i + 1) * d / n)}).drop("_n", "_i")


def bound_overlaps(cues: DataFrame, short: bool = False) -> DataFrame:
    """A cue ends where the next one starts, if that is earlier, but not before its own start."""
    after = F.col("_after")
    rows = scan(cues, "cue_idx", short=short, _after=("lead", F.col("start")))
    return rows.withColumn("end", F.when(F.col("end") > after, F.greatest("start", after)).otherwise(F.col("end"))).drop("_after")


def polish(cues: DataFrame, lead: float = 0.08, pad: float = 0.3, shortest: float = 0.5, gap: float = 0.02) -> DataFrame:
    """Earlier starts, padded ends, a least length, and a gap before the next start."""
    early = cues.withColumn("_start", F.greatest(F.lit(0.0), F.col("start") - lead))
    early, after = scan(early, "cue_idx", _after=("lead", F.col("_start"))), F.col("_after")
    want = F.greatest(F.col("end") + pad, F.col("_start") + shortest)
    end = F.when(after.isNull(), want).otherwise(F.least(want, F.greatest(F.col("_start"), after - gap)))
    return early.withColumn("end", end).withColumn("start", F.col("_start")).drop("_start", "_after")


def polish_singing(cues: DataFrame, lead: float = 0.0, hold: float = 0.5, shortest: float = 0.5, longest: float = 10.0, gap: float = 0.08, short: bool = False) -> DataFrame:
    """Hold cues over the silence after them, with a soft cap on their length (0: no cap).

    Optional columns: ``acoustic_start`` (a snapped onset; only ever moves a start later) and ``vocal_end``
    (where the voice ends; without it, the cue's own end). A cue longer than the cap is not trusted to end where it says, so it neither
    holds back the next start nor the gap before that.
    """
    heard = lambda name, other: F.coalesce(name, other) if name in cues.columns else F.col(other)
    long = (F.col("end") - F.col("start") > longest) if longest > 0 else F.lit(False)
    rows = cues.withColumns({"_voice": heard("vocal_end", "end"), "_long": long})
    early = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), F.col("start"), heard("acoustic_start", "start")) - lead)
    # What shows the next cue is its own early start and this cue's trusted end, so neighbours say all.
    own_end = F.when(~F.col("_long"), F.col("end"))
    rows = scan(rows.withColumn("_early", early), "cue_idx", short=short, _before=("lag", own_end), _after=("lead", F.col("_early")))
    rows = rows.withColumn("_shown", F.greatest("_early", "_before"))  # greatest passes over nulls
    following = F.when(F.col("_after").isNotNull(), F.greatest(F.col("_after"), own_end))
    rows = rows.withColumns({"_trusted": F.when(F.col("_long"), F.col("_shown")).otherwise(F.col("end")), "_next": following})
    want = F.greatest("_trusted", "_voice") + hold
    if longest > 0:
        want = F.greatest(F.least(want, F.col("_shown") + longest), "_voice")
    blank = F.when(F.col("_next") - F.col("_trusted") >= gap, gap).otherwise(0.0)
    boundary = F.greatest("_shown", F.col("_next") - blank)
    end = F.least(F.greatest(want, F.col("_shown") + shortest), F.when(F.col("_next").isNotNull(), boundary))
    return rows.withColumn("end", F.greatest("_shown", end)).withColumn("start", F.col("_shown")).drop("_voice", "_long", "_early", "_before", "_after", "_shown", "_trusted", "_next")


def reject_out_of_order(cues: DataFrame, source: str = "source_idx", slack: float = 0.25, short: bool = False) -> DataFrame:
    """Adds ``rejected``: a run of cues of one source whose first cue starts ``slack`` before the first cue of any earlier run."""
    leads = F.col("_source").isNull() | ~F.col("_source.s").eqNullSafe(F.col(source))
    rows = scan(cues, "cue_idx", short=short, _source=("lag", F.struct(F.col(source).alias("s"))))
    if short:
        rows = scan(rows.withColumn("_leads", leads), "cue_idx", short=True, _latest=("max_before", F.when(F.col("_leads"), F.col("start"))))
        late = F.when(F.col("_leads"), F.col("start") < F.coalesce("_latest", F.lit(-1.0)) - slack)
        return scan(rows.withColumn("_late", late), "cue_idx", short=True, rejected=("last", F.col("_late"))).drop("_source", "_leads", "_latest", "_late")
    rows = stored(rows)
    leaders = scan(rows.filter(leads).select("job_id", "cue_idx", "start"), "cue_idx", _latest=("max_before", F.col("start")))
    late = leaders.select("job_id", "cue_idx", (F.col("start") < F.coalesce("_latest", F.lit(-1.0)) - slack).alias("_late"))
    judged = stored(rows.drop("_source").join(late, ["job_id", "cue_idx"], "left"))
    return scan(judged, "cue_idx", rejected=("last", F.col("_late"))).drop("_late")


def merge_wrapped(cues: DataFrame, preferred: int = 30, most_gap: float = 0.15) -> DataFrame:
    """Join adjacent lines that read as one, greedily from the left; pairs never chain. Adds ``merged``.

    Needs ``text`` and ``barrier_before``, and rows that are lines; a line in several parts has them under one
    ``source_idx`` if there is that column, and joins nothing. A pair joins without a barrier between, over a gap of -0.05 to
    ``most_gap`` seconds, if the left does not end a sentence, both and a space have at most ``preferred`` characters,
    and the longer has max(12, 0.65 * ``preferred``) letters and numbers.
    """
    has_parts = "source_idx" in cues.columns
    line = F.col("source_idx") if has_parts else F.col("cue_idx")
    single = (F.count(F.lit(1)).over(Window.partitionBy("job_id", "source_idx")) == 1) if has_parts else F.lit(True)
    rows = cues.withColumns({"_letters": F.char_length(match_key_native(F.col("text"))), "_single": single, "_line": line})
    after = {c: F.lead(c).over(by_job()) for c in ("start", "text", "barrier_before", "_letters", "end", "_single", "_line")}
    both = F.trim(F.concat_ws(" ", "text", after["text"]))
    ends = F.col("text").rlike("[" + re.escape(SENTENCE_END) + r"]\z") | (F.col("text") == "")
    fits = (
        F.col("_single")
        & after["_single"]
        & (after["_line"] == F.col("_line") + 1)
        & ~after["barrier_before"]
        & (after["start"] - F.col("end")).between(-0.05, most_gap)
        & ~ends
        & (F.char_length(both) <= preferred)
        & (F.greatest("_letters", after["_letters"]) >= max(12, round(0.65 * preferred)))
    )
    rows = rows.withColumns({"_fits": F.coalesce(fits, F.lit(False)), "_text": both, "_end": F.greatest("end", after["end"])})
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_fits"), 0).otherwise(1)).over(by_job()))
    in_run = Window.partitionBy("job_id", "_run", "_fits").orderBy("cue_idx")
    rows = rows.withColumn("merged", F.col("_fits") & (F.row_number().over(in_run) % 2 == 1))
    rows = rows.withColumn("_right", F.coalesce(F.lag("merged").over(by_job()), F.lit(False))).filter(~F.col("_right"))
    joined = {c: F.when(F.col("merged"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("text", "end")}
    return rows.withColumns(joined).drop(*[c for c in rows.columns if c.startswith("_")])
