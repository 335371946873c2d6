"""Subtitle files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.timecode import srt_time
from cuewright.operators.timing import even_slots
from cuewright.sources.lines import split_cues
from cuewright.sources.srt import read_srt, write_srt

__all__ = ["demo", "read_srt", "render_srt", "write_srt"]


def render_srt(cues: DataFrame, offset: float = 0.0, anchor: bool = False) -> DataFrame:
    """(job_id, srt). With ``anchor``, if the first start and the offset lie after 0.6 s, a blank cue up to 0.5 s comes first."""
    w = Window.partitionBy("job_id")
    first = F.min(F.col("start") + offset).over(w)
    anchored = (first > 0.6) if anchor else F.lit(False)
    number = F.row_number().over(w.orderBy("cue_idx")) + anchored.cast("int")
    time = F.concat(srt_time(F.col("start") + offset), F.lit(" --> "), srt_time(F.col("end") + offset))
    block = F.concat(number.cast("string"), F.lit("\n"), time, F.lit("\n"), F.coalesce("text", F.lit("null")))
    rows = cues.select("job_id", F.struct(number.alias("n"), block.alias("b")).alias("block"), anchored.alias("anchored"))
    blocks = rows.groupBy("job_id").agg(F.sort_array(F.collect_list("block")).alias("all"), F.first("anchored").alias("anchored"))
    lead = F.concat(F.lit("1\n"), srt_time(F.lit(0.0)), F.lit(" --> "), srt_time(F.lit(0.5)), F.lit("\n\u2800\n\n"))
    text = F.concat(F.array_join(F.transform("all", lambda x: x["b"]), "\n\n"), F.lit("\n"))
    return blocks.select("job_id", F.when(F.col("anchored"), F.concat(lead, text)).otherwise(text).alias("srt"))


def demo(texts: DataFrame, max_chars: int | None = None, compatibility: bool = False) -> DataFrame:
    """Texts (job_id, text, duration) as evenly timed subtitles: the query that needs no model."""
    return render_srt(even_slots(split_cues(texts, max_chars, compatibility=compatibility)))
