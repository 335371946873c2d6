"""Cutting aligned lines at pauses and by pace. A line's words and units are arrays of one row.

Units are looked for from a cursor on and a cut makes the ranges for the next, so these steps are loops over a line's own words, in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import SENTENCE_END, match_key_native, squeeze
from cuewright.operators.locate import units_of_lines

#: Fixed value. Marks after which a cut is good.
CUT_MARKS = ",.!?;:，。！？；：…"
UNIT = "struct<unit_idx: long, text: string, start: double, end: double>"
PARTS = "array<struct<text: string, start: double, end: double>>"
Word = tuple[str, float, float]


def _least(*values: float | None) -> float | None:
    return min((v for v in values if v is not None), default=None)


def _greatest(*values: float | None) -> float | None:
    return max((v for v in values if v is not None), default=None)


def timed_words(words: list[str], keys: list[str], start: float | None, end: float | None, units: Sequence[tuple]) -> list[Word]:
    """Words (text, start, end) of a cue from its units (key, start, end) in order; ``keys`` are the words', none of them empty.

    A unit is looked for from the end of those before it on, else from 3 letters before. Each word takes its linear share of the units over it,
    within the cue. Without units, with fewer than two words, or with a word that no
    unit meets or without times, there are none.
    """
    if len(words) < 2 or not units:
        return []
    ends = [0, *accumulate(map(len, keys))]
    first, last = [None] * len(words), [None] * len(words)
    target, cursor = "".join(keys), 0
    for key, begins, stops in units:
        if not key:
            continue
        if (place := target.find(key, cursor)) < 0 and (place := target.find(key, max(0, cursor - 3))) < 0:
            continue
        hi = place + len(key)
        cursor = max(cursor, hi)
        k, span = bisect_right(ends, place) - 1, (place, hi, begins, stops)
        while k < len(words) and ends[k] < hi:
            first[k], last[k] = first[k] or span, span
            k += 1

    def time(span: tuple, place: int) -> float | None:
        lo, hi, a, b = span
        return None if a is None else a + (0.0 if b is None else max(0.0, b - a)) * ((place - lo) / (hi - lo))

    if None in first:
        return []
    found = [(text, _greatest(start, time(a, max(a[0], lo))), _least(end, time(b, min(b[1], hi)))) for text, a, b, (lo, hi) in zip(words, first, last, pairwise(ends), strict=True)]
    return found if all(w[1] is not None and w[2] is not None for w in found) else []


def largest_gap(units: Column) -> Column:
    """The largest silence between neighbours of an array of units; 0 for fewer than two."""
    after = F.slice(units, 2, F.greatest(F.size(units), F.lit(1)))
    gaps = F.zip_with(units, after, lambda a, b: F.greatest(F.lit(0.0), b["start"] - a["end"]))
    return F.when(F.size(units) < 2, 0.0).otherwise(F.coalesce(F.array_max(gaps), F.lit(0.0)))


def best_cut(words: list[Word], chars: list[int], letters: list[int], good: list[float], a: int, b: int, preferred: int, hard: int, slow: float) -> int | None:
    """Where words ``a`` to ``b`` (exclusive) are cut in two, or None if they stay together.

    They are cut while they are longer than their pace allows, or slow: over ``slow`` seconds, with 18 letters or
    0.6 ``preferred``, under 6.5 a second. The best cut is near the middle of text and time, or ``good``: after a mark, in a pause. ``chars`` and
    ``letters`` are prefix sums over the words.
    """
    if b - a < 2:
        return None
    began = words[a][1]
    length, seconds, sung = chars[b] - chars[a] + b - a - 1, max(0.01, words[b - 1][2] - began), letters[b] - letters[a]
    pace = sung / seconds
    allowed = round(preferred + (hard - preferred) * min(1.0, max(0.0, (pace - 4.0) / 3.0)))
    if length <= allowed and not (seconds > slow and sung >= max(18, round(0.6 * preferred)) and pace < 6.5):
        return None
    best, at = None, a
    for i in range(a + 1, b):
        left = chars[i] - chars[a] + i - a - 1
        off = abs(left / max(1, length) - 0.5) * 0.65 + abs((words[i][1] - began) / seconds - 0.5) * 0.35
        if left < 3 or chars[b] - chars[i] + b - i - 1 < 3:
            off += 0.5
        if best is None or off - good[i] < best:
            best, at = off - good[i], i
    return at


def cuts(words: list[Word], letters: list[int], preferred: int, hard: int, pause: float, slow: float) -> list[int]:
    """All cuts of a line, ascending: those at long silences, and those that ranges between them need by pace, until none does."""
    gaps = [max(0.0, after[1] - word[2]) for word, after in pairwise(words)]
    wide = sorted(g for g in gaps if g > 0.02)
    typical = (wide[(len(wide) - 1) // 2] + wide[len(wide) // 2]) / 2 if len(wide) >= 3 else 0.0
    long_gap = max(pause, min(2.2, typical * 4.0))
    found = [i for i, g in enumerate(gaps, 1) if g >= long_gap or (g >= min(long_gap, 1.2) and words[i - 1][0][-1] in SENTENCE_END)]
    chars = [0, *accumulate(len(w[0]) for w in words)]
    good = [0.0] + [(0.18 if word[0][-1] in CUT_MARKS else 0.0) + min(0.35, g / max(long_gap, 0.1) * 0.35) for word, g in zip(words, gaps, strict=False)]
    ranges = list(pairwise([0, *found, len(words)]))
    while ranges:
        a, b = ranges.pop()
        if (at := best_cut(words, chars, letters, good, a, b, preferred, hard, slow)) is not None:
            found.append(at)
            ranges += [(a, at), (at, b)]
    return sorted(found)


def split_lines(cues: DataFrame, preferred: int = 30, hard: int = 50, pause: float = 1.7, slow: float = 5.8) -> DataFrame:
    """Cues (job_id, cue_idx, text, start, end, units) in parts: adds ``part_idx``, gives each part its text and times, and drops ``units``.

    A line is cut where the silence between words is long: ``pause``, or four times the median of three or more silences over
    0.02, up to 2.2; after the end of a sentence 1.2 will do. What is left is cut by pace. The first part keeps the
    cue's start and the last its end. A line without timed words, or without a cut, stays as it is.
    """
    if not 1 <= preferred <= hard:
        raise ValueError("1 <= preferred <= hard")

    def parts(text: str | None, start: float | None, end: float | None, words: list[str], keys: list[str], units: list[tuple]) -> list[tuple]:
        some = [k for k, key in enumerate(keys) if key]
        words, keys = [words[k] for k in some], [keys[k] for k in some]
        timed = timed_words(words, keys, start, end, units)
        at = cuts(timed, [0, *accumulate(map(len, keys))], preferred, hard, pause, slow) if timed else []
        if not at:
            return [(text, start, end)]
        found = []
        for a, b in pairwise([0, *at, len(timed)]):
            begins = _greatest(start, timed[a][1]) if a else start
            ends = _least(end, timed[b - 1][2]) if b < len(timed) else end
            found.append((" ".join(w[0] for w in timed[a:b]), begins, _greatest(begins, ends)))
        return found

    def batch(text: pa.Array, start: pa.Array, end: pa.Array, words: pa.Array, keys: pa.Array, unit_keys: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = zip(*(column.to_pylist() for column in (text, start, end, words, keys, unit_keys, starts, ends)), strict=True)
        found = [parts(t, a, b, w or [], k or [], list(zip(u or [], x or [], y or [], strict=True))) for t, a, b, w, k, u, x, y in rows]
        flat = [part for line in found for part in line]
        columns = [pa.array([part[k] for part in flat], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
        offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["text", "start", "end"]))

    word = F.split(squeeze(F.col("text")), " ")
    times = [F.col(f"units.{c}").cast("array<double>") for c in ("start", "end")]
    given = [F.col("text"), F.col("start").cast("double"), F.col("end").cast("double"), word, F.transform(word, match_key_native), F.transform("units", lambda u: match_key_native(u["text"])), *times]
    others = [c for c in cues.columns if c not in ("text", "start", "end", "units")]
    rows = cues.select(*others, F.posexplode(F.arrow_udf(batch, PARTS)(*given)).alias("part_idx", "_part"))
    return rows.select(*others, "part_idx", "_part.text", "_part.start", "_part.end")


def auto_segment(lines: DataFrame, cues: DataFrame, global_units: DataFrame, local_units: DataFrame, preferred: int = 30, hard: int = 50, pause: float = 1.7, native: bool = False) -> DataFrame:
    """Aligned lines (job_id, cue_idx, text, start, end, weak) cut by the times of their units.

    A line goes by its local units (with ``cue_idx``), else by the units of the whole text that fall to it. A ``weak`` line with a
    pause of ``pause`` seconds in the latter, and none of a second in the former, goes by the latter and takes its times from them.
    """
    gathered = lambda units, name: units.groupBy("job_id", "cue_idx").agg(F.sort_array(F.collect_list(F.struct(F.col("unit_idx").cast("long").alias("unit_idx"), "text", "start", "end"))).alias(name))
    rows = cues.join(gathered(units_of_lines(lines, global_units, native), "_global"), ["job_id", "cue_idx"], "left").join(gathered(local_units, "_local"), ["job_id", "cue_idx"], "left")
    none = F.array().cast(f"array<{UNIT}>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("_global", "_local")})
    better = F.col("weak") & (F.size("_global") >= 2) & (largest_gap(F.col("_global")) >= pause) & (largest_gap(F.col("_local")) < 1.0)
    rows = rows.withColumn("_better", F.coalesce(better, F.lit(False)))
    rows = rows.withColumns(
        {
            "units": F.when(F.col("_better") | (F.size("_local") == 0), F.col("_global")).otherwise(F.col("_local")),
            "start": F.when(F.col("_better"), F.get("_global", F.lit(0))["start"]).otherwise(F.col("start")),
            "end": F.when(F.col("_better"), F.element_at("_global", -1)["end"]).otherwise(F.col("end")),
        }
    )
    return split_lines(rows.drop("_global", "_local", "_better"), preferred, hard, pause)
