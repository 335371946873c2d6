"""Known lines against heard units: the match table.

The lines' keys and the units' keys of a job are aligned letter by letter (``pathways``); what the pairs say of each line is worked out beside them in
short jobs, and by joins and sums in long ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType

from cuewright.functions.text import match_key, match_key_native
from cuewright.operators.intervals import char_spans
from cuewright.operators.intervals import met as spans_met
from cuewright.operators.jobs import doubles, ends_of, field, fields, keyed, keys_of, nulls, side_by_side
from cuewright.operators.pathways import TILE, align, codes, pair_runs
from cuewright.operators.similarity import ratio, similarity
from cuewright.sources.tables import stored


def status_of(similarity: Column, coverage: Column) -> Column:
    return F.when((similarity >= 0.84) & (coverage >= 0.75), "match").when((similarity >= 0.48) & (coverage >= 0.45), "changed").otherwise("weak")


def usable(similarity: float = 0.48, coverage: float = 0.45) -> Column:
    """Whether a match may anchor others; windows ask for a similarity of 0.62."""
    timed = F.col("start").isNotNull() & F.col("end").isNotNull()
    return timed & (F.col("exact_characters") >= 2) & (F.col("similarity") >= similarity) & (F.col("coverage") >= coverage)


def _keyed(rows: DataFrame, order: str, native: bool) -> DataFrame:
    key = (match_key_native if native else match_key)(F.coalesce("text", F.lit("")))
    return char_spans(stored(rows.withColumn("key", key)), F.col("key"), order)  # read twice


def _joined(rows: DataFrame, order: str, name: str) -> DataFrame:
    """(job_id, name): a job's keys in order, as one text."""
    keys = F.sort_array(F.collect_list(F.struct(order, "key")))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(keys, lambda x: x["key"]), "").alias(name))


def _compared(lines: pa.StructArray, units: pa.StructArray) -> list[pa.Array]:
    """The match table of a job that is aligned in one step."""
    keys, said = keys_of(lines), keys_of(units)
    lo, hi = ends_of(keys)
    ulo, uhi = ends_of(said)
    source, heard = "".join(keys), "".join(said)
    found = align(source, heard) if heard else np.full(len(source), -1, np.int64)
    i = np.flatnonzero(found >= 0)
    j = found[i]
    pairs = np.searchsorted(i, lo), np.searchsorted(i, hi)
    equal = np.concatenate(([0], np.cumsum(codes(source)[i] == codes(heard)[j])))
    mapped, exact = pairs[1] - pairs[0], equal[pairs[1]] - equal[pairs[0]]
    met = np.flatnonzero(mapped)
    ends = j[pairs[0][met]], j[pairs[1][met] - 1]
    owners = [np.searchsorted(uhi, at, "right") for at in ends]
    us, ue = doubles(units, "start"), doubles(units, "end")
    unknown = nulls(units, "start")
    # As SQL has it: a unit without an end has no length.
    seconds = np.where(unknown | nulls(units, "end"), 0.0, np.maximum(0.0, ue - us))
    times = []
    for at, u in ((ends[0], owners[0]), (ends[1] + 1, owners[1])):
        time, none = np.zeros(len(lines)), np.ones(len(lines), bool)
        time[met], none[met] = us[u] + seconds[u] * (at - ulo[u]) / (uhi[u] - ulo[u]), unknown[u]
        times.append(pa.array(time, pa.float64(), mask=none))
    words = [(t or "").strip(" ") for t in units.field("text").to_pylist()]
    texts, alike = [""] * len(lines), np.zeros(len(lines))
    for k, u, v in zip(met.tolist(), owners[0].tolist(), owners[1].tolist(), strict=True):
        texts[k] = " ".join(filter(None, words[u : v + 1]))
        alike[k] = ratio(keys[k], heard[ulo[u] : uhi[v]])
    coverage = np.zeros(len(lines))
    coverage[met] = mapped[met] / (hi - lo)[met]
    compared = pa.array([bool(source and heard)] * len(lines), pa.bool_())
    return [lines.field("cue_idx"), lines.field("text"), pa.array(texts, pa.string()), *times, pa.array(alike), pa.array(coverage), pa.array(exact, pa.int32()), compared]


def match_lines(cues: DataFrame, units: DataFrame, native: bool = False, tile: int | None = None) -> DataFrame:
    """The match table of cues (job_id, cue_idx, text) and units (job_id, unit_idx, text, start, end).

    A line's heard text is that of all units from the first to the last that one of its letters met. A line that met none is weak; a
    job without any source or heard letters has only lines of status ``missing``. Units of no cue's job are left out. ``job_id`` may have any type.
    Jobs within a ``tile``, as most are, are compared where their lines and units lie side by side; the others' letters by many tasks.
    Cues and units are read twice, so what takes long to make is ``stored`` first.
    """
    size = tile or TILE
    lines = cues.select("job_id", F.col("cue_idx").cast("int").alias("cue_idx"), "text")
    units = units.select("job_id", "unit_idx", "text", "start", "end")
    letters = lambda rows: rows.groupBy("job_id").agg(F.sum(F.greatest(F.lit(1), F.char_length("text"))).alias("n")).filter(F.col("n") > size)
    large = stored(letters(lines).unionByName(letters(units)).select("job_id").distinct())
    if large.isEmpty():
        return _side_by_side(lines, units, native)
    less, more = ([rows.join(large, "job_id", how) for rows in (lines, units)] for how in ("left_anti", "left_semi"))
    return _side_by_side(*less, native).unionByName(_tiled(*more, native, tile))


def _judged(rows: DataFrame) -> DataFrame:
    status = F.when(F.coalesce("compared", F.lit(False)), status_of(F.col("similarity"), F.col("coverage"))).otherwise("missing")
    return rows.select("job_id", "cue_idx", F.col("text").alias("source_text"), "transcript_text", "start", "end", "similarity", "coverage", "exact_characters", status.alias("status"))


def _side_by_side(lines: DataFrame, units: DataFrame, native: bool) -> DataFrame:
    values = [field("transcript_text", StringType()), *map(field, ("start", "end", "similarity", "coverage")), field("exact_characters", IntegerType()), field("compared", BooleanType())]
    return _judged(side_by_side(keyed(lines, native), keyed(units, native), _compared, [*fields(lines, "cue_idx", "text"), *values]))


def _tiled(cues: DataFrame, units: DataFrame, native: bool, tile: int | None) -> DataFrame:
    """The match table of long jobs: their pairs in runs, joined with lines and units by blocks of letters."""
    key = ["job_id", "cue_idx"]
    lines = stored(_keyed(cues, "cue_idx", native))
    heard = stored(_keyed(units, "unit_idx", native))
    jobs = stored(_joined(lines, "cue_idx", "source").join(_joined(heard, "unit_idx", "heard"), "job_id"))
    runs = pair_runs(jobs, tile).select("job_id", F.col("i").alias("ulo"), (F.col("i") + F.col("n")).alias("uhi"), "j", "same")
    shared = F.least("hi", "uhi") - F.greatest("lo", "ulo")
    pieces = spans_met(lines.select(*key, "lo", "hi"), runs).select(*key, "same", shared.alias("k"), (F.col("j") + F.greatest("lo", "ulo") - F.col("ulo")).alias("at"))
    met = pieces.groupBy(*key).agg(
        F.sum("k").alias("mapped"), F.sum(F.when(F.col("same"), F.col("k")).otherwise(0)).cast("int").alias("exact_characters"), F.min("at").alias("first"), F.max(F.col("at") + F.col("k") - 1).alias("last")
    )
    # The units of the first and of the last letter, and the letters' shares of their time.
    ends = met.withColumn("_end", F.explode(F.array(F.struct(F.lit(0).alias("is"), F.col("first").alias("at")), F.struct(F.lit(1).alias("is"), F.col("last").alias("at")))))
    ends = ends.select(*key, "mapped", "exact_characters", F.col("_end.is").alias("is"), F.col("_end.at").alias("lo"), (F.col("_end.at") + 1).alias("hi"))
    place = heard.select("job_id", "unit_idx", F.col("lo").alias("ulo"), F.col("hi").alias("uhi"), F.col("start").alias("us"), F.col("end").alias("ue"))
    at, width, seconds = F.col("lo") - F.col("ulo"), F.col("uhi") - F.col("ulo"), F.greatest(F.lit(0.0), F.col("ue") - F.col("us"))
    of = lambda end, value: F.max_by(value, F.when(F.col("is") == end, 1))
    met = spans_met(ends, place).groupBy(*key, "mapped", "exact_characters").agg(
        of(0, F.col("unit_idx")).alias("u0"), of(0, F.col("us") + seconds * at / width).alias("start"), of(1, F.col("unit_idx")).alias("u1"), of(1, F.col("us") + seconds * (at + 1) / width).alias("end")
    )
    met = stored(met)
    # Ranges of following lines follow each other, so a unit is in two of them at most.
    ranged = met.select(*key, F.explode(F.sequence("u0", "u1")).alias("unit_idx")).hint("merge").join(heard.select("job_id", "unit_idx", "text", "key"), ["job_id", "unit_idx"])
    said = ranged.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("unit_idx", F.trim("text").alias("text"), F.col("key").alias("k")))).alias("all"))
    texts = F.filter(F.transform("all", lambda x: F.coalesce(x["text"], F.lit(""))), lambda t: t != "")
    said = said.select(*key, F.array_join(texts, " ").alias("transcript_text"), F.array_join(F.transform("all", lambda x: x["k"]), "").alias("heard"))
    known = jobs.select("job_id", ((F.col("source") != "") & (F.col("heard") != "")).alias("compared"))
    rows = lines.join(met.drop("u0", "u1"), key, "left").join(said, key, "left").join(known, "job_id", "left")
    found = F.col("mapped").isNotNull()
    zero = F.lit(0.0)
    rows = rows.withColumns(
        {
            "similarity": F.when(found, similarity(F.col("key"), F.col("heard"))).otherwise(zero),
            "coverage": F.when(found, F.col("mapped") / F.char_length("key")).otherwise(zero),
            "exact_characters": F.coalesce("exact_characters", F.lit(0)),
            "transcript_text": F.coalesce("transcript_text", F.lit("")),
        }
    )
    return _judged(rows)


def partial_span(matches: DataFrame) -> DataFrame:
    """(job_id, first, last): the lines between the first and the last usable match; nulls where there is none."""
    idx = F.when(usable(), F.col("cue_idx"))
    return matches.groupBy("job_id").agg(F.min(idx).alias("first"), F.max(idx).alias("last"))
