"""Places of heard units in known text: a search that goes on from a cursor.

Each step begins where the one before ended, so a job's units go through one task, in time of a little more than their number: a
positional index of a long text gives every place of a key, in order, and a binary search the next one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import match_key, match_key_native
from cuewright.operators.intervals import char_spans, overlap_times
from cuewright.operators.jobs import doubles, ends_of, field, fields, keyed, keys_of, nulls, side_by_side
from cuewright.sources.tables import dealt, stored

FOUND = "array<struct<at: int, lo: int, hi: int>>"


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def locate(keys: Column, target: Column, back: int = 4, ahead: bool = True, only_forward: bool = False, strict: bool = False) -> Column:
    """Where each of a short array of keys stands in ``target``: struct(failed, spans), spans of (at, lo, hi), ``at`` the key's place in the array.

    For the units of a line; those of a whole job go through ``find_all``, as each step here copies the spans so far.

    A key is looked for from the cursor on, else from ``back`` characters before it; ``ahead`` bounds that second search
    to max(64, four times the key) characters after the cursor. The cursor goes to the end of what was found
    (``only_forward``: never back). Empty keys are passed over, and so are keys not found, unless ``strict``: then
    the first of them ends the search and ``failed`` is its place.
    """
    n = F.char_length(target)
    start = F.struct(F.lit(0).alias("cursor"), F.lit(None).cast("int").alias("failed"), F.array().cast(FOUND).alias("spans"))

    def place(state: Column, key: Column) -> Column:
        cursor, size = state["cursor"], F.char_length(key)
        low = F.greatest(F.lit(0), cursor - back)
        high = F.least(n, cursor + F.greatest(F.lit(64), size * 4)) if ahead else n
        near = F.position(key, F.substring(target, low + 1, high - low))
        return let(F.position(key, target, cursor + 1), lambda p: F.when(p > 0, p - 1).otherwise(let(near, lambda q: F.when(q > 0, low + q - 1))))

    def step(state: Column, item: Column) -> Column:
        def moved(lo: Column) -> Column:
            hi = lo + F.char_length(item["key"])
            span = F.struct(item["at"].cast("int").alias("at"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
            cursor = F.greatest(state["cursor"], hi) if only_forward else hi
            return F.struct(cursor.cast("int").alias("cursor"), state["failed"].alias("failed"), F.concat(state["spans"], F.array(span)).alias("spans"))

        missed = F.struct(state["cursor"].alias("cursor"), item["at"].cast("int").alias("failed"), state["spans"].alias("spans")) if strict else state
        done = (item["key"] == "") | item["key"].isNull() | state["failed"].isNotNull()
        return F.when(done, state).otherwise(let(place(state, item["key"]), lambda lo: F.when(lo.isNull(), missed).otherwise(moved(lo))))

    items = F.transform(keys, lambda key, i: F.struct(i.alias("at"), key.alias("key")))
    return F.aggregate(items, start, step, lambda state: F.struct(state["failed"].alias("failed"), state["spans"].alias("spans")))


class Places:
    """A positional index of a text: the places of each key, ascending, found once.

    A long text has all its places sorted by their first ``DEPTH`` letters, so that no key needs it read again; a short one is read.
    """

    DEPTH = 12
    LONG = 20_000

    def __init__(self, text: str):
        self.text, self.known = text, {}
        self.order = self._sorted(text) if len(text) > self.LONG else None

    @staticmethod
    def _sorted(text: str) -> np.ndarray:
        rank = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)[1].astype(np.int64) + 1
        for step in (1, 2, 3, 6):  # ranks by the first 2, 4, 7 and 13 letters
            after = np.zeros_like(rank)
            after[: max(0, len(rank) - step)] = rank[step:]
            rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        return np.argsort(rank, kind="stable")

    def of(self, key: str) -> list[int]:
        """All places of a key, which is not empty, ascending."""
        if (found := self.known.get(key)) is None and self.order is None:
            found, at = [], self.text.find(key)
            while at >= 0:
                found.append(at)
                at = self.text.find(key, at + 1)
            self.known[key] = found
        elif found is None:
            n, text, order = min(len(key), self.DEPTH), self.text, self.order
            head = key[:n]
            low = bisect_left(order, head, key=lambda p: text[p : p + n])
            high = bisect_left(order, True, lo=low, key=lambda p: text[p : p + n] != head)
            found = np.sort(order[low:high]).tolist()
            if len(key) > n:
                found = [p for p in found if text.startswith(key, p)]
            self.known[key] = found
        return found

    def next(self, key: str, low: int, high: int | None = None) -> int | None:
        """The first place of ``key`` from ``low`` on that ends by ``high``."""
        if self.order is None:
            place = self.text.find(key, low, high)
            return None if place < 0 else place
        places = self.of(key)
        k = bisect_left(places, low)
        return places[k] if k < len(places) and (high is None or places[k] + len(key) <= high) else None


def find_all(target: str, keys: list[str | None], back: int = 4, ahead: bool = True, only_forward: bool = False, strict: bool = False) -> tuple[list[int | None], int | None]:
    """What ``locate`` says, as the place of each key (None: passed over) and the place in the list of the one that ended a ``strict`` search."""
    index, cursor, found = Places(target), 0, []
    for at, key in enumerate(keys):
        place = None
        if key:
            place = index.next(key, cursor)
            if place is None:
                place = index.next(key, max(0, cursor - back), min(len(target), cursor + max(64, 4 * len(key))) if ahead else None)
            if place is not None:
                cursor = max(cursor, place + len(key)) if only_forward else place + len(key)
            elif strict:
                return found + [None] * (len(keys) - at), at
        found.append(place)
    return found, None


def line_spans(lines: DataFrame, native: bool = False) -> DataFrame:
    """Lines (job_id, cue_idx, text) with their ``key`` and its range ``lo``, ``hi`` in the job's joined keys."""
    keyed = stored(lines.withColumn("key", (match_key_native if native else match_key)(F.col("text"))))  # read twice
    return char_spans(keyed, F.col("key"), "cue_idx")


def unit_spans(lines: DataFrame, units: DataFrame, native: bool = False, **how) -> tuple[DataFrame, DataFrame]:
    """Units found in the joined keys of their job's lines, with ``lo`` and ``hi``; and (job_id, failed_unit) of the jobs whose strict search failed.

    ``lines`` come from ``line_spans``; ``how`` goes to ``find_all``. A job's text and units are one row of one task, and the search is made once, here.
    """
    ordered = lambda name, *columns: F.sort_array(F.collect_list(F.struct(*columns))).alias(name)
    target = lines.groupBy("job_id").agg(ordered("all", "cue_idx", "key")).select("job_id", F.array_join(F.transform("all", lambda x: x["key"]), "").alias("target"))
    keyed = units.withColumn("key", (match_key_native if native else match_key)(F.col("text")))
    heard = keyed.groupBy("job_id").agg(ordered("units", "unit_idx", "key", "start", "end"))
    kinds = dict(units.dtypes)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                items = batch.column("units").slice(row, 1).flatten()
                places, failed = find_all(batch.column("target")[row].as_py(), items.field("key").to_pylist(), **how)
                keep = [k for k, place in enumerate(places) if place is not None or k == failed]
                lo = pa.array([places[k] for k in keep], pa.int32())
                mine = items.take(pa.array(keep, pa.int64()))
                hi = pc.add(lo, pc.utf8_length(mine.field("key")))
                job = batch.column("job_id").take(pa.array([row] * len(keep), pa.int64()))
                yield pa.RecordBatch.from_arrays([job, mine.field("unit_idx"), lo, hi.cast(pa.int32()), mine.field("start"), mine.field("end")], ["job_id", "unit_idx", "lo", "hi", "start", "end"])

    schema = f"job_id {kinds['job_id']}, unit_idx {kinds['unit_idx']}, lo int, hi int, start {kinds['start']}, end {kinds['end']}"
    rows = stored(dealt(target.join(heard, "job_id").select("job_id", "target", "units"), "job_id").mapInArrow(found, schema))
    return rows.filter("lo IS NOT NULL"), rows.filter("lo IS NULL").select("job_id", F.col("unit_idx").alias("failed_unit"))


def strict_cues(lines: DataFrame, units: DataFrame, native: bool = False) -> DataFrame:
    """Lines with times from units, and ``status``: a job with a unit that is not in its text, a line without a
    key, or a line that no unit meets has null times in all lines and says so."""
    spans = stored(line_spans(lines, native))
    found, failed = unit_spans(spans, units, native, strict=True)
    timed = overlap_times(spans, found).join(failed, "job_id", "left")
    by_job = timed.groupBy("job_id").agg(F.bool_or(F.col("key") == "").alias("blank"), F.bool_or(F.col("start").isNull()).alias("unmet"), F.max(F.col("failed_unit").isNotNull()).alias("differs"))
    status = F.when(F.col("blank"), "line without letters or numbers").when(F.col("differs"), "performed lyrics may differ").when(F.col("unmet"), "line without times").otherwise("ok")
    rows = timed.join(by_job.select("job_id", status.alias("status")), "job_id")
    times = {c: F.when(F.col("status") == "ok", F.col(c)) for c in ("start", "end")}
    return rows.withColumns(times).drop("key", "lo", "hi", "failed_unit")


def _placed(lines: pa.StructArray, units: pa.StructArray, **how) -> tuple[np.ndarray, ...]:
    """Pairs (line, unit) that share letters, by unit and then by line, with the ranges lo, hi and ulo, uhi of both."""
    lines, said = keys_of(lines), keys_of(units)
    lo, hi = ends_of(lines)
    places, _ = find_all("".join(lines), said, **how)
    at = np.array([k for k, place in enumerate(places) if place is not None], np.int64)
    ulo = np.array([place for place in places if place is not None], np.int64)
    uhi = ulo + np.fromiter((len(said[k]) for k in at.tolist()), np.int64, len(at))
    some = np.flatnonzero(hi > lo)
    first, last = np.searchsorted(hi[some], ulo, "right"), np.searchsorted(lo[some], uhi, "left")
    n = last - first
    unit = np.repeat(np.arange(len(at)), n)
    line = some[np.arange(len(unit)) - np.repeat(np.cumsum(n) - n - first, n)]
    return line, at[unit], lo[line], hi[line], ulo[unit], uhi[unit]


def optional_cues(lines: DataFrame, units: DataFrame, native: bool = False) -> DataFrame:
    """Lines with times from units, as ``overlap_times`` gives them; null where no unit meets the line. Units that are not in the text are passed over."""
    rest = [f for f in fields(lines) if f.name not in ("job_id", "start", "end")]

    def step(mine: pa.StructArray, said: pa.StructArray) -> list[pa.Array]:
        line, unit, lo, hi, ulo, uhi = _placed(mine, said)
        us, ue = doubles(said, "start")[unit], doubles(said, "end")[unit]
        rate = (ue - us) / (uhi - ulo)
        times = []
        for place, pairs in ((np.maximum(lo, ulo), slice(None)), (np.minimum(hi, uhi), slice(None, None, -1))):
            value, none = us + (place - ulo) * rate, (nulls(said, "start") | nulls(said, "end"))[unit]
            met, at = np.unique(line[pairs], return_index=True)  # the first of each line, or the last
            time, unmet = np.zeros(len(mine)), np.ones(len(mine), bool)
            time[met], unmet[met] = value[pairs][at], none[pairs][at]
            times.append(pa.array(time, pa.float64(), mask=unmet))
        return [*(mine.field(f.name) for f in rest), *times]

    lines = keyed(lines.select("job_id", *(f.name for f in rest)), native)
    return side_by_side(lines, keyed(units.select("job_id", "unit_idx", "text", "start", "end"), native), step, [*rest, field("start"), field("end")])


def units_of_lines(lines: DataFrame, units: DataFrame, native: bool = False) -> DataFrame:
    """Units with ``cue_idx``: the line of the job that holds most of the unit's characters, the first of equals. Units not in the text are left out."""
    rest = [f for f in fields(units) if f.name not in ("job_id", "cue_idx")]

    def step(mine: pa.StructArray, said: pa.StructArray) -> list[pa.Array]:
        line, unit, lo, hi, ulo, uhi = _placed(mine, said, only_forward=True)
        order = np.lexsort((line, np.maximum(lo, ulo) - np.minimum(hi, uhi), unit))
        which, at = np.unique(unit[order], return_index=True)
        return [*(said.take(pa.array(which)).field(f.name) for f in rest), mine.field("cue_idx").take(pa.array(line[order][at]))]

    return side_by_side(keyed(lines.select("job_id", "cue_idx", "text"), native), keyed(units.select("job_id", *(f.name for f in rest)), native), step, [*rest, *fields(lines, "cue_idx")])
