"""Alignment of two texts of a job, letter by letter, in tiles.

The score of a pair of places depends on its three neighbours alone, so the table of all pairs is cut into tiles of bounded size: a tile
needs the last row of the tile above and the last column of the one before. Tiles of one diagonal are worked out together, for
all jobs, but only those that a band about the best ways touches (``Band``), and their edges are kept; the way back is found again within the tiles it crosses, one of each job a round. A job
whose texts fit one tile, as most do, is done in one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.sources.tables import dealt, stored

MATCH, MISMATCH, GAP = 3, -2, -2
#: Letters of a tile's sides; bytes of a tile's scores that are all kept, and rows worked out again at a time where they are more.
TILE, KEPT, ROWS = 16384, 1 << 25, 256
#: A band is tried first that has room for a LOST-th of the source without partners; it must leave out 1 - NARROW of the table.
LOST, NARROW = 10, 0.7
RUNS = "i int, j int, n int, same boolean"


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Tile:
    """Scores of a tile, with what gaps cost by place taken off both ways, so that a gap costs nothing and a step is three operations on a row.

    ``top`` is the row above from the column before on, ``left`` the column before. With ``moves`` the way back can be found: a small tile
    keeps its scores, of a large one each ``ROWS``-th row is kept and those between are worked out again where the way comes by.
    """

    def __init__(self, source: np.ndarray, heard: np.ndarray, top: np.ndarray, left: np.ndarray, moves: bool):
        n, m, self.base = len(source), len(heard), int(top[0])
        gain = MATCH - 2 * GAP
        most = max(int((top + gain * np.minimum(n, np.arange(m, -1, -1))).max()), int((left + gain * np.minimum(m, np.arange(n, 0, -1))).max()) + gain) - self.base
        self.kind = np.int16 if most < 1 << 15 else np.int32
        self.source, self.heard = source.tolist(), heard
        self.gains = {c: np.where(heard == c, gain, MISMATCH - 2 * GAP).astype(self.kind) for c in set(self.source)}
        self.left = (left - self.base).tolist()
        row = (top - self.base).astype(self.kind)
        self.step = 0 if not moves else 1 if (n + 1) * (m + 1) * row.itemsize <= KEPT else ROWS
        right = np.empty(n, np.int64)
        if self.step == 1:
            self.rows = np.empty((n + 1, m + 1), self.kind)
            self.rows[0] = row
            self._fill(self.rows, 0)
            row, right[:] = self.rows[n], self.rows[1:, -1]
        else:
            self.rows = []
            for k in range(0, n, ROWS):
                block = np.empty((min(ROWS, n - k) + 1, m + 1), self.kind)
                block[0] = row
                if self.step:
                    self.rows.append(row)
                self._fill(block, k)
                row = block[-1].copy()
                right[k : k + len(block) - 1] = block[1:, -1]
        self.bottom, self.right = row.astype(np.int64) + self.base, right + self.base

    def _fill(self, block: np.ndarray, first: int) -> None:
        """The rows of a block after its first, which is row ``first`` of the tile."""
        width = block.shape[1]
        best = np.empty(width, self.kind)
        inner = best[1:]
        gains = {c: g[: width - 1] for c, g in self.gains.items()}
        row = block[0]
        for new, c, edge in zip(block[1:], self.source[first:], self.left[first:], strict=False):
            np.add(row[:-1], gains[c], out=inner)
            np.maximum(inner, row[1:], out=inner)
            best[0] = edge
            np.maximum.accumulate(best, out=new)
            row = new

    def back(self, i: int, j: int) -> tuple[list[int], list[int], int, int]:
        """The pairs on the way from a place (counted from 1) to the tile's edge, and the place beyond it where the way leaves."""
        a, b = [], []
        source, heard = self.source, self.heard.tolist()
        same, other = MATCH - 2 * GAP, MISMATCH - 2 * GAP
        while i and j:
            if self.step == 1:
                low, block = 0, self.rows
            else:
                low = (i - 1) // ROWS * ROWS
                block = np.empty((i - low + 1, j + 1), self.kind)
                block[0] = self.rows[low // ROWS][: j + 1]
                self._fill(block, low)
            score = block.item
            while i > low and j:
                here = score(i - low, j)
                # Of equal ways a pair comes first, then a source letter without a partner.
                if here == score(i - low - 1, j - 1) + (same if source[i - 1] == heard[j - 1] else other):
                    i, j = i - 1, j - 1
                    a.append(i)
                    b.append(j)
                elif here == score(i - low - 1, j):
                    i -= 1
                else:
                    j -= 1
        return a, b, i, j


def _edges(n: int, m: int, j: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The row above the whole table, where all of ``heard`` is free, and the column before it, where the source is lost."""
    return -GAP * np.arange(j, j + m + 1), np.zeros(n, np.int64)


class Band:
    """The scores of a ``Tile`` over the whole table, of places (i, j) with -``lost`` <= j - i <= ``lost`` + m - n alone.

    A source letter without a partner and a pair of different letters each take MATCH - GAP off the score of n equal pairs, so a way
    outside of the band, on which more than ``lost`` letters have no partner, takes off more than ``lost`` of these: where the best
    in the band takes off no more (``needed``), it is the best of all, and all ways as good lie in the band.
    """

    def __init__(self, source: np.ndarray, heard: np.ndarray, lost: int):
        n, m = len(source), len(heard)
        self.lost, width, gain = lost, 2 * lost + m - n + 1, MATCH - 2 * GAP
        kind = np.int16 if gain * n - 2 * GAP * (m + lost) < 1 << 15 else np.int32
        outside = 2 * GAP * n - 8
        padded = np.concatenate((np.zeros(lost, np.uint32), heard, np.zeros(lost, np.uint32)))
        self.source, self.heard = source.tolist(), heard.tolist()
        gains = {c: np.where(padded == c, gain, MISMATCH - 2 * GAP).astype(kind) for c in set(self.source)}
        # Column k of row i is place j = i - lost + k; after the last stands one that no way comes from.
        self.rows = np.empty((n + 1, width + 1), kind)
        self.rows[:, width] = outside
        j = np.arange(width) - lost
        self.rows[0, :width] = np.where(j < 0, outside, -GAP * j)
        best = np.empty(width, kind)
        row = self.rows[0]
        for at, (c, new) in enumerate(zip(self.source, self.rows[1:], strict=True)):
            np.add(row[:-1], gains[c][at : at + width], out=best)
            np.maximum(best, row[1:], out=best)
            np.maximum.accumulate(best, out=new[:-1])
            row = new
        first, last = max(0, n - lost), min(m, m + lost)
        ends = row[first - n + lost : last - n + lost + 1] + GAP * np.arange(first, last + 1)
        self.end = int(ends.argmax()) + first
        self.needed = ((MATCH - GAP) * n - int(ends.max())) // (MATCH - GAP)

    def back(self) -> tuple[list[int], list[int]]:
        """The pairs on the way back, last first; of equal ways as in ``Tile``."""
        a, b = [], []
        source, heard, score = self.source, self.heard, self.rows.item
        same, other = MATCH - 2 * GAP, MISMATCH - 2 * GAP
        i, j = len(source), self.end
        k = j - i + self.lost
        here = score(i, k)
        while i and j:
            before = score(i - 1, k)
            if here == before + (same if source[i - 1] == heard[j - 1] else other):
                i, j, here = i - 1, j - 1, before
                a.append(i)
                b.append(j)
            elif here == score(i - 1, k + 1):
                i, k = i - 1, k + 1
            else:
                j, k = j - 1, k - 1
                here = score(i, k)
        return a, b


def _banded(source: np.ndarray, heard: np.ndarray) -> Band | None:
    """The band that holds all best ways, if it is much narrower than the table and its scores can be kept."""
    n, m = len(source), len(heard)
    lost = n // LOST + max(0, n - m) // 2 + 8
    for _ in range(2):  # the second is as wide as the first one needs
        lost = max(lost, n - m)
        width = 2 * lost + m - n + 1
        if width > NARROW * m or (n + 1) * (width + 1) * 4 > KEPT:
            return None
        band = Band(source, heard, lost)
        if band.needed <= lost:
            return band
        lost = band.needed
    return None


def align(source: str, heard: str) -> np.ndarray:
    """For each source character the place of its partner in ``heard``, or -1.

    Global in ``source``; what ``heard`` has before and after is free, and of equal ends the first counts.
    """
    s, h = codes(source), codes(heard)
    out = np.full(len(s), -1, np.int64)
    if len(s) and (band := _banded(s, h)):
        a, b = band.back()
        out[a] = b
    elif len(s):
        tile = Tile(s, h, *_edges(len(s), len(h)), moves=True)
        a, b, _, _ = tile.back(len(s), int((tile.bottom + GAP * np.arange(len(h) + 1)).argmax()))
        out[a] = b
    return out


def runs_of(i: np.ndarray, j: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs in ascending order as runs (i, j, n, same) of pairs that follow each other and are all of one kind."""
    first = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 1) | (np.diff(j) != 1) | (same[1:] != same[:-1])))) if len(i) else np.zeros(0, np.int64)
    return i[first], j[first], np.diff(np.append(first, len(i))), same[first]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            source, heard = batch.column("source")[row].as_py(), batch.column("heard")[row].as_py()
            found = align(source, heard)
            i = np.flatnonzero(found >= 0)
            i, j, n, same = runs_of(i, found[i], codes(source)[i] == codes(heard)[found[i]])
            job = batch.column("job_id").take(pa.array([row] * len(i), pa.int64()))
            yield pa.RecordBatch.from_arrays([job, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n, pa.int32()), pa.array(same, pa.bool_())], ["job_id", "i", "j", "n", "same"])


def _sides(row: dict, size: int) -> tuple[np.ndarray, ...]:
    s, h = codes(row["source"]), codes(row["heard"])
    top, left = _edges(len(s), len(h), row["tj"] * size)
    # Beside a tile that was left out, scores are those of the ways straight on from the corner, which are no better than the best.
    top = np.array(row["top"]) if row["top"] is not None else top if row["ti"] == 0 else np.full(len(h) + 1, row["corner"])
    left = np.array(row["left"]) if row["left"] is not None else left if row["tj"] == 0 else np.full(len(s), top[0])
    return s, h, top, left


def _listed(job: pa.Array, rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    at = pa.array([r[0] for r in rows], pa.int64())
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1)]
    return pa.RecordBatch.from_arrays([job.take(at), *columns], ["job_id", *names])


def paths(jobs: DataFrame, tile: int | None = None) -> DataFrame:
    """(job_id, i, j, same): the partners of ``align`` for jobs (job_id, source, heard), and whether their letters are the same.

    Jobs with an empty text have none.
    """
    pairs = pair_runs(jobs, tile).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return pairs.select("job_id", (F.col("i") + F.col("_k")).alias("i"), (F.col("j") + F.col("_k")).alias("j"), "same")


def pair_runs(jobs: DataFrame, tile: int | None = None) -> DataFrame:
    """(job_id, i, j, n, same): the same as runs of ``n`` pairs that follow each other in both texts."""
    size = tile or TILE
    kind = dict(jobs.dtypes)["job_id"]
    n, m = F.char_length("source"), F.char_length("heard")
    some = jobs.select("job_id", "source", "heard").filter((n > 0) & (m > 0))
    small = (n <= size) & (m <= size)
    done = dealt(some.filter(small), "job_id").mapInArrow(_whole, f"job_id {kind}, {RUNS}")
    large = some.filter(~small)
    if large.isEmpty():
        return done
    return done.unionByName(_tiled(stored(large), size, kind))


def _tiled(jobs: DataFrame, size: int, kind: str) -> DataFrame:
    count = lambda c: F.ceil(F.char_length(c) / size).cast("int")
    n, m = F.char_length("source"), F.char_length("heard")
    lost = F.greatest(n - m, F.floor(n / LOST) + F.greatest(F.lit(0), F.floor((n - m) / 2)) + 8)
    sizes = stored(jobs.select("job_id", n.alias("n"), m.alias("m"), count("source").alias("rows"), count("heard").alias("columns"), lost.cast("int").alias("lost")))
    cut = lambda c, name: jobs.select("job_id", F.explode(F.sequence(F.lit(0), count(c) - 1)).alias(name), F.col(c)).withColumn(c, F.substring(F.col(c), F.col(name) * size + 1, F.lit(size)))
    sources, heards = stored(cut("source", "ti")), stored(cut("heard", "tj"))

    def texts(tiles: DataFrame) -> DataFrame:
        return tiles.join(sources, ["job_id", "ti"]).join(heards, ["job_id", "tj"])

    ends = ["ti", "tj", "top", "left", "bottom", "right", "best", "end"]
    numbers = pa.list_(pa.int32())
    kinds = [pa.int32(), pa.int32(), numbers, numbers, numbers, numbers, pa.int32(), pa.int32()]

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.drop_columns(["job_id"]).to_pylist()):
                s, h, top, left = _sides(row, size)
                done = Tile(s, h, top, left, moves=False)
                best = end = None
                if row["ti"] == row["rows"] - 1:
                    first = row["tj"] * size
                    scores = (done.bottom + GAP * np.arange(first, first + len(done.bottom)))[1 if first else 0 :]
                    best, end = int(scores.max()), int(scores.argmax()) + first + (1 if first else 0)
                yield _listed(batch.column("job_id"), [[at, row["ti"], row["tj"], row["top"], row["left"], done.bottom, done.right, best, end]], ends, kinds)

    schema = f"job_id {kind}, ti int, tj int, top array<int>, left array<int>, bottom array<int>, right array<int>, best int, end int"
    none = F.lit(None).cast("array<int>")
    inputs = ["job_id", "ti", "tj", "top", "left", "corner"]

    def scored(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The edges of the tiles that the jobs' bands touch, and where the best way ends, with the band it needs."""
        rounds = sizes.agg(F.max(F.col("rows") + F.col("columns") - 1)).first()[0]
        now = sizes.select("job_id", F.lit(0).alias("ti"), F.lit(0).alias("tj"), none.alias("top"), none.alias("left"), F.lit(None).cast("int").alias("corner"))
        edges, lasts = [], []
        for k in range(rounds):
            found = stored(dealt(texts(now).join(sizes, "job_id"), "job_id", "ti", "tj").mapInArrow(forward, schema))
            edges.append(now)
            lasts.append(found.select("job_id", "best", "end"))
            if k + 1 < rounds:
                below = found.select("job_id", (F.col("ti") + 1).alias("ti"), "tj", F.col("bottom").alias("top"))
                after = found.select("job_id", "ti", (F.col("tj") + 1).alias("tj"), F.col("right").alias("left"), F.element_at("top", -1).alias("corner"))
                touched = f"ti < rows AND tj < columns AND (tj - ti + 1) * {size} >= -lost AND (tj - ti - 1) * {size} <= lost + m - n"
                now = stored(below.join(after, ["job_id", "ti", "tj"], "full").join(sizes, "job_id").filter(touched).select(*inputs))
        last = reduce(DataFrame.unionByName, lasts).filter("best IS NOT NULL")
        place = last.groupBy("job_id").agg(F.max(F.struct("best", -F.col("end"))).alias("x")).join(sizes, "job_id")
        needed = F.floor(((MATCH - GAP) * F.col("n") - F.col("x.best")) / (MATCH - GAP)).cast("int")
        return reduce(DataFrame.unionByName, edges), stored(place.select("job_id", F.col("n").alias("i"), (-F.col("x")["col2"]).alias("j"), "lost", needed.alias("needed")))

    tiles, place = scored(sizes)
    wider = stored(place.filter("needed > lost").select("job_id", "needed"))
    if not wider.isEmpty():  # as wide as the first one needs
        again, ends = scored(stored(sizes.join(wider, "job_id").withColumn("lost", F.col("needed")).drop("needed")))
        tiles, place = tiles.join(wider, "job_id", "left_anti").unionByName(again), place.filter("needed <= lost").unionByName(ends)
    place = place.select("job_id", "i", "j")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.drop_columns(["job_id"]).to_pylist()):
                s, h, top, left = _sides(row, size)
                di, dj = row["ti"] * size, row["tj"] * size
                a, b, i, j = Tile(s, h, top, left, moves=True).back(row["i"] - di, row["j"] - dj)
                a, b = np.array(a[::-1], np.int64), np.array(b[::-1], np.int64)
                runs = [dict(zip(("i", "j", "n", "same"), run, strict=True)) for run in zip(*(x.tolist() for x in runs_of(a + di, b + dj, s[a] == h[b])), strict=True)]
                yield _listed(batch.column("job_id"), [[at, i + di, j + dj, runs]], ["i", "j", "runs"], [pa.int32(), pa.int32(), kept])

    kept = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int32()), ("same", pa.bool_())]))
    found = []
    while not place.isEmpty():
        tile_of = lambda c: F.floor((F.col(c) - 1) / size).cast("int")
        here = place.filter("i > 0 AND j > 0").withColumns({"ti": tile_of("i"), "tj": tile_of("j")})
        step = stored(dealt(texts(here.join(tiles, ["job_id", "ti", "tj"])), "job_id").mapInArrow(back, f"job_id {kind}, i int, j int, runs array<struct<i: int, j: int, n: int, same: boolean>>"))
        found.append(step.select("job_id", F.inline("runs")))
        place = step.select("job_id", "i", "j").filter("i > 0 AND j > 0")
    return reduce(DataFrame.unionByName, found)
