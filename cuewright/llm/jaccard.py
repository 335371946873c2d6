"""Exact Jaccard similarity join of documents on word shingles, by count vectors.

A document's shingles are hashed into groups. Its count vector (how many shingles fall into each of ``GROUPS``)
is a point whose coordinate-wise minimum with another bounds their overlap from above.

An R-tree over all points of a large corpus does not prune (random texts of one length lie at one distance), so
the points are first dealt into buckets that no similar pair escapes: for a class of sizes in which similar sets
differ in at most T shingles, shingles are hashed into more than T finer groups, of which one at least is then
the same in both sets; every non-empty group of a document, with its content, is one bucket. Sets that share a
bucket with its smallest member are compared at once; where different components still meet in a bucket, its
points are put into an R-tree that prunes subtrees by the bound. What survives is verified on the exact sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import checkpointed, shuffle_partitions, small_batches
from cuewright.llm.components import connected_components

GROUPS = 64
#: Groups of the vectors that bound a pair's overlap for thresholds under 0.9. They leave room for the shingles that share a group by
#: chance: with few groups all pairs of the documents with one passage in common, of which a bucket can have very many, would pass.
FINE = 512
#: Ids up to this many are broadcast when the exact sets of candidates are read; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Points of a bucket that one R-tree holds; larger buckets are searched in blocks of this many.
TREE = 2048
#: Rounds of comparing a bucket's members with one of them, for buckets of more than this many members.
ROUNDS, SMALL = 3, 8
REMEMBERED = 200_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct ``k``-word shingles of a text as sorted 64-bit hashes; fewer words are one shingle."""

    def __init__(self, k: int, seed: int = 0):
        self.k, self.seed, self.known = k, seed, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w, self.seed)
            h = np.array([known[w] for w in words], np.uint64)
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out + h[i : len(h) - k + 1 + i])
        return np.unique(out)


@functools.lru_cache(None)
def size_classes(num: int, den: int, most: int) -> tuple[tuple[int, int, int, int], ...]:
    """(smallest, largest size, finer groups, empty ones that may be left out) of classes up to size ``most``.

    Sets a <= b with Jaccard similarity of num/den or more and a in the class differ in at most
    T = largest * (den - num) / num shingles. With T + 1 + m groups, m + 1 at least are the same in both sets:
    if the smaller set leaves at most m groups empty, one of them is not empty.
    """
    out, low = [], 1
    while low <= most:
        high = max(low, low * 3 // 2 - 1)
        t = high * (den - num) // num
        m = 0
        for _ in range(8):
            mean = (t + 1 + m) * math.exp(-low / (t + 1 + m))
            m = math.ceil(mean + 3 * math.sqrt(mean))
        out.append((low, high, t + 1 + m if t else 0, m))
        low = high + 1
    return tuple(out)


def buckets(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """The 64-bit names of a set's buckets, in the class of its size and those of similar smaller sets."""
    n = len(shingles)
    out = []
    for c, (low, high, groups, spare) in enumerate(size_classes(num, den, 1 << n.bit_length())):
        if low > n or high * den < num * n or not groups:
            continue
        group = (_mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
        order = np.argsort(group, kind="stable")
        group, content = group[order], _mix(shingles + np.uint64(0x9E3779B97F4A7C15))[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        name = np.add.reduceat(content, first)
        place = group[first]
        if groups - len(first) > spare:  # too many empty ones: they count as well
            empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), place)
            place, name = np.r_[place, empty], np.r_[name, np.zeros(len(empty), np.uint64)]
        out.append(_mix(_mix(name + place * _M1) + np.array([c], np.uint64) * _M2))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Counts of a set's shingles in 2**j groups by their first bits: ``groups``, or about one group for four shingles of larger sets."""
    bits = max(groups.bit_length() - 1, len(shingles).bit_length() - 3)
    return np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u2")


def coarser(counts: np.ndarray, groups: int) -> np.ndarray:
    """The counts of the same set in fewer groups."""
    return counts.reshape(groups, -1).sum(1, dtype=np.int32)


def overlap_bound(a: bytes, b: bytes) -> int:
    """Summed minima of two count vectors, in the groups of the shorter one."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    if len(x) != len(y):
        groups = min(len(x), len(y))
        x, y = coarser(x, groups), coarser(y, groups)
    return int(np.minimum(x, y).sum(dtype=np.int64))


class RTree:
    """Count vectors, packed by size and then by group counts; inner nodes keep the highest counts and least size below."""

    FAN = 16

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = np.lexsort((*(points[:, g] for g in range(8)), sizes))
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.levels = []
        high, least = self.points, self.sizes
        while len(high) > self.FAN:
            at = np.arange(0, len(high), self.FAN)
            high, least = np.maximum.reduceat(high, at), np.minimum.reduceat(least, at)
            self.levels.append((high, least))

    def search(self, size: int, point: np.ndarray, num: int, den: int) -> np.ndarray:
        """Positions of the points whose bound allows a similarity of num/den with the given one."""
        at = None
        for high, least in [*reversed(self.levels), (self.points, self.sizes)]:
            if at is not None:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(high)]
                high, least = high[at], least[at]
            fits = (num + den) * np.minimum(high, point).sum(1, dtype=np.int64) >= num * (size + least)
            at = np.flatnonzero(fits) if at is None else at[fits]
        return self.order[at]


def _points(k: int, seed: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k, seed)
        for batch in batches:
            n, h1, h2, vec = [], [], [], []
            for text in batch.column(1):
                s = shingle(text.as_py()) if text.is_valid else np.zeros(0, np.uint64)
                x = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                h1.append((x >> 64) - (1 << 63) if len(s) else None)
                h2.append((x & ((1 << 64) - 1)) - (1 << 63))
                vec.append(vector(s, groups).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(vec, pa.binary())], names=["doc_id", "n", "node", "check", "vec"])

    return run


def _bucketed(k: int, seed: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(k, seed), set()
        for batch in batches:
            names, nodes, counts = [], [], []
            for text in batch.column(1):
                s = shingle(text.as_py()) if text.is_valid else ()
                if not len(s):
                    continue
                node = (xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - (1 << 63)
                if node in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(node)
                b = buckets(s, num, den)
                names.append(b)
                nodes.append(node)
                counts.append(len(b))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), counts))], names=["sig", "node"])

    return run


def _sets(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k, seed)
        for batch in batches:
            nodes, sets = [], []
            for text in batch.column(1):
                s = shingle(text.as_py()) if text.is_valid else ()
                if len(s):
                    nodes.append((xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - (1 << 63))
                    sets.append(s.view(np.int64))
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat).cast(pa.list_(pa.int64()))], names=["node", "s"])

    return run


def _bounded(num: int, den: int):
    """Rows (a, b, na, nb, va, vb) whose summed minima allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                bounds = np.array([overlap_bound(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
                fits = (num + den) * bounds >= num * (na + nb)
                yield batch.select([0, 1, 2, 3]).filter(pa.array(fits))

    return run


def _searched(num: int, den: int):
    """Rows (bucket, i, j, part, node, comp, n, vec), sorted by (bucket, i, j): pairs of different components.

    Where i = j all points are searched against each other, else those of part i against those of part j.
    """

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        i, j = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        if not left or not right:
            return
        point = lambda r: coarser(np.frombuffer(r[7], "<u2"), GROUPS)
        tree = RTree(np.array([r[6] for r in right]), np.stack([point(r) for r in right]))
        for r in left:
            for at in tree.search(r[6], point(r), num, den).tolist():
                other = right[at]
                if other[5] != r[5] and (i != j or r[4] < other[4]) and (num + den) * overlap_bound(r[7], other[7]) >= num * (r[6] + other[6]):
                    yield min(r[4], other[4]), max(r[4], other[4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    out += pairs(held)
                    held = []
                held.append(row)
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                    out = []
        if held:
            out += pairs(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Documents link when ``den * |A & B| >= num * |A | B|`` for their sets of distinct ``k``-word shingles (ASCII
    letters lower-cased, words cut at ASCII white space; fewer than ``k`` words are one shingle). A component's
    id is the smallest document id in it.

    * Null and empty texts have no shingles and are linked with nothing: their component is their own id.
    * Documents with equal sets are one class and handled once; their number plays no part in the join.
    * Null ids stand for no component unless all its documents have null ids. Repeated rows are one class.
    * An empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    for seed in range(16):
        points = checkpointed(rows.mapInArrow(_points(k, seed, GROUPS if 10 * num >= 9 * den else FINE), "doc_id long, n long, node long, check long, vec binary"))
        classes = checkpointed(
            points.filter(F.col("node").isNotNull())
            .groupBy("node")
            .agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"), F.first("vec").alias("vec"))
        )
        if not classes.filter("low != high").head(1):  # two sets with one 64-bit name: take other hashes
            break
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("vec").alias(f"v{s}"))
        bounded = checkpointed(
            pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "va", "vb").mapInArrow(_bounded(num, den), "a long, b long, na long, nb long")
        )
        nodes = bounded.select(F.col("a").alias("node")).unionByName(bounded.select(F.col("b").alias("node"))).distinct()
        wanted = checkpointed(classes.join(nodes, "node", "left_semi").select("node", F.col("id").alias("doc_id")))
        ids = wanted.select("doc_id").distinct()
        ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
        sets = (
            rows.join(ids.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
            .mapInArrow(_sets(k, seed), "node long, s array<long>")
            .dropDuplicates(["node"])
        )
        sets = checkpointed(sets)
        both = bounded.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
        same = F.size(F.array_intersect("sa", "sb"))
        return both.withColumn("same", same).filter((num + den) * F.col("same") >= num * (F.col("na") + F.col("nb"))).select("a", "b")

    of_bucket = Window.partitionBy("sig")
    met = (
        rows.mapInArrow(_bucketed(k, seed, num, den), "sig long, node long")
        .select("sig", "node", F.min("node").over(of_bucket).alias("lead"), F.max("node").over(of_bucket).alias("last"), F.sum(F.xxhash64("node") % 1_000_003_579).over(of_bucket).alias("members"))
        .filter("lead != last")
    )
    # buckets with the same members are one
    met = checkpointed(met.groupBy("members", "lead", "node").agg(F.count(F.lit(1)).alias("times")))
    of_set = Window.partitionBy("members", "lead")

    def undecided(labels: DataFrame) -> DataFrame:
        """Members of buckets in which different components meet; comp is a lone node's own name."""
        rows = met.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rows = rows.withColumns({"least": F.min("comp").over(of_set), "most": F.max("comp").over(of_set), "size": F.count(F.lit(1)).over(of_set)})
        return rows.filter("least != most").select("members", "lead", "node", "comp", "size")

    # In each round every member is compared with one: the first by a hash that the round sets. A large group of
    # near copies joins up in a few rounds, each linear in its size, and its buckets need no look at their pairs.
    # Before that each set is compared with the one that leads most of its buckets, which mostly settles its component.
    leads = checkpointed(met.filter("lead != node").groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg(F.sum("times").alias("times")))
    nearest = leads.groupBy("b").agg(F.max(F.struct("times", "a")).alias("most")).select("most.a", "b")
    edges = checkpointed(verified(nearest))
    labels = connected_components(edges)
    comp_of = lambda s: labels.select(F.col("node").alias(s), F.col("comp").alias(f"comp_{s}"))
    other = leads.join(comp_of("a"), "a", "left").join(comp_of("b"), "b", "left")
    other = other.filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b").join(nearest, ["a", "b"], "left_anti")
    edges = checkpointed(edges.unionByName(verified(other)))
    labels = connected_components(edges)
    for turn in range(1, ROUNDS + 1):
        rows_left = undecided(labels).filter(F.col("size") > SMALL)
        one = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp")).over(of_set)
        pairs = rows_left.withColumn("one", one).filter(F.col("one.comp") != F.col("comp"))
        pairs = pairs.select(F.least("node", "one.node").alias("a"), F.greatest("node", "one.node").alias("b")).distinct()
        more = checkpointed(verified(pairs))
        if not more.head(1):
            break
        edges = edges.unionByName(more)
        labels = connected_components(edges)
    open_ = undecided(labels).filter("lead != node OR size > 2")
    open_ = checkpointed(open_.select("members", "lead", "node", "comp", F.ceil(F.col("size") / TREE).cast("int").alias("blocks")))
    if open_.head(1):
        dealt = (
            open_.join(classes.select("node", "n", "vec"), "node")
            .withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(F.xxhash64("members", "lead").alias("bucket"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "comp", "n", "vec")
            .repartition(parts, "bucket", "i", "j")
            .sortWithinPartitions("bucket", "i", "j")
        )
        more = dealt.mapInArrow(_searched(num, den), "a long, b long").distinct()
        labels = connected_components(checkpointed(edges.unionByName(verified(more))))
    named = classes.join(labels, "node", "left").select("node", "id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = named.join(least, "comp").select("node", "component_id")
    return points.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, less the near copies: one row of each component stays.

    It is the row with the smallest id; of rows with one id any, and one with a null id only where all have null ids.
    Rows are judged by their own texts, whatever their ids; rows without shingles all stay. The rows with their numbers
    are written once, as the join reads them several times.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    found = checkpointed(jaccard_components(numbered, row, text_col, k, num, den).select(F.col("doc_id").alias("at"), "component_id"))
    groups = found.filter(F.col("at") != F.col("component_id")).select("component_id").distinct()
    ids = numbered.select(F.col(row).alias("at"), F.col(id_col).alias("id"))
    members = checkpointed(found.join(groups, "component_id", "left_semi").join(ids, "at"))
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))["at"].alias("at"))
    gone = checkpointed(members.join(kept, "at", "left_anti").select(F.col("at").alias(row)))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
