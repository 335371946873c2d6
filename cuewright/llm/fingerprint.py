"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds, modulo two primes, the prefix sums of ``code * BASE**i``; the hash of any span is one
subtraction and one multiplication with an inverse power, so equality of spans and the longest common
extension of two places (binary search on its length) need no look at the text. A document's fingerprint is
its length, the hash of its whole span, and the smallest span hashes in each of ``BINS`` classes over all
spans of ``SPAN`` code points: two fingerprints estimate the share of spans that the texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import shuffle_partitions, small_batches

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 754974721)
SPAN, BINS, BLOCK = 12, 128, 1 << 15


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


POW = [_powers(b, p, BLOCK + SPAN + 1) for b, p in zip(BASES, PRIMES, strict=True)]
INVERSE = [_powers(pow(b, -1, p), p, BLOCK + SPAN + 1) for b, p in zip(BASES, PRIMES, strict=True)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


class PrefixHash:
    """Prefix arrays of up to BLOCK + SPAN code points. Longer texts are taken block by block."""

    def __init__(self, codes: np.ndarray, moduli: int = 2):
        self.n = len(codes)
        self.prefix = []
        for k in range(moduli):
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(codes * POW[k][: self.n] % PRIMES[k], out=sums[1:])
            self.prefix.append(sums % PRIMES[k])

    def span(self, start: int, stop: int) -> tuple[int, ...]:
        """The hash of [start, stop), the same wherever the span stands."""
        return tuple(int((p[stop] - p[start]) % q * INVERSE[k][start] % q) for k, (p, q) in enumerate(zip(self.prefix, PRIMES, strict=False)))

    def spans(self, width: int, k: int = 0) -> np.ndarray:
        """The hashes modulo PRIMES[k] of all spans of ``width``."""
        p = self.prefix[k]
        return (p[width:] - p[:-width]) % PRIMES[k] * INVERSE[k][: self.n - width + 1] % PRIMES[k]


def spans_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return i + length <= a.n and j + length <= b.n and a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix of two code point arrays: whole blocks, then binary search."""
    done, most = 0, min(len(a), len(b))
    while done < most:
        x, y = (PrefixHash(c[done : done + min(BLOCK, most - done)]) for c in (a, b))
        if x.span(0, x.n) != y.span(0, y.n):
            low, high = 0, x.n - 1
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if spans_equal(x, 0, y, 0, mid) else (low, mid - 1)
            return done + low
        done += x.n
    return most


def sketch(codes: np.ndarray) -> tuple[tuple[int, int], np.ndarray]:
    """The hash of the whole text and, per bin, 16 bits of its smallest span hash (0: no span there)."""
    whole, least = [0, 0], np.full(BINS, 1 << 32, np.int64)
    for start in range(0, len(codes), BLOCK):
        part = PrefixHash(codes[start : start + BLOCK + SPAN - 1])
        n = min(BLOCK, len(codes) - start)
        for k in range(2):
            whole[k] = (whole[k] + int(part.prefix[k][n]) * pow(BASES[k], start, PRIMES[k])) % PRIMES[k]
        if part.n < SPAN and start:
            continue
        mixed = part.spans(min(SPAN, part.n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = (mixed >> np.uint64(24)).astype(np.int64) & 0xFFFFFFFF
        np.minimum.at(least, (mixed >> np.uint64(57)).astype(np.int64), order)
    short = (least * 0x9E3779B1 & 0xFFFFFFFF) >> 16
    return (whole[0], whole[1]), np.where(least >> 32, 0, np.maximum(short, 1)).astype(np.uint16)


def fingerprint(text: str) -> str:
    codes = code_points(text)
    (a, b), bins = sketch(codes)
    return f"{len(codes):x}-{a:08x}{b:08x}-{bins.astype('>u2').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Share of equal bins among those that either has; 1 for equal fingerprints, 0 if one text is empty."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), ">u2") for f in (a, b))
    either = int(((x > 0) | (y > 0)).sum())
    return float(((x == y) & (x > 0)).sum() / either) if either else 0.0


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("shared_edited", pa.int64()),
        ("shared_next", pa.int64()),
    ]
)
SPARK_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, shared_edited long, shared_next long"
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, tail, id); each is compared with the one after it in its bucket."""
    bucket, before = None, None
    for batch in batches:
        out = []
        for at, tail, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            at, tail, doc_id, text = at.as_py(), tail.as_py(), doc_id.as_py(), text.as_py()
            codes = code_points(text)
            mark = fingerprint(text)
            if before is not None and bucket == at:
                own_id, own_text, own_codes, own_mark = before
                m = len(own_text) // 4
                edited = own_text[: len(own_text) - m] + text[:m]
                edited_codes = np.concatenate([own_codes[: len(own_codes) - m], codes[:m]])
                edited_mark = fingerprint(edited)
                out.append(
                    (
                        own_id,
                        len(own_text),
                        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        own_mark,
                        edited_mark,
                        likeness(own_mark, edited_mark),
                        likeness(own_mark, mark),
                        common_extension(own_codes, edited_codes),
                        common_extension(own_codes, codes),
                    )
                )
            bucket, before = at, None if tail else (doc_id, text, codes, mark)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprint every text, its edited text, and how near they and the next document are.

    The edited text has its last ``n // 4`` code points replaced by the first as many of the next document in
    order of id (after the last: the first). ``shared_*`` are the lengths of the common prefixes.

    Texts are shuffled once, into ranges of ids of which several go to a task; only the first document of each
    range is sent to the range before it as well, and only these ids (one per range) reach the driver.

    * Null text counts as empty; empty text has n_chars 0. A null id comes before all others.
    * Rows with equal ids are ordered by a hash of their text; a single document is its own next one.
    * An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    small_batches(spark)
    n = buckets or 8 * parts
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")

    def with_bucket(df: DataFrame) -> DataFrame:
        place = F.aggregate(  # binary search: 20 halvings reach every one of up to 2**20 ranges
            F.sequence(F.lit(0), F.lit(19)),
            F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")),
            lambda s, _: F.when(s["low"] >= s["high"], s).otherwise(
                F.when(
                    F.get(edges, F.floor((s["low"] + s["high"]) / 2).cast("int")) <= F.col("doc_id"),
                    F.struct((F.floor((s["low"] + s["high"]) / 2).cast("int") + 1).alias("low"), s["high"].alias("high")),
                ).otherwise(F.struct(s["low"].alias("low"), F.floor((s["low"] + s["high"]) / 2).cast("int").alias("high")))
            ),
            lambda s: s["low"],
        )
        return df.withColumn("bucket", F.when(F.col("doc_id").isNull() | (F.lit(len(cuts)) == 0), 0).otherwise(place))

    known = F.col("doc_id").isNotNull()
    firsts = (
        with_bucket(ids)
        .groupBy("bucket")
        .agg(F.min(F.struct(known.alias("known"), "doc_id")).alias("first"))
        .select("bucket", "first.doc_id")
        .orderBy("bucket")
        .collect()  # one id per range
    )
    texts = with_bucket(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = texts.select("bucket", F.lit(False).alias("tail"), "doc_id", "text")
    if firsts:
        sent = [(before.bucket, after.doc_id) for before, after in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
        heads = spark.createDataFrame(sent, "to int, head long")
        copies = (
            texts.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
            .groupBy("to")
            .agg(F.min_by(F.struct("doc_id", "text"), F.xxhash64("text")).alias("x"))
            .select(F.col("to").alias("bucket"), F.lit(True).alias("tail"), "x.doc_id", "x.text")
        )
        rows = rows.unionByName(copies)
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", known, "doc_id", F.xxhash64("text"))
    return rows.mapInArrow(_pairs, SPARK_SCHEMA)
