"""Phrases whose words stand together more often than apart, counted by suffix sorting.

Every place of a text gives the suffix that begins there, cut off after ``max_n`` words. Suffixes are shuffled and sorted in reverse
lexicographic order of language and words, so that each phrase's places are neighbours, as prefixes of theirs; one stack, a level for
each length, counts all of them in one pass. Suffixes are dealt out by ranges of that order and not by a hash of the first word,
so a frequent first word fills as many tasks as it needs. A range may cut a phrase's places in two: only the first and last
phrase of each length in a task can be cut, so these alone are summed once more.

A phrase with ``least`` places has only words with as many. Words are counted first; a suffix ends before a word with
fewer, which a bit table of fixed size knows (a word that shares a bit with a frequent one merely stays).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import checkpointed
from cuewright.llm.slices import slices, summed, summing, words_by_spaces

#: Bits of the table of frequent words, a power of two: 4 MB.
BITS = 1 << 25
#: Parts of a language that are ranked each for itself first.
RANK_PARTS = 16
#: What ends a piece with the white space around it, as one word of its own that no text can hold.
STOPS = r"[\x20\x09]*[.,;:!?\x0A-\x0D][.,;:!?\x0A-\x0D\x20\x09]*"
STOP = "\n"


def _words(batch: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray, pa.DictionaryArray]:
    """Words and stops of the texts in order, the row of each, and the rows' languages. Names are fit to be joined by NUL."""
    text = pc.replace_substring_regex(pc.ascii_lower(batch.column("text")), STOPS, f" {STOP} ")
    words, row = words_by_spaces(pc.replace_substring(text, "\t", " "))
    return _joinable(words.dictionary_encode()), row, _joinable(batch.column("lang").dictionary_encode())


def _joinable(names: pa.DictionaryArray) -> pa.DictionaryArray:
    """Names without NUL; NUL sorts below what is left, so a phrase sorts right before all longer ones."""
    plain = pc.replace_substring(pc.replace_substring(names.dictionary, "\x01", "\x01\x03"), "\0", "\x01\x02")
    return pa.DictionaryArray.from_arrays(names.indices, plain)


def _readable(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(key, "\x01\x02", "\0"), "\x01\x03", "\x01")


def _word_counts(batch: pa.RecordBatch) -> pa.Table:
    """(key, n): language and word joined by NUL."""
    words, row, lang = _words(batch)
    size = max(1, len(words.dictionary))
    pair = lang.indices.to_numpy().astype(np.int64)[row] * size + words.indices.to_numpy()
    found, n = np.unique(pair[words.indices.to_numpy() != _stop(words)], return_counts=True)
    key = pc.binary_join_element_wise(lang.dictionary.take(pa.array(found // size)), words.dictionary.take(pa.array(found % size)), "\0")
    return pa.table([key, pa.array(n)], ["key", "n"])


def _stop(words: pa.DictionaryArray) -> int:
    return pc.index(words.dictionary, STOP).as_py()


def _bit(key: Column) -> Column:
    return F.crc32(key.cast("binary")) % BITS


def frequent_bits(counts: DataFrame, least: int) -> bytes:
    """A bit for each key with ``least`` places: BITS / 8 bytes, whatever the number of keys."""
    bits = counts.filter(F.col("n") >= least).select(_bit(F.col("key")).alias("bit"))
    buckets = bits.groupBy(F.call_function("bitmap_bucket_number", "bit").alias("at")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", "bit")).alias("bits"))
    table, size = bytearray(BITS // 8 + 4096), 4096  # a bucket of Spark's bitmaps has 4096 bytes, the first holds bits 1 to 32768
    for row in buckets.collect():
        at = int(row["at"]) * size
        table[at : at + size] = row["bits"]
    return bytes(table)


def _suffixes(bits, max_n: int):
    """A kernel part: (key, n) of the suffixes of two to ``max_n`` words of a slice, words joined by NUL after the language."""

    def part(batch: pa.RecordBatch) -> pa.Table:
        table = np.frombuffer(bits.value, np.uint8)
        words, row, lang = _words(batch)
        code, size = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
        tongue = lang.indices.to_numpy().astype(np.int64)[row]
        names, tongues = words.dictionary.to_pylist(), [t.encode() + b"\0" for t in lang.dictionary.to_pylist()]
        pair, at = np.unique(tongue * size + code, return_inverse=True)
        hashed = np.fromiter((zlib.crc32(tongues[p // size] + names[p % size].encode()) % BITS for p in pair.tolist()), np.int64, len(pair))
        # Spark's bit 0 belongs to the bucket of number 0 at position 0; its bits follow from 1.
        found = _has(table, hashed) & (pair % size != _stop(words))
        live = found[at]
        columns, alive = [tongue, code], live.copy()
        n = len(code)
        for k in range(1, max_n):
            following = np.zeros(n, bool)
            if k < n:
                following[: n - k] = live[k:] & (row[k:] == row[: n - k])
            alive = alive & following
            column = np.full(n, -1, np.int64)
            column[: max(0, n - k)] = code[k:]
            columns.append(np.where(alive, column, -1))
        some = live & (columns[2] >= 0) if max_n > 1 else np.zeros(n, bool)
        parts = [f"c{k}" for k in range(max_n + 1)]
        rows = pa.table([pa.array(c[some]) for c in columns], parts).group_by(parts, use_threads=False).aggregate([([], "count_all")])
        taken = [lang.dictionary.take(rows.column("c0"))]
        taken += [words.dictionary.take(pc.if_else(pc.less(c, 0), pa.scalar(None, pa.int64()), c)) for c in rows.columns[1 : max_n + 1]]
        joined = pc.binary_join_element_wise(*taken, "\0", null_handling="skip")
        return pa.table([joined, rows.column("count_all").cast(pa.int64())], ["key", "n"])

    return part


def _has(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Whether Spark's bitmaps hold a bit: bucket 0 has bit 0 alone, bucket b the bits from 32768 (b - 1) + 1 on, at position (bit - 1) mod 32768."""
    bucket = np.where(bit > 0, (bit - 1) // 32768 + 1, 0)
    position = np.where(bit > 0, (bit - 1) % 32768, 0)
    return (table[bucket * 4096 + position // 8] >> (position % 8)) & 1 == 1


PHRASES = pa.schema([("key", pa.string()), ("words", pa.int32()), ("n", pa.int64()), ("edge", pa.bool_())])


def _counted(max_n: int, least: int):
    """A kernel over sorted suffixes (key, n): all prefixes of two words or more with ``least`` places; at the task's edges all, marked ``edge``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        # The stack: by number of words the open prefix, its places so far, and whether it stands at the task's beginning.
        stack: dict[int, list] = {k: [None, 0, True] for k in range(2, max_n + 1)}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PHRASES, strict=True)], schema=PHRASES)

        for batch in slices(batches, "key"):
            if not batch.num_rows:
                continue
            lists = pc.split_pattern(batch.column("key"), "\0")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            n = batch.column("n").to_numpy()
            codes = np.full((len(lists), max_n + 1), -1, np.int64)
            row = np.repeat(np.arange(len(lists)), size)
            codes[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = coded.indices.to_numpy()
            changed = np.zeros(len(lists), bool)
            changed[0] = True
            changed[1:] = (codes[1:, 0] != codes[:-1, 0]) | (codes[1:, 1] != codes[:-1, 1])
            closed: list[tuple] = []
            for k in range(2, max_n + 1):
                changed[1:] |= codes[1:, k] != codes[:-1, k]
                starts = np.flatnonzero(changed)
                sums = np.add.reduceat(n, starts)
                name = lambda i: "\0".join(coded.dictionary.take(pa.array(codes[i, : k + 1])).to_pylist()) if codes[i, k] >= 0 else None  # noqa: B023, E731
                first, top = name(starts[0]), stack[k]
                if top[0] == first:
                    top[1] += int(sums[0])
                else:
                    if top[0] is not None and (top[2] or top[1] >= least):
                        closed.append((top[0], k, top[1], top[2]))
                    # Without an open prefix before it, this one is the task's first.
                    stack[k] = top = [first, int(sums[0]), top[0] is None and top[2]]
                if len(starts) > 1:
                    if top[0] is not None and (top[2] or top[1] >= least):
                        closed.append((top[0], k, top[1], top[2]))
                    stack[k] = [name(starts[-1]), int(sums[-1]), False]
                    inner = np.arange(1, len(starts) - 1)
                    inner = inner[(sums[inner] >= least) & (codes[starts[inner], k] >= 0)]
                    if len(inner):
                        at = starts[inner]
                        key = pc.binary_join_element_wise(*[coded.dictionary.take(pa.array(codes[at, j])) for j in range(k + 1)], "\0")
                        yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(at), k), pa.int32()), pa.array(sums[inner], pa.int64()), pa.array(np.zeros(len(at), bool))], schema=PHRASES)
            if closed:
                yield batch_of(closed)
        last = [(name, k, n, True) for k, (name, n, _) in stack.items() if name is not None]
        if last:
            yield batch_of(last)

    return kernel


def phrase_counts(rows: DataFrame, words: DataFrame, max_n: int = 4, least: int = 30) -> DataFrame:
    """(key, words, n) of all phrases of two to ``max_n`` words with ``least`` places in ``rows`` (lang, text); ``words`` has (key, n) of single words."""
    bits = rows.sparkSession.sparkContext.broadcast(frequent_bits(words, least))
    part = _suffixes(bits, max_n)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in slices(batches, "text"):
            yield from part(batch).to_batches(100_000)

    found = rows.mapInArrow(suffixes, "key string, n long")
    order = F.desc("key")
    kinds = "key string, words int, n long, edge boolean"
    counted = checkpointed(found.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(_counted(max_n, least), kinds))
    whole = counted.filter(~F.col("edge")).select("key", "words", "n")
    cut = counted.filter("edge").groupBy("key", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return whole.unionByName(cut)


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, top: int = 2000, covered: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``max_n`` words by how seldom their parts stand apart.

    ``a`` counts a phrase's places within pieces of text between marks, overlapping ones too, and ``n`` all words of the language. A cut after the first
    words gives the places ``l`` and ``r`` of its parts and a score of floor(2000000 * a / (l + r)); the lowest counts, of equals the earliest cut.
    A phrase inside a longer one with ``covered`` percent of its places goes.

    * Null text counts as empty, a null language as ``und``. Rows with equal ids count each; ids and further columns are ignored.
    * Ranks break ties by ``a``, then by the phrase in UTF-8 order. An empty table, and a language without phrases, give no rows.
    * A very long text is one row of one task, which holds its words a few times over.
    """
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(lang.alias("lang"), text.alias("text"))
    counts = rows.mapInArrow(summing(_word_counts, "text", ["key"], ["n"]), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    words = checkpointed(counts)
    first = lambda key: F.substring_index(key, "\0", 1)
    totals = words.groupBy(first(F.col("key")).alias("lang")).agg(F.sum("n").alias("n"))
    phrases = checkpointed(phrase_counts(rows, words, max_n, least))

    known = phrases.select("key", "n").unionByName(words.filter(F.col("n") >= least))
    parts = F.split("key", "\0")
    piece = lambda at, size: F.concat_ws("\0", F.get("parts", F.lit(0)), F.slice("parts", at, size))
    cuts = phrases.withColumnRenamed("n", "a").withColumns({"parts": parts, "cut": F.explode(F.sequence(F.lit(1), F.col("words") - 1))})
    cuts = cuts.select("key", "words", "a", "cut", piece(F.lit(2), F.col("cut")).alias("left"), piece(F.col("cut") + 2, F.col("words") - F.col("cut")).alias("right"))
    cuts = cuts.join(known.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(known.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(8,0)") * F.col("a").cast("decimal(19,0)"), F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)"))
    best = cuts.groupBy("key", "words", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    longer = phrases.filter("words > 2").withColumn("parts", parts)
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: piece(at + 1, size))))
    inside = longer.select(F.explode(inside).alias("key"), F.col("n").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    left = best.join(inside, "key", "left").filter(F.col("longer").isNull() | (F.lit(100) * wide("longer") < F.lit(covered) * wide("a")))
    found = left.select(first(F.col("key")).alias("lang"), F.expr("substring(key, locate('\\0', key) + 1)").alias("phrase"), "a", "best.l", "best.r", "best.score")
    found = found.withColumn("phrase", _readable(F.replace("phrase", F.lit("\0"), F.lit(" "))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    few = found.withColumn("spread", spread).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "spread").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ranked.join(totals, "lang")
    return ranked.select(_readable(F.col("lang")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
