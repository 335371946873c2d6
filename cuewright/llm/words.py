"""Cutting text into the words that byte-level BPE encodes separately, and counting words, in Python workers."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the tokenizers' pattern means in Python's re, for texts without ODD characters: there \d is all of
#: \p{N}, other word characters but _ are all of \p{L}, and \s is Unicode white space.
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Numbers that are no digits, the separators that only Python counts as white space, and, as searching for a
#: long list of characters is slow, all characters beyond the basic plane.
ODD = re.compile("[\x1c-\x1f" + "".join(re.escape(chr(c)) for c in range(1 << 16) if unicodedata.category(chr(c)) in ("Nl", "No")) + "\U00010000-\U0010ffff]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives a text's matches of the tokenizers' ``pattern``, white space being Unicode's."""
    exact = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    ascii_odd = re.compile("[\x1c-\x1f]")

    def split(text: str) -> list[str]:
        odd = ascii_odd if text.isascii() else ODD
        return exact.findall(text) if odd.search(text) else FAST.findall(text)

    return split


CUT, WIDE = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")


def cut(text: str) -> list[str]:
    """Parts of a text that the tokenizers' pattern may cut each for itself: the words of the parts are those of the text.

    A space before anything but white space always begins a word, and the pattern looks at nothing before a word
    and, at the end of white space, only for more of it.
    """
    if "\0" in text:
        first, *rest = CUT.split(text)
        return [first, *[" " + r for r in rest]]
    return (CUT.sub("\0 ", text) if WIDE.search(text) else text.replace(" ", "\0 ")).split("\0")


#: Texts that only ``cut`` cuts right: with a NUL, or a space before white space or the end.
UNEVEN = "\\x00| (?:[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|$)"
#: A word of letters and the ASCII marks after it: two matches of the pattern, or one.
PLAIN = r"^(?P<word> ?\p{L}+)(?P<marks>[!-/:-@\[-`{-~]*)$"


def cut_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of many texts, as ``cut`` gives them, and the number of parts up to the end of each text. Null is empty."""
    texts = pc.fill_null(texts, "")
    uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
    parts, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
    if not uneven.any():
        return parts, np.cumsum(sizes, dtype=np.int64)
    rows = np.flatnonzero(uneven).tolist()
    own = [cut(texts[k].as_py()) for k in rows]
    ends = np.cumsum(sizes)
    pieces, at, sizes = [], 0, sizes.copy()
    for k, mine in zip(rows, own, strict=True):
        pieces += [parts[at : ends[k] - sizes[k]], pa.array(mine, parts.type)]
        at, sizes[k] = int(ends[k]), len(mine)
    return pa.concat_arrays([*pieces, parts[at:]]), np.cumsum(sizes, dtype=np.int64)


COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _summed(table: pa.Table) -> pa.Table:
    return table.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def count_pieces(texts: DataFrame, split: Callable[[str], list[str]], most: int = 60_000) -> DataFrame:
    """(word, n) of the matches of the tokenizers' pattern over the first column of ``texts``.

    Each worker counts parts of texts, cuts each different part once, and flushes at ``most`` of them; Spark sums.
    """

    def words_of(parts: pa.Table) -> pa.Table:
        word, n = parts.column("word").combine_chunks(), parts.column("n").combine_chunks()
        found = pc.extract_regex(word, PLAIN)
        plain, marks = found.is_valid(), pc.fill_null(pc.greater(pc.binary_length(found.field(1)), 0), False)
        counts = {"word": [], "n": []}
        others = pc.invert(plain)
        for part, k in zip(word.filter(others).to_pylist(), n.filter(others).to_pylist(), strict=True):
            mine = split(part)
            counts["word"] += mine
            counts["n"] += [k] * len(mine)
        tables = [pa.table([found.field(0).filter(plain), n.filter(plain)], schema=COUNTS), pa.table([found.field(1).filter(marks), n.filter(marks)], schema=COUNTS)]
        return _summed(pa.concat_tables([*tables, pa.table(counts, schema=COUNTS)]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back, which the default one keeps for itself
        held, rows = [], 0
        for batch in batches:
            found = cut_all(batch.column(0))[0].value_counts()
            held.append(pa.table([found.field(0), found.field(1)], schema=COUNTS))
            rows += len(found)
            if rows >= 2 * most:
                held = [_summed(pa.concat_tables(held))]
                rows = held[0].num_rows
                if rows >= most:
                    yield from words_of(held[0]).to_batches(100_000)
                    held, rows = [], 0
        if held:
            yield from words_of(_summed(pa.concat_tables(held))).to_batches(100_000)

    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_words(texts: DataFrame, split: Callable[[str], list[str]], most: int = 400_000) -> DataFrame:
    """(word, n) over the first column of ``texts``: summed in each worker, flushed at ``most`` words, then by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], schema=COUNTS)
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(split(text.as_py()))
                if len(seen) >= most:
                    yield flush()
        yield flush()

    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, with all others of the same level of count, as far as ``most`` allows.

    Levels are single counts up to 256, then eighths of a doubling: under 700 of them reach the driver.
    """
    level = F.when(F.col("n") <= 256, F.col("n")).otherwise(256 + F.floor(8 * (F.log2("n") - 8))).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).collect()
    total, least = 0, 1 << 62
    for row in sorted(levels, key=lambda r: -r.level):
        if (total := total + row.k) > most:
            break
        least = row.least
    return counts.filter(F.col("n") >= least)
