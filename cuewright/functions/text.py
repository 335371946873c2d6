"""Scalar text functions. Offsets count code points."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Fixed values. Marks after which a long line is cut first, and marks that end a sentence.
CUT_AFTER = ",.!?;:，。！？；：…~、)]}〉》」』"
SENTENCE_END = ".!?;:。！？；：…"


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def nfkc(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t)), "string")(text)


def normalize_line(text: Column) -> Column:
    return squeeze(nfkc(text))


def folded(text: str) -> str:
    """Compatibility form, case-folded, letters and numbers only."""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    return text if text.isalnum() else "".join(filter(str.isalnum, text))


def match_key(text: Column) -> Column:
    """``folded`` texts; null stays."""
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series([None if t is None else folded(t) for t in s], dtype="object"), "string")(text)


def match_key_native(text: Column) -> Column:
    """The same for text already in compatibility form, inside the JVM."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def cut_lines(line: Column, most: int) -> Column:
    """Parts of at most ``most`` code points of a line in normal form: one regular expression, matched again and again.

    The first 0.55 of a part stays uncut. What is left is taken whole if it fits; else the longest part that ends in a
    mark of ``CUT_AFTER`` is, else the longest that ends in a space, else the longest before a space, else all that fit.
    """
    if most < 1:
        raise ValueError("max_chars must be at least 1")
    least = max(1, int(0.55 * most))
    marks = "".join(map(re.escape, CUT_AFTER))
    head = f".{{{least - 1},{most - 1}}}"
    pattern = rf"(?s) *+(?:.{{1,{most}}}\z|{head}[{marks}]|{head} |.{{{least},{most}}}(?= )|.{{{most}}})"
    parts = F.transform(F.regexp_extract_all(F.trim(line), F.lit(pattern), F.lit(0)), lambda part: F.trim(part))
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda part: part != "")


def tokens(text: Column) -> Column:
    """Words of a text that hold a letter or number."""
    return F.filter(F.split(squeeze(text), " "), lambda word: match_key_native(word) != "")


def alignment_text(lines: Column) -> Column:
    """An array of lines as one text: those not blank, in normal form but for compatibility characters, joined by spaces."""
    return F.array_join(F.filter(F.transform(lines, squeeze), lambda line: line != ""), " ")


def speech_rate(text: Column, seconds: Column) -> Column:
    """Letters and numbers a second, over a hundredth of a second at least."""
    return F.char_length(match_key_native(text)) / F.greatest(F.lit(0.01), seconds)


def char_limit(rate: Column, preferred: int = 30, hard: int = 50) -> Column:
    """Characters a cue may have at a speech rate: ``preferred`` up to 4 a second, ``hard`` from 7, rounded half-even between."""
    return F.when(rate <= 4, preferred).when(rate >= 7, hard).otherwise(F.rint(preferred + (hard - preferred) * ((rate - 4) / 3))).cast("int")


def safe_file_name(name: Column) -> Column:
    return F.translate(name, '<>:"/\\|?*', "_" * 9)
