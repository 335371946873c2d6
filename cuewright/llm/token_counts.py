"""Token counts of documents without their ids.

A byte-level vocabulary encodes each match of its pattern (a pre-token) for itself, so a document's count is a sum over its
pre-tokens. Every distinct pre-token of the corpus is encoded once, in a table of its own. Documents meet that table twice: the most
frequent pre-tokens, a table of bounded size, are looked up where the documents are cut; all others leave there as (document,
pre-token, frequency), and join the table by a shuffle. What is frequent never enters that shuffle, so no key of it is hot.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import checkpointed, small_batches
from cuewright.llm.slices import SLICE_BYTES
from cuewright.llm.words import PLAIN, count_pieces, cut_all, frequent, splitter

#: Pre-tokens whose counts all tasks hold: some 4 MB.
HEAD = 300_000
TAIL = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))


def _library(path: str):
    """The vocabulary's tokenizer. Added tokens count as text: they have been cut out before."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.no_truncation()
    found.no_padding()
    return found


def added_tokens(path: str) -> list[str]:
    """The strings that the library takes out of a text before all else, longest first."""
    import json

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    before, added = whole.get("pre_tokenizer") or {}, whole.get("added_tokens", [])
    if whole["model"].get("type") != "BPE" or whole.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError(f"{path} is no byte-level vocabulary that cuts texts by its own pattern alone")
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError(f"{path} has added tokens that take in their surroundings")
    return sorted((t["content"] for t in added), key=len, reverse=True)


def piece_counts(counts: DataFrame, path: str) -> DataFrame:
    """(word, n, pieces) of (word, n): the number of ids of each pre-token."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _library(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                pieces = [len(e.ids) for e in tokenizer.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pieces, pa.int64())], ["word", "n", "pieces"])

    return counts.mapInArrow(encoded, "word string, n long, pieces long")


def _summing(head, pattern: str):
    """A kernel: segments of documents to the pieces of their frequent pre-tokens, and the other ones with their frequencies."""

    def words_of(parts: pa.Array, split) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of distinct parts, and the part of each."""
        found = pc.extract_regex(parts, PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        marks = pc.fill_null(pc.greater(pc.binary_length(found.field(1)), 0), False).to_numpy(zero_copy_only=False) & plain
        others = np.flatnonzero(~plain)
        lists = [split(part) for part in parts.take(pa.array(others)).to_pylist()]
        own = pa.array([w for words in lists for w in words], parts.type)
        words = pa.concat_arrays([found.field(0).filter(pa.array(plain)), found.field(1).filter(pa.array(marks)), own])
        return words, np.concatenate([np.flatnonzero(plain), np.flatnonzero(marks), np.repeat(others, [len(x) for x in lists])]).astype(np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        split = splitter(pattern)
        known, pieces = head.value
        pieces = np.append(pieces, 0)
        for whole in batches:
            ends = np.cumsum(whole.column("n_bytes").to_numpy(), dtype=np.int64)
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
                batch, at = whole.slice(at, to - at), to
                lists = batch.column("segments")
                segments, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                parts, upto = cut_all(segments)
                doc = np.repeat(owner, np.diff(upto, prepend=0))
                coded = parts.dictionary_encode()
                codes = coded.indices.to_numpy()
                words, part = words_of(coded.dictionary, split)
                place = pc.index_in(words, known)
                unknown = place.is_null().to_numpy(zero_copy_only=False)
                mine = pieces[pc.fill_null(place, len(known)).to_numpy(zero_copy_only=False)]
                size = len(coded.dictionary)
                sums = np.bincount(part, weights=mine, minlength=size)
                total = np.bincount(doc, weights=sums[codes] if size else None, minlength=len(batch)).astype(np.int64)
                # The rest, by document and part, then by document and word.
                rare = np.zeros(size, bool)
                rare[part[unknown]] = True
                seen = rare[codes] if size else np.zeros(0, bool)
                pairs = pa.table([doc[seen], codes[seen].astype(np.int64)], ["doc", "part"]).group_by(["doc", "part"], use_threads=False).aggregate([([], "count_all")])
                left = pa.table([pa.array(part[unknown]), words.filter(pa.array(unknown))], ["part", "word"])
                tail = pairs.join(left, "part", join_type="inner", use_threads=False)
                tail = tail.group_by(["doc", "word"], use_threads=False).aggregate([("count_all", "sum")]).sort_by("doc")
                offsets = np.searchsorted(tail.column("doc").to_numpy(), np.arange(len(batch) + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([tail.column("word").combine_chunks(), tail.column("count_all_sum").combine_chunks().cast(pa.int64())], fields=list(TAIL.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id"), batch.column("doc_id"), batch.column("n_bytes"), pc.add(batch.column("n_added"), pa.array(total)), pa.ListArray.from_arrays(pa.array(offsets), items).cast(TAIL)],
                    ["row_id", "doc_id", "n_bytes", "n_head", "tail"],
                )

    return kernel


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): each text's UTF-8 bytes and tokens, as the library gives them for the whole text.

    * Added tokens that stand in a text count as one each, as the library's default is; none are put at the ends.
    * Null text counts as empty: no bytes and no tokens. Rows with equal or null ids are counted each for itself.
    * A long text costs time in proportion to its length, and lies with its pre-tokens in one row of one task.
    * An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = "|".join(re.escape(t) for t in added_tokens(path))
    segments = F.split(text, cut, -1) if cut else F.array(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), segments.alias("segments"))
    pattern = public_tokenizers.PATTERN
    counts = count_pieces(rows.select(F.explode("segments")), splitter(pattern))
    sizes = checkpointed(piece_counts(counts, path))
    known = frequent(sizes, head).select("word", "pieces").toArrow()
    shared = spark.sparkContext.broadcast((known.column("word").combine_chunks(), known.column("pieces").to_numpy()))
    rows = rows.withColumns({"row_id": F.monotonically_increasing_id(), "n_added": (F.size("segments") - 1).cast("long")})
    schema = "row_id long, doc_id long, n_bytes long, n_head long, tail array<struct<word: string, n: bigint>>"
    found = checkpointed(rows.select("row_id", "doc_id", "n_bytes", "n_added", "segments").mapInArrow(_summing(shared, pattern), schema))
    tail = found.select("row_id", F.inline("tail")).join(sizes.select("word", "pieces"), "word")
    tail = tail.groupBy("row_id").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_tail"))
    n = F.col("n_head") + F.coalesce("n_tail", F.lit(0).cast("long"))
    rows = found.drop("tail").join(tail, "row_id", "left").withColumn("n_tokens", n)
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
