"""Packing of token sequences, balanced by attention cost.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n**2``. Documents are tokenised and packed where they are
read: no shuffle. Documents are taken in blocks of bounded size; their full sequences stand alone, and what is
left of each is assigned, longest first, to the cheapest of the block's sequences that has room. A block opens
just as many sequences as its tokens need; a piece that fits nowhere whole is cut over the roomiest ones, so
each block wastes less than one sequence.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import small_batches

LINEAR, QUADRATIC = 1.0, 1 / 512
#: Tokens to be packed in a block.
BLOCK_TOKENS = 1_000_000
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
)
SCHEMA = pa.schema(
    [(n, pa.float64() if n == "cost" else pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost")]
)


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: np.ndarray, room: int) -> list[tuple[int, int, int, int]]:
    """Pack pieces of at most ``room`` tokens: (piece, start, length, sequence) of each part, in order of packing."""
    total = int(lengths.sum())
    m = -(-total // room)
    left, costs = np.full(m, room, np.int64), np.zeros(m)
    out = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, start = int(lengths[i]), 0
        while n:
            fits = left >= n
            if fits.any():
                s = int(np.argmin(np.where(fits, costs, np.inf)))
                part = n
            else:
                s = int(np.argmax(left))
                part = int(left[s])
            out.append((i, start, part, s))
            left[s] -= part
            costs[s] += cost(part)
            start += part
            n -= part
    return out


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, to the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """bytes -> id of a byte-level BPE file if its ids are the order of its merges, so that ranks give the same ids."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or whole.get("normalizer") or whole.get("truncation") or before.get("type") != "ByteLevel":
        return None
    if before.get("add_prefix_space") or not before.get("use_regex", True) or any(t.get("normalized") for t in whole.get("added_tokens", [])):
        return None
    letters, vocab = byte_letters(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or any(vocab.get(c, 256) > 255 for c in letters):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}


def _tokenizer(path: str):
    """A function from text to the bytes of its ids (little-endian unsigned 32-bit), as the tokenizers library gives them.

    That library takes some 300 ns a letter. Where a vocabulary's ids are its merge ranks, tiktoken gives the same ids
    from the same file in a tenth of that; texts with special tokens, and other vocabularies, go to the library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    ranks = merge_ranks(path)
    fast = ranks and tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> bytes:
        if not fast or any(s in text for s in special):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return ids


def pack(docs: DataFrame, tokenizer_path: str, room: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``room`` tokens; one row per piece.

    A document's tokens are its ids and ``end_id``; ``start`` counts those before the piece, ``offset`` those
    before it in its sequence. ``sequence_id`` is unique; sequences never mix tokens of two tasks.

    * Null text counts as empty: one token. Rows with equal or null ids are packed each for itself.
    * An empty table gives an empty result; further columns are ignored.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 40
        rows: list[tuple] = []
        rest: list[tuple] = []  # doc_id, doc_tokens, start, bytes
        held = 0

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
            rows.clear()
            return out

        def close() -> None:
            nonlocal next_id, held
            if rest:
                fill: dict[int, int] = {}
                for i, start, part, s in assign(np.array([len(r[3]) // 4 for r in rest]), room):
                    doc_id, total, first, raw = rest[i]
                    rows.append((doc_id, first + start, part, zlib.crc32(raw[4 * start : 4 * (start + part)]), total, next_id + s, fill.get(s, 0), cost(part)))
                    fill[s] = fill.get(s, 0) + part
                next_id += len(fill)
            rest.clear()
            held = 0

        for doc_id, text in ((i, t) for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            raw = (encode(text.as_py()) if text.is_valid else b"") + end
            total = len(raw) // 4
            full = total // room * room
            for start in range(0, full, room):
                rows.append((doc_id, start, room, zlib.crc32(raw[4 * start : 4 * (start + room)]), total, next_id, 0, cost(room)))
                next_id += 1
            if total > full:
                rest.append((doc_id, total, full, raw[4 * full :]))
                held += total - full
            if held >= BLOCK_TOKENS:
                close()
            if len(rows) >= 20_000:
                yield emit()
        close()
        if rows:
            yield emit()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(packed, PIECES)
