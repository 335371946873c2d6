"""Byte-level BPE encoding and decoding.

Merges are folded by Spark's higher-order functions over the bytes of distinct words, with the ranks of pairs as
a literal map. The words that make up most of the corpus are counted over all documents and encoded once; this
bounded table goes to the workers, which replace words by ids. Words that are not in it are encoded by the
same fold where they stand, once for each document, so texts are never shuffled. Decoding concatenates the
binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import checkpointed, let, small_batches
from cuewright.llm.words import PLAIN, count_pieces, cut_all, frequent, splitter

#: A word of more bytes than this goes through a heap instead of the fold, which takes quadratic time.
LONG_WORD = 400
#: Values of the fold's state: no pair, the first piece, the edge of the word.
NONE, PIECE, EDGE = 1 << 20, 1 << 21, 1 << 22
#: At most this many words are encoded ahead and sent to every worker (some 50 bytes each there).
AHEAD = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 bytes and rank, one a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f))}


def pair_table(ranks: dict[bytes, int]) -> tuple[Column, Column, Column]:
    """The ranks of all joinable pairs as three literals: where the row of a left id begins, and the rows, laid into each other.

    The pair of ids a, b is at place begin[a] + b: its left id stands in the second literal, its rank in the third. A
    left id counts from ``PIECE`` here and in the fold.
    """
    base = max(ranks.values()) + 1
    partners: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            if (left := ranks.get(piece[:k])) is not None and (right := ranks.get(piece[k:])) is not None:
                partners.setdefault(left, {})[right] = rank
    room = 3 * sum(map(len, partners.values())) + 1
    taken = np.zeros(room + base, bool)
    begin: list[int | None] = [None] * base
    owner: list[int | None] = [None] * (room + base)
    found: list[int | None] = [None] * (room + base)
    offset, rng = 0, random.Random(0)
    for left, row in sorted(partners.items(), key=lambda x: -len(x[1])):
        rights = np.fromiter(row, np.int64, len(row))
        while taken[offset + rights].any():
            offset = rng.randrange(room)
        taken[offset + rights] = True
        begin[left] = offset - PIECE
        for right, rank in row.items():
            owner[offset + right], found[offset + right] = left + PIECE, rank
        offset = rng.randrange(room)
    literal = lambda values: F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<int>")
    return literal(begin), literal(owner), literal(found)


def fold_merges(words: Column, table: tuple[Column, Column, Column]) -> Column:
    """The ids of each of ``words``, an array of arrays of the ids of single bytes.

    State of a word: one array in which pieces and the ranks of neighbours' pairs take turns, between two ``EDGE``
    that pair with nothing. A piece is its id above ``PIECE``, a pair without a rank is ``NONE``, so the least value is
    the rank to merge while there is one, and is the new piece's id. Each step puts the leftmost pair of that rank
    together and looks up the two ranks beside it.
    """
    begins, owners, places = table

    def folded(begin: Column, owner: Column, place: Column, p: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            at = F.get(begin, left - PIECE) + right
            return F.when(F.get(owner, at) == left, F.get(place, at)).otherwise(NONE)

        def merged(state: Column, low: Column, i: Column) -> Column:
            new = low + PIECE
            middle = F.array(rank(F.get(state, i - 4), new), new, rank(new, F.get(state, i + 2)))
            return F.flatten(F.array(F.slice(state, F.lit(1), i - 3), middle, F.slice(state, i + 3, F.size(state))))

        def step(state: Column) -> Column:
            place_of = lambda low: F.array_position(state, low).cast("int")
            return let(F.array_min(state), lambda low: F.when(low >= NONE, state).otherwise(let(place_of(low), lambda i: merged(state, low, i))))

        rest = F.slice(p, 2, F.greatest(F.size(p), F.lit(1)))
        pairs = F.flatten(F.zip_with(p, rest, lambda a, b: F.array(a, F.when(b.isNull(), F.lit(NONE)).otherwise(rank(a, b)))))
        start = F.flatten(F.array(F.array(F.lit(EDGE), F.lit(NONE)), pairs, F.array(F.lit(EDGE))))
        ids = lambda state: F.transform(F.filter(state, lambda x: (x >= PIECE) & (x < EDGE)), lambda x: x - PIECE)
        return F.aggregate(rest, start, lambda state, _: step(state), ids)

    return let(begins, lambda b: let(owners, lambda o: let(places, lambda r: F.transform(words, lambda p: folded(b, o, r, p)))))


def byte_ids(word: Column, ranks: dict[bytes, int]) -> Column:
    """A word's single bytes as pieces of the fold."""
    ids = F.array(*[F.lit(ranks[bytes([b])] + PIECE) for b in range(256)])
    return F.transform(F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.get(ids, F.conv(h, 16, 10).cast("int")))


def heap_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one very long word, in n log n steps."""
    n = len(piece)
    stop, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if stop[i] < n and (rank := ranks.get(piece[i : stop[stop[i]]])) is not None:
            heapq.heappush(heap, (rank, i, stop[stop[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or stop[i] >= n or stop[stop[i]] != end:
            continue
        gone[stop[i]] = True
        stop[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


MARK = 1 << 31
ENCODED = "doc_id long, ids binary, rare array<array<int>>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of ``source`` one after another."""
    ends = np.cumsum(lengths)
    return source[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


#: Words of the book by their bytes: up to 8, up to 16, up to 32. Longer ones and those with a NUL are not in it.
WIDTHS = ((0, 8), (8, 16), (16, 32))


class Book:
    """Words with their ids: sorted keys of fixed width, searched for many words at once."""

    def __init__(self, words: pa.Array, ids: pa.ListArray):
        flat, ends = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
        self.shelves, order = [], [np.zeros(0, np.int64)]
        for _, places, keys in self._by_width(words):
            rank = np.argsort(keys, kind="stable")
            self.shelves.append((keys[rank], sum(map(len, order))))
            order.append(places[rank])
        order = np.concatenate(order)
        sizes = ends[order + 1] - ends[order]
        self.flat = gather(flat, ends[order], sizes).astype(np.uint16 if len(flat) == 0 or flat.max() < 1 << 16 else np.uint32)
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32)

    @staticmethod
    def _by_width(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        sizes = pc.fill_null(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        for k, (above, width) in enumerate(WIDTHS):
            places = np.flatnonzero((sizes > above) & (sizes <= width))
            mine = words.take(pa.array(places))
            _, offsets, data = mine.buffers()
            raw = np.frombuffer(data, np.uint8)[: int(sizes[places].sum())] if len(places) else np.zeros(0, np.uint8)
            padded = np.zeros((len(places), width), np.uint8)
            padded[np.arange(width) < sizes[places][:, None]] = raw
            if not raw.all():  # a NUL, which padding would hide
                clean = ~pc.match_substring(mine, "\0").to_numpy(zero_copy_only=False)
                places, padded = places[clean], padded[clean]
            yield k, places, padded.view(">u8").astype(np.uint64).ravel() if width == 8 else padded.view(f"S{width}").ravel()

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, or -1."""
        out = np.full(len(words), -1, np.int64)
        for k, places, keys in self._by_width(words):
            known, first = self.shelves[k]
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                same = known[at] == keys
                out[places[same]] = first + at[same]
        return out

    def ranges(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the ids of the words at ``places``; nothing for -1."""
        starts = self.ends[places].astype(np.int64)
        lengths = self.ends[places + 1] - starts
        return np.where(places < 0, 0, starts), np.where(places < 0, 0, lengths)


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, ahead: int) -> DataFrame:
    """``doc_id, ids, rare_ids`` of every text: the ids of its rare words apart.

    In ``ids`` a value of 2**31 + k stands for the k-th of ``rare_ids``.
    """
    spark = docs.sparkSession
    small_batches(spark, 300, "2m")
    ranks = read_ranks(ranks_path)
    table = pair_table(ranks)
    single = np.array([ranks[bytes([b])] + PIECE for b in range(256)], np.int32)
    split = splitter(pattern)
    texts = docs.select(F.col(text_col).alias("text"))
    counts = checkpointed(count_pieces(texts, split).filter((F.col("n") > 1) & (F.octet_length("word") <= WIDTHS[-1][1])))
    known = frequent(counts, ahead).repartition(4 * spark.sparkContext.defaultParallelism).select("word", fold_merges(F.array(byte_ids(F.col("word"), ranks)), table)[0].alias("ids"))
    pairs = known.toArrow().combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in pairs.columns]
    shared, shared_ranks = spark.sparkContext.broadcast(Book(*columns)), spark.sparkContext.broadcast(ranks)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        book, ranks = shared.value, shared_ranks.value
        for batch in batches:
            parts, stops = cut_all(batch.column(1))
            unlike = parts.dictionary_encode()
            places = book.find(unlike.dictionary)
            missed = np.flatnonzero(places < 0)
            apart = unlike.dictionary.take(pa.array(missed))
            found = pc.extract_regex(apart, PLAIN)
            core, tail = (book.find(found.field(k)) for k in range(2))
            no_tail = pc.fill_null(pc.equal(found.field(1), ""), False).to_numpy(zero_copy_only=False)
            plain = found.is_valid().to_numpy(zero_copy_only=False) & (core >= 0) & ((tail >= 0) | no_tail)

            rare: list[bytes] = []
            seen: dict[str, bytes] = {}

            def of_word(word: str) -> bytes:
                if (ids := seen.get(word)) is None:
                    raw = word.encode("utf-8", "surrogatepass")
                    if (one := ranks.get(raw)) is not None:
                        ids = one.to_bytes(4, "little")
                    elif len(raw) > LONG_WORD:
                        ids = np.array(heap_merges(raw, ranks), "<u4").tobytes()
                    else:
                        ids = (MARK + len(rare)).to_bytes(4, "little")
                        rare.append(raw)
                    seen[word] = ids
                return ids

            others = apart.filter(pa.array(~plain)).to_pylist()
            own = [b"".join(map(of_word, split(part))) for part in others]
            # Two ranges of ids in the book: those of a part's word and of the marks after it. Other parts' ids come after all of them.
            starts, lengths = np.zeros((len(places), 2), np.int64), np.zeros((len(places), 2), np.int64)
            starts[:, 0], lengths[:, 0] = book.ranges(places)
            for k, at in enumerate((core, tail)):
                starts[missed[plain], k], lengths[missed[plain], k] = book.ranges(at[plain])
            flat = np.concatenate([gather(book.flat, starts.ravel(), lengths.ravel()).astype("<u4"), np.frombuffer(b"".join(own), "<u4")])
            lengths = lengths.sum(1)
            starts = np.cumsum(lengths) - lengths
            sizes = np.array([len(x) // 4 for x in own], np.int64)
            starts[missed[~plain]], lengths[missed[~plain]] = len(flat) - sizes.sum() + np.cumsum(sizes) - sizes, sizes
            which = unlike.indices.to_numpy()
            ids = gather(flat, starts[which], lengths[which])
            ends = np.concatenate([[0], np.cumsum(lengths[which])])[stops]
            yield placed(batch.column(0), ids, ends, rare)

    def placed(docs: pa.Array, ids: np.ndarray, ends: np.ndarray, rare: list[bytes]) -> pa.RecordBatch:
        """A row for each text of a batch, with the rare words that stand in it."""
        marked = np.flatnonzero(ids >= MARK)
        text = np.searchsorted(ends, marked, side="right")
        used, local = np.unique((text << 32) + (ids[marked] - MARK).astype(np.int64), return_inverse=True)
        sizes = np.bincount(used >> 32, minlength=len(ends))
        stops = np.cumsum([0, *sizes])
        ids[marked] = MARK + local - stops[text]
        here = [rare[k] for k in (used & 0xFFFFFFFF).tolist()]
        words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, here)]), pa.int32()), pa.array(single[np.frombuffer(b"".join(here), np.uint8)]))
        offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])
        return pa.RecordBatch.from_arrays([docs, texts, pa.ListArray.from_arrays(pa.array(stops, pa.int32()), words)], names=["doc_id", "ids", "rare"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoded, ENCODED)
    return rows.select("doc_id", "ids", fold_merges(F.col("rare"), table).alias("rare_ids"))


def joined(ids: pa.Array, rare: pa.Array) -> list[np.ndarray]:
    """All ids of each text, with those of its rare words in place."""
    found, ends = np.frombuffer(b"".join(ids.to_pylist()), "<u4"), np.cumsum(pc.binary_length(ids).to_numpy() // 4, dtype=np.int64)
    words = rare.flatten()
    bases = np.concatenate([[0], np.cumsum(pc.list_value_length(rare).to_numpy())])
    flat, stops = words.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
    marked = np.flatnonzero(found >= MARK)
    k = bases[np.searchsorted(ends, marked, side="right")] + (found[marked] - MARK).astype(np.int64)
    starts, lengths = np.arange(len(found)), np.ones(len(found), np.int64)
    starts[marked], lengths[marked] = len(found) + stops[k], stops[k + 1] - stops[k]
    out, ends = gather(np.concatenate([found, flat]), starts, lengths), np.concatenate([[0], np.cumsum(lengths)])[ends].tolist()
    return [out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ahead: int = AHEAD) -> DataFrame:
    """``doc_id, ids`` of every text: its ids as little-endian unsigned 32-bit integers.

    A word that is a piece itself is its id. Null text counts as empty and has no ids. Repeated rows are encoded each
    for itself; an empty table gives an empty result; further columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = joined(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.tobytes() for t in texts], pa.binary())], names=["doc_id", "ids"])

    return _encoded(docs, ranks_path, pattern, id_col, text_col, ahead).mapInArrow(rows, "doc_id long, ids binary")


def decode(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    return b"".join([pieces[i] for i in ids.tolist()])


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ahead: int = AHEAD) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; see ``encode`` for nulls and repeated rows."""
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    shared = spark.sparkContext.broadcast(pieces)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = joined(batch.column(1), batch.column(2))
            a = [hashlib.sha256(t.tobytes()).hexdigest() for t in texts]
            b = [hashlib.sha256(decode(t, shared.value)).hexdigest() for t in texts]
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, ranks_path, pattern, id_col, text_col, ahead).mapInArrow(digested, DIGESTS)
