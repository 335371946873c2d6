"""Language-model scores from the lattice of subword segmentations.

An existing vocabulary of pieces, each with the existing score of its rank, is weighted by how often the
training words use it. A word's probability is the sum over all ways to cut it into pieces, by a forward
recursion in log space; a text's is the product over its words and an end token, so that all texts together
have probability 1 at most.

Word counts are summed over all training texts. The frequent words (a bounded table) reach every worker with
their counts and scores; the counts of rare words are joined by a shuffle of those words alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import checkpointed, held_fold, small_batches
from cuewright.llm.words import count_words, frequent

#: Frequent words sent to every worker (some 200 bytes each there).
AHEAD = 300_000
MARK = "▁"
FOLDS, HELD = 5, 1


def words(text: str) -> list[bytes]:
    """ASCII letters lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _decoded(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words(text)]


class Lattice:
    """Natural log-probabilities of words, from weights of the vocabulary's pieces."""

    def __init__(self, pieces: dict[str, float], bytes_: list[float]):
        self.pieces, self.bytes = pieces, bytes_
        self.letters: dict[str, float] = {}
        self.widest: dict[str, int] = {}  # by the first three letters
        for piece in pieces:
            if len(piece) > 2:
                self.widest[piece[:3]] = max(len(piece), self.widest.get(piece[:3], 0))

    def word(self, word: str) -> float:
        """log of the summed probability of all segmentations of the mark and the word.

        A letter may also be spelled by the pieces of its bytes, so every word has a segmentation.
        """
        s, get, widest, letters, exp, log = MARK + word, self.pieces.get, self.widest.get, self.letters, math.exp, math.log
        n = len(s)
        reach: list[list[float]] = [[] for _ in range(n + 1)]
        at = 0.0
        for i in range(n):
            if i:
                terms = reach[i]
                if len(terms) == 1:
                    at = terms[0]
                else:
                    top = max(terms)
                    at = top + log(sum([exp(t - top) for t in terms]))
                reach[i] = []
            for j in range(i + 1, min(n, i + max(2, widest(s[i : i + 3], 0))) + 1):
                lp = get(s[i:j])
                if lp is not None:
                    reach[j].append(at + lp)
            letter = letters.get(s[i])
            if letter is None:
                letter = letters[s[i]] = sum([self.bytes[b] for b in s[i].encode("utf-8", "surrogatepass")])
            reach[i + 1].append(at + letter)
        top = max(reach[n])
        return top + log(sum([exp(t - top) for t in reach[n]]))


def vocabulary(model: bytes) -> tuple[list[str], list[float], dict[int, int]]:
    """Pieces, their existing scores, and the ids of the byte pieces by byte."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = p.get_piece_size()
    return [p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}


def weighted(model: bytes, counts: dict[int, int], texts: int) -> tuple[Lattice, float]:
    """The lattice and the end token's log-probability.

    A piece's weight is its count plus half a count on average, dealt out by its existing score: a score of -r
    (the r-th merge) stands for a share of 1 / (1 + r).
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces, scores, of_byte = vocabulary(model)
    usable = [i for i in range(len(pieces)) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    lowest = min((scores[i] for i in usable if scores[i] > -1e8), default=0.0)
    prior = {i: 1 / (1 - (lowest if p.is_byte(i) else max(scores[i], lowest))) for i in usable}
    scale = 0.5 * len(usable) / sum(prior.values())
    weight = {i: counts.get(i, 0) + scale * prior[i] for i in usable}
    total = sum(weight.values()) + texts + 0.5
    logs = {i: math.log(w / total) for i, w in weight.items()}
    lattice = Lattice({pieces[i]: logs[i] for i in usable if not p.is_byte(i)}, [logs[of_byte[b]] for b in range(256)])
    return lattice, math.log((texts + 0.5) / total)


def piece_counts(counts: DataFrame, model: bytes) -> dict[int, int]:
    """How often the training words use each piece, as the vocabulary's own tokenizer cuts them: one sum per piece."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        sums = np.zeros(p.get_piece_size(), np.int64)
        for batch in batches:
            for ids, n in zip(p.encode(batch.column(0).to_pylist(), num_threads=1), batch.column(1).to_pylist(), strict=True):
                for i in ids:
                    sums[i] += n
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used], pa.int64())], names=["id", "n"])

    rows = counts.select("word", "n").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in rows}


ROWS = "uid long, doc_id long, n_tokens long, n_known long, base double, score double, word string, k long"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
LN10 = math.log(10)


def lattice_scores(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ahead: int = AHEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text.

    * ``held_out``: crc32 of the id's text modulo 5 is 1; such texts are not learned from.
    * Null text counts as empty: its only token is the end. Repeated rows count, and are scored, each for itself.
    * Without training texts every count is 0, and pieces have the weights of their existing scores.
    * An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:
        model = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = rows.filter(held_fold(F.col("doc_id"), FOLDS) != HELD)
    counts = checkpointed(count_words(seen.select("text"), _decoded))
    stats = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = seen.select("doc_id").count()
    total, kinds = (stats.n or 0) + ends, stats.v + (ends > 0)
    lattice, end = weighted(model, piece_counts(counts, model), ends)
    shared = spark.sparkContext.broadcast(lattice)
    below = math.log10(total + 0.5 * (kinds + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.word(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.float64())], names=["word", "n", "x"])

    common = frequent(counts, ahead)
    least = common.agg(F.min("n")).first()[0] or 0
    table = common.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(scored, "word string, n long, x double").toArrow()
    place = {w.encode("utf-8"): i for i, w in enumerate(table.column("word").to_pylist())}
    known = spark.sparkContext.broadcast(
        (place, np.append(np.log10(table.column("n").to_numpy() + 0.5) - below, 0.0), np.append(table.column("x").to_numpy(), 0.0))
    )
    end_base = math.log10(ends + 0.5) - below

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base, score = known.value
        find, lattice, missing = place.get, shared.value, len(place)
        task = TaskContext.get()
        uid = (task.partitionId() if task else 0) << 40
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = words(text.as_py())
                ids = np.array([find(w, missing) for w in parts], np.int64)
                rare = Counter(parts[i] for i in np.flatnonzero(ids == missing).tolist())
                total, lone = float(score[ids].sum()) + end, []
                for raw, k in rare.items():
                    w = raw.decode("utf-8", "replace")
                    total += k * lattice.word(w)
                    lone.append((uid, None, None, None, None, None, w, k))
                found = len(parts) - sum(rare.values()) + (ends > 0)
                # a word has no space: this key, of which there is one, joins with nothing
                out.append((uid, doc_id, len(parts) + 1, found, float(base[ids].sum()) + end_base, total / LN10, f" {uid}", 0))
                out += lone
                uid += 1
            types = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)

    rare = counts.filter(F.col("n") < least) if least else counts
    joined = rows.mapInArrow(texts, ROWS).join(rare.select("word", F.col("n").alias("c")), "word", "left")
    lone = F.col("k") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - below)
    return (
        joined.groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_tokens").alias("n_tokens"),
            (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0))).alias("n_known"),
            F.sum(F.coalesce("base", lone)).alias("base_score"),
            F.max("score").alias("score"),
        )
        .select(
            "doc_id",
            (held_fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(total).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )
    )
