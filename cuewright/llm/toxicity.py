"""Toxicity by class-conditional Kneser-Ney models.

Words are read as letters: each class has an n-gram model of the letters inside words whose top order holds
its own discounted counts, while all lower orders are one Kneser-Ney backoff distribution of continuation
counts that both classes share. A word that neither class knows therefore costs both alike, and a rare
expression counts by the n-grams it shares with known ones. As the backoff is shared, the ratio of the classes
needs only the n-grams that one of them has seen, and per context the ratio of the backoff weights.

A text is judged by its length-normalised log-likelihood ratio, over all its words and over those most typical
of toxic text; a logistic fit on labelled rows that the counts have not seen turns these into a score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import held_fold, small_batches

ORDER, DISCOUNT = 5, 0.75
#: Rows of each class that the counts may use, and rows for the logistic fit: the classifier's bounded sample.
MOST_ROWS, MOST_FIT = 40_000, 20_000
#: Words whose ratio a worker remembers.
REMEMBERED = 200_000
START, STOP = "\x02", "\x03"
FOLDS, HELD, FIT = 5, 0, 4
FEATURES = 5


def words(text: str) -> list[bytes]:
    """ASCII letters lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (toxic, text) to (toxic, gram, n), summed in the worker."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        toxic, gram, n = [], [], []
        for y in (0, 1):
            grams: Counter[str] = Counter()
            for raw, k in seen[y].items():
                w = START + raw.decode("utf-8", "replace") + STOP
                for i in range(1, len(w)):
                    for a in range(max(0, i - ORDER + 1), i + 1):
                        grams[w[a : i + 1]] += k
            toxic += [y] * len(grams)
            gram += grams.keys()
            n += grams.values()
            seen[y].clear()
        return pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], names=["toxic", "gram", "n"])

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen[toxic].update(words(text.as_py()) if text.is_valid else ())
        if len(seen[0]) + len(seen[1]) > 200_000:
            yield flush()
    yield flush()


class Ratios:
    """log10 P(letter | context, toxic) / P(letter | context, ordinary), from the counts of n-grams of both classes."""

    def __init__(self, counts: tuple[dict[str, int], dict[str, int]]):
        continued: Counter[str] = Counter()
        for gram in counts[0].keys() | counts[1].keys():
            if len(gram) > 1:
                continued[gram[1:]] += 1
        total: Counter[str] = Counter()
        types: Counter[str] = Counter()
        for gram, n in continued.items():
            total[gram[:-1]] += n
            types[gram[:-1]] += 1
        alphabet = 1 + sum(len(g) == 1 for g in continued)
        memo: dict[str, float] = {"": 1 / alphabet}

        def shared(gram: str) -> float:
            if (known := memo.get(gram)) is None:
                known = 1 / alphabet if len(gram) == 1 else shared(gram[1:])
                if n := total.get(gram[:-1]):
                    known = max(continued.get(gram, 0) - DISCOUNT, 0) / n + DISCOUNT * types[gram[:-1]] / n * known
                memo[gram] = known
            return known

        top = lambda g: len(g) == ORDER or g[0] == START
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        kinds: tuple[Counter, Counter] = (Counter(), Counter())
        for y in (0, 1):
            for gram, n in counts[y].items():
                if len(gram) > 1 and top(gram):
                    sums[y][gram[:-1]] += n
                    kinds[y][gram[:-1]] += 1

        def back(y: int, context: str) -> float:
            return DISCOUNT * kinds[y][context] / sums[y][context] if context in sums[y] else 1.0

        def chance(y: int, gram: str) -> float:
            context = gram[:-1]
            own = max(counts[y].get(gram, 0) - DISCOUNT, 0) / sums[y][context] if context in sums[y] else 0.0
            return own + back(y, context) * shared(gram[1:])

        self.context = {c: math.log10(back(1, c) / back(0, c)) for c in sums[0].keys() | sums[1].keys()}
        self.gram = {g: math.log10(chance(1, g) / chance(0, g)) for g in counts[0].keys() | counts[1].keys() if len(g) > 1 and top(g)}

    def word(self, raw: bytes) -> float:
        w = START + raw.decode("utf-8", "replace") + STOP
        gram, context, out = self.gram, self.context, 0.0
        for i in range(1, len(w)):
            g = w[max(0, i - ORDER + 1) : i + 1]
            x = gram.get(g)
            out += context.get(g[:-1], 0.0) if x is None else x
        return out


def features(values: np.ndarray) -> tuple[float, ...]:
    """Mean ratio of a word; the mean of its positive part; the highest; the mean of the three highest; log of the length."""
    if not len(values):
        return (0.0,) * FEATURES
    best = np.sort(values)[-3:] if len(values) > 3 else values
    return float(values.mean()), float(np.maximum(values, 0).mean()), float(values.max()), float(best.mean()), math.log1p(len(values))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights (the last one: the constant) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def _scored(ratios, weights, keep_features: bool):
    """A mapInArrow function: from (key, text) to (key, x: the features, or the score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ratios.value
        known: dict[bytes, float] = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                parts = words(text.as_py()) if text.is_valid else []
                if len(known) > REMEMBERED:
                    known.clear()
                values = []
                for w in parts:
                    v = known.get(w)
                    if v is None:
                        v = known[w] = model.word(w)
                    values.append(v)
                x = features(np.array(values))
                out.append(list(x) if keep_features else 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(a * b for a, b in zip((*x, 1.0), weights, strict=True)))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()) if keep_features else pa.float64())], names=["key", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS, most_fit: int = MOST_FIT):
    """(ratios, weights) from labelled rows outside the held-out fold; (None, share of toxic) if a class is missing.

    Counts come from three folds, the logistic fit from a fourth. Of more labelled rows than the bounds, those
    with the smallest hashes of their ids are used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", held_fold(F.col("id"), FOLDS).cast("int"))
        .filter(F.col("fold") != HELD)
        .withColumn("fit", F.col("fold") == FIT)
        .withColumn("u", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)))
    )
    sizes = {(r.fit, r.toxic): r.n for r in marked.groupBy("fit", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    share = sum(n for (_, y), n in sizes.items() if y) / max(1, sum(sizes.values()))
    if not all(sizes.get((False, y)) for y in (0, 1)):
        return None, share
    bound = F.lit(1 << 20)
    fits = sum(n for (f, _), n in sizes.items() if f)
    for (fit, y), n in sizes.items():
        most = most_fit if fit else most_rows
        if (fits if fit else n) > most:
            bound = F.when((F.col("fit") == fit) & (F.col("toxic") == y), int((1 << 20) * most / (fits if fit else n))).otherwise(bound)
    sample = F.broadcast(marked.filter(F.col("u") < bound).select("id", "toxic", "fit"))  # at most 2 * most_rows + most_fit rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    counts: tuple[dict, dict] = ({}, {})
    grams = texts.filter(~F.col("fit")).select("toxic", "text").mapInArrow(_grams, "toxic int, gram string, n long").groupBy("toxic", "gram").agg(F.sum("n").alias("n"))
    for batch in grams.toArrow().to_batches():
        for toxic, gram, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[toxic][gram] = n
    if not all(counts):
        return None, share
    ratios = spark.sparkContext.broadcast(Ratios(counts))
    rows = texts.filter("fit").select(F.col("toxic").alias("key"), "text").mapInArrow(_scored(ratios, None, True), "key int, x array<double>").toArrow()
    y = np.array(rows.column("key").to_pylist(), float)
    if not 0 < y.sum() < len(y):
        return ratios, np.array([0.0, 0.0, 0.0, 2.0, -1.0, -4.0])  # too few labels for a fit
    return ratios, logistic(np.array(rows.column("x").to_pylist(), float), y)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """Score every text: ``doc_id, held_out, score, predicted``.

    * ``held_out``: crc32 of the id's text is divisible by 5; such rows' labels are never looked at.
    * Null and empty texts get the score of a text without words. If a class has no labelled rows for
      training, every score is the share of toxic labels (0 without labels).
    * Repeated rows are scored each for itself. Repeated labels of an id count as toxic if one of them does;
      null labels are ignored. An empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    ratios, weights = train(docs, labels, id_col, text_col, label_col)
    scored = rows.select("key", F.lit(float(weights)).alias("x")) if ratios is None else rows.mapInArrow(_scored(ratios, [float(w) for w in weights], False), "key long, x double")
    return scored.select(
        F.col("key").alias("doc_id"),
        (held_fold(F.col("key"), FOLDS) == HELD).alias("held_out"),
        F.col("x").alias("score"),
        (F.col("x") >= threshold).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``.

    Texts are scored in their rows (no join back), so repeated and null ids need no care. Null and empty texts have the score of
    a text without words. Where one of the classes has no labelled rows nothing tells them apart, and all rows stay.
    """
    ratios, weights = train(docs, labels, id_col, text_col)
    if ratios is None:
        return docs
    schema = docs.schema
    inner = _scored(ratios, [float(w) for w in weights], False)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], names=["key", "text"])
            for scored in inner(iter([pair])):
                yield batch.filter(pa.array(scored.column("x").to_numpy() < threshold))

    return docs.mapInArrow(kept, schema)
