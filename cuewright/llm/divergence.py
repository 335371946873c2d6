"""How far each source's words diverge from those of the other sources of its language, priced exactly.

A source gives each kept term of its language a price p (parts of a thousand million, one added to every count), and two
sources diverge by the sum of floor((p - q)^2 / q) over all kept terms. That sum runs over the vocabulary, but most
terms stand in neither or one of two sources, and all terms with one count in a source have one price. So

* terms in neither count as if all terms were: a constant for each pair, times the size of the vocabulary;
* terms in one source are priced once for each count of its histogram, in place of that constant;
* terms in both are met in their postings, and what the two corrections above say of them is put right.

Postings are short, a source each. Sums over a pair's common terms are taken before the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import checkpointed
from cuewright.llm.slices import summing, words_by_spaces

#: What stands between terms.
GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Sources of all languages that are sent to all tasks; more of them meet by shuffles.
BROADCAST_GROUPS = 20_000
SCALE = 10**9
KEYS, VALUES = ["lang", "source", "term"], ["n", "docs"]


def _terms(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of documents: places, and documents with the term."""
    words, doc = words_by_spaces(pc.replace_substring_regex(pc.ascii_lower(batch.column("text")), GAPS, " "))
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    places = pa.table([pa.array(doc * size + coded.indices.to_numpy())], ["key"]).group_by("key", use_threads=False).aggregate([([], "count_all")])
    key = places.column("key").to_numpy()
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    many = max(1, len(source.dictionary))
    group = lang.indices.to_numpy().astype(np.int64) * many + source.indices.to_numpy()
    rows = pa.table([pa.array(group[key // size] * size + key % size), places.column("count_all")], ["key", "n"])
    rows = rows.group_by("key", use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    key = rows.column("key").to_numpy()
    names = [lang.dictionary.take(pa.array(key // size // many)), source.dictionary.take(pa.array(key // size % many)), coded.dictionary.take(pa.array(key % size))]
    return pa.table([*names, rows.column("n_sum").cast(pa.int64()), rows.column("count_all").cast(pa.int64())], [*KEYS, *VALUES])


def price(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kinds)): exact, as the product is a decimal. Null where there are no terms."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.when(kinds > 0, F.call_function("div", product, (total + kinds).cast("decimal(20,0)")) + 1)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); prices are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _wide(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Part ``pair`` has each other source of the language; part ``term`` the ``top`` terms of the source that weigh more there than in the
    whole language. A language keeps the terms of at least ``min_docs`` of its documents. Ranks go by value, then item in UTF-8 order.

    * Null text, lang and source count as ''. A source without kept terms takes part, and where a language keeps none all values are 0.
    * Rows are documents: repeated rows count each. Ids and further columns are ignored; an empty table gives an empty result.
    * A very long text is counted in one task like any other, in memory of its distinct terms.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    rows = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    found = rows.mapInArrow(summing(_terms, "text", KEYS, VALUES), "lang string, source string, term string, n long, docs long")
    found = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    postings = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("posts"))
    kept = checkpointed(postings.filter(F.col("docs") >= min_docs).drop("docs"))
    each = kept.select("lang", "term", "total", F.inline("posts"))
    counts = checkpointed(each.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("k")))

    totals = counts.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("k")).alias("size"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("total").alias("lang_size"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = checkpointed(groups.select("lang", "source", zero("size"), zero("kinds"), zero("lang_size")).withColumn("p0", price(F.lit(0).cast("long"), F.col("size"), F.col("kinds"))))
    few = groups.count() <= BROADCAST_GROUPS
    known = F.broadcast(groups) if few else groups
    side = lambda s: known.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "size", "kinds", "p0")])

    # Terms in neither source: as if that were all.
    a, b = side("a"), side("b")
    both = a.join(b, "lang").filter(F.col("source_a") != F.col("source_b"))
    flat = F.coalesce(_wide(F.col("kinds_a")) * _wide(divergence(F.col("p0_a"), F.col("p0_b"))), F.lit(0).cast("decimal(38,0)"))
    parts = [both.select("lang", "source_a", "source_b", flat.alias("v"))]

    # Terms in one: by the counts of its histogram.
    priced = counts.withColumnRenamed("source", "source_a").join(a, ["lang", "source_a"]).withColumn("p", price(F.col("n"), F.col("size_a"), F.col("kinds_a")))
    priced = priced.select("lang", "source_a", "p", "k", "p0_a").join(b, "lang").filter(F.col("source_a") != F.col("source_b"))
    there = _wide(F.col("k")) * _wide(divergence(F.col("p"), F.col("p0_b")) - divergence(F.col("p0_a"), F.col("p0_b")))
    back = _wide(F.col("k")) * _wide(divergence(F.col("p0_b"), F.col("p")) - divergence(F.col("p0_b"), F.col("p0_a")))
    ways = F.array(F.struct(F.col("source_a"), F.col("source_b"), there.alias("v")), F.struct(F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), back.alias("v")))
    parts.append(priced.select("lang", F.inline(ways)))

    # Terms in both: their postings' pairs, each once.
    met = kept.filter(F.size("posts") > 1).select("lang", "posts", F.posexplode("posts").alias("i", "x"))
    met = met.select("lang", "x", F.explode(F.slice("posts", F.col("i") + 2, F.size("posts"))).alias("y"))
    met = met.select("lang", F.col("x.source").alias("source_a"), F.col("x.n").alias("n_a"), F.col("y.source").alias("source_b"), F.col("y.n").alias("n_b"))
    met = met.join(a, ["lang", "source_a"]).join(b, ["lang", "source_b"])
    met = met.withColumns({s: price(F.col(f"n_{s}"), F.col(f"size_{s}"), F.col(f"kinds_{s}")) for s in "ab"})
    fix = lambda p, q, p0, q0: divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)
    cols = [F.col(c) for c in ("a", "b", "p0_a", "p0_b")]
    met = met.select("lang", "source_a", "source_b", fix(*cols).alias("there"), fix(cols[1], cols[0], cols[3], cols[2]).alias("back"))
    # Sums of 64-bit values in two halves, which cannot overflow.
    halves = [f(F.col(c)).alias(f"{c}_{h}") for c in ("there", "back") for h, f in (("high", lambda v: F.sum(F.shiftright(v, 32))), ("low", lambda v: F.sum(v.bitwiseAND(F.lit((1 << 32) - 1).cast("long")))))]
    sums = met.groupBy("lang", "source_a", "source_b").agg(*halves)
    whole = lambda c: (F.col(f"{c}_high").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col(f"{c}_low").cast("decimal(20,0)")).cast("decimal(38,0)").alias("v")
    parts.append(sums.select("lang", F.inline(F.array(F.struct("source_a", "source_b", whole("there")), F.struct(F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), whole("back"))))))

    pairs = reduce(DataFrame.unionByName, [p.select("lang", "source_a", "source_b", F.col("v").cast("decimal(38,0)").alias("v")) for p in parts])
    pairs = pairs.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum("v").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    weighed = each.join(known, ["lang", "source"])
    weighed = weighed.withColumns({"p": price(F.col("n"), F.col("size"), F.col("kinds")), "q": price(F.col("total"), F.col("lang_size"), F.col("kinds"))}).filter("p > q")
    terms = weighed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
