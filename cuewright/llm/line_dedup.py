"""Removal of lines that many sites share, by HyperLogLog spread.

Every line is hashed; per hash a HyperLogLog sketch of the sites is built by partial aggregation, so a
line that stands in a third of all documents reaches the shuffle as one row per task. Sketches far from
the threshold decide at once; for lines near it the exact number of distinct sites is counted. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import checkpointed

#: At most this many line hashes are broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_LINES = 200_000


def line_spread(lines: DataFrame, min_sites: int, long_sites: int, lg_k: int = 10, margin: float = 0.15) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` sites, with ``first_id``, the smallest document id.

    ``lines`` has ``h1, h2`` (128 bits of hash), ``site``, ``doc_id``, ``long``; long lines need ``long_sites``.
    ``margin`` is about four standard errors of a sketch with 2**``lg_k`` registers: an estimate within it of
    the threshold is not trusted.
    """
    need = F.when(F.max("long"), long_sites).otherwise(min_sites)
    seen = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), need.alias("need")
    )
    seen = checkpointed(
        seen.filter(F.col("n") >= F.col("need"))
        .withColumn("sites", F.hll_sketch_estimate("sketch"))
        .filter(F.col("sites") >= F.col("need") * (1 - margin))
        .select("h1", "h2", "sites", "first_id", "need")
    )
    sure = seen.filter(F.col("sites") > F.col("need") * (1 + margin)).select("h1", "h2", "first_id")
    near = seen.filter(F.col("sites") <= F.col("need") * (1 + margin))
    wanted = near.select("h1", "h2", "first_id", "need")
    if near.count() <= BROADCAST_LINES:
        rows = lines.join(F.broadcast(wanted), ["h1", "h2"])
    else:  # reduced to one row per line and site before the join, so no line is hot there
        rows = lines.select("h1", "h2", "site").distinct().join(wanted, ["h1", "h2"])
    exact = (
        rows.groupBy("h1", "h2", "first_id", "need", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2", "first_id", "need")
        .agg(F.count("site").alias("sites"))
        .filter(F.col("sites") >= F.col("need"))
        .select("h1", "h2", "first_id")
    )
    return sure.unionByName(exact)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 10,
    long_sites: int | None = None,
    long_chars: int = 60,
) -> DataFrame:
    """Remove cross-site lines from every document but the one with the smallest id that holds them.

    Returns every input row with all its columns, ``text`` without the removed lines, and two further
    columns ``n_lines`` and ``n_removed`` (replacing any of that name).

    * Lines are the parts between ``\\n``; they are compared after trimming spaces, tabs and returns.
      Blank lines are never removed.
    * A line is removed where at least ``min_sites`` distinct sites have it, a trimmed line of ``long_chars``
      characters or more where ``long_sites`` have it (None: no other threshold). The first document keeps
      every copy of the line that it has. Lines in documents with a null id count, and are removed; a
      line that only such documents have is left.
    * Null sites are not counted as sites. Null text stays null, with 0 lines; empty text has 1 line.
    * An empty table gives an empty result.
    """
    base = docs.drop("n_lines", "n_removed")
    keep = [c for c in base.columns if c != text_col]
    trimmed = F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    numbered = base.select(
        F.monotonically_increasing_id().alias("_uid"),
        F.struct(*[F.col(c) for c in keep]).alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(site_col).alias("_site"),
        F.col(text_col).alias("_text"),
    )
    rows = numbered.select("_uid", "_row", "_id", "_site", F.posexplode_outer(F.split("_text", "\n", -1)).alias("_pos", "line")).withColumn("_key", trimmed)
    hashed = rows.withColumns({"h1": F.xxhash64("_key"), "h2": F.xxhash64("_key", F.lit(1))})
    solid = hashed.filter(F.col("_key") != "").select("h1", "h2", F.col("_site").cast("string").alias("site"), F.col("_id").alias("doc_id"), (F.char_length("_key") >= long_chars).alias("long"))
    spread = checkpointed(line_spread(solid, min_sites, min_sites if long_sites is None else long_sites))
    table = F.broadcast(spread) if spread.count() <= BROADCAST_LINES else spread
    marked = hashed.join(table, ["h1", "h2"], "left").withColumn(
        "_out",
        F.col("first_id").isNotNull() & (F.col("_key") != "") & (F.col("_id").isNull() | (F.col("_id") != F.col("first_id"))),
    )
    grouped = marked.groupBy("_uid").agg(
        F.first("_row").alias("_row"),
        F.count("line").alias("n_lines"),
        F.count(F.when(F.col("_out"), 1)).alias("n_removed"),
        F.sort_array(F.collect_list(F.when(~F.coalesce("_out", F.lit(False)) & F.col("line").isNotNull(), F.struct("_pos", "line")))).alias("_left"),
    )
    text = F.when(F.col("n_lines") > 0, F.array_join(F.transform("_left", lambda x: x["line"]), "\n"))
    return grouped.select(
        *[(text.alias(c) if c == text_col else F.col("_row")[c].alias(c)) for c in base.columns], "n_lines", "n_removed"
    )
