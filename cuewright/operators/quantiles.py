"""Exact percentiles of groups of any size, in bounded memory for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.sources.tables import stored

#: Bins of a round, and values of a group that are ranked as they are.
BINS, FEW = 4096, 100_000


def quantiles(rows: DataFrame, value: str, few: int | None = None, bins: int | None = None, **shares: float) -> DataFrame:
    """(job_id, a column for each share): percentiles between neighbours, as ``percentile`` gives them to the last bit.

    The two values around a share have known ranks. A round counts the values between a least and a greatest one in equal bins, keeps
    the bin with the rank, and takes its true least and greatest value for the next; two different values never share
    all rounds. Ranges of at most ``few`` values are ranked. Nulls and NaN count as nothing; a job without values has nulls.
    """
    few, bins = few or FEW, bins or BINS
    v = F.col("_v")
    rows = rows.select("job_id", F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_v"))
    jobs = rows.groupBy("job_id").agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    position = lambda share: (F.col("_n") - 1) * F.lit(float(share))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(position(s)), F.ceil(position(s))) for s in shares.values()])))
    sought = stored(jobs.select("job_id", "_n", "_lo", "_hi", F.when(F.col("_n") > 0, ranks).alias("_ranks")))
    todo = sought.select("job_id", F.explode("_ranks").alias("_rank"), "_lo", "_hi").withColumns({"_k": F.col("_rank"), "_m": F.lit(None).cast("long")})
    todo = todo.join(sought.select("job_id", F.col("_n").alias("_all")), "job_id").withColumn("_m", F.col("_all")).drop("_all")
    done = []
    rows = rows.filter("_v IS NOT NULL")
    target = ["job_id", "_rank"]

    def ranked(counts: DataFrame, order: str) -> DataFrame:
        """The row of each target's rank, and how many values lie before it."""
        w = Window.partitionBy(*target).orderBy(order)
        upto = counts.withColumn("_upto", F.sum("_c").over(w))
        return upto.filter((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c")))

    while True:
        open_ = todo.filter((F.col("_lo") < F.col("_hi")) & (F.col("_m") > few))
        done.append(todo.filter((F.col("_lo") >= F.col("_hi")) | (F.col("_m") <= few)))
        if open_.isEmpty():
            break
        within = rows.join(open_, "job_id").filter(v.between(F.col("_lo"), F.col("_hi")))
        # Halves, as the difference of two doubles may not be one.
        at = F.least(F.lit(bins - 1), F.floor((v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins))
        at = F.when(v == F.col("_hi"), bins - 1).otherwise(at)
        counts = within.groupBy(*target, "_k", at.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        todo = stored(ranked(counts, "_bin").select(*target, "_lo", "_hi", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k"), F.col("_c").alias("_m")))
    found = reduce(DataFrame.unionByName, done)
    last = rows.join(found, "job_id").filter(v.between(F.col("_lo"), F.col("_hi")))
    values = ranked(last.groupBy(*target, "_k", "_v").agg(F.count(F.lit(1)).alias("_c")), "_v")
    known = values.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_known"))

    def between(share: float) -> Column:
        at, low, high = position(share), F.floor(position(share)), F.ceil(position(share))
        a, b = F.try_element_at("_known", low), F.try_element_at("_known", high)
        return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)

    return sought.join(known, "job_id", "left").select("job_id", *[between(s).alias(name) for name, s in shares.items()])
