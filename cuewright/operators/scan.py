"""Running values of a job's rows in order, without a job in one task.

Rows are dealt out by job and range of their order; each range has its own running values, a small table holds what each range adds,
and what came before a range is carried into it. A job of 10^8 rows is 1,500 ranges, and 1,500 rows of that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column in a range.
RANGE = 1 << 16
KINDS = ("sum", "max_before", "last", "lag", "lead", "total")


def within_a_range(rows: DataFrame, order: str) -> bool:
    """Whether all jobs of a stored table lie within the first range."""
    first, last = rows.agg(F.min(order), F.max(order)).first()
    return first is None or 0 <= first and last < RANGE


def _windows(rows: DataFrame, order: str, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    all_rows = Window.partitionBy("job_id")
    job = all_rows.orderBy(order)
    upto, before = (job.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    kinds = {
        "sum": lambda v: F.sum(v).over(upto),
        "total": lambda v: F.sum(v).over(all_rows),
        "max_before": lambda v: F.max(v).over(before),
        "last": lambda v: F.last(v, True).over(upto),
        "lag": lambda v: F.lag(v).over(job),
        "lead": lambda v: F.lead(v).over(job),
    }
    return rows.withColumns({name: kinds[kind](value) for name, (kind, value) in wanted.items()})


def scan(rows: DataFrame, order: str, size: int | None = None, short: bool = False, **wanted: tuple[str, Column]) -> DataFrame:
    """Rows with a column for each of ``wanted`` (kind, value), over the job's rows in the order of an integer column.

    ``sum`` and ``last`` (the last value that is not null) include the row itself; ``max_before`` does not; ``lag`` and ``lead`` are the values of
    the rows next to it; ``total`` is the sum over all rows of the job. Nulls add nothing to a sum and are no maximum.
    The values must come from the row alone. Rows of one job with equal order have no defined order.
    ``short`` says that all jobs lie ``within_a_range``: then nothing is carried, and scans that follow each other share one shuffle and one sort.
    """
    if unknown := [kind for kind, _ in wanted.values() if kind not in KINDS]:
        raise ValueError(f"no such kind: {unknown}")
    if short:
        return _windows(rows, order, wanted)
    at = F.col(order)
    rows = rows.withColumn("_range", F.floor(at / (size or RANGE)))
    adds = {
        "sum": lambda v: F.sum(v),
        "total": lambda v: F.sum(v),
        "max_before": lambda v: F.max(v),
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), at)),
        "lag": lambda v: F.max_by(F.struct(v.alias("v")), at),
        "lead": lambda v: F.min_by(F.struct(v.alias("v")), at),
    }
    ranges = rows.groupBy("job_id", "_range").agg(*[adds[kind](value).alias(name) for name, (kind, value) in wanted.items()])
    job = Window.partitionBy("job_id").orderBy("_range")
    before = job.rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        "sum": lambda c: F.sum(c).over(before),
        "total": lambda c: F.sum(c).over(Window.partitionBy("job_id")),
        "max_before": lambda c: F.max(c).over(before),
        "last": lambda c: F.last(c, True).over(before),
        "lag": lambda c: F.lag(c).over(job),
        "lead": lambda c: F.lead(c).over(job),
    }
    carry = ranges.select("job_id", "_range", *[carried[kind](F.col(name)).alias(f"_c_{name}") for name, (kind, _) in wanted.items()])
    own = Window.partitionBy("job_id", "_range").orderBy(order)
    own_before = own.rowsBetween(Window.unboundedPreceding, -1)
    local = {
        "sum": lambda v: F.sum(v).over(own.rowsBetween(Window.unboundedPreceding, 0)),
        "total": lambda v: F.lit(None),
        "max_before": lambda v: F.max(v).over(own_before),
        "last": lambda v: F.last(v, True).over(own.rowsBetween(Window.unboundedPreceding, 0)),
        "lag": lambda v: F.lag(F.struct(v.alias("v"))).over(own),
        "lead": lambda v: F.lead(F.struct(v.alias("v"))).over(own),
    }
    joined = {
        "sum": lambda here, past: F.when(here.isNull(), past).otherwise(here + F.coalesce(past, here - here)),
        "total": lambda here, past: past,
        "max_before": lambda here, past: F.greatest(past, here),
        "last": lambda here, past: F.coalesce(here, past),
        "lag": lambda here, past: F.coalesce(here, past)["v"],
        "lead": lambda here, past: F.coalesce(here, past)["v"],
    }
    rows = rows.withColumns({f"_l_{name}": local[kind](value) for name, (kind, value) in wanted.items()}).join(carry, ["job_id", "_range"])
    rows = rows.withColumns({name: joined[kind](F.col(f"_l_{name}"), F.col(f"_c_{name}")) for name, (kind, _) in wanted.items()})
    return rows.drop("_range", *[f"_{x}_{name}" for name in wanted for x in "lc"])
