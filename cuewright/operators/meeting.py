"""Joins of intervals that meet, on the job and a block of a dyadic grid, so that neither long jobs nor long intervals make a product.

An interval lives on the level of the grid whose blocks are as wide as itself, where it touches two at most. Two intervals meet on
the level of the longer one: the shorter one visits there, but only levels on which the other side has intervals. No interval
has more than two copies a level, and visitors of one level never meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the grid: blocks of 1 to 2^LEVELS widths.
LEVELS = 62
#: How two sides meet: both at home, the left at home, the right at home.
HOME, LEFT, RIGHT = 0, 1, 2


def _width(level: Column, base: float) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), level)


def _bit(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def level_of(low: Column, high: Column, base: float) -> Column:
    """The level whose blocks are as wide as an interval, 0 at least."""
    return F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(high - low, F.lit(base)) / base))).cast("int")


def _placed(rows: DataFrame, low: str, high: str, base: float, used: Column, home: tuple[int, int], visit: int) -> DataFrame:
    level = level_of(F.col(low), F.col(high), base)
    rows = rows.filter(F.col(low) <= F.col(high)).withColumns({"_home": level, "_used": used})
    entry = lambda at, kind: F.struct(at.alias("level"), F.lit(kind).alias("kind"))
    above = F.filter(F.sequence(F.col("_home"), F.lit(LEVELS)), lambda at: (at > F.col("_home")) & (F.col("_used").bitwiseAND(_bit(at)) != 0))
    entries = F.concat(F.array(*[entry(F.col("_home"), kind) for kind in home]), F.transform(above, lambda at: entry(at, visit)))
    rows = rows.withColumn("_at", F.explode(entries)).withColumns({"_level": F.col("_at.level"), "_kind": F.col("_at.kind")})
    width = _width(F.col("_level"), base)
    return rows.withColumn("_block", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))).drop("_at", "_home", "_used")


def meeting(left: DataFrame, right: DataFrame, of_left: tuple[str, str], of_right: tuple[str, str], base: float) -> DataFrame:
    """Pairs of rows of one job whose closed intervals (low, high) have a point in common, each once.

    The sides' columns must differ but for ``job_id``. ``base`` is the width of the smallest blocks. Intervals that end before they begin meet none.
    The copies are merged: Spark would judge by the rows they are made of, and send them to all executors.
    """
    used = lambda rows, span: rows.filter(F.col(span[0]) <= F.col(span[1])).agg(F.coalesce(F.bit_or(_bit(level_of(F.col(span[0]), F.col(span[1]), base))), F.lit(0).cast("long")))
    a = _placed(left, *of_left, base, used(right, of_right).scalar(), (HOME, LEFT), RIGHT)
    b = _placed(right, *of_right, base, used(left, of_left).scalar(), (HOME, RIGHT), LEFT)
    both = a.join(b.hint("merge"), ["job_id", "_level", "_kind", "_block"])
    first = F.greatest(of_left[0], of_right[0])
    meet = (first <= F.least(of_left[1], of_right[1])) & (F.floor(first / _width(F.col("_level"), base)) == F.col("_block"))
    return both.filter(meet).drop("_level", "_kind", "_block")
