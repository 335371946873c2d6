"""Interval joins against all pairs, with intervals from a point to a whole long job."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators import onsets
from cuewright.operators.meeting import HOME, LEFT, RIGHT, _placed, meeting

COLUMNS = "job_id string, {0} long, {0}lo double, {0}hi double"


@pytest.mark.parametrize("base", [1.0, 16.0])
def test_meeting_against_all_pairs(spark, base):
    rng = random.Random(int(base))

    def some(n):
        rows = []
        for k in range(n):
            low = rng.choice([rng.uniform(0, 5000), float(rng.randrange(0, 5000))])
            rows.append((rng.choice(["a", "b"]), k, low, low + rng.choice([-1.0, 0.0, 0.0, 1.0, rng.uniform(0, 40), rng.uniform(0, 3000)])))
        return [*rows, ("a", n, 0.0, 5000.0), ("b", n + 1, -70.0, 1e7)]

    left, right = some(150), some(170)
    a, b = spark.createDataFrame(left, COLUMNS.format("l")), spark.createDataFrame(right, COLUMNS.format("r"))
    found = meeting(a, b, ("llo", "lhi"), ("rlo", "rhi"), base)
    got = sorted((r.job_id, r.l, r.r) for r in found.collect())
    want = sorted((x[0], x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and max(x[2], y[2]) <= min(x[3], y[3]))
    assert got == want and len(want) > 1000
    assert meeting(a.limit(0), b, ("llo", "lhi"), ("rlo", "rhi"), base).count() == 0


def test_copies_of_a_long_interval(spark):
    """One interval over a whole job of a million seconds has four copies; a short one two a level that the other side uses."""
    long = spark.createDataFrame([("j", 1, 0.0, 1e6), ("j", 2, 15.9, 16.1)], COLUMNS.format("l"))
    alone = _placed(long, "llo", "lhi", 16.0, F.lit(0).cast("long"), (HOME, LEFT), RIGHT).groupBy("l").count().collect()
    assert {r.l: r["count"] for r in alone} == {1: 2, 2: 4}
    every = _placed(long, "llo", "lhi", 16.0, F.lit((1 << 30) - 1).cast("long"), (HOME, LEFT), RIGHT).groupBy("l").count().collect()
    assert all(r["count"] <= 2 * 31 for r in every)
    points = spark.range(20_000).select(F.lit("j").alias("job_id"), F.col("id").alias("cue_idx"), (F.col("id") * 50.0).alias("at"))
    segs = spark.createDataFrame([("j", 0.0, 1e6)], "job_id string, seg_start double, seg_end double")
    assert onsets.tail_end(points, segs).filter("tail = least(at + 4.0, 1e6)").count() == 20_000
