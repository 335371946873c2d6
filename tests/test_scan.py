"""Running values, runs and percentiles over ranges against whole windows, plain loops and Spark's own percentile."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewright.operators import activity
from cuewright.operators.quantiles import quantiles
from cuewright.operators.scan import scan


@pytest.mark.parametrize("size", [1, 3, 64, 1 << 16])
def test_scan(spark, size):
    rng = random.Random(size)
    rows = []
    for job in range(12):
        at = 0
        for _ in range(rng.choice([1, 2, 30, 200])):
            at += rng.choice([1, 1, 1, 2, 9])
            rows.append((job, at, rng.choice([None, *range(-4, 9)])))
    df = spark.createDataFrame(rows, "job_id int, at int, v int")
    v = F.col("v")
    kinds = {"sum": "a", "total": "b", "max_before": "c", "last": "d", "lag": "e", "lead": "f"}
    got = scan(df, "at", size, **{name: (kind, v) for kind, name in kinds.items()})
    w = Window.partitionBy("job_id").orderBy("at")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"a": F.sum(v).over(upto), "b": F.sum(v).over(Window.partitionBy("job_id")), "c": F.max(v).over(before), "d": F.last(v, True).over(upto), "e": F.lag(v).over(w), "f": F.lead(v).over(w)})
    cols = ["job_id", "at", "v", *"abcdef"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert scan(df.limit(0), "at", size, a=("sum", v)).count() == 0
    with pytest.raises(ValueError, match="kind"):
        scan(df, "at", a=("median", v))


def loop_runs(mask):
    out = []
    for i, x in enumerate(mask):
        if out and out[-1][0] == x:
            out[-1][2], out[-1][3] = i, out[-1][3] + 1
        else:
            out.append([x, i, i, 1])
    return out


@pytest.mark.parametrize("size", [1, 2, 5, 40, 1 << 16])
def test_runs_over_ranges(spark, size):
    rng = random.Random(size)
    jobs = {j: [rng.random() < p for _ in range(rng.choice([1, 7, 90]))] for j, p in enumerate([0, 0.1, 0.5, 0.5, 0.9, 0.95, 1])}
    mask = spark.createDataFrame([(j, i, x) for j, m in jobs.items() for i, x in enumerate(m)], "job_id int, frame int, active boolean").repartition(5)
    found = activity.runs(mask, size)
    filled = activity.fill_gaps(found, 2, size)
    kept = activity.drop_short(filled, 3, size)
    got = [{}, {}, {}]
    for df, by in zip((found, filled, kept), got, strict=True):
        for r in df.orderBy("job_id", "first").collect():
            by.setdefault(r.job_id, []).append([r.active, r["first"], r["last"], r.n])
    for j, m in jobs.items():
        assert got[0][j] == loop_runs(m)
        for x, a, b, n in loop_runs(m):
            if not x and n <= 2 and a > 0 and b < len(m) - 1:
                m = [*m[:a], *[True] * n, *m[b + 1 :]]
        assert got[1][j] == loop_runs(m)
        for x, a, b, n in loop_runs(m):
            if x and n < 3:
                m = [*m[:a], *[False] * n, *m[b + 1 :]]
        assert got[2][j] == loop_runs(m)
        assert [r.active for r in activity.frames(kept.filter(F.col("job_id") == j)).orderBy("frame").collect()] == m


def test_one_long_job_is_dealt_over_tasks(spark):
    """Ten million frames of one job: no task of the shuffle holds more than a few ranges."""
    mask = spark.range(0, 10_000_000, 1, 8).select(F.lit(1).alias("job_id"), F.col("id").alias("frame"), (F.col("id") % 1000 < 900).alias("active"))
    found = activity.fill_gaps(activity.runs(mask), 50)
    assert found.count() == 20_000
    ranges = mask.select(F.hash("job_id", F.floor(F.col("frame") / activity.RANGE)).alias("h")).groupBy(F.pmod("h", F.lit(32))).count()
    assert ranges.count() > 24 and ranges.agg(F.max("count")).first()[0] < 2_000_000
    assert activity.numbers(spark.createDataFrame([(1, 0, 3_000_000)], "job_id int, a long, b long"), "a", "b", "k").count() == 3_000_001


@pytest.mark.parametrize(("few", "bins"), [(1, 2), (3, 7), (100_000, 4096)])
def test_quantiles(spark, few, bins):
    rng = random.Random(bins)
    pick = [lambda: rng.random(), lambda: rng.choice([1.5, 2.5]), lambda: 10.0 ** rng.randint(-9, 9), lambda: -0.1, lambda: rng.gauss(0, 1e-3), lambda: rng.choice([1.7e308, -1.7e308, 0.3])]
    rows = [(j, rng.choice([None, f(), f(), f()])) for j, f in enumerate(pick) for _ in range(rng.choice([1, 2, 50, 300]))] + [(99, None), (98, float("nan")), (98, 4.0)]
    df = spark.createDataFrame(rows, "job_id int, v double")
    shares = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.9, "e": 0.98, "f": 1.0}
    got = quantiles(df, "v", few=few, bins=bins, **shares)
    known = F.when(~F.isnan("v"), F.col("v"))
    want = df.groupBy("job_id").agg(*[F.percentile(known, F.lit(s)).alias(n) for n, s in shares.items()])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert quantiles(df.limit(0), "v", a=0.5).count() == 0
