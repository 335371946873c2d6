"""Joins of character spans: all pairs, few copies, and no rows before an explode taken for those after it."""

import random

from pyspark.sql import functions as F

from cuewright.operators import intervals
from cuewright.operators.meeting import meeting

LINES, UNITS = "job_id string, cue_idx int, lo long, hi long", "job_id string, unit_idx int, ulo long, uhi long"


def test_spans_against_all_pairs(spark):
    rng = random.Random(3)
    some = lambda n: [(rng.choice("ab"), k, low, low + rng.choice([0, 1, 5, 300, 4000])) for k in range(n) for low in [rng.randrange(5000)]]
    left, right = some(120), some(150)
    for size in (1, 256):
        got = sorted((r.job_id, r.cue_idx, r.unit_idx) for r in intervals.met(spark.createDataFrame(left, LINES), spark.createDataFrame(right, UNITS), size).collect())
        want = sorted((a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and max(a[2], b[2]) < min(a[3], b[3]))
        assert got == want and len(want) > 1000


def test_copies_of_units_beside_long_lines(spark):
    """Units of 40 letters have 1.2 copies each, whatever lengths the lines have."""
    units = spark.range(20_000).select(F.lit("j").alias("job_id"), (F.col("id") * 40).alias("ulo"), (F.col("id") * 40 + 40).alias("uhi"))
    assert intervals.blocks(units, "ulo", "uhi").count() <= 24_000


def test_rows_before_an_explode_are_not_broadcast(spark):
    """A few rows that become many are merged, not sent to all executors as the few."""
    few = spark.range(100).select(F.col("id").alias("job_id"))
    units = few.select("job_id", F.explode(F.sequence(F.lit(0), F.lit(9999))).alias("unit_idx")).withColumns({"ulo": F.col("unit_idx") * 40, "uhi": F.col("unit_idx") * 40 + 40})
    lines = few.select("job_id", F.lit(0).alias("cue_idx"), F.lit(0).alias("lo"), F.lit(400_000).alias("hi"))
    for found in (intervals.met(lines, units), meeting(lines, units, ("lo", "hi"), ("ulo", "uhi"), 256)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_keys_of_lines_are_made_once(spark):
    """A running sum reads its rows twice; the keys, from Python, were made twice with all that led to them."""
    from cuewright.operators import locate

    lines = spark.createDataFrame([("j", 0, "Ａ b"), ("j", 1, "Straße")], "job_id string, cue_idx int, text string")
    spans = locate.line_spans(lines)
    assert "ArrowEvalPython" not in spans._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.cue_idx, r.key, r.lo, r.hi) for r in spans.collect()) == [(0, "ab", 0, 2), (1, "strasse", 2, 9)]


def test_frames_of_onsets_are_numbered_once(spark):
    """Events were read and numbered anew for each of the points and segments of three joins."""
    from cuewright import queries

    assert not any("events" in f for f in queries.onset_times(spark, "/root/testdata/sf0.001").inputFiles())
