import pytest
from pyspark.sql import functions as F

from cuewright.functions.text import match_key, normalize_line
from cuewright.functions.timecode import srt_time
from cuewright.operators import activity, intervals, timing
from cuewright.plans.demo import render_srt
from cuewright.sources.lines import split_cues


def cues(spark, *times, **extra):
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(times)]
    return spark.createDataFrame(rows, "job_id long, cue_idx int, start double, end double")


def times(df):
    return [(round(r.start, 6), round(r.end, 6)) for r in df.orderBy("cue_idx").collect()]


def test_split_and_barriers(spark):
    df = spark.createDataFrame([(1, "짧아\n\n한 단어\n"), (2, "첫 줄\n둘째 줄\n\n새 절\n마지막 줄"), (3, "보이는 가사\n(흐음)\n다음 가사"), (4, "()\n다음"), (5, ""), (6, None)], "job_id long, text string")
    rows = split_cues(df, 30, hidden_marks=True).orderBy("job_id", "cue_idx").collect()
    of = lambda j: [r for r in rows if r.job_id == j]
    assert [r.text for r in of(1)] == ["짧아", "한 단어"]
    assert [r.cue_idx for r in of(2) if r.barrier_before] == [2]
    assert [(r.text, r.hidden) for r in of(3)] == [("보이는 가사", False), ("흐음", True), ("다음 가사", False)]
    assert not any(r.hidden for r in of(4)) and not of(5) and not of(6)


def test_keys_and_time_codes(spark):
    row = spark.createDataFrame([("  Ａ　b\tStraße! ", 3661.2346)], "t string, s double").select(normalize_line(F.col("t")).alias("n"), match_key(F.col("t")).alias("k"), srt_time(F.col("s")).alias("c")).first()
    assert (row.n, row.k, row.c) == ("A b Straße!", "abstrasse", "01:01:01,235")


def test_polish(spark):
    assert times(timing.polish(cues(spark, (1.0, 1.8), (2.0, 2.4)), 0.1, 0.5, 0.5, 0.02)) == [(0.9, 1.88), (1.9, 2.9)]
    assert times(timing.polish_singing(timing.bound_overlaps(cues(spark, (1, 8), (5, 7)))))[0] == (1.0, 5.0)
    assert times(timing.polish_singing(cues(spark, (1, 2), (2.5, 3)), hold=1.2))[0] == (1.0, 2.42)
    assert times(timing.polish_singing(cues(spark, (1, 2), (2.02, 3)), lead=0.1, hold=1.2)) == [(0.9, 2.0), (2.0, 4.2)]


def test_order(spark):
    rows = [(1, 0, 27, 237.5), (1, 1, 27, 244.3), (1, 2, 28, 247.3), (1, 3, 29, 241.2), (2, 0, 1, 10.0), (2, 1, 2, 9.85)]
    df = timing.reject_out_of_order(spark.createDataFrame(rows, "job_id long, cue_idx int, source_idx int, start double"))
    assert [(r.job_id, r.source_idx) for r in df.filter("rejected").collect()] == [(1, 29)]


@pytest.mark.parametrize(("barrier", "n"), [(False, 1), (True, 2)])
def test_merge(spark, barrier, n):
    rows = [(1, 0, "가" * 20, 1.0, 3.0, False), (1, 1, "나" * 8, 3.08, 4.2, barrier)]
    df = timing.merge_wrapped(spark.createDataFrame(rows, "job_id long, cue_idx int, text string, start double, end double, barrier_before boolean"))
    assert df.count() == n


def test_masks(spark):
    mask = spark.createDataFrame([(1, i, c == "1") for i, c in enumerate("0110111001")], "job_id long, frame int, active boolean")
    text = lambda df: "".join("1" if r.active else "0" for r in df.orderBy("frame").collect())
    assert text(activity.fill_short_gaps(mask, 1)) == "0111111001"
    assert text(activity.remove_short_runs(mask, 3)) == "0000111000"
    assert [(r.seg_start, r.seg_end) for r in activity.segments(mask, 0.5).orderBy("seg_start").collect()] == [(0.5, 1.5), (2.0, 3.5), (4.5, 5.0)]


def test_overlap_join(spark):
    c = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 6), (1, 2, 6, 6)], "job_id long, cue_idx int, lo int, hi int")
    u = spark.createDataFrame([(1, 0, 0, 2, 0.0, 1.0), (1, 1, 2, 6, 1.0, 3.0)], "job_id long, unit_idx int, lo int, hi int, start double, end double")
    rows = intervals.overlap_times(c, u).orderBy("cue_idx").collect()
    assert [(r.start, r.end) for r in rows] == [(0.0, 2.0), (2.0, 3.0), (None, None)]


def test_srt(spark):
    df = cues(spark, (12.0, 13.0)).withColumn("text", F.lit("x"))
    assert render_srt(df).first().srt == "1\n00:00:12,000 --> 00:00:13,000\nx\n"
    assert render_srt(df, anchor=True).first().srt.startswith("1\n00:00:00,000 --> 00:00:00,500\n⠀\n\n2\n")
