"""Jobs whose lines and units lie side by side: the same results as by joins, without them."""

import random

import numpy as np
from pyspark.sql import functions as F

from cuewright.operators import evidence, intervals, locate, matching, pathways, timing

LINES, UNITS = "job_id string, cue_idx int, text string", "job_id string, unit_idx long, text string, start double, end double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark, seed):
    """Random jobs with blank and null texts, units that are not in the text, null times, jobs without units and units without a job."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "ab", "bé", "Sun", "ﬁre", "...", "가사", "", "the moon", "ba"])
    lines = [(f"j{k}", i, rng.choice([None, *[" ".join(word() for _ in range(rng.randint(0, 4)))] * 9])) for k in range(30) for i in range(rng.randint(1, 6))]
    units = []
    for k in range(1, 32):
        for i in rng.sample(range(40), rng.choice([0, 3, 25])):
            a = rng.choice([None, *[rng.random() * 9] * 9])
            units.append((f"j{k}", i, rng.choice([word(), word(), None]), a, rng.choice([None, *[(a or 0) + rng.choice([-0.2, 0.0, 0.5])] * 9])))
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(units, UNITS)


def test_searches_against_joins(spark):
    lines, units = tables(spark, 21)
    spans = locate.line_spans(lines)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    by_joins = intervals.overlap_times(spans, locate.unit_spans(spans, units)[0]).drop("key", "lo", "hi")
    assert rows(locate.optional_cues(lines, units)) == rows(by_joins.select("job_id", "cue_idx", "text", "start", "end"))
    by_joins = units.join(intervals.largest_overlap(locate.unit_spans(spans, units, only_forward=True)[0], spans), ["job_id", "unit_idx"])
    found = locate.units_of_lines(lines, units)
    assert found.columns == by_joins.columns and rows(found) == rows(by_joins)
    assert found.count() > 20


def test_no_blocks_of_short_jobs(spark):
    """Each search and match of short jobs made copies of all lines and units by blocks of letters, and joined them."""
    lines, units = tables(spark, 23)
    for found in (locate.optional_cues(lines, units), locate.units_of_lines(lines, units), matching.match_lines(lines, units)):
        assert "_block" not in plan(found) and plan(found).count("Join") == 1


def test_band_holds_the_best_ways():
    """The same partners as from the whole table, from a fifth of it."""
    rng, banded = random.Random(24), 0

    def whole(s, h):
        tile = pathways.Tile(pathways.codes(s), pathways.codes(h), *pathways._edges(len(s), len(h)), moves=True)
        a, b, _, _ = tile.back(len(s), int((tile.bottom + pathways.GAP * np.arange(len(h) + 1)).argmax()))
        return dict(zip(a, b, strict=True))

    for _ in range(800):
        letters, p = rng.choice(["ab", "abcd", "abcdefghijklmnop"]), rng.choice([0.02, 0.1, 0.3])
        s = "".join(rng.choice(letters) for _ in range(rng.randint(1, 120)))
        h = "".join(x for c in s for x in ([] if rng.random() < p else [rng.choice(letters)] if rng.random() < p else [c])) + "".join(rng.choices(letters, k=rng.choice([0, 0, 9])))
        h = rng.choice(["", "", "xyab"]) + h or "z"
        banded += pathways._banded(pathways.codes(s), pathways.codes(h)) is not None
        assert {i: j for i, j in enumerate(pathways.align(s, h).tolist()) if j >= 0} == whole(s, h)
    assert banded > 300
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(1, 9))) for _ in range(500)]
    band = pathways._banded(pathways.codes("".join(words)), pathways.codes("".join("hm" if i % 9 == 8 else w for i, w in enumerate(words))))
    assert band.rows.size < 0.25 * len("".join(words)) ** 2


def test_rules_of_time_share_a_shuffle(spark):
    """Order, overlaps and polish of short jobs were five scans, each with two shuffles and a join."""
    rng = random.Random(25)
    rows = [(f"j{k}", i, i // 2, a, a + rng.random() * 14) for k in range(20) for i in range(rng.randint(1, 30)) for a in [i * 2.0 + rng.choice([0, 0, 0, -7]) + rng.random()]]
    cues = spark.createDataFrame(rows, "job_id string, cue_idx int, source_idx int, start double, end double")
    found = {}
    for short in (False, True):
        ordered = timing.reject_out_of_order(cues, short=short)
        made = timing.polish_singing(timing.bound_overlaps(ordered.filter(~F.col("rejected")), short), short=short)
        found[short] = sorted(map(tuple, made.select("job_id", "cue_idx", "source_idx", "start", "end", "rejected").collect()))
    assert found[True] == found[False] and 0 < len(found[True]) < len(rows)
    assert "Join" not in plan(made) and made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_evidence_joined_once(spark):
    """Times are chosen and moved as rule by rule, with two joins in place of six."""
    rng = random.Random(26)
    key = [(f"j{k}", i) for k in range(40) for i in range(8)]
    time = lambda i: (i * 3.0 + rng.choice([0.0, 0.2, 0.5, 1.0]), i * 3.0 + rng.choice([-0.5, 2.0, 2.5, 3.0]))
    none = (None, None)
    lines = spark.createDataFrame([(*k, f"line {k[1]}", rng.random() < 0.3, rng.random() < 0.2) for k in key], LINES + ", barrier_before boolean, hidden boolean")
    whole = spark.createDataFrame([(*k, *rng.choice([none, *[time(k[1])] * 4])) for k in key], "job_id string, cue_idx int, start double, end double")
    local = spark.createDataFrame([(*k, *rng.choice([none, *[time(k[1])] * 9])) for k in key if rng.random() < 0.6], "job_id string, cue_idx int, start double, end double")
    matches = spark.createDataFrame([(*k, *rng.choice([none, *[time(k[1])] * 9]), rng.choice([0.5, 0.9]), 0.8, rng.choice([1, 9])) for k in key], "job_id string, cue_idx int, start double, end double, similarity double, coverage double, exact_characters int")
    chosen, _ = evidence.choose_cues(lines, local, whole)
    refined = evidence.refine_starts(evidence.with_evidence(chosen.filter("NOT hidden"), matches, local, whole))
    want = refined.select(*chosen.columns).unionByName(chosen.filter("hidden"))
    got = evidence.weighed(lines.join(whole, ["job_id", "cue_idx"]), matches, local)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(got.select(*chosen.columns)) == rows(want) and plan(got).count("Join") == 3
    moves = rows(evidence.adjustments(refined))
    assert rows(evidence.adjustments(got.filter("NOT hidden"))) == moves and len(moves) > 10


def test_edges_beside_tiles_outside_of_the_band():
    """All tiles of a long job were worked out; one beside a tile that is left out goes on from the corner."""
    row = {"source": "abc", "heard": "ab", "ti": 1, "tj": 2, "top": None, "left": [6, 7, 8], "corner": 5}
    _, _, top, left = pathways._sides(row, 3)
    assert top.tolist() == [5, 5, 5] and left.tolist() == [6, 7, 8]
    _, _, top, left = pathways._sides(row | {"top": [4, 5, 9], "left": None}, 3)
    assert top.tolist() == [4, 5, 9] and left.tolist() == [4, 4, 4]
