"""Timing, evidence, location and segmentation against plain loops over the rules as they are stated, and literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuewright.functions.text import CUT_AFTER, SENTENCE_END, cut_lines
from cuewright.operators import activity, evidence, locate, matching, onsets, pathways, segments, timing
from cuewright.plans import diagnostics
from cuewright.plans.align import Policy, align, with_activity
from cuewright.plans.demo import render_srt
from cuewright.sources.languages import language_code, languages
from cuewright.sources.media import flatten_segments, sample_range, wave_seconds

CUE = "job_id long, cue_idx int, start double, end double"
UNIT = "job_id long, unit_idx int, text string, start double, end double"


def near(found, wanted):
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_cut_lines(spark):
    rng = random.Random(1)

    def slow(line, most):
        out = []
        while len(line) > most:
            window = range(max(1, int(0.55 * most)), most + 1)
            kinds = ([k for k in window if line[k - 1] in CUT_AFTER], [k for k in window if line[k - 1] == " "], [k for k in window if line[k] == " "], [most])
            k = next(max(found) for found in kinds if found)
            out.append(line[:k].strip())
            line = line[k:].strip()
        return [part for part in (*out, line) if part]

    lines = ["가" * 31, "this is a moderately long English lyric line", "", None, "\U0001d7d8" * 9]
    lines += [" ".join("".join(rng.choice("ab가,.)~」") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for most in (1, 2, 7, 20, 30):
        df = spark.createDataFrame([(x,) for x in lines], "t string").select("t", cut_lines(F.col("t"), most).alias("parts"))
        for r in df.collect():
            assert r.parts == ([] if r.t is None else slow(r.t, most)), (most, r.t)
    with pytest.raises(ValueError, match="at least 1"):
        cut_lines(F.col("t"), 0)


@pytest.mark.parametrize("longest", [10.0, 0.0])
def test_polish_singing(spark, longest):
    rng = random.Random(2)
    jobs = {}
    for job in range(60):
        at, cues = 0.0, []
        for _ in range(rng.randint(1, 8)):
            at += rng.choice([0.0, 0.02, 0.3, 1.0, 5.0])
            end = at + rng.choice([0.1, 0.6, 3.0, 12.0, 31.0])
            cues.append((at, end, rng.choice([None, at - 0.1, at + 0.2]), rng.choice([None, end + 0.4, end + 3.0])))
            at = rng.choice([at, end])
        jobs[job] = cues
    jobs[99] = [(1.0, 31.0, None, None)]
    rows = [(j, i, *c) for j, cues in jobs.items() for i, c in enumerate(cues)]
    df = spark.createDataFrame(rows, CUE + ", acoustic_start double, vocal_end double")
    lead, hold, shortest, gap = 0.1, 0.5, 0.5, 0.08
    got = {(r.job_id, r.cue_idx): (r.start, r.end) for r in timing.polish_singing(df, lead, hold, shortest, longest, gap).collect()}
    for job, cues in jobs.items():
        shown = []
        for i, (a, _, heard, _) in enumerate(cues):
            s = max(0.0, max(0.0, a, a if heard is None else heard) - lead)
            if i and (not longest or cues[i - 1][1] - cues[i - 1][0] <= longest):
                s = max(s, cues[i - 1][1])
            shown.append(s)
        for i, (a, b, _, voice) in enumerate(cues):
            s, over = shown[i], bool(longest) and b - a > longest
            voice, trusted = b if voice is None else voice, s if over else b
            want = max(trusted, voice) + hold
            want = max(voice, min(want, s + longest)) if longest else want
            want = max(want, s + shortest)
            if i + 1 < len(cues):
                nxt = shown[i + 1]
                want = min(want, max(s, nxt - (gap if nxt - trusted >= gap else 0.0)))
            near(got[job, i], (s, max(s, want)))
    if longest:
        assert got[99, 0] == (0.9, 31.0)


def test_activity_moves_times(spark):
    cue = lambda *times: spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(times)], CUE)
    seg = lambda *times: spark.createDataFrame([(1, float(a), float(b)) for a, b in times], "job_id long, seg_start double, seg_end double")
    times = lambda cues, segs, **how: [(r.start, r.end) for r in timing.polish_singing(with_activity(cues, segs, 10.0), **how).orderBy("cue_idx").collect()]
    near(times(cue((1.1, 3.0), (5.1, 5.8)), seg((0.95, 3.4), (5, 6)))[0], (1.1, 3.9))
    assert times(cue((1.1, 2.5)), seg((0.8, 1.0), (1.2, 3.0)))[0][0] >= 1.1
    first = times(cue((1, 30), (30, 34)), seg((1, 8), (30, 34)))[0]
    assert first[1] == pytest.approx(8.5)
    assert times(cue((1, 13)), seg((1, 13)))[0][1] >= 13
    a, b = times(cue((1, 3), (3.02, 5)), seg((1, 3), (2.9, 5)))
    assert a[1] >= 3.0 and a[1] <= b[0] <= 3.02
    near([onsets.snap_start(cue((3.0, 4.0)).withColumnRenamed("start", "at"), seg((1, 5))).first().snapped], [3.0])


def test_order_goes_by_first_cue(spark):
    rows = [(1, 0, 0, 10.0), (1, 1, 1, 20.0), (1, 2, 1, 5.0), (1, 3, 2, 9.0), (1, 4, None, 30.0), (1, 5, None, 1.0)]
    found = timing.reject_out_of_order(spark.createDataFrame(rows, "job_id long, cue_idx int, source_idx int, start double"))
    assert [r.rejected for r in found.orderBy("cue_idx").collect()] == [False, False, False, True, False, False]


def test_anchor_counts_the_offset(spark):
    cue = lambda start: spark.createDataFrame([(1, 0, start, start + 1, "x")], CUE + ", text string")
    head = lambda start, offset: render_srt(cue(start), offset, anchor=True).first().srt.split("\n")[1]
    assert head(0.7, -0.5).startswith("00:00:00,200") and head(0.0, 80.5).endswith("00:00:00,500") and head(12.0, 0.0).startswith("00:00:00,000")
    assert "00:01:21,000 --> 00:01:22,000" in render_srt(cue(0.5), 80.5).first().srt


def test_merge_wrapped(spark):
    schema = CUE + ", text string, barrier_before boolean"
    merged = lambda *rows, **how: [(r.text, r.end) for r in timing.merge_wrapped(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], schema), **how).orderBy("cue_idx").collect()]
    assert merged((1.0, 3.0, "가" * 20, False), (3.08, 4.2, "나" * 8, False)) == [("가" * 20 + " " + "나" * 8, 4.2)]
    assert len(merged((1.0, 3.0, "가" * 20, False), (3.08, 4.2, "나" * 8, True))) == 2
    assert len(merged((1.0, 3.0, "내 곁에", False), (3.05, 4.2, "있어주세요", False))) == 2
    assert all(len(merged((1.0, 3.0, "가" * 19 + mark, False), (3.08, 4.2, "나" * 8, False))) == 2 for mark in SENTENCE_END)
    assert merged((1.0, 3.0, "가" * 20, False), (2.97, 2.98, "나" * 8, False))[0][1] == 3.0
    assert len(merged(*[(float(i), i + 1.0, "가" * (8 if i % 2 else 20), False) for i in range(5)])) == 3


def fold(units, target, back, ahead, forward, strict):
    cursor, out = 0, []
    for k, key in enumerate(units):
        if not key:
            continue
        at = target.find(key, cursor)
        if at < 0:
            at = target.find(key, max(0, cursor - back), min(len(target), cursor + max(64, 4 * len(key))) if ahead else len(target))
        if at < 0:
            if strict:
                return k, out
            continue
        out.append((k, at, at + len(key)))
        cursor = max(cursor, at + len(key)) if forward else at + len(key)
    return None, out


@pytest.mark.parametrize(("back", "ahead", "forward", "strict"), [(4, True, False, True), (4, True, False, False), (4, True, True, False), (3, False, True, False)])
def test_locate(spark, back, ahead, forward, strict):
    rng = random.Random(4)
    rows = [("", []), ("abc", ["abc", "abc", ""])]
    for _ in range(200):
        target = "".join(rng.choice("ab") for _ in range(rng.randint(1, 120)))
        units = []
        for _ in range(rng.randint(0, 12)):
            a = rng.randrange(len(target))
            units.append(rng.choice([target[a : a + rng.randint(1, 9)], "", "abba", "zz" if rng.random() < 0.3 else "a"]))
        rows.append((target, units))
    df = spark.createDataFrame(rows, "target string, units array<string>")
    found = df.select("target", "units", locate.locate(F.col("units"), F.col("target"), back, ahead, forward, strict).alias("f")).collect()
    for r in found:
        want = fold(r.units, r.target, back, ahead, forward, strict)
        assert (r.f.failed, [(s["at"], s.lo, s.hi) for s in r.f.spans]) == want
        places, failed = locate.find_all(r.target, r.units, back, ahead, forward, strict)
        assert (failed, [(at, lo, lo + len(r.units[at])) for at, lo in enumerate(places) if lo is not None]) == want


@pytest.mark.parametrize("long", [0, 20_000])
def test_places_of_long_keys(monkeypatch, long):
    monkeypatch.setattr(locate.Places, "LONG", long)
    rng = random.Random(8)
    text = "".join(rng.choice("ab") for _ in range(3000)) + "é𝟘" * 40
    index = locate.Places(text)
    for _ in range(500):
        at = rng.randrange(len(text))
        key = text[at : at + rng.randint(1, 40)] + rng.choice(["", "", "b", "zz"])
        want = [m.start() for m in re.finditer(f"(?={re.escape(key)})", text)]
        assert index.of(key) == want
        low, high = rng.randrange(len(text)), rng.choice([None, rng.randrange(len(text))])
        assert (index.next(key, low, high) if index.next(key, low, high) is not None else -1) == text.find(key, low, len(text) if high is None else high)


def test_units_of_one_long_job(spark):
    """A job of 100,000 units, a fifth of them misheard: seconds, as no search runs to the end of the text."""
    import time

    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    words = [rng.choice(names) for _ in range(100_000)]
    heard = [w + "zz" if rng.random() < 0.2 else w for w in words]
    began = time.time()
    places, _ = locate.find_all("".join(words), heard)
    assert time.time() - began < 20 and sum(p is not None for p in places) > 20_000
    lines = spark.createDataFrame([("one", i, " ".join(words[i : i + 10])) for i in range(0, 5000, 10)], "job_id string, cue_idx int, text string")
    units = spark.createDataFrame([("one", i, w, i * 1.0, i + 0.5) for i, w in enumerate(words[:5000])], "job_id string, unit_idx int, text string, start double, end double")
    rows = locate.strict_cues(lines, units, native=True).orderBy("cue_idx").collect()
    assert [(r.start, r.end, r.status) for r in rows] == [(float(i), i + 9.5, "ok") for i in range(0, 5000, 10)]


def test_cues_from_units(spark):
    lines = spark.createDataFrame([(1, 0, "안녕 hello"), (1, 1, "다시 만나"), (2, 0, "정답 가사"), (3, 0, "first line"), (3, 1, "missing tail")], "job_id long, cue_idx int, text string")
    at = lambda job, *words: [(job, i, w, 0.1 + 0.3 * i, 0.4 + 0.3 * i) for i, w in enumerate(words)]
    units = spark.createDataFrame(at(1, "안", "녕", " hello", "다", "시", "만", "나") + at(2, "완전다름") + at(3, "first line"), UNIT)
    strict = {(r.job_id, r.cue_idx): r for r in locate.strict_cues(lines, units).collect()}
    near((strict[1, 0].start, strict[1, 0].end, strict[1, 1].start, strict[1, 1].end), (0.1, 1.0, 1.0, 2.2))
    assert strict[2, 0].status == "performed lyrics may differ" and strict[2, 0].start is None and strict[3, 0].status == "line without times"
    loose = {(r.job_id, r.cue_idx): (r.start, r.end) for r in locate.optional_cues(lines, units).collect()}
    assert loose[3, 0] == (0.1, 0.4) and loose[3, 1] == (None, None) and loose[2, 0] == (None, None)
    assert {r.unit_idx: r.cue_idx for r in locate.units_of_lines(lines, units).filter("job_id = 1").collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1}


WITH_UNITS = "job_id long, cue_idx int, text string, start double, end double, units array<struct<unit_idx:long,text:string,start:double,end:double>>"


def parts_of(spark, rows, **how):
    df = spark.createDataFrame([(1, i, text, a, b, [(k, *u) for k, u in enumerate(units)]) for i, (text, a, b, units) in enumerate(rows)], WITH_UNITS)
    out = {}
    for r in segments.split_lines(df, **how).orderBy("cue_idx", "part_idx").collect():
        out.setdefault(r.cue_idx, []).append((r.text, r.start, r.end))
    return out


def test_split_lines(spark):
    rap, slow = "하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉 열".split(), "천천히 길게 부르는 노래 한 줄이 여기에 있어요 그래요".split()
    rows = [
        (" ".join(rap), 0.0, 4.45, [(w, 0.45 * i, 0.45 * i + 0.4) for i, w in enumerate(rap)]),
        ("의리라도 괜찮은데", 1.0, 7.0, [("의리라도", 1.0, 2.4), ("괜찮은데", 5.4, 7.0)]),
        ("안되나요. 어렵나요.", 0.0, 4.0, [("안되나요.", 0.0, 1.0), ("어렵나요.", 2.3, 4.0)]),
        ("안되나요. 어렵나요.", 0.0, 4.0, [("안되나요.", 0.0, 1.0), ("어렵나요.", 3.0, 4.0)]),
        ("우리 함께", 0.0, 3.3, [("우리", 0.0, 1.0), ("함께", 2.3, 3.3)]),
        (" ".join(slow), 0.0, 7.05, [(w, 0.8 * i, 0.8 * i + 0.65) for i, w in enumerate(slow)]),
        ("no units here", 0.0, 1.0, []),
        ("half a match", 0.0, 2.0, [("half", 0.0, 1.0)]),
    ]
    found = parts_of(spark, rows)
    assert found[1] == [("의리라도", 1.0, 2.4), ("괜찮은데", 5.4, 7.0)]
    assert [len(found[k]) for k in (0, 2, 3, 4, 6, 7)] == [1, 2, 2, 1, 1, 1] and found[6] == [("no units here", 0.0, 1.0)]
    assert len(found[5]) > 1 and " ".join(p[0] for p in found[5]) == " ".join(slow)


def test_cuts_against_recursion(spark):
    rng, key = random.Random(6), lambda t: "".join(c for c in t.lower() if c.isalnum())

    def cut(words, long_gap):
        text, size = " ".join(w[0] for w in words), len(words)
        letters, seconds = len(key(text)), max(0.01, words[-1][2] - words[0][1]) if words else 1.0
        pace = letters / seconds
        limit = 30 if pace <= 4 else 50 if pace >= 7 else round(30 + 20 * (pace - 4) / 3)
        if size < 2 or (len(text) <= limit and not (seconds > 5.8 and letters >= 18 and pace < 6.5)):
            return [text]
        best = None
        for k in range(1, size):
            left, right = " ".join(w[0] for w in words[:k]), " ".join(w[0] for w in words[k:])
            score = 0.65 * abs(len(left) / len(text) - 0.5) + 0.35 * abs((words[k][1] - words[0][1]) / seconds - 0.5) + (0.5 if min(len(left), len(right)) < 3 else 0)
            score -= (0.18 if left[-1] in segments.CUT_MARKS else 0) + min(0.35, max(0.0, words[k][1] - words[k - 1][2]) / long_gap * 0.35)
            if best is None or score < best[0] - 1e-12:
                best = (score, k)
        return cut(words[: best[1]], long_gap) + cut(words[best[1] :], long_gap)

    rows, wanted = [], []
    for _ in range(60):
        at, words = 0.0, []
        for _ in range(rng.randint(2, 25)):
            word = "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) + rng.choice(["", "", "", ",", "."])
            at += rng.choice([0.0, 0.01, 0.3, 0.5, 1.3, 2.5])
            words.append((word, at, at + 0.3))
            at += 0.3
        gaps = [max(0.0, b[1] - a[2]) for a, b in zip(words, words[1:], strict=False)]
        wide = sorted(g for g in gaps if g > 0.02)
        typical = (wide[(len(wide) - 1) // 2] + wide[len(wide) // 2]) / 2 if len(wide) >= 3 else 0.0
        long_gap = max(1.7, min(2.2, 4 * typical))
        ranges, run = [], [words[0]]
        for gap, before, word in zip(gaps, words, words[1:], strict=False):
            if gap >= long_gap or (gap >= min(long_gap, 1.2) and before[0][-1] in SENTENCE_END):
                ranges.append(run)
                run = []
            run.append(word)
        wanted.append([text for r in [*ranges, run] for text in cut(r, long_gap)])
        rows.append((" ".join(w[0] for w in words), words[0][1], words[-1][2], words))
    found = parts_of(spark, rows)
    assert [[p[0] for p in found[i]] for i in range(len(rows))] == wanted


def test_segments_take_the_pause_of_the_whole_text(spark):
    words = "가나 다라 마바 사아".split()
    lines = spark.createDataFrame([(1, 0, " ".join(words))], "job_id long, cue_idx int, text string")
    cues = lines.select("job_id", "cue_idx", "text", F.lit(234.12).alias("start"), F.lit(239.44).alias("end"), F.lit(True).alias("weak"))
    whole = spark.createDataFrame([(1, 0, words[0], 237.54, 237.7), (1, 1, words[1], 237.7, 237.92), (1, 2, words[2], 244.30, 245.0), (1, 3, words[3], 245.0, 246.0)], UNIT)
    local = spark.createDataFrame([(1, i, w, 234.12 + 1.33 * i, 235.45 + 1.33 * i) for i, w in enumerate(words)], UNIT).withColumn("cue_idx", F.lit(0))
    run = lambda weak: [round(r.start, 2) for r in segments.auto_segment(lines, cues.withColumn("weak", F.lit(weak)), whole, local).orderBy("part_idx").collect()]
    assert run(True) == [237.54, 244.30] and run(False) == [234.12]


def test_start_rules(spark):
    columns = CUE + ", match_start double, match_end double, exact int, similarity double, coverage double"
    base = {"prev": (0, 1.0, 3.0, 1.0, 3.0, 8, 0.9, 0.9), "cur": (1, 3.0, 6.0, 3.05, 6.05, 8, 0.9, 0.9), "local": (3.05, 6.05), "whole": (4.0, 6.10)}

    def run(**change):
        case = base | change
        rows = spark.createDataFrame([(1, *case["prev"]), (1, *case["cur"])], columns)
        matches = rows.select("job_id", "cue_idx", F.col("match_start").alias("start"), F.col("match_end").alias("end"), F.col("exact").alias("exact_characters"), "similarity", "coverage")
        times = lambda t: spark.createDataFrame([(1, 1, *t)], CUE)
        refined = evidence.refine_starts(evidence.with_evidence(rows.select("job_id", "cue_idx", "start", "end"), matches, times(case["local"]), times(case["whole"])))
        cue = refined.filter("cue_idx = 1").first()
        kinds = {r.kind for r in evidence.adjustments(refined).filter("cue_idx = 1").collect()}
        return round(cue.start, 6), cue.end, kinds

    assert run() == (4.0, 6.0, {"sustained_boundary_consensus"})
    assert run(whole=(4.0, 7.5))[0] == 3.0 and run(whole=(3.2, 6.1))[0] == 3.0
    assert run(prev=(0, 1.0, 3.0, 1.0, 2.0, 8, 0.9, 0.9))[0] == 3.0 and run(cur=(1, 3.0, 6.0, 3.05, 6.05, 8, 0.5, 0.9))[0] == 3.0
    assert run(cur=(1, 10.0, 14.0, 12.0, 14.0, 4, 0.8, 0.8)) == (11.95, 14.0, {"lexical_floor"})


def test_windows(spark):
    rng = random.Random(9)
    rows, jobs = [], []
    for job in range(40):
        at = 0.0
        for i in range(rng.randint(0, 9)):
            at += rng.choice([-1.0, 0.1, 0.5, 3.0])
            some = max(0.0, at), max(0.0, at) + rng.choice([0.2, 1.0, 4.0])
            rows.append((job, i, f"l{i}", *(some if rng.random() > 0.15 else (None, None)), rng.choice([0.55, 0.62, 0.9]), rng.choice([0.4, 0.45, 0.9]), rng.choice([1, 2, 9])))
        jobs.append((job, 14.0))
    matches = spark.createDataFrame(rows, "job_id long, cue_idx int, source_text string, start double, end double, similarity double, coverage double, exact_characters int")
    for least, covers in ((0.62, 0.45), (0.5, 0.4)):
        windows = evidence.align_windows(matches, spark.createDataFrame(jobs, "job_id long, duration double"), least, covers)
        got = {(r.job_id, r.cue_idx): (r.lower, r.upper) for r in evidence.separate_windows(windows).collect()}
        wanted = {}
        for job, duration in jobs:
            chosen, latest = [], -1.0
            for r in rows:
                if r[0] == job and r[3] is not None and r[5] >= least and r[6] >= covers and r[7] >= 2 and r[3] >= latest:
                    chosen.append(r)
                    latest = r[3]
            made = []
            for k, r in enumerate(chosen):
                weak = r[5] < 0.62 or r[6] < 0.45
                lo, hi = max(0.0, r[3] - (1.2 if weak else 0.8)), min(duration, r[4] + (5.0 if weak else 1.2))
                lo = max(lo, chosen[k - 1][4] + 0.05) if k else lo
                hi = min(hi, chosen[k + 1][3] - 0.10) if k + 1 < len(chosen) else hi
                if hi > lo:
                    made.append([r, lo, hi])
            for a, b in zip(made, made[1:], strict=False):
                if a[2] > b[1]:
                    middle = min(max(a[1] + 0.025, (a[0][4] + b[0][3]) / 2), b[2] - 0.025)
                    a[2], b[1] = middle - 0.025, middle + 0.025
            wanted |= {(job, r[1]): (lo, hi) for r, lo, hi in made if hi > lo}
        assert got.keys() == wanted.keys()
        for k, v in wanted.items():
            near(got[k], v)


def test_windows_to_cues(spark):
    windows = spark.createDataFrame([(1, 3, "ab cd"), (1, 5, "ef"), (2, 0, "ab cd"), (2, 1, "ef"), (3, 0, "zz")], "job_id long, cue_idx int, source_text string")
    unit = "array<struct<text:string,start:double,end:double>>"
    given = [(1, 0, [("ab", 1.0, 2.0), ("cd", 2.0, 3.0)]), (1, 1, []), (2, 0, [("ab", 1.0, 2.0), ("cd", 2.0, 3.0), ("ef", 4.0, 5.0)]), (3, 0, [("q", 1.0, 2.0)]), (3, 1, [("r", 2.0, 3.0)])]
    cues, units = evidence.windows_to_cues(windows, spark.createDataFrame(given, f"job_id long, seg_idx int, units {unit}"))
    assert sorted((r.job_id, r.cue_idx, r.start, r.end) for r in cues.collect()) == [(1, 3, 1.0, 3.0), (2, 0, 1.0, 3.0), (2, 1, 4.0, 5.0)]
    assert sorted((r.job_id, r.cue_idx, r.text) for r in units.collect()) == [(1, 3, "ab"), (1, 3, "cd"), (2, 0, "ab"), (2, 0, "cd"), (2, 1, "ef")]


def test_tail_span_and_status(spark):
    units = spark.createDataFrame([(1, 0, "a", 9.8, 9.82, 10.0), (1, 1, "b", 9.7, 9.72, 10.0), (1, 2, "c", 9.9, 10.0, 10.0)], UNIT + ", duration double")
    assert [r.unit_idx for r in evidence.drop_failed_tail(units).orderBy("unit_idx").collect()] == [1, 2]
    lines = spark.createDataFrame([(1, i, i in (4, 6)) for i in range(12)], "job_id long, cue_idx int, barrier_before boolean")
    span = spark.createDataFrame([(1, 4, 6)], "job_id long, first int, last int")
    assert [(r.cue_idx, r.barrier_before) for r in evidence.apply_span(lines, span).orderBy("cue_idx").collect()] == [(0, True), (1, False), (2, False)]
    whole = evidence.apply_span(lines, span.withColumns({"first": F.lit(0), "last": F.lit(11)}))
    assert {r.cue_idx for r in whole.filter("barrier_before").collect()} == {4, 6}


def test_align(spark):
    at = lambda job, *words: [(job, i, w, 0.1 + 0.3 * i, 0.4 + 0.3 * i) for i, w in enumerate(words)]
    texts = spark.createDataFrame([(1, "안녕 hello\n다시 만나", 10.0), (2, "", 5.0), (3, "(흐음)", 3.0), (4, "보여\n(흐음)\n다시", 9.0), (5, "absent", 4.0), (6, None, 1.0)], "job_id long, text string, duration double")
    units = spark.createDataFrame(at(1, "안", "녕", " hello", "다", "시", "만", "나") + [(4, 0, "보여", 0.0, 2.0), (4, 1, "흐음", 2.4, 3.2), (4, 2, "다시", 4.0, 5.0)] + at(5, "zzz"), UNIT)
    local = units.withColumn("cue_idx", F.lit(0)).limit(0)
    run = align(texts, units, units, local, policy=Policy(offset=80.0, anchor=True))
    assert {r.job_id: r.status for r in run.status.collect()} == {1: "ok", 2: "no lyrics", 3: "all lines hidden", 4: "ok", 5: "no line aligned", 6: "no lyrics"}
    srt = {r.job_id: r.srt for r in run.srt.collect()}
    assert set(srt) == {1, 4} and srt[1].startswith("1\n00:00:00,000 --> 00:00:00,500\n") and "흐음" not in srt[4]
    shown = {(r.job_id, r.text): (r.start, r.end) for r in run.cues.collect()}
    assert shown[4, "보여"][1] <= 2.4 and shown[4, "다시"][0] >= 4.0
    ranged = align(texts, units, units, local, policy=Policy(partial_range=True))
    assert {r.job_id: r.status for r in ranged.status.collect()}[5] == "range not in the lyrics"
    jobs = texts.select(F.col("job_id"), "duration", F.lit("ko").alias("language"))
    notes = diagnostics.messages(run.unresolved, run.matches, run.lines, run.adjustments, run.rejected, spark.createDataFrame([(1, "split", 2), (1, "merge", 0)], "job_id long, kind string, n long"))
    found = diagnostics.documents(jobs, units, run.matches, run.lines, units, run.whole, units.withColumn("cue_idx", F.lit(0)), run.adjustments, run.cues, run.cues, notes, {"lead": 0})
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [(f.name, f.dataType.simpleString()) for f in diagnostics.DOCUMENT] and found.count() == 6
    assert {(r.job_id, r.kind) for r in notes.collect()} >= {(1, "split"), (5, "unresolved")}


def test_documents_round_trip(spark, tmp_path):
    text = '{"job_id": "7", "duration": 1.5,\n "global_units": [{"text": "a", "start": 0.0, "end": 1.0}], "local_cues": {"0": {"text": "a", "start": 0.0, "end": 1.0}}, "messages": ["x"]}'
    (tmp_path / "d.json").write_text(text)
    found = diagnostics.read_documents(spark, str(tmp_path / "d.json"))
    assert [tuple(r) for r in diagnostics.units_of(found).collect()] == [("7", 0, "a", 0.0, 1.0)]
    diagnostics.write_documents(found, str(tmp_path / "out"))
    assert found.collect() == diagnostics.read_documents(spark, str(tmp_path / "out")).collect()


WHOLE = {
    "audio": "/songs/a.wav", "duration": 9.5, "backend": "b", "model": "small", "language": None, "detected_language": "ko", "device": {"whisper": "cpu", "separation": "cpu", "reason": "none"},
    "settings": {"auto_segment": True, "max_chars": 30, "range_end_seconds": None, "lead_ms": 0}, "transcript_units": [{"text": "가", "start": 0.0, "end": 1.0}],
    "transcript_matches": [{"cue_index": 0, "source_text": "가", "transcript_text": "가", "start": 0.0, "end": 1.0, "similarity": 1.0, "coverage": 1.0, "exact_characters": 1, "status": "match"}],
    "auto_hidden_gaps": [{"after_cue_index": 1, "text": "x", "start": 1.0, "end": 2.0}], "manual_hidden_indices": [1], "global_units": [], "local_cues": {"0": {"text": "가", "start": 0.0, "end": 1.0}},
    "local_units": {"0": [{"text": "가", "start": 0.0, "end": 1.0}]}, "start_adjustments": [], "hidden_timing_cues": [{"text": "h", "start": 2.0, "end": 3.0}], "raw_cues": [], "cues": [], "messages": ["done"], "of later versions": {"deep": [1, {"x": None}]},
}


@pytest.mark.parametrize("lines", [False, True])
def test_whole_documents_survive_and_broken_ones_are_rows(spark, tmp_path, lines):
    import json

    good, folder = [WHOLE, {**WHOLE, "job_id": "mine", "device": None}, {}], tmp_path / "in"
    bad = ["{broken", "[1, 2]", json.dumps({**WHOLE, "duration": "long", "cues": 3}), '"text"']
    folder.mkdir()
    texts = [json.dumps(d, ensure_ascii=False, indent=None if lines else 2) for d in good] + bad
    if lines:
        (folder / "all.json").write_text("\n".join([*texts, ""]))
    else:
        for k, text in enumerate(texts):
            (folder / f"song {k}.json").write_text("\ufeff" + text if k == 0 else text)
    found, broken = diagnostics.scan_documents(spark, str(folder), lines)
    rows = {r.job_id: r for r in found.filter("model IS NOT NULL").collect()}
    first = rows["all" if lines else "song 0"] if not lines else rows["all"]
    assert "mine" in rows and found.count() == 3
    assert (first.audio, first.duration, first.device.whisper, first.hidden_timing_cues[0].text, first.auto_hidden_gaps[0].after_cue_index, first.local_units["0"][0].text) == ("/songs/a.wav", 9.5, "cpu", "h", 1, "가")
    assert first.settings.toPython() == WHOLE["settings"]
    reasons = sorted(r.reason for r in broken.collect())
    assert reasons == ["not JSON", "not an object", "not an object", "of another type: duration, cues"]
    diagnostics.write_documents(found, str(tmp_path / "out"))
    again = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()), key=str)
    assert again == sorted(good, key=str)


def test_files_to_subtitles(spark, tmp_path):
    """Texts and sounds as files of one name, a range of the sound, and a document that is read again."""
    import wave

    from cuewright.plans.align import settings
    from cuewright.plans.demo import read_srt, write_srt
    from cuewright.sources.lines import read_texts
    from cuewright.sources.media import read_wave_lengths

    for name, text in (("one song", "\ufeffhello there\nsecond line"), ("b%c+d", "other words")):
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(2)
            out.setframerate(100)
            out.writeframes(b"\0\0" * 1200)
    texts = read_texts(spark, str(tmp_path / "*.txt"), read_wave_lengths(spark, str(tmp_path / "*.wav")))
    assert {(r.job_id, r.duration) for r in texts.collect()} == {("one song", 12.0), ("b%c+d", 12.0)}
    units = spark.createDataFrame([("one song", i, w, i * 1.0, i + 0.8) for i, w in enumerate("hello there second line".split())] + [("b%c+d", 0, "other", 1.0, 1.5), ("b%c+d", 1, "words", 1.6, 2.0)], UNIT.replace("job_id long", "job_id string"))
    policy = Policy(range_start=2.0, range_end=11.0)
    run = align(texts, units, units, units.withColumn("cue_idx", F.lit(0)).limit(0), policy=policy)
    assert {r.status for r in run.status.collect()} == {"ok"}
    assert "00:00:04,000 --> " in next(r.srt for r in run.srt.collect() if r.job_id == "one song")
    write_srt(run.srt, str(tmp_path / "out"))
    assert {(r.job_id, r.text, r.start) for r in read_srt(spark, str(tmp_path / "out")).collect()} == {("one song", "hello there", 2.0), ("one song", "second line", 4.0), ("b%c+d", "other words", 3.0)}
    jobs = texts.select("job_id", "duration", F.lit("ko").alias("language"), F.lit("small").alias("model"))
    none = run.adjustments.limit(0)
    notes = diagnostics.messages(run.unresolved, run.matches, run.lines, none, run.rejected, spark.createDataFrame([], "job_id string, kind string, n long"))
    made = diagnostics.documents(jobs, units, run.matches, run.lines, units, run.whole, units.withColumn("cue_idx", F.lit(0)), none, run.cues, run.cues, notes, settings(policy))
    diagnostics.write_documents(made, str(tmp_path / "documents"))
    again, broken = diagnostics.scan_documents(spark, str(tmp_path / "documents"), lines=True)
    row = next(r for r in again.collect() if r.job_id == "one song")
    assert broken.count() == 0 and row.settings.toPython() == settings(policy) and (row.model, row.duration, len(row.cues)) == ("small", 12.0, 2)
    parts = diagnostics.full_report(diagnostics.report(run.matches, run.whole, run.whole.limit(0)), run.cues, notes).filter("job_id = 'one song'").collect()
    assert [r.line for r in parts if r.part == "cue"][0].startswith("01    0.00-") and {r.part for r in parts} >= {"line", "cue"}


def test_languages(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", "auto", " Automatic", "Korean", "EN", "Klingon")], "v string").select(language_code(F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == [None, None, None, None, "ko", "en", "klingon"]
    assert languages(spark).count() >= 100 and languages(spark).filter("code = 'yue' and name = 'Cantonese'").count() == 1


def test_sound(spark):
    import io
    import math
    import wave

    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000), f.writeframes(b"\0\0" * 12_000)
    got = spark.createDataFrame([(raw.getvalue(),), (b"no",), (None,)], "c binary").select(wave_seconds(F.col("c")).alias("s")).collect()
    assert [r.s for r in got] == [1.5, None, None]
    sine = spark.range(24_000).select(F.lit(1).alias("job_id"), F.col("id").alias("sample_idx"), (0.4 * F.sin(F.col("id") * 2 * math.pi * 220 / 8000)).alias("value"))
    peaks = activity.waveform(sine, 80)
    assert peaks.count() == 80 and peaks.agg(F.max("peak")).first()[0] > 0.8
    assert sample_range(sine, 8000, 3.0, 0.75, 2.25).count() == 12_000 and sample_range(sine, 8000, 3.0, -1.0, 9.0).count() == 24_000
    with pytest.raises(ValueError, match="positive duration"):
        sample_range(sine, 8000, 3.0, 2.0, 1.0)
    silent = diagnostics.waveform_json(activity.waveform(sine.withColumn("value", F.lit(0.0)), 32), spark.createDataFrame([(1, 1.0)], "job_id int, duration double")).first().json
    assert re.fullmatch(r'\{"duration":1\.0,"peaks":\[(0\.0,){31}0\.0\]\}', silent)
    results = spark.createDataFrame([(1, [([("a", 0.0, 1.0)],), (None,), ([("b", 1.0, 2.0), ("c", 2.0, 3.0)],)]), (2, None)], "job_id int, segments array<struct<words:array<struct<word:string,start:double,end:double>>>>")
    assert [tuple(r)[1:3] for r in flatten_segments(results).orderBy("unit_idx").collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_blocks_of_alignment():
    rng = random.Random(11)

    def slow(s, h):
        score, move = [[0] * (len(h) + 1) for _ in range(len(s) + 1)], {}
        for i in range(1, len(s) + 1):
            for j in range(len(h) + 1):
                ways = [(score[i - 1][j - 1] + (3 if s[i - 1] == h[j - 1] else -2), 0)] if j else []
                ways += [(score[i - 1][j] - 2, 1)] + ([(score[i][j - 1] - 2, 2)] if j else [])
                best = max(w[0] for w in ways)
                score[i][j], move[i, j] = best, next(w[1] for w in ways if w[0] == best)
        i, j, out = len(s), max(range(len(h) + 1), key=lambda k: score[-1][k]), [-1] * len(s)
        while i:
            m = move[i, j]
            if m == 0:
                out[i - 1] = j - 1
            i, j = i - (m < 2), j - (m != 1)
        return out

    for _ in range(150):
        s, h = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(2))
        assert pathways.align(s, h).tolist() == slow(s, h)
