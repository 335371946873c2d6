import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cuewright.operators import matching, onsets, pathways
from cuewright.operators.similarity import common_letters, longest_block, similarity


def run(spark, lines, units):
    cues = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "job_id long, cue_idx int, text string")
    heard = spark.createDataFrame([(1, i, t, float(a), float(b)) for i, (t, a, b) in enumerate(units)], "job_id long, unit_idx int, text string, start double, end double")
    return matching.match_lines(cues, heard)


def test_align_against_plain_loop():
    rng = random.Random(1)
    for _ in range(200):
        s, h = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in "sh")
        table = [[0] * (len(h) + 1)]
        for i in range(1, len(s) + 1):
            row = [-2 * i]
            for j in range(1, len(h) + 1):
                row.append(max(table[-1][j - 1] + (3 if s[i - 1] == h[j - 1] else -2), table[-1][j] - 2, row[-1] - 2))
            table.append(row)
        found = pathways.align(s, h)
        pairs = [(i, j) for i, j in enumerate(found.tolist()) if j >= 0]
        score = sum(3 if s[i] == h[j] else -2 for i, j in pairs) - 2 * (len(s) - len(pairs))
        score -= 2 * sum(b[1] - a[1] - 1 for a, b in zip(pairs, pairs[1:]))
        assert score == max(table[-1])


def test_matches(spark):
    (row,) = run(spark, ["너를 사랑해"], [("정말", 1.0, 1.5), ("사랑해", 1.5, 2.5)]).collect()
    assert (row.transcript_text, row.status) == ("정말 사랑해", "changed") and row.exact_characters >= 2
    rows = run(spark, ["첫 줄", "다음 줄"], [("첫", 0, 0.5), ("줄", 0.5, 1), ("우우", 2, 3), ("다음", 4, 4.5), ("줄", 4.5, 5)]).orderBy("cue_idx").collect()
    assert rows[1].start == 4.0 and rows[1].status == "match"
    spans = matching.partial_span(run(spark, ["없는 가사", "내 곁에"], [("내", 0, 1), ("곁에", 1, 2)])).collect()
    assert (spans[0]["first"], spans[0]["last"]) == (1, 1)


def slow_align(source, heard):
    """The whole table, and the way back with pairs before lost source letters before lost heard ones."""
    table = [[0] * (len(heard) + 1)]
    for i in range(1, len(source) + 1):
        row = [-2 * i]
        for j in range(1, len(heard) + 1):
            row.append(max(table[-1][j - 1] + (3 if source[i - 1] == heard[j - 1] else -2), table[-1][j] - 2, row[-1] - 2))
        table.append(row)
    out, i, j = [-1] * len(source), len(source), table[-1].index(max(table[-1]))
    while i and j:
        if table[i][j] == table[i - 1][j - 1] + (3 if source[i - 1] == heard[j - 1] else -2):
            i, j = i - 1, j - 1
            out[i] = j
        elif table[i][j] == table[i - 1][j] - 2:
            i -= 1
        else:
            j -= 1
    return out


@pytest.mark.parametrize("tile", [1, 3, 7, 4096])
def test_tiles_against_the_whole_table(spark, tile):
    rng = random.Random(tile)
    most = 6 if tile == 1 else 25
    jobs = [(f"job {k}", "".join(rng.choice("abé𝟘") for _ in range(rng.randint(0, most))), "".join(rng.choice("abé𝟘c") for _ in range(rng.randint(0, most)))) for k in range(40)]
    jobs += [("same", "abcabcabc"[:most], "xabcabcabcx"[: most + 2]), ("other", "a" * most, "b" * most)]
    got = {}
    for r in pathways.paths(spark.createDataFrame(jobs, "job_id string, source string, heard string"), tile).collect():
        got.setdefault(r.job_id, {})[r.i] = (r.j, r.same)
    for job, source, heard in jobs:
        want = {i: (j, source[i] == heard[j]) for i, j in enumerate(slow_align(source, heard)) if j >= 0} if source and heard else {}
        assert got.get(job, {}) == want
        assert pathways.align(source, heard).tolist() == slow_align(source, heard)


def test_similarity_on_both_sides_of_popular_letters(spark):
    rng, pairs = random.Random(3), [(None, None), ("", "a"), ("a", ""), ("abc", "abc")]
    for k in range(600):
        letters = ("ab", "abcdefghij ", "abcdefghijklmnopqrstuvwxyz0123456789가나다라")[k % 3]
        second = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 30, 60, 199, 200, 201, 300]) if k % 5 == 0 else rng.randint(0, 40)))
        first = "".join(rng.choice(letters) if rng.random() < 0.3 else c for c in second)[rng.randint(0, 3) :] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        pairs.append((first, second))
        assert common_letters(first, second) == sum(b.size for b in SequenceMatcher(None, first, second).get_matching_blocks())
        block = SequenceMatcher(None, first, second, False).find_longest_match(0, len(first), 0, len(second))
        assert not block.size or longest_block(first, second) == tuple(block)
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == SequenceMatcher(None, r.a or "", r.b or "").ratio() for r in rows)


@pytest.mark.parametrize("tile", [5, None])
def test_match_table_against_its_rules(spark, tile):
    """Random jobs, with string ids, empty keys, blank and null texts, and units that go back in time."""
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "bé", "Sun", "ﬁre", "...", "가사", "", None, "the moon", " x "])
    lines, units = [], []
    for k in range(14):
        lines += [(f"j{k}", i, " ".join(w for w in (word() for _ in range(rng.randint(0, 4))) if w) or None) for i in range(rng.randint(1, 5))]
        at = 0.0
        for i in range(rng.choice([0, 3, 12])):
            at += rng.random()
            units.append((f"j{k}", i, word(), at, at + rng.choice([-0.2, 0.0, 0.5])))
    cues, heard = spark.createDataFrame(lines, "job_id string, cue_idx int, text string"), spark.createDataFrame(units, "job_id string, unit_idx long, text string, start double, end double")
    got = {(r.job_id, r.cue_idx): r for r in matching.match_lines(cues, heard, tile=tile).collect()}
    assert len(got) == len(lines)
    key = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "").casefold() if c.isalnum())
    for job in {x[0] for x in lines}:
        mine, said = [x for x in lines if x[0] == job], [x for x in units if x[0] == job]
        source, joined = "".join(key(x[2]) for x in mine), "".join(key(x[2]) for x in said)
        owner = [(u, k, len(key(u[2]))) for u in said for k in range(len(key(u[2])))]
        partner, at = slow_align(source, joined) if source and joined else None, 0
        for _, idx, text in mine:
            r, n = got[job, idx], len(key(text))
            assert r.source_text == text
            if partner is None:
                assert (r.status, r.similarity, r.transcript_text, r.start) == ("missing", 0.0, "", None)
                continue
            js = [j for j in partner[at : at + n] if j >= 0]
            exact = sum(source[at + k] == joined[j] for k, j in enumerate(partner[at : at + n]) if j >= 0)
            at += n
            if not js:
                assert (r.status, r.coverage, r.exact_characters, r.end) == ("weak", 0.0, 0, None)
                continue
            (u, k, size), (v, l, width) = owner[min(js)], owner[max(js)]
            between = said[u[1] : v[1] + 1]
            ratio = SequenceMatcher(None, key(text), "".join(key(x[2]) for x in between)).ratio()
            assert r.transcript_text == " ".join(x[2].strip() for x in between if x[2] and x[2].strip())
            assert (r.similarity, r.coverage, r.exact_characters) == (ratio, len(js) / n, exact)
            assert r.start == pytest.approx(u[3] + max(0.0, u[4] - u[3]) * k / size) and r.end == pytest.approx(v[3] + max(0.0, v[4] - v[3]) * (l + 1) / width)


def test_nothing_heard(spark):
    assert {r.status for r in run(spark, ["a", None], []).collect()} == {"missing"}


def test_snap(spark):
    points = spark.createDataFrame([(1, 0, 3.0), (1, 1, 1.2)], "job_id long, cue_idx int, at double")
    segs = spark.createDataFrame([(1, 1.0, 5.0)], "job_id long, seg_start double, seg_end double")
    assert [r.snapped for r in onsets.snap_start(points, segs).orderBy("cue_idx").collect()] == [3.0, 1.0]
