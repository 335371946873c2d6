"""Alignments as runs, with few of their rows kept; blocks of short texts."""

import random

from cuewright.operators import pathways
from cuewright.operators.similarity import longest_block, short_block


def test_way_back_through_rows_worked_out_again(monkeypatch):
    rng = random.Random(8)
    texts = [("".join(rng.choices("abc", k=rng.randrange(1, 70))), "".join(rng.choices("abcd", k=rng.randrange(1, 70)))) for _ in range(60)]
    want = [pathways.align(s, h).tolist() for s, h in texts]
    monkeypatch.setattr(pathways, "KEPT", 1)
    monkeypatch.setattr(pathways, "ROWS", 7)
    assert [pathways.align(s, h).tolist() for s, h in texts] == want


def test_a_text_heard_as_it_is_makes_one_run(spark):
    """5000 letters were 5000 rows, found in four tiles."""
    text = "".join(random.Random(9).choices("abcdefgh", k=5000))
    jobs = spark.createDataFrame([("a", text, text), ("b", text, "xy" + text[:2500] + "-" + text[2501:]), ("c", "", "x")], "job_id string, source string, heard string")
    got = sorted((r.job_id, r.i, r.j, r.n, r.same) for r in pathways.pair_runs(jobs).collect())
    assert got == [("a", 0, 0, 5000, True), ("b", 0, 2, 2500, True), ("b", 2500, 2502, 1, False), ("b", 2501, 2503, 2499, True)]
    tiled = sorted((r.job_id, r.i, r.j, r.same) for r in pathways.paths(jobs, 1024).collect())
    assert tiled == sorted((r.job_id, r.i, r.j, r.same) for r in pathways.paths(jobs).collect()) and len(tiled) == 10_000


def test_blocks_of_short_texts():
    rng = random.Random(10)
    for _ in range(300):
        first, second = ("".join(rng.choices("abc", k=rng.randrange(0, 40))) for _ in range(2))
        assert short_block(first, second) == longest_block(first, second)
