"""Cuts of lines as loops over a line's words, in time of little more than their number."""

import time

from cuewright.operators import segments


def test_words_take_their_share_of_units():
    units = [("ab", 0.0, 1.0), ("", 1.0, 2.0), (None, 1.0, 2.0), ("zz", 2.0, 3.0), ("cde", 3.0, 6.0)]
    assert segments.timed_words(["ab", "c", "de"], ["ab", "c", "de"], 0.5, 5.5, units) == [("ab", 0.5, 1.0), ("c", 3.0, 4.0), ("de", 4.0, 5.5)]
    assert segments.timed_words(["ab", "x"], ["ab", "x"], 0.0, 1.0, units) == [] == segments.timed_words(["ab"], ["ab"], 0.0, 1.0, units)
    assert segments.timed_words(["ab", "c", "de"], ["ab", "c", "de"], None, None, [("ab", None, 1.0), ("cde", 3.0, 6.0)]) == []


def test_lines_of_many_words_and_units(spark):
    """A word was held against every unit of its line: 3000 times 3000 steps of an interpreted expression a line."""
    text = " ".join(f"w{k}" for k in range(3000))
    units = [(k, f"w{k}", k * 0.25, k * 0.25 + 0.2) for k in range(3000)]
    df = spark.createDataFrame([(1, k, text, 0.0, 750.0, units) for k in range(4)], f"job_id long, cue_idx int, text string, start double, end double, units array<{segments.UNIT}>")
    began = time.time()
    parts = [r for r in segments.split_lines(df).orderBy("cue_idx", "part_idx").collect() if r.cue_idx == 0]
    assert time.time() - began < 30 and len(parts) > 100
    assert " ".join(r.text for r in parts) == text and (parts[0].start, parts[-1].end) == (0.0, 750.0)
