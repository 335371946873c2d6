"""Sound and subtitle files: samples by ranges against the whole read, sinks that leave all files or none."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.sources import sound
from cuewright.sources.sound import RangedSoundReader, encode, header, read_sound, write_sound
from cuewright.sources.srt import read_srt, write_srt


def wave_file(path, values, bits, floating=False, channels=1, extensible=False, odd=True):
    data = encode(np.array(values), bits, floating) if bits > 8 else bytes(int(v * 128 + 128) for v in values)
    kind, frame = (sound.FLOAT if floating else sound.PCM), channels * bits // 8
    fmt = struct.pack("<HHIIHH", sound.EXTENSIBLE if extensible else kind, channels, 100, 100 * frame, frame, bits)
    fmt += struct.pack("<HHIH14s", 22, bits, 0, kind, b"") if extensible else b""
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0" if odd else b""
    path.write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + extra + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data)


@pytest.mark.parametrize(("bits", "floating", "channels", "extensible"), [(8, False, 1, False), (16, False, 2, False), (24, False, 1, True), (32, False, 3, False), (32, True, 1, True), (64, True, 2, False)])
def test_sound_by_ranges(spark, tmp_path, bits, floating, channels, extensible):
    rng = random.Random(bits)
    values = [rng.randrange(-127, 128) / 128 for _ in range(1000 * channels)]
    wave_file(tmp_path / "a.wav", values, bits, floating, channels, extensible)
    (tmp_path / "note.txt").write_text("no sound")
    whole = read_sound(spark, str(tmp_path), block=64)
    rows = whole.orderBy("sample_idx", "channel").collect()
    assert [r.value for r in rows] == values and [r.sample_idx for r in rows] == [k // channels for k in range(len(values))]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = read_sound(spark, str(tmp_path), block=64).filter("sample_idx >= 100 AND sample_idx < 150 AND channel = 0")
        assert [r.value for r in part.orderBy("sample_idx").collect()] == values[100 * channels : 150 * channels : channels]
        assert part.rdd.getNumPartitions() == 2  # of 16 blocks
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_ranges_read_only_their_blocks(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

    wave_file(tmp_path / "a.wav", [0.5] * 1000, 16)
    want = {
        (GreaterThanOrEqual(("sample_idx",), 990),): (990, 1000),
        (GreaterThan(("sample_idx",), 127), LessThanOrEqual(("sample_idx",), 200)): (128, 201),
        (LessThan(("sample_idx",), 3), EqualTo(("channel",), 0)): (0, 3),
        (EqualTo(("sample_idx",), 77),): (77, 78),
        (LessThan(("sample_idx",), 5), GreaterThan(("sample_idx",), 9)): (0, 0),
    }
    for filters, (low, high) in want.items():
        reader = RangedSoundReader(str(tmp_path), 64)
        assert [f for f in reader.pushFilters(list(filters))] == [f for f in filters if f.attribute == ("channel",)]
        read = [n for block in reader.partitions() for batch in reader.read(block) for n in batch.column("sample_idx").to_pylist()]
        assert read == list(range(low, high))


def test_headers():
    for raw in (b"", b"RIFF", b"RIFF0000WAVE", b"RIFF0000WAVEfmt \x10\0\0\0" + b"\0" * 16, b"RIFX0000WAVE" + b"\0" * 99):
        assert header(lambda at, n, raw=raw: raw[at : at + n], len(raw)) is None


@pytest.mark.parametrize(("bits", "floating"), [(16, False), (24, False), (32, False), (32, True), (64, True)])
def test_sound_written_and_read(spark, tmp_path, bits, floating):
    jobs = [(f"job/{k} é", i, math.sin(i / 9 + k)) for k in range(3) for i in range(500)] + [("loud", 0, 2.0), ("loud", 1, None), ("loud", 2, -2.0)]
    df = spark.createDataFrame(jobs, "job_id string, sample_idx long, value double").repartition(7)
    write_sound(df, str(tmp_path / "out"), 100, bits, floating)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(files) == 4 and not any(f.startswith("_") for f in files)
    got = {(r.file.rsplit("/", 1)[1], r.sample_idx): r.value for r in read_sound(spark, str(tmp_path / "out")).collect()}
    assert len(got) == len(jobs)
    step = 1e-7 if floating else 2.0 ** (1 - bits)
    for job, i, value in jobs:
        want = (value or 0.0) if floating else max(-1.0, min(1 - 2.0 ** (1 - bits), value or 0.0))
        assert abs(got[sound.file_name(job, ".wav"), i] - want) <= step
    with pytest.raises(ValueError, match="bits"):
        write_sound(df, str(tmp_path / "no"), 100, 12)


def test_subtitles_written_and_read(spark, tmp_path):
    one = "1\n00:00:00,000 --> 00:00:00,500\n\u2800\n\n2\n00:00:01,250 --> 00:01:02,003\nfirst line\nof two\n\n3\n01:00:00,000 --> 100:00:01,000\nlast\n"
    rendered = spark.createDataFrame([("a/b: c", one), ("a%2Fb", "1\n00:00:00,000 --> 00:00:01,000\nx\n"), ("empty", "")], "job_id string, srt string")
    path = str(tmp_path / "out")
    write_srt(rendered, path)
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbf") and p.suffix == ".srt" for p in (tmp_path / "out").iterdir()) and len(list((tmp_path / "out").iterdir())) == 3
    got = sorted(tuple(r) for r in read_srt(spark, path).collect())
    assert got == [("a%2Fb", 0, 0.0, 1.0, "x"), ("a/b: c", 0, 1.25, 62.003, "first line\nof two"), ("a/b: c", 1, 3600.0, 360001.0, "last")]
    write_srt(rendered.filter("job_id = 'empty'"), path, "overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["empty.srt"]


def test_failed_writes_leave_no_file(spark, tmp_path):
    """One task fails after others have written; and two tasks have one job."""
    path = tmp_path / "out"
    rows = spark.range(40).repartition(8).select(F.col("id").cast("string").alias("job_id"), F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise("x").alias("srt"))
    with pytest.raises(Exception, match="no"):
        write_srt(rows, str(path))
    assert not path.exists() or not list(path.iterdir())
    with pytest.raises(Exception, match="two tasks"):
        write_srt(spark.createDataFrame([("a", "x"), ("a", "y")], "job_id string, srt string").repartition(2), str(path))
    assert not list(path.iterdir())
