"""Wave files as a data source: samples by ranges, decoded here, and one file a job as a sink.

A scan plans blocks of samples from the files' headers alone; filters on ``sample_idx`` leave out blocks, and what a block has to
read outside them. Samples are numbers from -1 to 1, whatever the file holds.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from cuewright.sources.staging import Staged, Written, file_name, file_system

#: Samples of a block.
BLOCK = 1 << 20
#: The formats' numbers in a wave file.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
SCHEMA = "file string, channel int, sample_idx long, value double"


@dataclass(frozen=True)
class Header:
    kind: int
    channels: int
    rate: int
    bits: int
    start: int  # of the samples, in bytes
    samples: int  # of a channel

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def header(read, size: int) -> Header | None:
    """The header of a wave file of ``size`` bytes; ``read`` gives bytes by place and number. None where it is none."""
    if size < 12 or read(0, 4) != b"RIFF" or read(8, 4) != b"WAVE":
        return None
    at, found = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt " and length >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            if kind == EXTENSIBLE and length >= 26:
                kind = struct.unpack("<H", read(at + 32, 2))[0]
            if channels and rate and (kind, bits) in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
                found = Header(kind, channels, rate, bits, 0, 0)
        elif name == b"data":
            length = min(length, size - at - 8)  # a stream's length is a guess
            return found and replace(found, start=at + 8, samples=length // found.frame)
        at += 8 + length + length % 2
    return None


def decode(raw: bytes, kind: int, bits: int) -> np.ndarray:
    """Samples as doubles."""
    if kind == FLOAT:
        return np.frombuffer(raw, f"<f{bits // 8}").astype(np.float64)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8) - 128.0) / 128
    if bits == 24:
        three = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        whole = np.zeros((len(three), 4), np.uint8)
        whole[:, 1:] = three  # the high bytes of 32 bits
        return whole.view("<i4").ravel() / 2.0**31
    return np.frombuffer(raw, f"<i{bits // 8}") / 2.0 ** (bits - 1)


def encode(values: np.ndarray, bits: int, floating: bool) -> bytes:
    if floating:
        return values.astype(f"<f{bits // 8}").tobytes()
    top = 2 ** (bits - 1)
    whole = np.clip(np.rint(values * top), -top, top - 1).astype("<i4")
    return whole.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()


def wave_header(samples: int, rate: int, bits: int, floating: bool) -> bytes:
    frame = bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + samples * frame, b"WAVE", b"fmt ", 16, FLOAT if floating else PCM, 1, rate, rate * frame, frame, bits, b"data", samples * frame)


@dataclass
class Block(InputPartition):
    file: str
    of: Header
    first: int
    after: int


class SoundReader(DataSourceReader):
    """Blocks of the files' samples from ``low`` to before ``high``."""

    def __init__(self, path: str, block: int):
        self.path, self.block, self.low, self.high = path, block, 0, None

    def partitions(self) -> list[Block]:
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        found = []
        for info in sorted(infos, key=lambda f: f.path):
            if info.type != fs.FileType.File or not info.base_name.lower().endswith(".wav"):
                continue
            with system.open_input_file(info.path) as file:
                of = header(lambda at, n, file=file: file.read_at(n, at), info.size)
            if of is None:
                raise ValueError(f"{info.path} is no wave file of a known kind")
            high = of.samples if self.high is None else min(of.samples, self.high)
            found += [Block(info.path, of, max(at, self.low), min(at + self.block, high)) for at in range(self.low // self.block * self.block, high, self.block)]
        return found or [Block("", Header(PCM, 1, 1, 16, 0, 0), 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        of, n = partition.of, partition.after - partition.first
        if n <= 0:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.file) as file:
            values = decode(file.read_at(n * of.frame, of.start + partition.first * of.frame), of.kind, of.bits)
        at = np.repeat(np.arange(partition.first, partition.after), of.channels)
        channel = np.tile(np.arange(of.channels, dtype=np.int32), n)
        file = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int8)), pa.array([partition.file])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([file, pa.array(channel), pa.array(at), pa.array(values)], ["file", "channel", "sample_idx", "value"])


class RangedSoundReader(SoundReader):
    """Takes its bounds from filters. Spark has such readers only in sessions with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("sample_idx",) and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    after = f.value + (not isinstance(f, LessThan))
                    self.high = after if self.high is None else min(self.high, after)
            else:
                yield f


class SoundWriter(DataSourceWriter):
    """Rows (job_id, sample_idx, value) in order, each job's in one task, as one file a job."""

    def __init__(self, path: str, overwrite: bool, rate: int, bits: int, floating: bool):
        self.staged, self.rate, self.bits, self.floating = Staged(path, overwrite), rate, bits, floating

    def write(self, iterator: Iterator[Row]) -> Written:
        written, place = Written(), self.staged.place()
        system, _ = file_system(place)

        def store(job: str, values: list[bytes], n: int) -> None:
            name = file_name(job, ".wav")
            waits = posixpath.join(place, name)
            with system.open_output_stream(file_system(waits)[1]) as out:
                out.write(wave_header(n, self.rate, self.bits, self.floating))
                for part in values:
                    out.write(part)
            written.files.append((waits, name))

        job, held, parts, n = None, [], [], 0
        for row in iterator:
            if row["job_id"] != job:
                if job is not None:
                    store(job, [*parts, encode(np.array(held), self.bits, self.floating)], n)
                job, held, parts, n = row["job_id"], [], [], 0
            held.append(row["value"] or 0.0)
            n += 1
            if len(held) >= 1 << 16:
                parts.append(encode(np.array(held), self.bits, self.floating))
                held = []
        if job is not None:
            store(job, [*parts, encode(np.array(held), self.bits, self.floating)], n)
        return written

    def commit(self, messages: list[Written | None]) -> None:
        self.staged.commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.staged.abort(messages)


class SoundSource(DataSource):
    """``spark.read.format("sound").load(path)`` of a folder of wave files or one; ``df.write.format("sound")`` with rate, bits and floating."""

    @classmethod
    def name(cls) -> str:
        return "sound"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SoundReader:
        kind = RangedSoundReader if self.options.get("ranged", "false") == "true" else SoundReader
        return kind(self.options["path"], int(self.options.get("block", BLOCK)))

    def writer(self, schema, overwrite: bool) -> SoundWriter:
        return SoundWriter(self.options["path"], overwrite, int(self.options["rate"]), int(self.options.get("bits", 16)), self.options.get("floating", "false") == "true")


def read_sound(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, channel, sample_idx, value) of the wave files at an address that driver and executors see.

    Filters on ``sample_idx`` reach the scan if the session has spark.sql.python.filterPushdown.enabled; without, Spark filters after it.
    A file that is no wave file of a known kind (PCM of 8 to 32 bits, floats) is an error.
    """
    spark.dataSource.register(SoundSource)
    ranged = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("sound").option("block", block).option("ranged", ranged).load(path)


def write_sound(samples: DataFrame, path: str, rate: int, bits: int = 16, floating: bool = False, mode: str = "append") -> None:
    """One wave file for each job of (job_id, sample_idx, value): PCM of 16, 24 or 32 bits, or floats of 32 or 64. A write that fails leaves no file."""
    if bits not in ((32, 64) if floating else (16, 24, 32)):
        raise ValueError("PCM has 16, 24 or 32 bits, floats 32 or 64")
    samples.sparkSession.dataSource.register(SoundSource)
    rows = samples.select(F.col("job_id").cast("string").alias("job_id"), "sample_idx", F.col("value").cast("double").alias("value"))
    rows = rows.repartition("job_id").sortWithinPartitions("job_id", "sample_idx")
    rows.write.format("sound").option("rate", rate).option("bits", bits).option("floating", str(floating).lower()).mode(mode).save(path)


def wave_seconds(content: Column) -> Column:
    """Seconds of a wave file's bytes; null where they are none."""

    def seconds(raw: bytes | None) -> float | None:
        of = header(lambda at, n: raw[at : at + n], len(raw)) if raw else None
        return of and of.samples / of.rate

    return F.pandas_udf(lambda files: files.map(seconds).astype("float64"), "double")(content)
