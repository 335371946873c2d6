"""Steps over the lines and the units of a job side by side, both in order, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from cuewright.functions.text import folded, match_key_native
from cuewright.sources.tables import dealt

#: Jobs whose rows leave a task together.
TOGETHER = 64


def fields(rows: DataFrame, *names: str) -> list[StructField]:
    """Columns of a table, all of them unless named, as they may come out of a left join."""
    return [StructField(f.name, f.dataType) for f in rows.schema if not names or f.name in names]


def field(name: str, kind: DataType = DoubleType()) -> StructField:
    return StructField(name, kind)


def keyed(rows: DataFrame, native: bool) -> DataFrame:
    """Rows with the ``_key`` of their text if it is made in the JVM; else ``keys_of`` makes it where the rows are."""
    return rows.withColumn("_key", match_key_native(F.col("text"))) if native else rows


def keys_of(rows: pa.StructArray) -> list[str]:
    """The match keys of rows; empty where the text is null."""
    names = [f.name for f in rows.type]
    if "_key" in names:
        return [k or "" for k in rows.field("_key").to_pylist()]
    return [folded(t) if t else "" for t in rows.field("text").to_pylist()]


def ends_of(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each key begins and ends in all of them joined."""
    n = np.fromiter(map(len, keys), np.int64, len(keys))
    return np.cumsum(n) - n, np.cumsum(n)


def doubles(rows: pa.StructArray, name: str) -> np.ndarray:
    """A column as numbers; null is NaN."""
    return rows.field(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def nulls(rows: pa.StructArray, name: str) -> np.ndarray:
    return pc.is_null(rows.field(name)).to_numpy(zero_copy_only=False)


def _ordered(rows: pa.StructArray, order: str) -> pa.StructArray:
    at = rows.field(order).to_numpy(zero_copy_only=False)
    return rows if len(at) < 2 or (at[1:] >= at[:-1]).all() else rows.take(pa.array(np.argsort(at, kind="stable")))


def side_by_side(lines: DataFrame, units: DataFrame, step: Callable[[pa.StructArray, pa.StructArray], list[pa.Array]], columns: list[StructField]) -> DataFrame:
    """(job_id, columns) that ``step`` gives for the lines, by ``cue_idx``, and the units, by ``unit_idx``, of each job that has lines.

    A job's lines and units are one row of one task. The jobs are dealt over as many tasks as the session shuffles into, once.
    """
    gathered = lambda rows, name: dealt(rows, "job_id").groupBy("job_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "job_id"])).alias(name))
    schema = StructType([*fields(lines, "job_id"), *columns])
    kinds = [(f.name, f.dataType) for f in columns]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part, parts = batch.slice(first, TOGETHER), []
                for row in range(part.num_rows):
                    mine, said = (_ordered(part.column(name).slice(row, 1).flatten(), order) for name, order in (("lines", "cue_idx"), ("units", "unit_idx")))
                    parts.append(step(mine, said))
                job = part.column("job_id").take(pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])))
                yield pa.RecordBatch.from_arrays([job, *(pa.concat_arrays([p[k] for p in parts]) for k in range(len(kinds)))], ["job_id", *(name for name, _ in kinds)])

    return gathered(lines, "lines").join(gathered(units, "units").hint("merge"), "job_id", "left").select("job_id", "lines", "units").mapInArrow(found, schema)
