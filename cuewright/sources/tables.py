"""Tables of a run in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder of this machine, on a local master only."""
    if known := spark.conf.get("spark.checkpoint.dir", None):
        return known
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cuewright-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The rows written once, as a table in the shared folder, and read from there: later steps neither repeat the work nor carry its plan.

    Survives lost executors. Unlike ``checkpoint()`` this forgets the estimated size, which through many joins becomes a number of
    millions of digits. The table goes with the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuewright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over as many tasks as the session shuffles into: for steps that take long over few bytes, which Spark would put together in one."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *keys)
