"""Exact deduplication over a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text. A batch is
reduced to one row per digest (partial aggregation before the shuffle); a sort-merge anti-join with the index
leaves the new digests, which are appended with the batch's name; a second join reads from the index which document
stays for each digest. The index side of both joins is never shuffled, whatever its size; as a bucket has a
file for each batch, it is sorted again within the bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import SPACE, checkpointed, shared_dir


def normalised(text: Column) -> Column:
    """Null becomes the empty text; each run of ASCII white space becomes one space (no trimming)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class DigestIndex:
    """One row per digest seen so far: ``digest`` BINARY, ``keep_id`` BIGINT (the document that stays), ``batch`` STRING (which brought it).

    ``path`` lies in a folder all executors share; an existing index there is picked up again, in any
    later session, with the bucket count it was made with, which lies beside its data. Another count is refused, and so is
    a folder with data and no count.
    """

    #: The file of the bucket count; readers of tables pass over names with an underscore.
    COUNT = "_buckets"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets = self._buckets(buckets)
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def _buckets(self, wanted: int | None) -> int:
        """The index's own bucket count; a new index gets ``wanted``, or 64."""
        if wanted is not None and wanted < 1:
            raise ValueError("an index has at least one bucket")
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        file, fs = jvm.org.apache.hadoop.fs.Path(folder, self.COUNT), folder.getFileSystem(hadoop)
        if not fs.exists(file):
            if fs.exists(folder) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(folder)):
                raise ValueError(f"{self.path} holds data, but no bucket count")
            count = wanted or 64
            out = fs.create(file, False)  # of two that make one index at once, one fails here
            out.writeInt(count)
            out.close()
            return count
        found = fs.open(file)
        count = found.readInt()
        found.close()
        if wanted not in (None, count):
            raise ValueError(f"{self.path} has {count} buckets, not {wanted}")
        return count

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Forget the index: its catalogue entry and its folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def append(self, fresh: DataFrame) -> None:
        """Add digests that the index does not hold; one sorted file per bucket."""
        fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate a batch against itself and the index, and append its new digests.

        Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

        * Null text counts as empty; all empty texts are one group.
        * Of equal texts in the batch the smallest id stays, a null id only if there is no other; of
          repeated rows with that id exactly one is ``kept``. If an earlier batch holds the text,
          its ``keep_id`` is given and no row of this batch is kept.
        * ``group_size`` counts the rows of this batch with the text.
        * A batch that was lost after its digests were appended may come again under the same name ``batch``: what
          it brought itself counts as new. Without a name each call is another batch.
        * An empty table gives an empty result; further columns of the input are ignored.
        """
        name = batch or uuid.uuid4().hex
        rows = checkpointed(
            docs.select(
                F.col(id_col).cast("long").alias("doc_id"),
                F.monotonically_increasing_id().alias("row_id"),
                F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"),
            )
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_id"))
        groups = checkpointed(rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self.append(fresh.select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(name).alias("batch")))
        held = groups.join(self.rows().hint("merge"), "digest").select("digest", "keep_id", "group_size", F.when(F.col("batch") == name, F.col("first.row_id")).alias("kept_row"))
        return rows.join(checkpointed(held), "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row_id") == F.col("kept_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Deduplicate ``docs`` against ``index``, or against a new one in the shared folder that goes afterwards; see ``DigestIndex.ingest``."""
    if index is not None:
        return index.ingest(docs, id_col, text_col, batch)
    spark = docs.sparkSession
    index = DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}")
    found = index.ingest(docs, id_col, text_col, batch)  # its rows are written; the index is not read again
    index.drop()
    return found
