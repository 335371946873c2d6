from pyspark.sql import functions as F

from cuewright.streaming.phrases import phrases


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 0.0), (1, 1.0), (1, 2.5), (1, 9.0), (2, 0.5), (2, 3.0), (1, 9.9), (3, 500.0)]
    units = spark.createDataFrame(rows, "job_id long, s double").select("job_id", F.timestamp_seconds("s").alias("at"))
    units.repartition(1).sortWithinPartitions("at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(units.schema).parquet(str(tmp_path / "in"))
    query = phrases(stream).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {(r.job_id, r.phrase_start, r.phrase_end, r.n_units) for r in phrases(units).collect()}
    assert {(j, n) for j, _, _, n in batch} == {(1, 3), (1, 2), (2, 1), (3, 1)}
    got = {(r.job_id, r.phrase_start, r.phrase_end, r.n_units) for r in spark.table("found").collect()}
    assert got <= batch and {j for j, *_ in got} == {1, 2}  # the last phrase is still open
