"""Incremental ingest and result cache (G-03, G-04)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Parts of a target by a hash of the key; a batch reads only those that its own keys fall into.
BUCKETS = 1024


def ingest_incremental(spark: SparkSession, src: str, dst: str, checkpoint: str, schema: str, key: str = "doc_id",
                       transform: Callable[[DataFrame], DataFrame] | None = None, max_files: int = 1000, buckets: int = BUCKETS) -> StreamingQuery:
    """G-03: process the files that arrived since the last run, then stop.

    ``transform`` keeps the key. The file source remembers what it has seen; a batch drops repeats of a key inside itself and keys already written.
    The target is partitioned by ``key_bucket``, a hash of the key, and ``batch``, the stream and its batch. A batch looks for its keys in the
    buckets that they fall into, and a batch that is replayed overwrites its own partitions, whether they were written wholly, in part or not at all.
    ``checkpoint`` and ``dst`` must lie in folders all executors share.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        label = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        fresh = batch.dropDuplicates([key]).withColumn("key_bucket", bucket).persist()
        try:
            touched = [r[0] for r in fresh.select("key_bucket").distinct().collect()]
            if _exists(session, dst) and touched:
                done = written(session, dst, touched).filter(F.col("batch") != label).select("key_bucket", key)
                new = fresh.join(done, ["key_bucket", key], "left_anti")
            else:
                new = fresh
            new = transform(new.drop("key_bucket")) if transform else new.drop("key_bucket")
            new.withColumn("key_bucket", bucket).withColumn("batch", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_bucket", "batch").parquet(dst)
        finally:
            fresh.unpersist()

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def written(spark: SparkSession, dst: str, buckets: Sequence[int]) -> DataFrame:
    """The rows of some buckets of the target; the others are pruned before a file is opened."""
    return spark.read.parquet(dst).filter(F.col("key_bucket").isin(list(buckets)))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def split_cached(df: DataFrame, cache: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """G-04: cached results of the requested keys, and the requests still to be computed."""
    return cache.join(df.select(*key).distinct(), list(key), "left_semi"), df.join(cache.select(*key), list(key), "left_anti")


def cached_compute(df: DataFrame, cache: DataFrame, fn: Callable[[DataFrame], DataFrame], key: Sequence[str]) -> DataFrame:
    """G-04: compute only keys the cache lacks and add the cached ones; the whole key is compared."""
    known, missing = split_cached(df, cache, key)
    return known.unionByName(fn(missing.dropDuplicates(list(key))))


def append_cache(results: DataFrame, path: str) -> None:
    """G-04: add newly computed results to the stored cache."""
    results.write.mode("append").parquet(path)
