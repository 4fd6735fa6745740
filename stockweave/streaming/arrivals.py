"""Files that arrive in a folder: read each once, keep one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    """Stream of Parquet files as they appear below ``path``."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", per_trigger)
        .option("recursiveFileLookup", True)
        .parquet(path)
    )


def load_new(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> None:
    """Append what has arrived since the last call, one row per key.

    The keys seen so far are keyed state of the stream, on disk and split by
    key: a batch looks up its own keys and never reads the target. There is no
    watermark, so every arrived row counts, however late. The sink commits a
    batch as a whole, and a batch that is run again after a failure starts from
    the state before it: a restart neither loses nor doubles rows. Null keys are
    compared as values. Without any arrival the target is an empty table.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        query = (
            stream.dropDuplicates(keys)
            .writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    query.awaitTermination()
    if query.lastProgress is None and not _has_batches(spark, target):
        spark.createDataFrame([], stream.schema).write.mode("append").parquet(target)


def _has_batches(spark: SparkSession, target: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_spark_metadata")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def weekly_counts(df: DataFrame, event_time: str, kind: str) -> DataFrame:
    return df.groupBy(F.date_trunc("week", event_time).cast("date").alias("week_start"), kind).agg(
        F.count("*").alias("n")
    )
