"""Sources, sinks and runs of streams over files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.lineage import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of files: a folder of part files, or one file beside others."""
    path = f"{sf_dir}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_available(stream: DataFrame, file_format: str = "parquet") -> str:
    """Run a stream over all that is there now; returns the folder it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.format(file_format)
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return f"{base}/out"


def collected(stream: DataFrame) -> DataFrame:
    """Run a stream to its end and read back what it wrote."""
    return stream.sparkSession.read.schema(stream.schema).parquet(run_available(stream))


def emission_json(kind: Column, text: Column) -> Column:
    """Wire form of a message: ``{"partial": …}`` or ``{"text": …}``."""
    return F.when(kind == "partial", F.to_json(F.struct(text.alias("partial")))).otherwise(
        F.to_json(F.struct(text.alias("text")))
    )


def ordered_messages(messages: DataFrame, lateness: str | None = None) -> DataFrame:
    """A message stream without repeats of (session, seq), the same for any number of micro-batches.

    Without ``lateness`` every pair is remembered, in a state store on disk. With it, memory is
    bounded by ``ts``, and messages later than that are dropped.
    """
    if lateness is None:
        return messages.dropDuplicates(["session", "seq"])
    return messages.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["session", "seq"])
