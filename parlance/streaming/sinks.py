"""A sink for stream output in which a batch counts once, however often it is written.

``OnceSink`` is the function of a ``foreachBatch``. It writes a batch to a folder named by the batch
id, over whatever an earlier attempt left there, and then creates a small file of that name in
``_published``. Creating is the one step that counts: a reader takes published batches only, and an
attempt that finds its batch published changes nothing. Both steps go through Hadoop's file system,
so any shared folder serves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

_PUBLISHED = "_published"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def wire_line(kind: Column, texts: Column) -> Column:
    """One message: ``{"partial": …}`` or ``{"text": …}``; the texts of a list follow each other without a blank."""
    joined = F.concat_ws("", texts)
    return F.when(kind == "partial", F.to_json(F.struct(joined.alias("partial")))).otherwise(F.to_json(F.struct(joined.alias("text"))))


@dataclass(frozen=True)
class OnceSink:
    folder: str

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files, mark = _path(spark, f"{self.folder}/{_PUBLISHED}/{batch_id}")
        if files.exists(mark):
            return
        self.write(batch, batch_id)
        files.create(mark, False).close()

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A writer of ``stream`` into this sink; set a trigger and start it."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).outputMode("append")

    def published(self, spark: SparkSession) -> list[int]:
        files, folder = _path(spark, f"{self.folder}/{_PUBLISHED}")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(folder)) if files.exists(folder) else []

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The rows of all published batches, with their ``batch``."""
        ids = self.published(spark)
        if not ids:
            return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long")).limit(0)
        frame = spark.read.schema(schema).option("basePath", self.folder).parquet(*(f"{self.folder}/batch={i}" for i in ids))
        return frame.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("long"))
