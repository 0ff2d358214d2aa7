"""What the corpus operators share: durable tables, stable row spreading, small numeric helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; tests set it, a cluster must."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    A lost executor then costs a re-read only, and several branches read the files instead of each
    repeating the work. The write is atomic per task, so what was drawn from it stays the same.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Remove the files behind tables that ``stored`` wrote, once all that reads them has been stored too."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held_out(key: str | Column) -> Column:
    """True where crc32 of the id as text leaves no rest by 5; such rows are never learned from."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def uniform(*cols: str | Column) -> Column:
    """A number in [0, 1) that depends on the given columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """The named columns of every batch as Python lists."""
    for batch in batches:
        yield [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def in_order(part_cols: list[str], partitions: int, df: DataFrame, *sort: str | Column) -> DataFrame:
    """Rows of a key side by side, for operators that stream over sorted partitions."""
    return df.repartition(partitions, *part_cols).sortWithinPartitions(*part_cols, *sort)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
