"""Results kept in the shared folder, and global row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.storage import Folder, shared_folder


def kept(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: worked out once, and not again for a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``kept`` gave, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        Folder(df.sparkSession, folder).delete("")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, its rows' numbers from 0 in an order, without passing all through one task.

    Rows are dealt out by range and kept; a row's number is its place in its partition after the rows of the partitions
    before. The partitions' sizes alone are brought together.
    """
    dealt = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place - 1).drop("_part", "_before")
