"""Shared pieces of the corpus operators: lineage cuts, Arrow batches, column names, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; where that is unset, the context's, or in local mode a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc._jsc.sc().getCheckpointDir()
        if folder.isDefined():
            folder = folder.get()
        elif sc.master.startswith("local"):
            folder = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared checkpoint folder: a lost executor costs no recomputation beyond it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that clashes with no column of ``df`` (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (``a``, ``b``, long): rows ``node``, ``root``, the smallest node reachable.

    Alternating large-star and small-star steps: the number of edges never grows, each step is two shuffles with
    map-side minima, and nothing is collected. Each round is a table in the shared checkpoint folder; the one before is
    deleted, and its shuffles are released. Nulls and self loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit(0xFFFFFFFF)))).first())

    def stars(now: DataFrame) -> DataFrame:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        return small.select("e.a", "e.b").where("a > b").distinct()

    now, path = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = digest(now)
    for _ in range(rounds):
        if not before[0]:
            break
        new, to = stored(stars(now))
        discard(spark, path)
        release(spark)
        now, path, after = new, to, digest(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``df`` as a Parquet table in the shared checkpoint folder, read back, and the table's path."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``stored`` made."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that are no longer referred to, which Spark does when the driver's memory is collected."""
    spark.sparkContext._jvm.System.gc()
