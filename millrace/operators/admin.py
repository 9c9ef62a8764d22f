"""Reports on collections: list, statistics, and their files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T


def list_collections(manifest: DataFrame, chunks: DataFrame, active: str | None = None) -> DataFrame:
    """A row per collection by name: chunks stored, files, time of the last run, its configuration, whether it is active."""
    files = manifest.groupBy("collection").agg(F.count("*").alias("files"), F.max("indexed_at").alias("at"), F.count_distinct("config_fingerprint").alias("configs"), F.min("config_fingerprint").alias("config"))
    stored = chunks.groupBy("collection").agg(F.count("*").alias("chunks"))
    both = stored.join(files, "collection", "full_outer")
    n = F.coalesce("configs", F.lit(0))
    return both.select(
        "collection", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("files", F.lit(0)).alias("files"), T.shown_time(F.col("at")).alias("last_indexed"),
        F.when(n == 1, F.col("config")).otherwise(F.concat(n.cast("string"), F.lit(" mixed"))).alias("fingerprint"), (F.col("collection") == F.lit(active)).alias("active") if active else F.lit(False).alias("active"),
    ).orderBy("collection")


def collection_stats(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row on a collection: chunks, files, chunks per file (average, least, most; 0 without files), configurations."""
    n = F.size("chunk_ids")
    files = manifest.agg(F.count("*").alias("files"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_chunks"), F.coalesce(F.min(n), F.lit(0)).alias("min_chunks"), F.coalesce(F.max(n), F.lit(0)).alias("max_chunks"), F.coalesce(F.sum(n), F.lit(0)).alias("listed_chunks"), F.count_distinct("config_fingerprint").alias("configs"), F.min("config_fingerprint").alias("config"))
    label = F.when(F.col("configs") == 1, F.col("config")).otherwise(F.concat(F.col("configs").cast("string"), F.lit(" distinct (re-index needed)")))
    return files.join(chunks.agg(F.count("*").alias("chunks")), how="cross").select("chunks", "files", "avg_chunks", "min_chunks", "max_chunks", "listed_chunks", label.alias("fingerprint"))


def extension_counts(manifest: DataFrame) -> DataFrame:
    """Files by extension, the most frequent first."""
    return manifest.groupBy(T.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext")


def metadata_keys(chunks: DataFrame, sample: int | None = 200) -> DataFrame:
    """The metadata fields that stored chunks have a value in, by name; ``sample`` rows are looked at, None for all."""
    fields = ("file_name", "chunk_id", "ingest_date", "source_url", "page_number", "section_title")
    rows = chunks.select(*fields)
    rows = rows.limit(sample) if sample is not None else rows
    named = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]), lambda k: k.isNotNull())
    return rows.select(F.explode(named).alias("key")).distinct().orderBy("key")


def inspect_files(manifest: DataFrame, name: str | None = None) -> DataFrame:
    """The files of a collection by name: ``file_name``, ``path``, ``chunks``, ``indexed_at``, and ``chunk_ids`` with ``name``.

    name: shows files whose base name contains it, whatever the case.
    """
    rows = manifest.withColumn("file_name", T.base_name(F.col("path")))
    if name:
        rows = rows.where(F.contains(F.lower("file_name"), F.lit(name.lower())))
    shown = rows.select("file_name", "path", F.size("chunk_ids").alias("chunks"), T.shown_time(F.col("indexed_at")).alias("indexed_at"), *(["chunk_ids"] if name else []))
    return shown.orderBy("file_name", "path")


def footer(files: DataFrame) -> DataFrame:
    """The closing line of an inspection: ``2 files, 7 chunks``."""
    return files.agg(F.count("*").alias("f"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("c")).select(F.concat(T.counted(F.col("f"), "file"), F.lit(", "), T.counted(F.col("c"), "chunk")).alias("total"))


def main(argv: list[str] | None = None) -> int:
    """Command line: ``list``, ``stats``, ``inspect`` and ``delete`` of the collections below a folder."""
    from millrace.operators.index import Store

    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("--store", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for name in ("stats", "inspect", "delete"):
        commands.add_parser(name).add_argument("collection")
    commands.choices["inspect"].add_argument("--file")
    commands.choices["delete"].add_argument("--yes", action="store_true")
    args = parser.parse_args(argv)
    store = Store(SparkSession.builder.getOrCreate(), args.store)
    if args.command == "list":
        list_collections(store.manifest(), store.chunks()).show(1000, False)
        return 0
    if not store.exists(args.collection):
        print(f"no such collection: {args.collection}")
        return 1
    manifest, chunks = store.manifest(args.collection), store.chunks(args.collection)
    if args.command == "stats":
        collection_stats(manifest, chunks).show(1, False)
        extension_counts(manifest).show(1000, False)
        metadata_keys(chunks).show(100, False)
    elif args.command == "inspect":
        files = inspect_files(manifest, args.file)
        files.show(1000, False)
        footer(files).show(1, False)
    else:
        store.drop(args.collection, args.collection if args.yes else input(f"Type {args.collection} to delete it: "))
    return 0
