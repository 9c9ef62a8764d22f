"""New files as a stream that refreshes a collection. Deletions are not seen by a stream; ``refresh`` handles them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.config import Settings
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import index
from millrace.sources.files import EXTENSIONS, read_blocks, sentence_records

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, store: index.Store, collection: str, checkpoint: str, settings: Settings = Settings(), read: Callable[[DataFrame], DataFrame] = read_blocks, extensions: tuple[str, ...] = EXTENSIONS, make: Callable[[], V.Embedder] = V.HashEmbedder, urls: DataFrame | None = None) -> StreamingQuery:
    """Indexes the files that are there and those that come, each micro-batch as one version of the store.

    The query ends once all files present are done (trigger available-now); started again with the same checkpoint it
    takes up the files that came since. A batch that is repeated after a failure gives the same rows. make: builds the
    embedder that ``settings.embedding_model`` names, as for ``index.refresh``; urls: ``path``, ``source_url``.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).load(folder)
    wanted = files.where(F.col("path").rlike(r"\.(" + "|".join(extensions) + ")$"))

    def take(batch: DataFrame, _: int) -> None:
        hashed = batch.select("path", "content", T.content_hash(F.col("content")).alias("hash"))
        since = store.now()
        config, at = F.lit(index.fingerprint(settings)), F.lit(datetime.now(UTC))
        todo = index.file_status(hashed.select("path", "hash"), store.manifest(collection, since), config).where("status <> 'skipped'")
        if todo.isEmpty():
            return
        blocks = read(hashed.join(todo.select("path"), "path", "left_semi").select("path", "content")).cache()
        failed = blocks.where("kind = 'error'").select("path").distinct()
        done = todo.join(failed, "path", "left_anti").select(F.lit(collection).alias("collection"), "path", "hash")
        new = index.build_chunks(sentence_records(blocks), settings, collection, at, make, urls)
        index.replace(store, since, new, done, done.select("collection", "path").limit(0), config, at)
        blocks.unpersist()

    return wanted.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
