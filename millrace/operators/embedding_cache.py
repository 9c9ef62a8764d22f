"""Embeddings kept by content: a text that a model has seen, in whatever file or collection, is not embedded again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.operators.tables import Conflict, Log, Table, Version

TABLES = {"vectors": Table("model string, key string, embedding array<double>", ("model",))}


class EmbeddingCache:
    """Vectors of distinct texts below a folder, by the model's name and the SHA-256 of the text.

    model: names the embedder that ``make`` builds, and everything else that changes its vectors; a worker process builds
    it once. A null text is an empty one. Several writers may share a folder: what one could not commit because another
    was first is worked out again only as far as the other has not brought it.
    """

    def __init__(self, spark: SparkSession, root: str, model: str, make: Callable[[], V.Embedder] = V.HashEmbedder, batch: int = 64, flatten_newlines: bool = False):
        self.model, self.make, self.batch, self.flatten = model, make, batch, flatten_newlines
        self.log = Log(spark, root, TABLES, {}, "model")

    def key(self, text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        return F.sha2(F.replace(text, F.lit("\n"), F.lit(" ")) if self.flatten else text, 256)

    def known(self, version: Version | None = None) -> DataFrame:
        """``key``, ``embedding``: a row for each text embedded by this model so far."""
        return self.log.read("vectors", version).where(F.col("model") == self.model).select("key", "embedding").dropDuplicates(["key"])

    def add(self, rows: DataFrame, text: str = "text", tries: int = 5) -> int:
        """Embeds those texts of ``rows`` that are not known yet, each distinct one once, and returns the number of the version that has all.

        Copies are made one before the shuffle, so a text that many rows share is no large group. Nothing is written
        where all are known.
        """
        asked = rows.select(self.key(F.col(text)).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
        for _ in range(tries):
            since = self.log.version()
            new = asked.join(self.known(since), "key", "left_anti") if since.parts else asked
            vector = V.embed(F.col("text"), self.make, self.batch, self.flatten, self.model)
            change = self.log.change(since)
            if change.put("vectors", new.select(F.lit(self.model).alias("model"), "key", vector.alias("embedding")), TABLES["vectors"].folders) is None:
                change.abort()
                return since.number
            try:
                return change.commit()
            except Conflict:
                continue
        raise Conflict(f"other writers were first {tries} times")

    def embedded(self, rows: DataFrame, text: str = "text", into: str = "embedding") -> DataFrame:
        """``rows`` with their vectors in the column ``into``; they are read twice, once for what is new and once for the result.

        Vectors are met by the text's hash; the rows of one text, however many, are split by adaptive execution.
        """
        known = self.known(self.log.version(self.add(rows, text)))
        key, vector = "_key_of_embedding_cache", "_vector_of_embedding_cache"
        met = rows.withColumn(key, self.key(F.col(text))).join(known.select(F.col("key").alias(key), F.col("embedding").alias(vector)), key)
        return met.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() != into.lower()], F.col(vector).alias(into))

    def compact(self) -> int | None:
        return self.log.compact()

    def vacuum(self, keep: int = 1, grace: float = 3600) -> int:
        return self.log.vacuum(keep, grace)
