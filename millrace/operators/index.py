"""Incremental index: what changed, new chunks, and collections kept as a log of Parquet tables with a manifest."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.functions import boundaries
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import chunking, keywords, search
from millrace.operators.embedding_cache import EmbeddingCache
from millrace.operators.tables import Log, Table, Version

CHUNKS = "collection string, id string, document string, embedding array<double>, file_name string, path string, chunk_id int, ingest_date timestamp, source_url string, page_number int, section_title string"
MANIFEST = "collection string, path string, hash string, config_fingerprint string, chunk_ids array<string>, indexed_at timestamp"


def fingerprint(s: Settings) -> str:
    """The fingerprint of everything that changes chunks or vectors; the model counts too."""
    return T.config_fingerprint(
        {
            "chunking_method": s.chunking_method, "chunk_size": s.chunk_size, "overlap_size": s.overlap_size,
            "semantic_breakpoint_percentile": s.semantic_breakpoint_percentile, "semantic_buffer_size": s.semantic_buffer_size,
            "semantic_max_chunk_sentences": s.semantic_max_chunk_sentences, "token_chunk_size": s.token_chunk_size,
            "token_chunk_overlap": s.token_chunk_overlap, "token_encoding": s.token_encoding, "model": s.embedding_model,
        }
    )


def stale(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries whose file is gone."""
    return manifest.join(files.select("path").distinct(), "path", "left_anti")


def file_status(files: DataFrame, manifest: DataFrame, config: Column) -> DataFrame:
    """``files`` (``path``, ``hash``) with ``status``: ``new``, ``updated`` or ``skipped``.

    A file is up to date if its manifest entry has its hash and the current configuration; nulls never are.
    """
    known = manifest.select("path", F.col("hash").alias("_hash"), F.col("config_fingerprint").alias("_config"), F.lit(True).alias("_known"))
    same = (F.col("hash") == F.col("_hash")) & (F.col("_config") == config)
    status = F.when(F.col("_known").isNull(), "new").when(F.coalesce(same, F.lit(False)), "skipped").otherwise("updated")
    return files.join(known, "path", "left").withColumn("status", status).drop("_hash", "_config", "_known")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("collection", "id")) -> DataFrame:
    """``old`` without the keys that ``new`` has, and ``new``; of repeated keys in ``new`` any one row stays."""
    one = new.dropDuplicates(list(keys))
    return old.join(one.select(*keys), list(keys), "left_anti").unionByName(one)


def delete(old: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("collection", "id")) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def manifest_entries(chunks: DataFrame, files: DataFrame, config: Column, now: Column) -> DataFrame:
    """A manifest row per file (``collection``, ``path``, ``hash``) with its chunks' ids in order, empty without any."""
    ids = chunks.groupBy("collection", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "id"))), lambda c: c["id"]).alias("chunk_ids"))
    rows = files.select("collection", "path", "hash").join(ids, ["collection", "path"], "left")
    return rows.select("collection", "path", "hash", config.alias("config_fingerprint"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), now.alias("indexed_at"))


def build_chunks(records: DataFrame, settings: Settings, collection: str, now: Column, make: Callable[[], V.Embedder] = V.HashEmbedder, urls: DataFrame | None = None, counts: Callable[[Column], Column] | None = None) -> DataFrame:
    """``chunk_rows`` with their vectors."""
    rows = chunk_rows(records, settings, collection, now, make, urls, counts)
    return rows.withColumn("embedding", V.embed(F.col("document"), make, settings.embedding_batch_size))


def chunk_rows(records: DataFrame, settings: Settings, collection: str, now: Column, make: Callable[[], V.Embedder] = V.HashEmbedder, urls: DataFrame | None = None, counts: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks, without vectors, of sentence ``records`` (``path``, ``idx``, ``text``, ``page_number``, ``section_title``), or of files with theirs as arrays (``path``, ``records``).

    urls: ``path``, ``source_url``. Ids are made of the whole path, so files of one name in two folders stay apart.
    """
    whole = "records" in records.columns
    packed = records.where(F.size("records") > 0) if whole else records.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("idx", "text", "page_number", "section_title"))).alias("records"))
    docs = packed.select("path", F.transform("records", lambda r: r["text"]).alias("sentences"), "records")
    s = settings
    if s.chunking_method == "semantic":
        cut = chunking.create_chunks(docs, "semantic", "sentences", "path", make=make, percentile=s.semantic_breakpoint_percentile, buffer=s.semantic_buffer_size, max_sentences=s.semantic_max_chunk_sentences)
        rows = chunking.first_sentence_metadata(cut, docs, "records", "path")
    else:
        # Chunks take their first sentence's metadata where they are cut: the sentences are not met a second time.
        first = lambda c: F.get("records", F.least(c["first_sentence"], F.size("records") - 1))
        chunks = chunking.chunk_arrays(F.col("sentences"), s.chunking_method, s.chunk_size, s.overlap_size, s.token_chunk_size, s.token_chunk_overlap, counts)
        rows = docs.select("path", F.inline(F.transform(chunks, lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"), first(c)["page_number"].alias("page_number"), first(c)["section_title"].alias("section_title")))))
    if urls is not None:
        rows = rows.join(urls.select("path", F.nullif("source_url", F.lit("")).alias("source_url")), "path", "left")
    else:
        rows = rows.withColumn("source_url", F.nullif(F.lit(s.source_url), F.lit("")))
    return rows.select(
        F.lit(collection).alias("collection"), T.chunk_name(F.col("path"), F.col("chunk_id")).alias("id"), F.col("text").alias("document"),
        T.base_name(F.col("path")).alias("file_name"), "path", "chunk_id",
        now.alias("ingest_date"), "source_url", "page_number", "section_title",
    )


#: What a store holds: chunks and the manifest of their files, and the keyword index.
TABLES = {"chunks": Table(CHUNKS, ("collection",), ("id",)), "manifest": Table(MANIFEST, ("collection",), ("path",)), **keywords.TABLES}
KINDS = {"id": ("collection", "id"), "path": ("collection", "path")}


class Store:
    """Collections below a folder, kept as a log of changes (``tables.Log``).

    Adding a file writes what the file has; readers see a version as a whole and keep it while others write. indexed:
    every change also brings the stored keyword index up to date. number: reads are of that version, not of the latest.
    """

    def __init__(self, spark: SparkSession, root: str, indexed: bool = False, number: int | None = None):
        self.spark, self.root, self.indexed, self.number = spark, root.rstrip("/"), indexed, number
        self.log = Log(spark, root, TABLES, KINDS)

    def at(self, number: int) -> Store:
        """The store as of an older version."""
        return Store(self.spark, self.root, self.indexed, number)

    def now(self) -> Version:
        return self.log.version(self.number)

    def version(self) -> int | None:
        return self.now().number or None

    def table(self, name: str, collection: str | None, version: Version | None) -> DataFrame:
        found = self.log.read(name, version or self.now())
        return found if collection is None else found.where(F.col("collection") == collection)

    def chunks(self, collection: str | None = None, version: Version | None = None) -> DataFrame:
        return self.table("chunks", collection, version)

    def manifest(self, collection: str | None = None, version: Version | None = None) -> DataFrame:
        return self.table("manifest", collection, version)

    def collections(self) -> DataFrame:
        version = self.now()
        return self.manifest(version=version).select("collection").union(self.chunks(version=version).select("collection")).distinct()

    def exists(self, collection: str) -> bool:
        return not self.collections().where(F.col("collection") == collection).isEmpty()

    def open(self, collection: str) -> DataFrame:
        if not self.exists(collection):
            raise ValueError(f"no such collection: {collection}")
        return self.chunks(collection)

    def put(self, since: Version, chunks: DataFrame | None = None, removed: DataFrame | None = None, replaced: DataFrame | None = None, entries: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """One change on top of a version, as the next one.

        chunks: rows to add; of rows there already, those of the same id must be among ``removed``. removed:
        (``collection``, ``id``) of chunks to go; replaced: (``collection``, ``path``) of manifest entries to go; entries:
        makes the new manifest entries from the chunks as stored. Refused with ``Conflict`` if the version is no longer the latest.
        """
        with self.log.change(since) as change:
            empty = self.spark.createDataFrame([], CHUNKS)
            stored = empty if chunks is None else change.add("chunks", chunks)
            gone = None
            if removed is not None and since.parts:
                keys = change.remove("id", removed)
                gone = self.chunks(version=since).join(keys, ["collection", "id"], "left_semi")
            if self.indexed:
                keywords.update(change, stored, gone)
            if replaced is not None and since.parts:
                change.remove("path", replaced)
            if entries is not None:
                change.add("manifest", entries(stored))
        return change.base.number + 1

    def upsert(self, chunks: DataFrame) -> int:
        """Adds chunks; those of the same collection and id are replaced. Of repeated ids one row stays."""
        one = chunks.dropDuplicates(["collection", "id"])
        return self.put(self.now(), one, one.select("collection", "id"))

    def delete(self, keys: DataFrame) -> int:
        """Removes the chunks of these keys (``collection``, ``id``)."""
        return self.put(self.now(), removed=keys)

    def drop(self, collection: str, confirm: str) -> None:
        """Removes a collection with its manifest; ``confirm`` must repeat its name."""
        if confirm != collection:
            raise ValueError("the confirmation does not match the collection's name")
        if not self.exists(collection):
            raise ValueError(f"no such collection: {collection}")
        with self.log.change(self.now()) as change:
            change.clear(collection)

    def compact(self, whole: bool = False) -> int | None:
        return self.log.compact(whole)

    def vacuum(self, keep: int = 1, grace: float = 3600) -> int:
        return self.log.vacuum(keep, grace)

    def keywords(self, collection: str) -> keywords.Keywords:
        return keywords.Keywords(self.log, collection, self.now())

    def search(self, queries: DataFrame, collection: str, n: int = 5, hybrid: bool = False, candidates: int = 3, k: int = 60, metric: str = "l2", make: Callable[[], V.Embedder] = V.HashEmbedder, places: int | None = None) -> DataFrame:
        """The hits for ``queries`` as ``search.search`` ranks them, with what is stored of them: ``query_id``, ``rank``, ``id``,
        ``distance`` (and ``score`` with ``hybrid``), ``document``, ``file_name``, ``path``, ``chunk_id``, ``ingest_date``,
        ``source_url``, ``page_number``, ``section_title``. Keywords are looked up in the stored index where there is one."""
        chunks, words = self.open(collection), None
        if hybrid and self.indexed:
            words = lambda asked, wide: self.keywords(collection).top(asked, wide, places=places)
        hits = search.search(queries, chunks, n, hybrid, candidates, k, metric, make, places=places, keywords=words)
        return hits.join(chunks.drop("collection", "embedding"), "id")


def refresh(store: Store, files: DataFrame, read: Callable[[DataFrame], DataFrame], collection: str, settings: Settings = Settings(), make: Callable[[], V.Embedder] = V.HashEmbedder, now: datetime | None = None, urls: DataFrame | None = None, model: DataFrame | None = None, counts: Callable[[Column], Column] | None = None, cache: EmbeddingCache | None = None) -> dict[str, int]:
    """Brings a collection up to date with ``files`` (``path``, ``content``) and says what was done.

    read: gives the blocks of files (as ``sources.files.read_blocks``). Only new and changed files are read; chunks of
    gone files go. New rows are built before old ones are dropped, and a file that cannot be read keeps the chunks and
    the entry it had. An unchanged folder writes nothing. model: learnt sentence boundaries (``boundaries.learn``), of
    which those of ``settings.data_language`` hold. counts: exact token counts by the encoding ``settings.token_encoding``.
    cache: chunks take their vectors from it, by its model, and only texts that it does not know are embedded.
    """
    from millrace.sources.files import sentence_arrays

    at = F.lit(now or datetime.now(UTC))
    config, since = F.lit(fingerprint(settings)), store.now()
    hashed = files.select("path", "content", T.content_hash(F.col("content")).alias("hash"))
    mine = store.manifest(collection, since)
    status = file_status(hashed.select("path", "hash"), mine, config).cache()
    by_status = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    gone = stale(mine, hashed)
    n_gone = gone.count()
    todo = status.where("status <> 'skipped'")
    summary = {"new": by_status.get("new", 0), "updated": by_status.get("updated", 0), "skipped": by_status.get("skipped", 0), "failed": 0, "removed": n_gone}
    if not n_gone and not summary["new"] and not summary["updated"]:
        status.unpersist()
        return summary
    # Contents are not shuffled to be met with a list of paths of a known length.
    listed = todo.select("path")
    listed = F.broadcast(listed) if summary["new"] + summary["updated"] <= 1_000_000 else listed
    blocks = read(hashed.join(listed, "path", "left_semi").select("path", "content")).cache()
    failed = blocks.where("kind = 'error'").select("path").distinct()
    bad = {r["status"]: r["count"] for r in todo.join(failed, "path", "left_semi").groupBy("status").count().collect()}
    for kind, n in bad.items():
        summary[kind] -= n
        summary["failed"] += n
    done = todo.join(failed, "path", "left_anti").select(F.lit(collection).alias("collection"), "path", "hash")
    cut = T.sentences if model is None else boundaries.rule(model, settings.data_language)
    records, made = sentence_arrays(blocks, cut), None
    if cache is None:
        new = build_chunks(records, settings, collection, at, make, urls, counts)
    else:
        made = chunk_rows(records, settings, collection, at, make, urls, counts).cache()
        new = cache.embedded(made, "document")
    replace(store, since, new, done, gone.select(F.lit(collection).alias("collection"), "path"), config, at)
    status.unpersist()
    blocks.unpersist()
    if made is not None:
        made.unpersist()
    return summary


def replace(store: Store, since: Version, new: DataFrame, done: DataFrame, gone: DataFrame, config: Column, at: Column) -> int:
    """Commits the chunks ``new`` of the files ``done`` (``collection``, ``path``, ``hash``) in place of what these files and
    those ``gone`` (``collection``, ``path``) had. Only what the manifest lists is removed, so a new file removes nothing."""
    known = store.manifest(version=since)
    replaced = known.join(done.select("collection", "path").union(gone.select("collection", "path")).distinct(), ["collection", "path"], "left_semi")
    ids = replaced.select("collection", F.explode("chunk_ids").alias("id"))
    return store.put(since, new, ids, replaced.select("collection", "path"), lambda stored: manifest_entries(stored, done, config, at))
