"""Prompts from search hits, hypothetical documents, and answers by an injected language model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The message without hits, the mark before the trailer, and the labels in hit_text.
NOTHING = "No relevant data found."
TRAILER = "<|DOCS_JSON|>"
TEMPLATE = "Answer the question from the data below. If the data does not answer it, say so.\n\nData:\n{data}\n\nQuestion: {query}"
Generate = Callable[[str], str | None]


def hit_text(number: Column) -> Column:
    """One hit as lines: number, file, chunk, what is known of page, section, source and time, and the content."""
    line = lambda label, column: F.when(F.col(column).cast("string") != "", F.concat(F.lit(f"{label}: "), F.col(column).cast("string"), F.lit("\n")))
    known = [F.coalesce(line(label, column), F.lit("")) for label, column in (("Page", "page_number"), ("Section", "section_title"), ("Source URL", "source_url"), ("Indexed", "ingest_date"))]
    return F.concat(
        F.lit("Document "), number.cast("string"), F.lit(":\n"), F.lit("File: "), F.coalesce("file_name", F.lit("N/A")), F.lit("\n"),
        F.lit("Chunk ID: "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("N/A")), F.lit("\n"), *known,
        F.lit("Content: "), F.coalesce("document", F.lit("")), F.lit("\n" + "-" * 80 + "\n"),
    )


def format_hits(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """The hits of each query as one text: ``query_id``, ``data``.

    hits: ``query_id``, ``rank`` (from 0), ``file_name``, ``chunk_id``, ``document`` and, null where unknown,
    ``page_number``, ``section_title``, ``source_url``, ``ingest_date``. A query of ``queries`` without hits gets a
    message in their place.
    """
    parts = hits.select("query_id", "rank", hit_text(F.col("rank") + 1).alias("part"))
    texts = parts.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda p: p["part"]), "").alias("data"))
    if queries is None:
        return texts
    return queries.select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce("data", F.lit(NOTHING)).alias("data"))


def fill(data: Column, query: Column, template: str = TEMPLATE) -> Column:
    """The template with ``{data}`` and ``{query}`` filled in; braces inside either stay as they are."""
    parts, rest = [], template
    while rest:
        at = {name: rest.find("{" + name + "}") for name in ("data", "query")}
        at = {name: i for name, i in at.items() if i >= 0}
        if not at:
            parts.append(F.lit(rest))
            break
        name = min(at, key=at.get)
        parts += [F.lit(rest[: at[name]]), data if name == "data" else query]
        rest = rest[at[name] + len(name) + 2 :]
    return F.concat(*parts)


def fill_text(data: str, query: str, template: str = TEMPLATE) -> str:
    """``fill`` for one prompt, on the driver."""
    left, name, right = (template.partition("{data}")) if template.find("{data}") <= template.find("{query}") or "{query}" not in template else template.partition("{query}")
    values = {"{data}": data, "{query}": query}
    other = "{query}" if name == "{data}" else "{data}"
    return left + values.get(name, "") + right.replace(other, values[other], 1)


def hypothetical(query: str, generate: Generate | None, limit: int = 200) -> str | None:
    """A made-up passage that would answer the query, to be embedded in its place; None where there is none."""
    if generate is None:
        return None
    try:
        return generate(f"Write a passage of at most {limit} tokens that answers this question as a document would: {query}") or None
    except Exception:  # noqa: BLE001  any failure of a service means: search with the query
        return None


class Responder:
    """A language model behind ``stream``, which gives the pieces of its answer to a prompt.

    ready: called once before the first prompt, to fetch or check the model.
    """

    def __init__(self, stream: Callable[[str], Iterable[str]], template: str = TEMPLATE, ready: Callable[[], None] | None = None):
        self.stream, self.template, self.ready = stream, template, ready

    def chunks(self, data: str, query: str) -> Iterator[str]:
        """The pieces of the answer to ``query`` from ``data``."""
        if self.ready:
            ready, self.ready = self.ready, None
            ready()
        yield from answer(fill_text(data, query, self.template), self.stream)

    def respond(self, data: str, query: str) -> str:
        return "".join(self.chunks(data, query))


def answer(prompt: str, stream: Callable[[str], Iterable[str]]) -> Iterator[str]:
    """The pieces of a model's answer, empty ones left out."""
    yield from (piece for piece in stream(prompt) if piece)


def chat(query: str, hits: list[dict], data: str, stream: Callable[[str], Iterable[str]], template: str = TEMPLATE, hyde: str | None = None, hyde_requested: bool = False, hybrid: bool = False, log: Callable[[str, str], None] | None = None) -> Iterator[str]:
    """Streams the answer, then a trailer with the documents used; logs the exchange once all is sent.

    hits: dictionaries without distances, as they go to the trailer. A failing model ends the text with its error; the
    trailer still follows.
    """
    if not query.strip():
        raise ValueError("the query is empty")
    said = []
    try:
        for piece in answer(fill_text(data, query, template), stream):
            said.append(piece)
            yield piece
    except Exception as e:  # noqa: BLE001
        said.append(f"\n[Error: {e}]")
        yield said[-1]
    yield TRAILER + json.dumps({"docs": hits, "hyde_doc": hyde, "hyde_requested": hyde_requested, "hybrid_used": hybrid})
    if log:
        log(query, "".join(said))


def append_log(spark: SparkSession, path: str, query: str, response: str, now: datetime | None = None) -> None:
    """Adds one exchange to the chat log, a Parquet table of ``timestamp``, ``user_query``, ``response``."""
    rows = [(now or datetime.now(timezone.utc), query, response)]
    spark.createDataFrame(rows, "timestamp timestamp, user_query string, response string").coalesce(1).write.mode("append").parquet(path)


def log_summary(log: DataFrame) -> DataFrame:
    """The chat log with query and response cut to 50 characters."""
    return log.select("timestamp", F.substring("user_query", 1, 50).alias("query"), F.substring("response", 1, 50).alias("response"))
