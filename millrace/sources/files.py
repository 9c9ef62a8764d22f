"""Files of several formats as rows of sentences, with page numbers and section titles where the format has them."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from millrace.functions import text as T
from millrace.sources import markup

EXTENSIONS = ("txt", "pdf", "docx", "md", "html", "htm", "csv")
FOUND = "path string, kind string, page_number int, section_title string, pos int, block string"
#: A page reader for PDF files, bytes to (page number from 1, kind "prose" or "table", text); none comes with the package.
PageReader = Callable[[bytes], Iterator[tuple[int, str, str]]]


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The files below ``root`` whose name ends with one of the extensions, in that case: ``path``, ``content``, more."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(F.col("path").rlike(r"\.(" + "|".join(extensions) + ")$"))


def csv_prose(text: str, delimiter: str = ",", header: bool = True, most: int | None = None) -> str:
    """Rows of a CSV text as sentences, a line each; rows of more fields than the header make the file unreadable.

    Without a header a blank line is a row without fields, a lone full stop; with one it is no row.
    """
    out = []
    if header:
        for row in csv.DictReader(io.StringIO(text), delimiter=delimiter):
            if None in row:
                raise ValueError("a row has more fields than the header")
            parts = [f"{k}: {v.strip()}" for k, v in row.items() if v is not None and v.strip()]
            out.append(", ".join(parts) + ".")
            if most is not None and len(out) >= most:
                break
    else:
        for row in csv.reader(io.StringIO(text), delimiter=delimiter):
            out.append(", ".join(f"col_{i}: {v.strip()}" for i, v in enumerate(row)) + ".")
            if most is not None and len(out) >= most:
                break
    return "\n".join(out if most is None else out[:most])


def blocks_of(path: str, content: bytes, read_pages: PageReader | None = None) -> list[tuple[str, int | None, str | None, str]]:
    """(kind, page, section, text) of a file's blocks; kind ``split`` is to be cut in sentences, ``whole`` is not.

    Text must be UTF-8 (a bad byte fails the file); HTML, Markdown and CSV take replacement characters. Raises
    ValueError for other extensions.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "txt":
        return [("split", None, None, content.decode())]
    if kind in ("html", "htm"):
        return [("split", None, s, t) for s, t in markup.html_blocks(content.decode(errors="replace"))]
    if kind == "md":
        return [("split", None, s, t) for s, t in markup.markdown_blocks(content.decode(errors="replace"))]
    if kind == "docx":
        return [("split", None, s, t) for s, t in markup.docx_blocks(content)]
    if kind == "csv":
        return [("whole", None, None, line) for line in csv_prose(content.decode(errors="replace")).splitlines()]
    if kind == "pdf":
        if read_pages is None:
            raise ValueError("no reader for PDF files is installed")
        return [("whole" if k == "table" else "split", page, None, t) for page, k, t in read_pages(content)]
    raise ValueError(f"unsupported file type: {path}")


def plain_text(path: str, content: bytes, read_pages: PageReader | None = None) -> str:
    """A whole file as one text, without pages and sections; paragraphs, pages and rows are lines.

    HTML becomes its visible text with white space collapsed, Markdown that of its headings and paragraphs.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("html", "htm"):
        return markup.html_text(content.decode(errors="replace"))
    if kind == "docx":
        return "\n".join(t for _, t in markup.docx_paragraphs(content) if t.strip())
    if kind == "md":
        return markup.markdown_text(content.decode(errors="replace"))
    return "\n".join(t for _, _, _, t in blocks_of(path, content, read_pages))


def read_plain(files: DataFrame, read_pages: PageReader | None = None) -> DataFrame:
    """``files`` (``path``, ``content``) as ``path``, ``text`` and ``error``: one of the two is null."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for path, content in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                try:
                    row = path, plain_text(path, content or b"", read_pages), None
                except Exception as e:  # noqa: BLE001  one bad file must not end the run
                    row = path, None, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def read_blocks(files: DataFrame, read_pages: PageReader | None = None) -> DataFrame:
    """The blocks of ``files`` (``path``, ``content``): ``path``, ``kind``, ``page_number``, ``section_title``, ``pos``, ``block``.

    A file that cannot be read gives one row of kind ``error`` with the message, so callers can tell it from an empty one.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for path, content in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                try:
                    found = blocks_of(path, content or b"", read_pages)
                except Exception as e:  # noqa: BLE001  one bad file must not end the run
                    found = [("error", None, None, str(e))]
                rows = [(path, k, p, s, i, t) for i, (k, p, s, t) in enumerate(found)]
                for at in range(0, len(rows), 5000):
                    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000]), types)], names=["path", "kind", "page_number", "section_title", "pos", "block"])

    return files.select("path", "content").mapInArrow(run, FOUND)


def sentence_records(blocks: DataFrame, sentences: Callable[[Column], Column] = T.sentences) -> DataFrame:
    """A row per sentence, numbered within its file: ``path``, ``idx``, ``text``, ``page_number``, ``section_title``.

    sentences: cuts a block (``boundaries.rule`` gives the one of a language learnt from a corpus).
    """
    return sentence_arrays(blocks, sentences).select("path", F.posexplode("records").alias("idx", "r")).select("path", "idx", "r.text", "r.page_number", "r.section_title")


def sentence_arrays(blocks: DataFrame, sentences: Callable[[Column], Column] = T.sentences) -> DataFrame:
    """A row per file with the sentences of ``sentence_records`` in order: ``path``, ``records`` (``text``, ``page_number``, ``section_title``)."""
    per = F.when(F.col("kind") == "split", sentences(F.col("block"))).otherwise(F.filter(F.array("block"), lambda b: ~T.is_blank(b)))
    rows = blocks.where("kind <> 'error'").select("path", "pos", F.transform(per, lambda s: F.struct(s.alias("text"), F.col("page_number"), F.col("section_title"))).alias("records"))
    return rows.groupBy("path").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "records"))), lambda r: r["records"])).alias("records"))


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """The sidecars below ``root``, see ``sidecars_of``."""
    return sidecars_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))


def sidecars_of(files: DataFrame) -> DataFrame:
    """Metadata kept beside files as ``name.meta.json``: ``path`` of the file, ``meta`` (map). Bad ones give empty maps."""
    found = files.where(F.col("path").endswith(".meta.json"))
    parsed = F.try_parse_json(F.col("content").cast("string"))
    fields = F.from_json(F.col("content").cast("string"), "map<string,string>")
    return found.select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.when(parsed.isNotNull(), F.coalesce(fields, F.create_map().cast("map<string,string>"))).otherwise(F.create_map().cast("map<string,string>")).alias("meta"))


def source_url(meta: Column, default: str = "") -> Column:
    """The sidecar's ``source_url`` if it names one, else the default; an empty one is null."""
    given = F.when(F.map_contains_key(F.coalesce(meta, F.create_map().cast("map<string,string>")), "source_url"), F.coalesce(meta["source_url"], F.lit(""))).otherwise(F.lit(default))
    return F.nullif(given, F.lit(""))


def html_text(pages: Column, open_references: bool = True) -> Column:
    """The visible text of pages, as ``markup.html_text`` gives it."""

    @F.arrow_udf(StringType())
    def run(found: pa.Array) -> pa.Array:
        return pa.array([markup.html_text(p, open_references) for p in found.to_pylist()], pa.string())

    return run(pages)


@F.arrow_udf(ArrayType(StructType([StructField("section", StringType()), StructField("text", StringType())])))
def html_blocks(pages: pa.Array) -> pa.Array:
    """The blocks of pages with their sections."""
    return pa.array([[{"section": s, "text": t} for s, t in markup.html_blocks(p)] for p in pages.to_pylist()], pa.list_(pa.struct([("section", pa.string()), ("text", pa.string())])))
