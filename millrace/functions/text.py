"""Text expressions. All are built-in column functions that stay in the JVM."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it; Java's plain \s misses some.
SPACE = r"(?U)[\s\x1c-\x1f]"
SENTENCE_END = r"(?<=[.!?])\s+"
WORDS_TO_TOKENS = 1.33


def strip(text: Column) -> Column:
    """``text`` without white space at either end; null stays null."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def sentences(text: Column) -> Column:
    """The sentences of a text: cut at white space after ``.``, ``!`` or ``?``, blank ones dropped; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: ~is_blank(s))


def tokens(text: Column) -> Column:
    """Search tokens: lower-cased runs of non-space; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    """About how many model tokens a text has: its words times 1.33, cut to whole, at least 1."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda t: t != "")
    return F.greatest(F.lit(1), (F.size(words) * F.lit(WORDS_TO_TOKENS)).cast("int"))


def newlines_to_spaces(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, in hexadecimal."""
    return F.sha2(content, 256)


def config_fingerprint(params: dict) -> str:
    """Eight hexadecimal digits of the MD5 of the parameters as JSON with sorted keys."""
    return hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()[:8]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dot and what follows it in the base name, lower-cased; ``(no ext)`` without one or for dot-files."""
    found = F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.when(F.length(found) > 0, F.lower(found)).otherwise("(no ext)")


def chunk_name(file_name: Column, number: Column) -> Column:
    return F.concat(file_name, F.lit("_chunk_"), number.cast("string"))


def shortened(text: Column, length: int = 50) -> Column:
    return F.substring(text, 1, length)


def counted(n: Column, noun: str) -> Column:
    """``1 file``, ``2 files``."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, noun).otherwise(f"{noun}s"))


def shown_time(time: Column) -> Column:
    """A timestamp to the second, or a dash."""
    return F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit("—"))


def row_prose(columns: dict[str, Column], header: bool = True) -> Column:
    """A row as a sentence: ``name: value, name: value.``

    With a header, blank and null values are left out, so an all-blank row gives ``.``; without one, the labels are
    ``col_0`` and so on, and blank values stay.
    """
    parts = []
    for i, (name, value) in enumerate(columns.items()):
        text = strip(value.cast("string"))
        if header:
            parts.append(F.when(text != "", F.concat(F.lit(f"{name}: "), text)))
        else:
            parts.append(F.concat(F.lit(f"col_{i}: "), F.coalesce(text, F.lit(""))))
    return F.concat(F.concat_ws(", ", *parts), F.lit("."))


def table_text(rows: Column) -> Column:
    """A table (array of rows of cells) as lines between pipes, with a rule under the first of several.

    Rows without a non-blank cell go; cells are stripped, null ones empty; nothing left gives an empty text.
    """
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    full = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.transform(F.get(full, 0), lambda c: F.lit("---")))
    lines = F.transform(full, line)
    return F.when(F.size(full) > 1, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(full))), "\n")).when(F.size(full) == 1, F.get(lines, 0)).otherwise("")
