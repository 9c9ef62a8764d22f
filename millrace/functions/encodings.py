"""Exact token counts by a byte-pair encoding."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A worker's encodings by file: tasks that run in it one after the other share them.
KEPT: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """The encoding of a file of ranks (a token in base 64 and its number a line), made once a process."""
    import tiktoken

    if path not in KEPT:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        KEPT[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return KEPT[path]


def exact_counts(find: Callable[[], tuple[str, str]], most: int = 200_000) -> Callable[[Column], Column]:
    """Counts the tokens of each text of an array column, exactly as the encoding splits that text.

    find: called on the executors, gives the file of ranks and the pattern that splits texts into words. Texts are encoded
    as they are, names of special tokens like any text; null texts have none, a null array gives null. Texts of up to
    ``most`` characters are encoded at a time.
    """

    def counts(texts: Column) -> Column:
        @F.arrow_udf("array<int>")
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = encoding(*find())
            for column in columns:
                sizes, held, waiting, texts = array("i"), 0, [], column.flatten()
                for at in range(0, len(texts), 1000):
                    for text in texts.slice(at, 1000).to_pylist():
                        waiting.append(text or "")
                        held += len(waiting[-1])
                        if held >= most:
                            sizes.extend(map(len, known.encode_ordinary_batch(waiting, num_threads=1)))
                            held, waiting = 0, []
                sizes.extend(map(len, known.encode_ordinary_batch(waiting, num_threads=1)))
                ends = pa.array([0, *column.value_lengths().fill_null(0).to_pylist()], pa.int64()).to_numpy().cumsum()
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sizes, pa.int32()))

        return F.when(texts.isNotNull(), run(texts))

    return counts
