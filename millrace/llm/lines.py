"""Line dedup: repeated windows of three consecutive lines lose their later occurrences. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, let

WINDOW = 3


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every repeated run of ``window`` lines kept at its first occurrence only.

    Lines are what newlines separate in the whole ``text`` (a carriage return stays with its line). A window is
    ``window`` consecutive lines of one document; of equal windows, in the same document or others, all but the first by
    (``doc_id``, position) are covered, and covered lines are removed; windows are judged on the input, overlaps are
    merged. Returns the columns of ``docs`` with the new ``text``, and ``n_lines``, ``n_removed`` and ``n_spans`` (merged
    runs removed), under other names if taken.

    Windows are counted by a 128-bit hash with partial aggregation, and only repeated ones are joined back, so a window
    in a third of all documents is a join with one row on the other side, which adaptive execution splits. A null text
    stays null (0 lines); an empty one has one empty line; shorter texts have no windows. A null id comes before all
    others. Rows equal in id and text count as one document and are treated alike; rows that share an id but not the
    text are ordered by the text's hash.
    """
    id_, th, pos, cid, cth = (fresh(docs, c) for c in ("_id", "_th", "_pos", "_covered_id", "_covered_th"))
    keyed = docs.withColumn(id_, F.col("doc_id")).withColumn(th, F.xxhash64("text"))
    lines = F.split(F.col("text"), "\n", -1)
    windows = let(
        lines,
        lambda x: F.when(
            F.size(x) >= window,
            F.transform(F.sequence(F.lit(0), F.size(x) - window), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(x, i + k) for k in range(window)]).alias("k1"), F.xxhash64(F.lit(7), *[F.get(x, i + k) for k in reversed(range(window))]).alias("k2"))),
        ),
    )
    placed = keyed.where("text is not null").select(F.col(id_).alias("id"), F.col(th).alias("th"), F.inline(windows))
    place = F.struct("id", "th", "pos")
    first = placed.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = placed.join(first, ["k1", "k2"]).where(place > F.col("first"))
    covered = later.groupBy(F.col("id").alias(cid), F.col("th").alias(cth)).agg(F.sort_array(F.collect_set("pos")).alias(pos))
    joined = keyed.join(covered, F.col(id_).eqNullSafe(F.col(cid)) & (F.col(th) == F.col(cth)), "left").drop(cid, cth)
    gone = F.array_distinct(F.flatten(F.transform(F.col(pos), lambda p: F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: p + k))))
    text = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.coalesce(F.get(x, i), F.lit(""))), "\n"))
    n_lines, n_removed, n_spans = (fresh(docs, c) for c in ("n_lines", "n_removed", "n_spans"))
    spans = let(F.col(pos), lambda p: F.size(F.filter(p, lambda v, i: (i == 0) | (v > F.get(p, i - 1) + window))))
    return (
        joined.withColumn(n_lines, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
        .withColumn(n_removed, F.when(F.col(pos).isNull(), 0).otherwise(F.size(gone)))
        .withColumn(n_spans, F.when(F.col(pos).isNull(), 0).otherwise(spans))
        .withColumn("text", F.when(F.col(pos).isNull(), F.col("text")).otherwise(text))
        .drop(id_, th, pos)
    )


def op6_lines(spark, sf_dir: str) -> DataFrame:
    """Line dedup of all documents, with a digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.col("n_spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
