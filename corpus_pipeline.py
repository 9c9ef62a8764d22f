"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Rows with a null id pass the stages like others but are never taken for one another's copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, fresh, stored
from millrace.llm.decontamination import contaminated, find_contamination
from millrace.llm.lines import dedup_lines
from millrace.llm.neardup import near_components
from millrace.llm.packing import pack_documents, word_bpe
from millrace.llm.quality import fit_quality, score_quality

#: Documents that score less go.
LEAST_QUALITY = 0.7


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not among ``ids``; rows with a null id stay."""
    return docs.join(ids.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of documents that are there and drops what the classifier rejects."""
    model, score = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh(docs, "_quality")
    return score_quality(docs, model, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated three-line windows; ``n_chars`` follows the text."""
    done = dedup_lines(docs)
    return done.drop(*(c for c in done.columns if c not in docs.columns)).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return without(docs, near_components(docs, 5, (80, 100)).where(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a twentieth or more of the words of are benchmark passages."""
    return without(docs, find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(contaminated()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: a row per piece, with its token ids."""
    return pack_documents(docs, word_bpe)


STAGES = [("quality", quality), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared checkpoint folder and read back."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
