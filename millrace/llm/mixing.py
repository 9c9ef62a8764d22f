"""Mixing of sources to target weights by thresholds on a hash of each document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, fresh, stored

#: Hash digits in all, and those of a histogram: 16 ** 3 buckets a source and level.
DIGITS, LEVEL = 15, 3
WORD = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"{WORD}+")), F.lit(0)).cast("long")


def draw(id_: Column, text: Column) -> Column:
    """A number below 16 ** 15 for an id and a text, the same in every run."""
    key = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, its rows' numbers from 0 in an order, without passing all through one task.

    Rows are dealt out by range and written to the shared folder; a row's number is its place in its partition after the
    rows of the partitions before. The partitions' sizes alone are brought together.
    """
    part, before = fresh(df, "_part"), fresh(df, "_before")
    keys = [F.asc_nulls_last(c) for c in order]
    dealt, _ = stored(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    offsets = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*keys))
    return dealt.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + place - 1).drop(part, before)


def targets(sources: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """``sources`` (``source``, ``source_size``) with ``target``: its share of all sizes by weight, at most ``most`` times its size.

    Sources by code point, null last, have the weights in turn. In each round the sources whose share is over their limit
    stop there and the rest is shared among the others by weight, until none is over it. A round is one aggregate of a
    row a source; nothing but its sums comes to the driver.
    """
    n = F.pmod(F.col("number"), F.lit(len(weights))).cast("int")
    rows, _ = stored(numbered(sources, ["source"], "number").withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), n)))
    limit = (F.col("source_size") * most).cast("double")
    level, full = 0.0, -1
    while True:
        # A source is over its limit at a level if it was at a lower one: levels only rise.
        over = limit < F.col("weight") * level
        sums = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("source_size") * most).otherwise(0)).alias("full"), F.sum(F.when(~over, F.col("weight")).otherwise(0.0)).alias("open"), F.sum(over.cast("long")).alias("n")).first()
        if not sums["all"] or sums["n"] == full or not sums["open"]:
            break
        level, full = (sums["all"] - sums["full"]) / sums["open"], sums["n"]
    return rows.select("source", "source_size", F.least(limit, F.col("weight") * level).alias("target"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(rows: DataFrame, goals: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Where each source's budget ends among its documents in the order of ``draw``.

    rows: ``source``, ``size``, ``draw``; goals: ``source``, ``part`` (words to take). Histograms of size by source and
    leading hash digits find the bucket in which the budget ends; only that one is told apart by the next digits, until it
    has one value. The thresholds of smaller budgets lie below those of larger ones, so what a smaller mix takes a larger
    one takes too. sent: marks the table of a row a source for its joins. Returns ``source``, ``part``, ``edge`` (the draw
    at which the budget ends) and ``under`` (the size of all below it).
    """
    top = F.lit(16**DIGITS).cast("long")
    now, path = stored(goals.where("part > 0").select("source", "part", F.lit(0).cast("long").alias("edge"), (top - 1).alias("last"), F.lit(0).cast("long").alias("under")))
    for level in range(LEVEL, DIGITS + 1, LEVEL):
        known = now.select(F.col("source").alias("s"), "part", F.col("edge").alias("from"), "last", "under")
        inside = rows.join(sent(known.select("s", "from", "last")), same("source", "s") & F.col("draw").between(F.col("from"), F.col("last")))
        sums = inside.groupBy("source", F.floor(F.col("draw") / F.lit(16 ** (DIGITS - level))).alias("bucket")).agg(F.sum("size").alias("size"), F.min("draw").alias("edge"), F.max("draw").alias("last"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        met = sums.withColumn("to", run).join(sent(known.select("s", "part", "under")), same("source", "s")).withColumn("under", F.col("under") + F.col("to") - F.col("size"))
        new, after = stored(met.where((F.col("under") < F.col("part")) & (F.col("under") + F.col("size") >= F.col("part"))).select("source", "part", "edge", "last", "under"))
        discard(rows.sparkSession, path)
        now, path = new, after
        if now.where("edge < last").isEmpty():
            break
    return now


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, broadcast_sources: int = 100_000) -> DataFrame:
    """How much a mix of all ``docs`` (``doc_id``, ``text``, ``source``) takes of each: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``repeats``, ``taken``.

    The mix has as many words as all documents. Sources, by code point, null last, share them by ``weights`` in turn, none
    more than ``most`` times its words (``targets``). Of a source whose target is k times its size and a part, every
    document is taken k times, and once more if its hash lies below the threshold at which that part is reached
    (``thresholds``); at the threshold itself a document is taken if more than half of it is due, so a source's words are
    within half a document of its target. Nothing is sorted, and the hash is of id and text, so reruns agree.

    A null text and an empty one have no words: none are taken. Rows equal in id and text are told apart at the
    threshold by numbers, so that as many of them are taken as are due. A source without words has the target 0; no rows
    give no rows. Other columns are ignored. The table of sizes and hashes, a few dozen bytes a document, is written once
    to the shared folder and read for each level. Up to ``broadcast_sources`` sources, which are counted, their table is
    sent to the tasks; more are joined by shuffling both.
    """
    slim, _ = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("draw")))
    aims = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    sent = F.broadcast if aims.count() <= broadcast_sources else lambda df: df
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = aims.select("source", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("part"))
    edges = thresholds(slim.where("size > 0"), goals, sent).select(F.col("source").alias("s"), "edge", "under")
    plan = goals.join(edges, same("source", "s"), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", "part", "edge", "under")
    rows = slim.join(sent(plan), same("source", "of")).drop("of")

    tied = F.coalesce((F.col("draw") == F.col("edge")) & (F.col("size") > 0), F.lit(False))
    placed = numbered(rows.where(tied), ["source", "draw", "doc_id"], "_number")
    first = placed.groupBy("source").agg(F.min("_number").alias("_first")).select(F.col("source").alias("of"), "_first")
    due = F.col("under") + (F.col("_number") - F.col("_first") + F.lit(0.5)) * F.col("size") < F.col("part")
    settled = placed.join(sent(first), same("source", "of")).withColumn("more", due).select(*rows.columns, "more")
    others = rows.where(~tied).withColumn("more", F.coalesce((F.col("size") > 0) & (F.col("draw") < F.col("edge")), F.lit(False)))
    repeats = F.col("whole") + F.col("more").cast("long")
    return others.unionByName(settled).select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def op12_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents by weights 5, 2, 1."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
