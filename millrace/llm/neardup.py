"""MinHash near-dedup by a signature-coordinate inverted join.

Every distinct shingle set posts its document under the (coordinate, value) pairs of its MinHash signature. Pairs that one
set has alone cannot collide and are dropped; of the others a set keeps its rarest as a prefix that no partner with enough
matches can miss. The collisions of one set with the later ones of a list are counted by merging the sets' lists: the
shortest, again a prefix, are merged, the longest are only looked up for those found, and sets that are already linked are
skipped. Pairs above a match threshold become candidates, kept as a spanning forest, and links are confirmed on full
shingle sets within the groups that the candidates make; large groups meet under their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, discard, release, stored

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of fewer words, one of the whole sequence."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, U)
    w = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    n = min(size, len(w))
    total = np.full(len(w) - n + 1, n, U)
    for k in range(n):
        total = mixed(total + w[k : len(w) - n + 1 + k])
    return np.unique(total)


def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240)
    return draw.integers(0, 2**63, (count, 1), U) * U(2) + U(1), draw.integers(0, 2**63, (count, 1), U) * U(2)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The MinHash coordinates, 32 bits each."""
    least = np.full(len(a), np.iinfo(U).max, U)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (a * shingles[at : at + 4096] + b).min(axis=1), out=least)
    return (least >> U(32)).astype(np.uint32)


def least_matches(similarity: float, coordinates: int, loss: float = 1e-6) -> int:
    """The most matches that a pair at ``similarity`` falls short of with less than ``loss`` chance."""
    below, least = 0.0, 0
    while True:
        below += comb(coordinates, least) * similarity**least * (1 - similarity) ** (coordinates - least)
        if below >= loss:
            return least
        least += 1


class Trees:
    """Which rows are linked so far: rows of equal ``label``."""

    def __init__(self, known: list[int]):
        self.label = np.unique(known, return_inverse=True)[1]

    def join(self, x: int, y: int) -> bool:
        """Links two rows; whether that joined something."""
        x, y = self.label[x], self.label[y]
        self.label[self.label == max(x, y)] = min(x, y)
        return x != y


def groups(frames: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal leading ``keys`` columns; the rows come sorted by them."""
    now, held = None, []
    for frame in frames:
        for row in zip(*(c.to_pylist() for c in frame.columns)):
            if row[:keys] != now:
                if held:
                    yield held
                now, held = row[:keys], []
            held.append(row)
    if held:
        yield held


def meetings(signs: np.ndarray, sides: list[int] | None, trees: Trees, least: int) -> Iterator[tuple[int, list[int]]]:
    """For each row the later rows, not linked to it yet, that match it in ``least`` coordinates; with ``sides``, of another side.

    The rows are posted under every (coordinate, value). Of a row's lists, the ``coordinates - least + 1`` shortest are
    merged and counted from behind the row on; a match must be in one of them. The others only add to its count.
    """
    n, coordinates = signs.shape
    other = None if sides is None else np.array(sides)
    columns = np.ascontiguousarray(signs.T)
    lists = np.argsort(columns, axis=1, kind="stable")
    values = np.take_along_axis(columns, lists, 1)
    ends = np.full((coordinates, n), n)
    ends[:, :-1] = np.where(values[:, 1:] != values[:, :-1], np.arange(1, n), n)
    ends = np.minimum.accumulate(ends[:, ::-1], axis=1)[:, ::-1]
    place = np.empty_like(lists)
    np.put_along_axis(place, lists, np.broadcast_to(np.arange(n), lists.shape), 1)
    start, stop = place.T + 1, np.take_along_axis(ends, place, 1).T
    for i in range(n - 1):
        unlinked = trees.label != trees.label[i]
        if not unlinked[i + 1 :].any():
            continue
        by = np.argsort(stop[i] - start[i])
        short, long = by[: coordinates - least + 1], by[coordinates - least + 1 :]
        merged = [lists[c, x:y] for c, x, y in zip(short.tolist(), start[i, short].tolist(), stop[i, short].tolist()) if x < y]
        if not merged:
            continue
        hits = np.bincount(np.concatenate(merged), minlength=n) * unlinked
        if other is not None:
            hits *= other != other[i]
        later = np.flatnonzero(hits)
        if len(later):
            found = later[hits[later] + (signs[np.ix_(later, long)] == signs[i, long]).sum(axis=1) >= least]
            yield i, found.tolist()


def rarest(shingles: np.ndarray, often: np.ndarray, counts: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """The set's prefix in the order of ``counts`` (of the sorted shingles ``often``; 0 for others), then hash, and which of it is outer.

    Sets that have ``part / whole`` of their union in common share a shingle of both prefixes, and at the first such one
    not both are outer: what is left of them from there on would be too little.
    """
    n = len(shingles)
    at = np.minimum(np.searchsorted(often, shingles), max(0, len(often) - 1))
    count = np.where(often[at] == shingles, counts[at], 0) if len(often) else np.zeros(n, np.int64)
    order = np.lexsort((mixed(shingles), count))[: n + (-part * n) // whole + 1]
    return shingles[order], (whole + part) * (n - np.arange(len(order))) < 2 * part * n


def dealt(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``i``, ``j``, ``side``: groups over ``size`` (column ``count``) rows are cut at random, each key in its own way; every row goes to one task."""
    side = F.pmod(F.xxhash64("node", key, F.lit("cut")), F.ceil(F.col("count") / size)).cast("int")
    return rows.withColumn("side", side).withColumn("i", F.col("side")).withColumn("j", F.col("side"))


def met(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The tasks in which the rows (``node``, ``root``) of each ``key`` meet those of other roots; keys of one root are left out.

    Rows need not meet within a key's most frequent root, nor, if there is a column ``outer``, among those for which it is
    true. The larger of these classes is not met with itself: it is cut into blocks, the others too, and each of the
    others' blocks meets every block in a task of its own. Keys whose rows are all outer are left out. Adds ``i``, ``j``, ``side``.
    """
    if "outer" not in rows.columns:
        rows = rows.withColumn("outer", F.lit(False))
    by_root = rows.groupBy(key, "root").agg(F.count("*").alias("count"), F.count_if("outer").alias("outers"))
    stats = by_root.groupBy(key).agg(
        F.sum("count").alias("all"), F.count("*").alias("roots"), F.max(F.struct("count", "root")).alias("most"), F.sum("outers").alias("outers")
    )
    stats = stats.where("roots > 1 and outers < all").withColumn("far", F.col("outers") > F.col("most.count"))
    stats = stats.withColumn("idle", F.greatest("outers", "most.count"))
    small = F.col("all") <= size
    first = F.when(small, 0).otherwise(F.ceil(F.col("idle") / size)).cast("int")
    rest = F.when(small, 1).otherwise(F.ceil((F.col("all") - F.col("idle")) / size)).cast("int")
    rows = rows.join(stats.drop("outers"), key).withColumn("first", first).withColumn("rest", rest)
    alike = F.when(F.col("far"), F.col("outer")).otherwise(F.col("root") == F.col("most.root")) & ~small
    draw = F.xxhash64("node", F.lit("block"))
    rows = rows.withColumn("side", F.when(alike, F.pmod(draw, F.greatest("first", F.lit(1)))).otherwise(F.col("first") + F.pmod(draw, F.greatest("rest", F.lit(1)))).cast("int"))
    blocks = F.sequence(F.when(alike, F.col("first")).otherwise(0), F.col("first") + F.col("rest") - 1)
    rows = rows.select("*", F.explode(blocks).alias("other"))
    # A block meets itself in the task (i, i), sent once; two different blocks meet in (i, j).
    return rows.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))


def labelled(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their ``node`` among the components ``linked``, or the node."""
    return rows.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_components(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (80, 100), coordinates: int = 64, block: int = 2000) -> DataFrame:
    """Groups near-duplicate ``docs`` (``doc_id``, ``text``): a row per row with ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    A-Z is lower-cased and words are what white space (tab to carriage return, space) separates; a set holds the distinct
    ``size``-word shingles of the whole text, or the whole sequence of fewer words. Two documents are linked if
    ``similarity[1] * intersection >= similarity[0] * union``, confirmed on full sets; ``component_id`` is the smallest
    id reachable over links, ``kept`` tells whether it is the row's own.

    Equal sets are one node and never expanded into pairs. A pair at the threshold is missed with a chance below 1e-6
    (see ``least_matches``). What leaves a task is a spanning forest, never all pairs. The (coordinate, value) pairs of all
    sets are counted; a set with fewer than the least matches among those that others have too is done with, the others
    post under their rarest, so that what a common passage brings is posted last, if at all. Lists above ``block`` nodes
    are first cut at random, each list in its own way, under a few of each set's rarest, so that a group of near copies
    becomes one component while every row is sent a few times. Only lists that still hold several components go on: in
    them the nodes outside the most frequent one meet all others, block by block. Candidate groups above ``block / 4``
    nodes are first cut twice at random. Where several components are left in one, its nodes meet under the rarest of
    their shingles, as many as a link cannot miss; rare is what a sample of the group's nodes has seldom, which orders
    shingles and decides no result. Keys at which all have too little left for a link (``rarest``) are left out.
    So a task holds two blocks at most, and copies are not sent to one another's blocks. Texts without words are linked with nothing. A row with a null id is kept, with a null component, and
    links nothing by itself. Texts under one id are linked. Repeated rows get equal results; no rows give none.
    """
    least = least_matches(similarity[0] / similarity[1], coordinates)
    a, b = coefficients(coordinates)
    part, whole = similarity

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for frame in frames:
            for at in range(0, frame.num_rows, 1000):
                rows = frame.slice(at, 1000)
                n, keys, signs = [], [], []
                for text in rows.column(1).to_pylist():
                    s = shingle_set(text, size, hashes)
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    signs.append(signature(s, a, b).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "sig"])

    def post(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            signs = np.frombuffer(b"".join(frame.column(1).to_pylist()), np.uint32).reshape(-1, coordinates)
            key = (np.arange(coordinates, dtype=np.int64) << 32) + signs.astype(np.int64)
            number = np.repeat(frame.column(0).to_numpy(zero_copy_only=False), coordinates)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(number)], names=["key", "no"])

    def parts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for frame in frames:
            for group, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                s = shingle_set(text, size, hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), group)), pa.array(s)], names=["group", "s"])

    def prefixes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, seen = WordHashes(), None, None
        for frame in frames:
            for group, chunk, node, root, set_id, text, often, counts in zip(*(c.to_pylist() for c in frame.columns)):
                if (group, chunk) != now:
                    now, seen = (group, chunk), (np.empty(0, U), np.empty(0, np.int64))
                if node is None:
                    often = np.array(often, np.int64).view(U)
                    by = np.argsort(often)
                    seen = often[by], np.array(counts, np.int64)[by]
                    continue
                s = shingle_set(text, size, hashes)
                if xxhash.xxh3_128_digest(s.tobytes()) == set_id:
                    keys, outer = rarest(s, *seen, part, whole)
                    keys = mixed(keys + mixed(np.array([group], np.int64).view(U))).view(np.int64)
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([node] * n, pa.int64()), pa.array([root] * n, pa.int64()), pa.array([set_id] * n, pa.binary()), pa.array(outer)], names=["key", "node", "root", "set_id", "outer"])

    def edges(left: list[int], right: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    def collide(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for rows in groups(frames, 3):
            nodes, sides, trees = [r[3] for r in rows], None if rows[0][1] == rows[0][2] else [r[4] for r in rows], Trees([r[5] for r in rows])
            signs = np.frombuffer(b"".join(r[6] for r in rows), np.uint32).reshape(-1, coordinates)
            for i, later in meetings(signs, sides, trees, least):
                for j in later:
                    if trees.join(i, j):
                        left.append(nodes[i])
                        right.append(nodes[j])
            if len(left) > 5000:
                yield edges(left, right)
                left, right = [], []
        yield edges(left, right)

    def confirm(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows in groups(frames, 3):
            # An id with several texts comes with each of them for each of its sets.
            pairs = [(r, shingle_set(r[6], size, hashes)) for r in rows]
            pairs = [(r, s) for r, s in pairs if xxhash.xxh3_128_digest(s.tobytes()) == r[7]]
            rows, full = [r for r, _ in pairs], [s for _, s in pairs]
            if len(rows) < 2:
                continue
            nodes, sides, trees = [r[3] for r in rows], None if rows[0][1] == rows[0][2] else [r[4] for r in rows], Trees([r[5] for r in rows])
            signs = np.array([signature(s, a, b) for s in full])
            left, right = [], []
            for i, later in meetings(signs, sides, trees, least):
                for j in later:
                    if trees.label[i] == trees.label[j] or min(len(full[i]), len(full[j])) * whole < max(len(full[i]), len(full[j])) * part:
                        continue
                    both = len(np.intersect1d(full[i], full[j], assume_unique=True))
                    if whole * both >= part * (len(full[i]) + len(full[j]) - both) and trees.join(i, j):
                        left.append(nodes[i])
                        right.append(nodes[j])
            yield edges(left, right)

    def compared(tasks: DataFrame, key: str, *content: str) -> DataFrame:
        """The links of the tasks, by signatures or, if there are texts, by full sets."""
        rows = tasks.select(key, "i", "j", "node", "side", "root", *content).repartition(key, "i", "j")
        return rows.sortWithinPartitions(key, "i", "j", "node", *content[1:]).mapInArrow(confirm if "text" in content else collide, "a long, b long")

    spark, spent = docs.sparkSession, []

    def kept(rows: DataFrame) -> DataFrame:
        """The rows as a table in the shared checkpoint folder, for this call only."""
        table, path = stored(rows)
        spent.append(path)
        return table

    def joined(first: DataFrame, more: DataFrame) -> DataFrame:
        return components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    found, _ = stored(docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, n_shingles long, set_id binary, sig binary"))
    nodes = found.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"))
    nodes, _ = stored(nodes.withColumn("no", F.xxhash64("set_id")))
    posts = nodes.select("no", "sig").mapInArrow(post, "key long, no long")
    shared = posts.groupBy("key").count().where("count > 1")
    # Two sets with enough matches have the first they share, rare ones first, among all but the last ``least - 1`` of either.
    own = posts.join(shared, "key").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("own")).where(F.size("own") >= least)
    rare = kept(own.select("no", F.posexplode(F.slice("own", 1, F.size("own") - least + 1)).alias("place", "own")).select("no", "place", "own.key"))
    lists = rare.join(rare.groupBy("key").count().where("count > 1"), "key").join(nodes.select("no", "node", "sig"), "no").withColumn("root", F.col("node"))
    grouped = components(compared(dealt(lists.where(F.col("place") < 4), "key", block), "key", "sig"))
    rest = labelled(rare.join(nodes.select("no", "node"), "no").select("key", "node", "no"), grouped)
    tasks = met(rest, "key", block).join(nodes.select("no", "sig"), "no")
    grouped = joined(grouped, compared(tasks, "key", "sig"))

    # A set of an id with several texts is confirmed on the text it comes from; ``group`` is a group of candidates.
    some = max(1, block // 4)
    members = grouped.withColumnRenamed("root", "group")
    members = members.join(members.groupBy("group").count(), "group").join(nodes.select("node", "set_id"), "node")
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(members.select("node").distinct(), "node", "left_semi")
    texts = kept(texts.withColumn("th", F.xxhash64("text")).dropDuplicates(["node", "th"]))
    twice = F.explode(F.when(F.col("count") > some, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    tasks = members.select("*", twice.alias("turn")).withColumn("task", F.xxhash64("group", "turn")).withColumn("root", F.col("node"))
    linked = components(compared(dealt(tasks, "task", some).join(texts, "node"), "task", "text", "set_id"))
    ids = found.where("set_id is not null and doc_id is not null").select("doc_id", "set_id").distinct().join(nodes.select("set_id", "node"), "set_id").select("doc_id", "node").distinct()
    several = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    more = ids.join(several, "doc_id").select("a", F.col("node").alias("b"))
    large = labelled(members.where(F.col("count") > some), linked)
    mixed_groups = large.groupBy("group").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("group")
    large = kept(large.join(mixed_groups, "group").select("group", "node", "root", "set_id", "count"))
    if not large.isEmpty():
        sample = large.where(F.expr("pmod(xxhash64(node, 'sample'), count) < 64")).select("group", "node").join(texts, "node")
        often = sample.select("group", "text").mapInArrow(parts, "group long, s long").groupBy("group", "s").count().where("count > 1")
        often = often.groupBy("group").agg(F.collect_list(F.struct("s", "count")).alias("often"))
        chunks = F.ceil(F.col("count") / some).cast("int")
        told = large.groupBy("group").agg(F.max("count").alias("count")).join(often, "group").select("group", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "often")
        told = told.select("group", "chunk", F.col("often.s").alias("often"), F.col("often.count").alias("counts"))
        those = large.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), chunks).cast("int")).join(texts, "node")
        rows = those.select("group", "chunk", "node", "root", "set_id", "text").unionByName(told, allowMissingColumns=True).repartition("group", "chunk")
        keyed = kept(rows.sortWithinPartitions("group", "chunk", F.asc_nulls_first("node")).mapInArrow(prefixes, "key long, node long, root long, set_id binary, outer boolean"))
        more = more.union(compared(met(keyed, "key", some).join(texts, "node"), "key", "text", "set_id"))
    linked = joined(linked, more)
    for path in spent:
        discard(spark, path)
    release(spark)
    final = nodes.select("set_id", "node").join(linked, "node", "left").select("set_id", F.coalesce("root", "node").alias("root"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = found.select("doc_id", "n_shingles", "set_id").join(final, "set_id", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, (85, 100))
