"""Periodic runs: branching tandem repeats from each document's suffix tree, rotated and merged into maximal runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, let
from millrace.llm.infill import texts

LEAST = 12
MIX = np.uint64(0x9E3779B97F4A7C15)


def least_depth(least: int) -> int:
    """The depth of tree nodes that no run of ``least`` words can do without: some multiple of its period, squared within it."""
    return max(1, min((q * (least // (2 * q)) for q in range(1, least // 2 + 1)), default=1))


def leaves(words: np.ndarray, until: np.ndarray, of: np.ndarray, depth: int) -> np.ndarray:
    """The places whose next ``depth`` words come again in their document, as far as hashes tell (they only add places), and
    the places ``depth`` words behind these."""
    n = len(words) - depth + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = of[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(depth):
            key = (key + words[k : k + n].astype(np.uint64) + np.uint64(1)) * MIX
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    twin = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][twin]] = True
    again[order[:-1][twin]] = True
    place = np.flatnonzero(again)
    place = place[place + depth <= until[place]]
    behind = place + depth
    return np.union1d(place, behind[behind < until[place]])


class Tree:
    """The suffix trees of documents below nodes of a least depth, as leaves in order and the depths between neighbours.

    Leaves are sorted by doubling, ties only; the names of all lengths are kept, and the depth of the node that joins two
    neighbours is found from the longest down.
    """

    def __init__(self, words: np.ndarray, until: np.ndarray, of: np.ndarray, depth: int):
        self.place = place = leaves(words, until, of, depth)
        n, self.until = len(place), until[place]
        self.leaf = np.full(len(words) + 1, -1, np.int64)
        self.leaf[place] = np.arange(n)
        at = lambda k: np.where(place + k < self.until, words[np.minimum(place + k, len(words) - 1)], -1)
        first = [of[place], *[at(k) for k in range(depth)]]
        order = np.lexsort(first[::-1])
        new = np.zeros(n, bool)
        new[:1] = True
        for column in first:
            new[1:] |= column[order[1:]] != column[order[:-1]]
        names, size = [], depth
        name = np.empty(n, np.int64)
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        name[order] = start
        while True:
            names.append(name)
            tied = np.flatnonzero(~(new & np.append(new[1:], True)[:n]))
            if not len(tied):
                break
            who = order[tied]
            then = place[who] + size
            after = np.where(then < self.until[who], name[self.leaf[np.minimum(then, len(words))]], -1)
            inner = np.lexsort((after, name[who]))
            who, after = who[inner], after[inner]
            order[tied] = who
            new[tied[1:]] |= (after[1:] != after[:-1]) | (name[who[1:]] != name[who[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            name = np.empty(n, np.int64)
            name[order] = start
            size *= 2
        self.order = order
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.joined = np.zeros(n, np.int64)
        a, b = order[:-1], order[1:]
        same = np.flatnonzero(names[0][a] == names[0][b])
        a, b, got = place[a[same]], place[b[same]], np.zeros(len(same), np.int64)
        end_a, end_b = until[a], until[b]
        for level in range(len(names) - 1, -1, -1):
            # Each length is tried once: what two places share is a sum of distinct doublings and a rest below the least.
            x, y = np.where(a + got < end_a, self.leaf[a + got], -1), np.where(b + got < end_b, self.leaf[b + got], -1)
            hit = (x >= 0) & (y >= 0) & (names[level][x] == names[level][y])
            got[hit] += depth << level
        for _ in range(depth - 1):
            x, y = a + got, b + got
            hit = (x < end_a) & (y < end_b)
            hit[hit] = words[x[hit]] == words[y[hit]]
            got[hit] += 1
        self.joined[same + 1] = got

    def nodes(self) -> tuple[np.ndarray, ...]:
        """The binary nodes of the tree: depth, first leaf, first leaf of the right half, end; nodes of one depth in a chain stand for one."""
        depth = self.joined.tolist()
        left, right, stack = [0] * len(depth), [0] * len(depth), []
        for k, d in enumerate(depth):
            while stack and depth[stack[-1]] >= d:
                right[stack.pop()] = k
            left[k] = stack[-1] if stack else 0
            if d == 0:
                stack.clear()
            stack.append(k)
        for k in stack:
            right[k] = len(depth)
        middle = np.flatnonzero(self.joined > 0)
        return self.joined[middle], np.array(left, np.int64)[middle], middle, np.array(right, np.int64)[middle]

    def tandems(self, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """All branching tandem repeats as start and half: at each node the leaves of the smaller half are looked up, one
        half's length before and behind, among those of the larger one. A leaf is looked up at most log n times."""
        depth, left, middle, right = self.nodes()
        small_left = middle - left <= right - middle
        begin, end = np.where(small_left, left, middle), np.where(small_left, middle, right)
        low, high = np.where(small_left, middle, left), np.where(small_left, right, middle)
        size = end - begin
        bounds = np.cumsum(size)
        starts, halves, at = [], [], 0
        while at < len(size):
            stop = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + most, "right")))
            part = size[at:stop]
            node = np.repeat(np.arange(at, stop), part)
            leaf = begin[node] + np.arange(len(node)) - np.repeat(np.cumsum(part) - part, part)
            here, d = self.place[self.order[leaf]], depth[node]
            for sign in (1, -1):
                there = here + sign * d
                there[(there < 0) | (there >= len(self.leaf))] = len(self.leaf) - 1
                met = self.leaf[there]
                rank = np.where(met >= 0, self.rank[met], -1)
                hit = (rank >= low[node]) & (rank < high[node])
                starts.append(np.minimum(here[hit], there[hit]))
                halves.append(d[hit])
            at = stop
        return (np.concatenate(starts), np.concatenate(halves)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def leftmost(words: np.ndarray, since: int, at: int, period: int) -> int:
    """How far back from ``at``, not before ``since``, words equal those a period later."""
    size = 32
    while at > since:
        a = max(since, at - size)
        differ = np.flatnonzero(words[a:at] != words[a + period : at + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        at, size = a, size * 2
    return at


def find(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The maximal runs of at least ``least`` words in documents that lie one after another: rows of first word, end, period.

    bounds: where each document's words begin, and the end of the last. A branching repeat is the last rotation of its
    run, so all of one run share its end; the shortest half at an end is rotated back as far as it goes, and longer halves
    that are whole multiples of it within what it covers belong to the same run.
    """
    depth = least_depth(least)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    since, until = bounds[of], bounds[of + 1]
    tree = Tree(words, until, of, depth)
    start, half = tree.tandems()
    end = start + 2 * half
    order = np.lexsort((half, end))
    start, half, end = start[order], half[order], end[order]
    out, at = [], 0
    cuts = np.flatnonzero(np.append(end[1:] != end[:-1], True)) + 1 if len(end) else []
    for stop in cuts:
        group, at = [(int(start[k]), int(half[k])) for k in range(at, stop)], stop
        last = group[0][0] + 2 * group[0][1]
        while group:
            begin, d = group[0]
            begin = leftmost(words, int(since[begin]), begin, d)
            # Periods below the least depth show as their first multiple of that depth.
            period = next((q for q in range(1, min(depth, d)) if d % q == 0 and (words[begin : begin + d - q] == words[begin + q : begin + d]).all()), d)
            if last - begin >= max(least, 2 * period):
                out.append((begin, last, period))
            group = [g for g in group[1:] if g[1] % period or last - 2 * g[1] < begin]
    return np.array(out, np.int64).reshape(-1, 3)


def split_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that fill a byte array (runs other than ASCII white space), and where each text's begin."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    heads = starts[(ends > starts)]
    first[heads] = inside[heads]
    after = np.cumsum(inside)
    begin = np.flatnonzero(first)
    offsets = np.append(after[begin] - 1, after[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.searchsorted(begin, np.append(starts, ends[-1]))


def collapsed(text: Column, least: int = LEAST) -> Column:
    """A struct of ``n_words``, ``runs`` (``start``, ``length``, ``period``, by start, then period) and ``text`` of the kept words."""

    @F.arrow_udf("n_words long, runs array<struct<start: long, length: long, period: long>>, text string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for _, data, starts, ends in texts(column):
                if not ends[-1]:
                    data = np.full(1, 32, np.uint8)
                words, bounds = split_words(data, starts, ends)
                found = find(words.dictionary_encode().indices.to_numpy().astype(np.int64), bounds, least)
                found = found[np.lexsort((found[:, 2], found[:, 0]))]
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, found[:, 0] + found[:, 2], 1)
                np.add.at(change, found[:, 1], -1)
                keep = np.cumsum(change)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep))), b" ").cast(pa.string())
                doc = np.searchsorted(bounds, found[:, 0], "right") - 1
                rows = pa.StructArray.from_arrays([pa.array(found[:, 0] - bounds[doc]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(bounds))), pa.int32()), rows)
                out.append(pa.StructArray.from_arrays([pa.array(np.diff(bounds)), lists, joined], names=["n_words", "runs", "text"]))
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("text", pa.string())]))

    return run(text)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` (``text``, more) with ``n_words``, ``runs`` and ``collapsed``.

    Words are what ASCII white space separates, numbered from 0 in each document. A run is a stretch of at least ``least``
    words and two periods in which words one period apart are the same and which no neighbouring word extends; its period is
    the smallest. ``runs`` has ``start``, ``length``, ``period`` by start, then period. ``collapsed`` has the words but
    those that a run contains behind its first period, joined by single spaces.

    Each document's suffix tree holds the leaves whose next words come again in the document (no others lie below a node
    that a run needs). Documents are read in slices of about 4 MB of text; a longer one is a slice of its own, so its words
    and tree, a few hundred bytes a word of repeated text, are what a task holds. Nothing is shuffled. A null, empty or
    blank text has no words, no runs and an empty ``collapsed``; repeated rows are treated alike; ``doc_id`` is not needed.
    Columns whose names are taken get a leading underscore.
    """
    found, text = fresh(docs, "_found"), fresh(docs, "_text")
    names = [fresh(docs, c) for c in ("n_words", "runs", "collapsed")]
    # A text that the caller computes is made first: Spark cannot hand an expression with lambdas to an Arrow function.
    made = docs.select("*", F.explode(F.array("text")).alias(text))
    done = made.withColumn(found, collapsed(F.col(text), least))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{found}.{c}").alias(name) for c, name in zip(("n_words", "runs", "text"), names)])


def planted(id_: Column, text: Column) -> Column:
    """The text of op11: for a tenth of the ids, by CRC-32, the words from some place on repeat a period drawn from the id; no other is changed, nor one with a null id."""
    h = F.crc32(id_.cast("string"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, again(w)).otherwise(""))).otherwise(text)


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, repeats planted into a tenth of them: the longest run, and digests of all and of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    done = find_runs(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = done.withColumn("top", top)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
