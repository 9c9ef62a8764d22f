"""Benchmark decontamination with suffix arrays over shards of the training text.

Each shard (a run of documents of bounded size) gets a sparse suffix array: its word positions that can start a match,
sorted by their next words. Every distinct test window is binary-searched in it; equal ranges are the verbatim matches,
with their locations. How far matches go on is found by another binary search, of the matched positions among the sorted
suffixes of the test set. The test set travels in blocks of bounded size, a pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.neardup import mixed

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of characters beyond ASCII, makes the rest a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
FOUND = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, longest long, longest_at long"
HITS = "doc_id long, th long, n_words long, begins array<long>, ends array<long>, items array<string>, longest long, longest_at long"

U = np.uint64
BASE = 0xD1B54A32D192ED03
INVERSE = U(pow(BASE, -1, 2**64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


@dataclass
class TestBlock:
    """The words of some benchmark items, as numbers from 1; ``ends`` are the items' ends."""

    vocabulary: bytes
    tokens: np.ndarray
    ends: np.ndarray
    labels: list[str | None]

    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.vocabulary.split(), 1)}

    def suffixes(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each searched suffix: its position, the words that must match, its item."""
        n = np.diff(np.concatenate([[0], self.ends]))
        need = np.minimum(n, window)
        count = np.where(n > 0, n - need + 1, 0)
        item = np.repeat(np.arange(len(n)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (self.ends - n)[item]
        return at, need[item], item


def block_of(rows: list[tuple]) -> TestBlock:
    numbers: dict[bytes, int] = {}
    tokens, ends = [], []
    for _, text in rows:
        tokens += [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        ends.append(len(tokens))
    return TestBlock(b" ".join(numbers), np.array(tokens, np.uint32), np.array(ends, np.int64), [None if r[0] is None else str(r[0]) for r in rows])


def keyed(tokens: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The next ``depth`` tokens at each position as byte strings that sort like them; beyond the end: zeros."""
    padded = np.concatenate([tokens, np.zeros(depth, tokens.dtype)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[at].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * depth}").ravel() if len(at) else np.empty(0, f"S{4 * depth}")


class Stretches:
    """Hashes of any stretch of a token sequence, from sums of powers modulo 2^64."""

    def __init__(self, tokens: np.ndarray):
        self.size = len(tokens)
        self.down = np.cumprod(np.concatenate([[U(1)], np.full(self.size, INVERSE)]))
        up = np.cumprod(np.concatenate([[U(1)], np.full(max(0, self.size - 1), U(BASE))]))[: self.size]
        self.sums = np.concatenate([[U(0)], np.cumsum(mixed(tokens.astype(U)) * up)])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


class TestSuffixes:
    """All suffixes of a block's items in order, to find the longest match of positions of other texts."""

    def __init__(self, block: TestBlock):
        n = np.diff(np.concatenate([[0], block.ends]))
        beyond = int(block.tokens.max(initial=0)) + 1
        # An end mark that no document has follows each item.
        tokens = np.insert(block.tokens.astype(np.int64), block.ends, beyond)
        self.tokens, self.most = tokens, int(n.max(initial=0))
        rank, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width <= self.most and len(tokens) and rank.max() < len(tokens) - 1:
            next_ = np.concatenate([rank[width:] + 1, np.zeros(min(width, len(rank)), np.int64)])
            both = rank * (len(tokens) + 1) + next_
            order = np.argsort(both, kind="stable")
            rank = np.empty(len(tokens), np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], both[order][1:] != both[order][:-1]]))
            width *= 2
        self.order, self.stretches = order, Stretches(tokens)

    def common(self, theirs: Stretches, place: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """The words that positions of another text and suffixes have in common."""
        length = np.zeros(len(place), np.int64)
        for k in reversed(range(self.most.bit_length())):
            ok = np.flatnonzero((place + length + (1 << k) <= theirs.size) & (suffix + length + (1 << k) <= self.stretches.size))
            ok = ok[theirs.at((place + length)[ok], 1 << k) == self.stretches.at((suffix + length)[ok], 1 << k)]
            length[ok] += 1 << k
        return length

    def longest(self, tokens: np.ndarray, theirs: Stretches, place: np.ndarray) -> np.ndarray:
        """The words of the longest match of each position of ``tokens`` with any suffix."""
        lo, hi = np.zeros(len(place), np.int64), np.full(len(place), len(self.order))
        best = np.zeros(len(place), np.int64)
        open_ = np.arange(len(place))
        padded = np.concatenate([tokens, [0]])
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            suffix = self.order[mid]
            length = self.common(theirs, place[open_], suffix)
            best[open_] = np.maximum(best[open_], length)
            less = self.tokens[np.minimum(suffix + length, len(self.tokens) - 1)] < padded[place[open_] + length]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return best


class Searcher:
    """Binary search of all distinct windows of one test block in the suffix arrays of shards."""

    def __init__(self, block: TestBlock, window: int):
        self.block, self.window, self.get = block, window, block.numbers().get
        at, need, item = block.suffixes(window)
        keys = keyed(block.tokens, at, window).view(np.uint8).reshape(len(at), 4 * window).copy()
        keys[np.arange(4 * window) >= 4 * need[:, None]] = 0
        self.low, first, of = np.unique(keys.view(f"S{4 * window}").ravel() if len(at) else np.empty(0, f"S{4 * window}"), return_index=True, return_inverse=True)
        self.need = need[first]
        high = keys[first]
        high[np.arange(4 * window) >= 4 * self.need[:, None]] = 255
        self.high = np.ascontiguousarray(high).view(f"S{4 * window}").ravel() if len(first) else self.low
        self.least = int(need.min()) if len(need) else 0
        self.starts = np.zeros(int(block.tokens.max(initial=0)) + 1, bool)
        self.starts[block.tokens[at]] = True
        # Windows of the same items share one set of them.
        pairs = np.unique(np.column_stack([of, item]), axis=0) if len(at) else np.empty((0, 2), np.int64)
        bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.low) + 1))
        sets: dict[bytes, int] = {}
        self.set_of = np.array([sets.setdefault(pairs[b:e, 1].tobytes(), len(sets)) for b, e in zip(bounds, bounds[1:])], np.int64)
        self.sets = [frozenset(block.labels[i] for i in np.frombuffer(s, np.int64)) - {None} for s in sets]
        self.suffixes = None

    def search(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In a shard's words, with an empty word after each document: the words as numbers, positions and windows of matches.

        A position has at most one match of each length, so there are at most ``window`` times as many as positions.
        """
        tokens = np.fromiter((self.get(w, 0) for w in words), np.uint32, len(words))
        none = np.empty(0, np.int64)
        if not self.least:
            return tokens, none, none
        zero = np.flatnonzero(tokens == 0)
        after = np.diff(np.concatenate([[-1], zero]))
        run = np.repeat(zero, after) - np.arange(int(zero[-1]) + 1 if len(zero) else 0)
        array = np.flatnonzero((run >= self.least) & self.starts[tokens[: len(run)]])
        keys = keyed(tokens, array, self.window)
        order = np.argsort(keys, kind="stable")
        array, keys = array[order], keys[order]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        some = np.flatnonzero(hi > lo)
        if not len(some):
            return tokens, none, none
        n = (hi - lo)[some]
        which = np.repeat(some, n)
        place = array[np.repeat(lo[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        fits = run[place] >= self.need[which]
        return tokens, place[fits], which[fits]

    def lengths(self, tokens: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For positions of whole windows, in order, the words of their longest matches, or less where a longer one is beside.

        Runs of such positions are searched from their first one; where the match does not end with the run, all others
        of the run are.
        """
        if self.suffixes is None:
            self.suffixes = TestSuffixes(self.block)
        new = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(place)]]) - 1
        theirs, out = Stretches(tokens), np.full(len(place), self.window)
        out[first] = self.suffixes.longest(tokens, theirs, place[first])
        short = place[first] + out[first] < place[last] + self.window
        more = np.flatnonzero(short[np.cumsum(new) - 1] & ~new)
        out[more] = self.suffixes.longest(tokens, theirs, place[more])
        return out


def spans_of(place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches as disjoint ones, in order: begins and ends."""
    order = np.argsort(place, kind="stable")
    begin, end = place[order], np.maximum.accumulate((place + length)[order])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else np.empty(0, np.int64)
    return begin[first], end[np.concatenate([first[1:], [len(begin)]]) - 1] if len(begin) else end


def searched(docs: DataFrame, block: TestBlock, window: int, shard_words: int, every: bool):
    """What each document (``doc_id``, ``th``, ``text``) shares with one block, and the broadcast to destroy after use.

    every: whether documents without hits get a row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def shard(rows: list[tuple], searcher: Searcher) -> pa.RecordBatch:
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        ends = np.cumsum(sizes + 1)
        begins = ends - 1 - sizes
        tokens, place, which = searcher.search([w for r in rows for w in (*r[2], b"")])
        doc = np.searchsorted(ends, place, "right")
        found: list[set] = [set() for _ in rows]
        for d, s in np.unique(np.column_stack([doc, searcher.set_of[which]]), axis=0).tolist() if len(doc) else ():
            found[d] |= searcher.sets[s]
        need = searcher.need[which]
        length, whole = need.copy(), np.flatnonzero(need == searcher.window)
        whole = whole[np.argsort(place[whole])]
        if len(whole):
            length[whole] = searcher.lengths(tokens, place[whole], doc[whole])
        best, best_at = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        order = np.lexsort((place, -length, doc))
        top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(order) else order
        best[doc[top]], best_at[doc[top]] = length[top], place[top] - begins[doc[top]]
        b, e = spans_of(place, need)
        bounds = np.searchsorted(b, np.append(begins, ends[-1]))
        out = []
        for k, (row, lo, hi) in enumerate(zip(rows, bounds, bounds[1:])):
            if every or hi > lo:
                out.append((row[0], row[1], int(sizes[k]), (b[lo:hi] - begins[k]).tolist(), (e[lo:hi] - begins[k]).tolist(), sorted(found[k]), int(best[k]), None if best_at[k] < 0 else int(best_at[k])))
        longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        types = [pa.int64(), pa.int64(), pa.int64(), longs, longs, strings, pa.int64(), pa.int64()]
        names = [c.split()[0] for c in HITS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=names)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(sent.value, window)
        rows, held = [], 0
        for frame in frames:
            for at in range(0, frame.num_rows, 200):
                for doc, th, text in zip(*(c.to_pylist() for c in frame.slice(at, 200).columns)):
                    rows.append((doc, th, words_of(text)))
                    held += len(rows[-1][2]) + 1
                    if held >= shard_words:
                        yield shard(rows, searcher)
                        rows, held = [], 0
        if rows:
            yield shard(rows, searcher)

    return docs.mapInArrow(run, HITS), sent


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_chars: int = 8_000_000, shard_words: int = 1_500_000) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``), with what it shares with ``benchmark`` (``item_id``, ``text``).

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A test window is ``window``
    consecutive words of an item, or all words of an item that has fewer but some. Returns ``doc_id``, ``n_words``,
    ``n_hit`` (words inside any occurrence of a window), ``n_items``, ``items`` (ids, sorted as strings, of items with
    occurring windows), ``longest`` (words of the longest verbatim match that starts with a window, 0 without) and
    ``longest_at`` (the word it starts at, the first such; null without).

    The distinct items are measured first and dealt by hash to blocks of about ``block_chars`` characters (or one item),
    which pass the driver one at a time. One block is searched in one pass without a shuffle, in shards of at most
    ``shard_words`` words (or one document). Of several, each is searched and its hits, of the documents that have any,
    written to the shared checkpoint folder before the next is sent; then the hits are joined back. Null texts and items
    have no words; an item with a null id hits but is not listed; repeated rows of ``docs`` get equal results; an empty
    benchmark hits nothing.
    """
    items = benchmark.select("item_id", "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-chars // block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    blocks = (block_of(sorted(map(tuple, items.where(part == k).collect()), key=str)) for k in range(count))
    keyed_ = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    hit = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda a, n: a + n)
    named = ["doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "longest", "longest_at"]
    if count == 1:
        return searched(keyed_, next(blocks), window, shard_words, True)[0].select(*named)
    found = None
    for block in blocks:
        hits, sent = searched(keyed_, block, window, shard_words, False)
        hits, _ = stored(hits.distinct())
        sent.destroy()
        found = hits if found is None else found.union(hits)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begins", "ends"))))
    # Disjoint stretches: an overlap with what comes before is left out.
    ahead = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["ends"]).alias("end"), (a["n"] + F.greatest(s["ends"] - F.greatest(s["begins"], a["end"]), F.lit(0))).alias("n")),
    )
    top = F.max(F.struct("longest", (-F.col("longest_at")).alias("at")))
    merged = found.groupBy("doc_id", "th").agg(ahead["n"].alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), top.alias("top"))
    merged = merged.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), "n_hit", "items", "top")
    empty, _ = searched(keyed_, block_of([]), window, shard_words, True)
    both = empty.select("doc_id", "th", "n_words").join(merged, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), F.coalesce(F.col("top")["longest"], F.lit(0)).cast("long").alias("longest"), (-F.col("top")["at"]).alias("longest_at"))


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The rule: a document with hits that make up a twentieth of its words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Searches the whole benchmark in all documents."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"), "longest", "longest_at")
