"""Packing of tokenised documents: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII symbols at the end of a run; the tokenizer keeps them apart from letters.
SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Tokenizer:
    """Token ids of texts by a public tokenizer file, remembering the ids of each run of non-space characters.

    The file's normaliser and splitter never join characters across ASCII white space, so a text's ids are those of
    its runs between such in turn; it lower-cases, so runs are looked up in lower case (but for texts that may hold a
    special token, which is matched as written). New words of a to z go straight to the model; other new runs are encoded
    together: words of letters one after the other, as their last ids tell where they end, and others with a mark between
    them that is a token of its own. The memory has two generations of ``most_bytes``: as the younger fills up, it becomes
    the older, and runs met again return to the younger. Runs over ``LONG`` bytes are not remembered beyond a call, and
    what is encoded together has ``TOGETHER`` bytes or is one run.
    """

    MARK, LONG, TOGETHER = b"\x01", 200, 200_000
    #: About what an entry of the memory takes beside its bytes.
    ENTRY = 180

    def __init__(self, path: str, end_id: int, most_bytes: int = 160_000_000):
        from tokenizers import Tokenizer as Public

        self.public, self.most_bytes, self.held = Public.from_file(path), most_bytes, 0
        vocabulary = self.public.get_vocab()
        self.type = np.dtype("<u2" if max(end_id, *vocabulary.values()) < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.type).tobytes()
        self.codes = [np.array([i], self.type).tobytes() for i in range(max(vocabulary.values()) + 1)]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.mark = self.encoded(self.MARK)
        if len(self.mark) != 1:
            raise ValueError("the mark between runs must be one token")
        self.word_ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encoded(self, run: bytes) -> np.ndarray:
        return np.array(self.public.encode_batch_fast([run.decode()], add_special_tokens=False)[0].ids, self.type)

    def learn(self, runs: list[bytes]) -> None:
        """Remembers new runs: those of letters, with symbols after them or not, by their two parts, others as they are."""
        known = self.known
        plain = {r for r in runs if r.isalpha() and r.islower()}
        self.spell(plain)
        rest, parts = [], []
        for run in runs:
            if run not in plain:
                core = run.rstrip(SYMBOLS)
                (parts if core.isalpha() or core.decode().isalpha() else rest).append((run, core))
        cores = {core for _, core in parts if core not in known}
        ends = {run[len(core) :] for run, core in parts if len(run) > len(core)}
        plain = {c for c in cores if c.isalpha() and c.islower()}
        self.spell(plain)
        self.separate(list(cores - plain), self.word_ends)
        self.separate([r for r in {*ends, *(run for run, _ in rest)} if r not in known], None)
        for run, core in parts:
            if len(run) > len(core):
                known[run] = known[core] + known[run[len(core) :]]

    def spell(self, words: set[bytes]) -> None:
        """Remembers words of a to z by the tokenizer's last step alone: the others leave such words as they are."""
        step, codes, known = self.public.model.tokenize, self.codes, self.known
        for word in words:
            known[word] = b"".join([codes[t.id] for t in step(word.decode())])

    def separate(self, runs: list[bytes], ends: np.ndarray | None) -> None:
        """Remembers runs encoded together: told apart by the ids in ``ends``, or by marks put in between."""
        if ends is None:
            for run in runs:
                if self.MARK in run:
                    self.known[run] = self.encoded(run).tobytes()
            runs = [r for r in runs if self.MARK not in r]
        turn = np.cumsum([len(r) for r in runs]) // self.TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(runs)]
        for part in (runs[b:e] for b, e in zip(cuts, cuts[1:]) if e > b):
            if ends is None:
                ids = self.encoded((b" " + self.MARK + b" ").join([*part, b""]))
                stops, skip = np.flatnonzero(ids == self.mark[0]), 1
            else:
                ids = self.encoded(b" ".join(part))
                stops, skip = np.flatnonzero(ends[ids]) + 1, 0
                if len(stops) != len(part):
                    self.separate(part, None)
                    continue
            data, start, width = ids.tobytes(), 0, self.type.itemsize
            for run, stop in zip(part, (width * stops).tolist(), strict=True):
                self.known[run] = data[start:stop]
                start = stop + width * skip

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text, the end id last, as numbers of ``type`` one after the other."""
        runs = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        if self.held > self.most_bytes:
            self.known, self.older, self.held = {}, self.known, 0
        new, distinct = [], set(chain.from_iterable(runs))
        for run in distinct.difference(self.known):
            if run in self.older:
                self.known[run] = self.older[run]
                self.held += len(run) + len(self.known[run]) + self.ENTRY
            else:
                new.append(run)
        # Nothing here is cyclic, and the collector would walk the whole memory time and again.
        before = len(self.known)
        gc.disable()
        try:
            self.learn(new)
        finally:
            gc.enable()
        self.held += sum(len(r) + len(self.known[r]) for r in new) + self.ENTRY * (len(self.known) - before)
        get = dict(zip(distinct, map(self.known.__getitem__, distinct))).__getitem__  # small, unlike what is known
        out = [b"".join(map(get, x)) + self.end for x in runs]
        for run in [r for r in new if len(r) > self.LONG]:
            self.held -= len(run) + len(self.known.pop(run)) + self.ENTRY
            self.known.pop(run.rstrip(SYMBOLS), None)
        return out


#: Tokenizers of this worker process, by path and end id.
KEPT: dict[tuple[str, int], Tokenizer] = {}


def worker_tokenizer(path: str, end_id: int) -> Tokenizer:
    """This worker process's tokenizer: tasks that run in it one after the other share what it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, end_id) not in KEPT:
        KEPT[path, end_id] = Tokenizer(path, end_id)
    return KEPT[path, end_id]


def forget_tokenizers() -> None:
    """Frees the memory of this worker's tokenizers, which later stages have no use for."""
    KEPT.clear()


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: larger items first (ties: earlier first), each to the first bin with room.

    A tournament tree holds at each node the most room of the bins below, so the first fitting bin is one descent.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room, bins = [capacity] * (2 * leaves), [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, at = sizes[item], 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[item] = at - leaves
        room[at] -= size
        at //= 2
        while at:
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
            at //= 2
    return bins


def fill(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length): first-fit decreasing, then gaps closed by cutting.

    The emptiest bins are taken apart and their items cut to fill the gaps of the fullest exactly; what is left, under
    one capacity, is cut into sequences of descending powers of two. So no sequence needs padding, few items are cut.
    """
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for item, at in enumerate(first_fit_decreasing(sizes, capacity)):
        bins.setdefault(at, []).append((item, 0, sizes[item]))
    order = sorted(bins.values(), key=lambda b: (-sum(p[2] for p in b), b))
    total = sum(sizes)
    whole = total // capacity
    done, loose = order[:whole], [p for b in order[whole:] for p in b]
    loose.reverse()

    def take(want: int) -> list[tuple[int, int, int]]:
        got = []
        while want:
            item, start, length = loose.pop()
            part = min(length, want)
            got.append((item, start, part))
            want -= part
            if part < length:
                loose.append((item, start + part, length - part))
        return got

    for pieces in done:
        pieces.extend(take(capacity - sum(p[2] for p in pieces)))
    rest = total - whole * capacity
    while rest:
        part = 1 << (rest.bit_length() - 1)
        done.append(take(part))
        rest -= part
    return done


#: ``sequence_id`` is the group's number, then so many bits for that of the sequence in its group.
GROUP_BITS = 36


def pack_documents(docs: DataFrame, tokenizer_path: Callable[[], str], capacity: int = 4096, end_id: int = 2, group_rows: int = 4000, group_tokens: int = 4_000_000) -> DataFrame:
    """Packs all ``docs`` (``doc_id``, ``text``) into sequences of at most ``capacity`` tokens.

    tokenizer_path: called on the executors, gives the tokenizer's file. Returns a row per piece: ``doc_id``,
    ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit, binary), ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``. Full sequences are cut off long documents where they are tokenised; the remainders go
    to random groups of about ``group_rows`` documents, drawn by a hash of the id and the text, and each group is
    packed on its own. A group is packed in turns of ``group_tokens`` tokens at most, so its memory is bounded; its
    sequences are numbered through all turns.
    A null text is an empty one: its document is the end id alone. A null id stays null; repeated rows are packed each
    for itself (in the group of their shared hash). No rows give no rows.
    """
    rows = docs.count()
    groups = max(1, -(-rows // group_rows))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("pack")), F.lit(groups))
    text = docs.select("doc_id", "text", draw.alias("grp"))
    parts = "doc_id long, grp long, start long, n long, doc_tokens long, ids binary"

    def slices(frame: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        """Stretches of at most 500 rows and about 2 MB of text, or one row."""
        at, held = 0, 0
        for i, n in enumerate(pc.binary_length(frame.column(1)).fill_null(0).to_pylist()):
            if i > at and (i - at == 500 or held + n > 2_000_000):
                yield at, i - at
                at, held = i, 0
            held += n
        if frame.num_rows:
            yield at, frame.num_rows - at

    def tokenise(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        public = worker_tokenizer(tokenizer_path(), end_id)
        width = public.type.itemsize
        for frame in frames:
            for at, size in slices(frame):
                out = []
                part = frame.slice(at, size)
                bodies = part.column(1).cast(pa.binary()).to_pylist()
                for doc, ids, grp in zip(part.column(0).to_pylist(), public.ids(bodies), part.column(2).to_pylist()):
                    n = len(ids) // width
                    for s in range(0, n, capacity):
                        e = min(n, s + capacity)
                        out.append((doc, grp, s, e - s, n, ids[s * width : e * width]))
                names = ["doc_id", "grp", "start", "n", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.binary()])], names=names)

    def lay(key: int, items: list[tuple], plan: list[list[tuple[int, int, int]]], first: int) -> list[tuple]:
        """The pieces of sequences numbered from ``first`` in their group."""
        out = []
        if first + len(plan) > 1 << GROUP_BITS:
            raise OverflowError("more sequences in a group than sequence_id has room for")
        for number, pieces in enumerate(plan, first):
            offset = 0
            for item, start, length in pieces:
                doc, begin, n, tokens, ids = items[item]
                width = len(ids) // n
                part = np.frombuffer(ids[start * width : (start + length) * width], f"<u{width}").astype("<u4").tobytes()
                out.append((doc, begin + start, length, part, zlib.crc32(part), tokens, (key << GROUP_BITS) + number, offset))
                offset += length
        return out

    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by group; one group's turn is held at a time."""
        forget_tokenizers()
        now, held, tokens, first = None, [], 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            """The pieces of the turn, a few sequences at a time."""
            nonlocal first
            plan = fill([r[2] for r in held], capacity)
            for at in range(0, len(plan), 50):
                out = lay(now, held, plan[at : at + 50], first + at)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            first += len(plan)

        for frame in frames:
            for at in range(0, frame.num_rows, 500):
                part = frame.slice(at, 500)
                for grp, *row in zip(*(part.column(c).to_pylist() for c in ("grp", "doc_id", "start", "n", "doc_tokens", "ids"))):
                    if held and (grp != now or tokens >= group_tokens):
                        yield from close()
                        first, held, tokens = (first if grp == now else 0), [], 0
                    now = grp
                    held.append(tuple(row))
                    tokens += row[2]
        if held:
            yield from close()

    pieces = text.mapInArrow(tokenise, parts)
    shared = pieces.repartition(F.col("grp")).sortWithinPartitions("grp", "doc_id", "start", "ids")
    return shared.mapInArrow(place, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, word_bpe).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
