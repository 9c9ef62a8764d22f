"""Fill-in-middle: documents are cut at token borders found by a parallel automaton scan and their parts rearranged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from millrace.llm.common import fresh

#: Marks of the prefix, the suffix and the middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 64
SPACE, OTHER, OPEN, LETTER, CLOSE, NONE = range(6)
STATES, MARKED = 8, 3


def step(state: int, kind: int) -> tuple[int, int]:
    """The next state on a byte of a kind, and whether a token ends before that byte.

    A state is ``4 * inside + mark``: whether the last byte was of a word, and how much of a mark was read (nothing,
    ``<``, ``<`` and a letter, a whole mark seen). Kind ``NONE`` pads: it changes nothing.
    """
    inside, mark = divmod(state, 4)
    if kind == NONE:
        return state, 0
    if mark != MARKED:
        mark = 1 if kind == OPEN else 2 if kind == LETTER and mark == 1 else MARKED if kind == CLOSE and mark == 2 else 0
    return 4 * (kind != SPACE) + mark, int(inside and kind == SPACE)


def build_tables() -> tuple[np.ndarray, ...]:
    """The automaton as tables: the kind of each byte, the transition functions that strings of bytes can have, the number
    of a function followed by a byte of a kind, the ends emitted then (a lane of 8 bits for each start state), the number
    of one function followed by another, and the ends emitted in a state on a kind."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[32, *range(9, 14)]] = SPACE
    kinds[[ord(c) for c in "PSM"]] = LETTER
    kinds[ord("<")], kinds[ord(">")] = OPEN, CLOSE
    found = [tuple(range(STATES))]
    known = {found[0]: 0}
    after = []
    for f in found:
        row = []
        for kind in range(6):
            g = tuple(step(s, kind)[0] for s in f)
            if g not in known:
                known[g] = len(found)
                found.append(g)
            row.append(known[g])
        after.append(row)
    emits = [[sum(step(s, kind)[1] << 8 * q for q, s in enumerate(f)) for kind in range(6)] for f in found]
    both = [[known[tuple(g[s] for s in f)] for g in found] for f in found]
    single = [[step(s, kind)[1] for kind in range(6)] for s in range(STATES)]
    return kinds, np.array(found, np.int64), np.array(after, np.int64), np.array(emits, np.uint64), np.array(both, np.int64), np.array(single, np.int64)


MADE: list[tuple[np.ndarray, ...]] = []


def tables() -> tuple[np.ndarray, ...]:
    """``build_tables``, made once a process."""
    if not MADE:
        MADE.append(build_tables())
    return MADE[0]


class Scan:
    """One pass over the stretches ``starts`` to ``ends`` of a byte array, each cut into blocks of 64 bytes.

    Every block has its transition function and, for each start state, its count of token ends; prefixes of functions
    are composed by doubling, so the state in which any block is entered is known for each start state.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        kinds, functions, after, emits, both, _ = tables()
        self.data, self.starts, self.ends = data, starts, ends
        n = -(-(ends - starts) // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.of = np.repeat(np.arange(len(n)), n)
        order = np.arange(len(self.of)) - self.first[self.of]
        self.at = starts[self.of] + order * BLOCK
        self.until = np.minimum(self.at + BLOCK, ends[self.of])
        f, self.counts = np.zeros(len(self.of), np.int64), np.zeros(len(self.of), np.uint64)
        for j in range(BLOCK):
            kind = self.kind(self.at, self.until, j)
            self.counts += emits[f, kind]
            f = after[f, kind]
        s = 1
        while len(order) and s <= order.max():
            later = np.flatnonzero(order >= s)
            f = f.copy()
            f[later] = both[f[later - s], f[later]]
            s *= 2
        self.whole = f
        self.before = np.where(order > 0, np.concatenate([[0], f[:-1]]), 0) if len(f) else f

    def kind(self, at: np.ndarray, until: np.ndarray, j: int) -> np.ndarray:
        return np.where(at + j < until, tables()[0][self.data[np.minimum(at + j, len(self.data) - 1)]], NONE)

    def totals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch, entered in state ``q``: the state in which it is left, and its count of token ends."""
        functions = tables()[1]
        entered = functions[self.before, q[self.of]]
        self.ended = np.concatenate([[0], np.cumsum((self.counts >> (8 * entered).astype(np.uint64)) & np.uint64(255)).astype(np.int64)])
        self.entered = entered
        filled = self.first[1:] > self.first[:-1]
        left = q.copy()
        left[filled] = functions[self.whole[self.first[1:][filled] - 1], q[filled]]
        return left, self.ended[self.first[1:]] - self.ended[self.first[:-1]]

    def places(self, stretch: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The byte before which token ``number`` (from 1) of a stretch ends, by the start states last given to ``totals``."""
        goal = self.ended[self.first[stretch]] + number
        block = np.searchsorted(self.ended, goal) - 1
        rest, state = goal - self.ended[block], self.entered[block]
        at, until, found = self.at[block], self.until[block], np.full(len(block), -1)
        for j in range(BLOCK):
            kind = self.kind(at, until, j)
            rest = rest - tables()[5][state, kind]
            found[(rest == 0) & (found < 0)] = j
            state = tables()[1][tables()[2][0, kind], state]
        return at + found


def characters(data: np.ndarray) -> np.ndarray:
    """Code points before each byte of UTF-8, and in all."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def texts(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of about ``most`` bytes, or one text, of a text or binary column: first row, bytes, starts, ends; null is empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        part = data[offsets[at] : offsets[stop]]
        yield at, part if len(part) else np.zeros(1, np.uint8), offsets[at:stop] - offsets[at], offsets[at + 1 : stop + 1] - offsets[at]
        at = stop


def cut_numbers(n: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = one % (n + 1), two % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


FOUND = StructType([StructField("n", LongType()), StructField("marked", BooleanType()), StructField("first", LongType()), StructField("second", LongType())])


@F.arrow_udf(FOUND)
def cuts_in_place(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of each whole text: its number of tokens, whether it has a mark, and the two cuts in code points."""
    for column, one, two in columns:
        out = []
        one, two = one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)
        for at, data, starts, ends in texts(column):
            rows = slice(at, at + len(starts))
            scan = Scan(data, starts, ends)
            state, n = scan.totals(np.zeros(len(starts), np.int64))
            n = n + (ends > starts)
            chars, cuts = characters(data), []
            for number in cut_numbers(n, one[rows], two[rows]):
                byte = np.where(number == n, ends, starts)
                inner = np.flatnonzero((number > 0) & (number < n))
                byte[inner] = scan.places(inner, number[inner])
                cuts.append(chars[byte] - chars[starts])
            out.append(pa.StructArray.from_arrays([pa.array(n), pa.array(state % 4 == MARKED), *map(pa.array, cuts)], names=["n", "marked", "first", "second"]))
        yield pa.concat_arrays(out) if out else pa.array([], pa.struct([("n", pa.int64()), ("marked", pa.bool_()), ("first", pa.int64()), ("second", pa.int64())]))


def border(data: np.ndarray, at: int) -> int:
    """``at``, or the start of the code point that it falls into."""
    while at < len(data) and at > 0 and data[at] & 0xC0 == 0x80:
        at -= 1
    return min(at, len(data))


def giant_cuts(giants: DataFrame, chunk_bytes: int) -> DataFrame:
    """Of texts of any length (``key``, ``text``, ``one``, ``two``): ``key``, ``n``, ``marked``, and where the cuts lie.

    Texts are dealt out in pieces of ``chunk_bytes``, and each piece gives, for each of the eight start states, the state
    it ends in and its token ends. These are composed in order for each text (two numbers a piece and state, so at most
    2 GB / ``chunk_bytes`` rows), which settles the state each piece is entered in and the piece that a cut falls into.
    ``cuts`` has, for either cut, the piece, the number of the token end within it (0: at the start of the text, null: at
    the end), the state the piece is entered in and the code points before it.
    """

    def pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for key, text in zip(frame.column(0), frame.column(1)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for no in range(-(-len(data) // chunk_bytes)):
                    part = data[border(data, no * chunk_bytes) : border(data, (no + 1) * chunk_bytes)].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([no], pa.int32()), pa.array([part], pa.binary())], names=["key", "no", "piece"])

    def functions(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at, data, starts, ends in texts(frame.column("piece")):
                scan = Scan(data, starts, ends)
                found = [scan.totals(np.full(len(starts), q, np.int64)) for q in range(STATES)]
                part, chars = frame.slice(at, len(starts)), characters(data)
                lists = [pa.array(np.stack([f[k] for f in found], 1).tolist(), pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("no"), *lists, pa.array(chars[ends] - chars[starts])], names=["key", "no", "state", "ends", "chars"])

    @F.arrow_udf("n long, marked boolean, cuts array<struct<no: int, number: long, state: int, chars: long>>")
    def resolve(rows: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for row, *draws in zip(rows.to_pylist(), one.to_pylist(), two.to_pylist()):
            state, chars, ended, entered = 0, 0, 0, []
            for piece in row:
                entered.append((ended, state, chars))
                ended, chars, state = ended + piece["ends"][state], chars + piece["chars"], piece["state"][state]
            n, cuts = ended + 1, []
            for number in sorted(d % (n + 1) for d in draws):
                no = max((i for i, (before, *_) in enumerate(entered) if before < number), default=0)
                cuts.append({"no": no, "number": None if number == n else number - entered[no][0], "state": entered[no][1], "chars": chars if number == n else entered[no][2]})
            out.append({"n": n, "marked": state % 4 == MARKED, "cuts": cuts})
        return pa.array(out, pa.struct([("n", pa.int64()), ("marked", pa.bool_()), ("cuts", pa.list_(pa.struct([("no", pa.int32()), ("number", pa.int64()), ("state", pa.int32()), ("chars", pa.int64())])))]))

    dealt = giants.select("key", "text").mapInArrow(pieces, "key string, no int, piece binary").repartition("key", "no")
    made = dealt.mapInArrow(functions, "key string, no int, state array<long>, ends array<long>, chars long").dropDuplicates(["key", "no"])
    whole = made.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "state", "ends", "chars"))).alias("rows"))
    drawn = giants.groupBy("key").agg(F.first("one").alias("one"), F.first("two").alias("two"))
    return whole.join(drawn, "key").select("key", resolve("rows", "one", "two").alias("found")).select("key", "found.*")


def select_cuts(text: Column, cuts: Column, chunk_bytes: int) -> Column:
    """The code points before either cut, by a scan of the pieces alone that ``giant_cuts`` names."""

    @F.arrow_udf("array<long>")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, found in columns:
            out = []
            for text, row in zip(column, found.to_pylist()):
                data, places = np.frombuffer(text.as_buffer(), np.uint8), []
                for c in row:
                    if c["number"]:
                        part = data[border(data, c["no"] * chunk_bytes) : border(data, (c["no"] + 1) * chunk_bytes)]
                        scan = Scan(part, np.array([0]), np.array([len(part)]))
                        scan.totals(np.array([c["state"]]))
                        places.append(c["chars"] + int(characters(part)[scan.places(np.array([0]), np.array([c["number"]]))[0]]))
                    else:
                        places.append(c["chars"])
                out.append(places)
            yield pa.array(out, pa.list_(pa.int64()))

    return run(text, cuts)


def draws(seed: int, id_: Column) -> list[Column]:
    """Four unsigned 32-bit numbers for an id: the first groups of the SHA-256 of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk_bytes: int = 1 << 16) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, more) with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``infill``.

    A text is cut into ``n`` tokens (white space and the word after it; white space at the end is one). By draws from its id
    ``rate`` of 100 documents are transformed, ``spm_rate`` of 100 of these to ``spm`` (suffix, prefix, middle), the rest to
    ``psm``; the others, empty texts and texts that have one of the marks are ``plain``: ``infill`` is the text and the two
    numbers are null. Parts begin and end between tokens and may be empty. Texts of up to ``chunk_bytes`` bytes are
    scanned where they are read; longer ones in pieces over all tasks (``giant_cuts``). Rows are treated each for itself:
    repeated rows give repeated results, a null text is an empty one, a null id draws like an empty id. Columns that are
    taken get other names (a leading underscore).
    """
    names = {c: fresh(docs, c) for c in ("n", "form", "prefix_chars", "middle_chars", "infill")}
    found, key, made = fresh(docs, "_found"), fresh(docs, "_key"), fresh(docs, "_text")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # A text that the caller computes is made first: Spark cannot hand an expression with lambdas to an Arrow function.
    docs = docs.select("*", F.explode(F.array(F.coalesce(F.col("text"), F.lit("")))).alias(made))
    text, giant = F.col(made), F.octet_length(made) > chunk_bytes
    one, two, three, four = draws(seed, F.col("doc_id"))
    near = docs.where(~giant).withColumn(found, cuts_in_place(text, one, two))

    keyed = docs.where(giant).withColumn(key, F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text), 256))
    where = giant_cuts(keyed.select(F.col(key).alias("key"), text.alias("text"), one.alias("one"), two.alias("two")), chunk_bytes)
    met = keyed.join(where.select(F.col("key").alias(key), F.struct("n", "marked", "cuts").alias(found)), key)
    placed = met.withColumn(key, select_cuts(text, F.col(f"{found}.cuts"), chunk_bytes))
    far = placed.withColumn(found, F.struct(F.col(f"{found}.n"), F.col(f"{found}.marked"), F.get(key, 0).alias("first"), F.get(key, 1).alias("second"))).drop(key)

    both = near.unionByName(far.select(*[F.col(f"`{c}`") for c in near.columns]))
    x = F.col(found)
    form = F.when((x["n"] == 0) | x["marked"] | (three % 100 >= rate), "plain").when(four % 100 < spm_rate, "spm").otherwise("psm")
    formed = both.withColumn(names["form"], form)
    shape, a, b = F.col(names["form"]), x["first"].cast("int"), x["second"].cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.lit(2**31 - 1) - b)
    whole = F.when(shape == "plain", text).when(shape == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = shape != "plain"
    done = formed.withColumns({names["n"]: x["n"], names["prefix_chars"]: F.when(cut, x["first"]), names["middle_chars"]: F.when(cut, x["second"] - x["first"]), names["infill"]: whole})
    return done.select(*columns, *names.values())


def restore(infill: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``infill`` of: a transformed text has each mark once."""
    part = F.split(infill, "<[PSM]>", -1)
    return F.when(form == "plain", infill).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op13_infill(spark, sf_dir: str) -> DataFrame:
    """Fill-in-middle of all documents, with digests of the output and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = fill_in_middle(docs)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("infill", 256).alias("output_sha256"), F.sha2(restore(F.col("infill"), F.col("form")), 256).alias("restored_sha256"))
