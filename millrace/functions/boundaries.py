"""Sentence boundaries learnt from a corpus: abbreviations, sentence starters and collocations by log-likelihood ratios.

After Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006). All counts are grouped by language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.keywords import words
from millrace.operators.ordering import kept

# Fixed values of the published method: the chance of a period after an abbreviation, and the thresholds.
AFTER_ABBREVIATION, ABBREVIATION, STARTER, COLLOCATION = 0.99, 0.3, 30.0, 7.88
NUMBER = "##"
#: Bytes of text that are counted or cut together, or one text.
TEXTS = 3_000_000
Rule = Callable[[Column], Column]
# Patterns of a token, for expressions and for the tasks.
AROUND, PERIOD, DIGITS, CLOSING = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", r"\.$", r"^[\p{N}.,]+$", r"([.!?])[^\p{L}\p{N}.!?]*$"
UPPER, LOWER, LETTER = r"^[^\p{L}\p{N}]*\p{Lu}", r"^[^\p{L}\p{N}]*\p{Ll}", r"^\p{L}$"


def bare(token: Column) -> Column:
    """A token in lower case without what is neither letter nor digit around it, but with a period at its end."""
    return F.lower(F.regexp_replace(token, AROUND, ""))


def kind(token: Column) -> Column:
    """The type that is counted for a bare token: without the period at its end; numbers are all one."""
    word = F.regexp_replace(token, PERIOD, "")
    return F.when(word.rlike(DIGITS), NUMBER).otherwise(word)


def types(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``kind`` makes of ``bare`` tokens, but not in lower case, and whether they end in a period."""
    found = pc.replace_substring_regex(tokens, AROUND, "")
    word = pc.replace_substring_regex(found, PERIOD, "")
    return pc.if_else(pc.match_substring_regex(word, DIGITS), NUMBER, word), pc.ends_with(found, ".").to_numpy(zero_copy_only=False)


def small(words_: pa.Array) -> pa.Array:
    """In lower case, as ``lower`` gives it."""
    out, odd = pc.utf8_lower(words_), pc.invert(pc.string_is_ascii(words_))
    rest = pa.array([w.lower() for w in words_.filter(odd).to_pylist()], pa.string())
    return pc.replace_with_mask(out, odd, rest) if len(rest) else out


def parts(column: pa.Array, most: int) -> Iterator[slice]:
    """Stretches of a column of texts, each of a bounded number of bytes or one text."""
    ends, at = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, stop)
        at = stop


def read(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))


def tally(langs: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """The rows of ``occurrences`` that a slice of texts gives."""
    found, size = words(texts)
    coded, known = found.dictionary_encode(), langs.dictionary_encode()
    code, many = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    mine = np.repeat(known.indices.to_numpy(zero_copy_only=False).astype(np.int64), size) * many + code
    last = np.zeros(len(code), bool)
    last[np.cumsum(size)[size > 0] - 1] = True
    paired = pc.match_substring_regex(coded.dictionary, "[.!?]").to_numpy(zero_copy_only=False)[code] & ~last
    at = np.flatnonzero(paired)
    pair, times = np.unique(mine[at] * many + code[at + 1], return_counts=True)
    one, alone = np.unique(mine[~paired], return_counts=True)
    key = np.concatenate([one, pair // many])
    after = pa.concat_arrays([pa.nulls(len(one), pa.string()), coded.dictionary.take(pa.array(pair % many))])
    return known.dictionary.take(pa.array(key // many)), coded.dictionary.take(pa.array(key % many)), after, pa.array(np.concatenate([alone, times]))


def occurrences(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Tokens as written and how often each occurs: ``lang``, ``w``, ``after`` (the next token of the document, for tokens with a sentence mark in them alone), ``n``.

    Texts are cut and counted in the tasks, a bounded slice at a time.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for its in parts(frame.column("text"), TEXTS):
                yield pa.RecordBatch.from_arrays([*tally(*(c[its] for c in frame.columns))], names=["lang", "w", "after", "n"])

    return read(docs, text, lang).mapInArrow(run, "lang string, w string, after string, n long").groupBy("lang", "w", "after").agg(F.sum("n").alias("n"))


def typed(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Types and the pairs around a sentence mark: ``lang``, ``mark`` (``.``, ``!`` or ``?`` at the first one's end), ``type``, ``next``, ``n``, ``dots`` (times with a period).

    A type's own row has neither ``mark`` nor ``next``. What the patterns make of a token is worked out once a different token of a slice of texts, not once an occurrence.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for its in parts(frame.column("text"), TEXTS):
                yield from named(*tally(*(c[its] for c in frame.columns)))

    def named(lang: pa.Array, w: pa.Array, after: pa.Array, n: pa.Array) -> Iterator[pa.RecordBatch]:
        coded, langs = pa.concat_arrays([w, after]).dictionary_encode(), lang.dictionary_encode()
        type_, dot = types(coded.dictionary)
        mark = pc.struct_field(pc.extract_regex(coded.dictionary, CLOSING.replace("(", "(?P<mark>", 1)), "mark")
        code = coded.indices.fill_null(-1).to_numpy().astype(np.int64)
        first, second, many, n = code[: len(w)], code[len(w) :], max(1, len(coded.dictionary)), n.to_numpy()
        real = pc.not_equal(type_, "").to_numpy(zero_copy_only=False)

        key, place = np.unique(langs.indices.to_numpy().astype(np.int64) * many + first, return_inverse=True)
        times, its = np.bincount(place, n, len(key)).astype(np.int64), key % many
        none = pa.nulls(len(key), pa.string())
        own = pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // many)), none, type_.take(pa.array(its)), none, pa.array(times), pa.array(np.where(dot[its], times, 0))], names=names)
        yield own.filter(pa.array(real[its]))

        closed = mark.is_valid().to_numpy(zero_copy_only=False)
        both = np.flatnonzero((second >= 0) & closed[first] & real[first] & real[second])
        x, y = pa.array(first[both]), pa.array(second[both])
        yield pa.RecordBatch.from_arrays([lang.take(pa.array(both)), mark.take(x), type_.take(x), type_.take(y), pa.array(n[both]), pa.array(np.zeros(len(both), np.int64))], names=names)

    names = ["lang", "mark", "type", "next", "n", "dots"]
    found = read(docs, text, lang).mapInArrow(run, "lang string, mark string, type string, next string, n long, dots long")
    return found.groupBy("lang", "mark", F.lower("type").alias("type"), F.lower("next").alias("next")).agg(F.sum("n").alias("n"), F.sum("dots").alias("dots"))


def log_share(k: Column, n: Column, p: Column) -> Column:
    """The logarithm of the chance of ``k`` in ``n`` at probability ``p``."""
    part = lambda c, x: F.when(c == 0, F.lit(0.0)).otherwise(c * F.log(x))
    return part(k, p) + part(n - k, 1 - p)


def likelihood(c1: Column, c2: Column, c12: Column, n: Column) -> Column:
    """The log-likelihood ratio of the second event after the first: they occur ``c1`` and ``c2`` times, ``c12`` times together, among ``n``."""
    p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / (n - c1)
    return -2 * (log_share(c12, c1, p) + log_share(c2 - c12, n - c1, p) - log_share(c12, c1, p1) - log_share(c2 - c12, n - c1, p2))


def abbreviations(counts: DataFrame) -> DataFrame:
    """Types that stand before a period far more often than chance: ``lang``, ``term``, ``score``.

    The ratio is weighed by length (short types are likelier), inner periods, and the times without a period. Numbers and
    types without a letter are none.
    """
    letters = F.char_length(F.regexp_replace("type", r"\.", "")).cast("double")
    alone = F.col("n") - F.col("dots")
    ratio = -2 * (log_share(F.col("dots"), F.col("n"), F.col("periods") / F.col("words")) - log_share(F.col("dots"), F.col("n"), F.lit(AFTER_ABBREVIATION)))
    score = ratio * F.exp(-letters) * (F.char_length("type") - letters + 1) * F.pow(letters, -alone.cast("double"))
    fit = (F.col("dots") > 0) & (F.col("type") != NUMBER) & F.col("type").rlike(r"\p{L}")
    return counts.where(fit).withColumn("score", score).where(F.col("score") >= ABBREVIATION).select("lang", F.col("type").alias("term"), "score")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The model of a corpus: ``lang``, ``kind`` (``abbreviation``, ``starter``, ``collocation``), ``term``, ``other`` (of a collocation), ``score``.

    One grouped count of types and of the pairs around sentence marks, made in the tasks of tokens as written; this and the model are kept in the shared folder. A starter follows the end of
    a sentence far more often than chance, ends after abbreviations, initials and numbers aside; a collocation is a pair
    with a period between, the first an abbreviation, an initial or a number. A null language is one of its own (empty).
    Counts of types join only with what can still reach its threshold.
    """
    rows = kept(typed(docs, text, lang))
    counts = rows.where("next is null").select("lang", "type", "dots", "n")
    whole = kept(counts.groupBy("lang").agg(F.sum("n").alias("words"), F.sum("dots").alias("periods")))
    short = kept(abbreviations(counts.join(F.broadcast(whole), "lang")))
    marked = rows.where("next is not null").join(short.select("lang", F.col("term").alias("type"), F.lit(True).alias("short")), ["lang", "type"], "left")
    loose = F.coalesce("short", F.lit(False)) | (F.char_length("type") == 1) | (F.col("type") == NUMBER)

    ends = kept(marked.where((F.col("mark") != ".") | ~loose).groupBy("lang", "next").agg(F.sum("n").alias("c12")))
    breaks = ends.groupBy("lang").agg(F.sum("c12").alias("c1")).join(whole.select("lang", "words"), "lang")
    # Where a word follows more often than chance, the ratio falls with the times that it occurs: it is greatest where all of them follow.
    most = likelihood(F.col("c1"), F.col("c12"), F.col("c12"), F.col("words"))
    met = kept(ends.join(F.broadcast(breaks), "lang").where(F.col("next").rlike(r"^\p{L}") & (most >= STARTER - 1e-6)))
    close = kept(marked.where((F.col("mark") == ".") & loose).groupBy("lang", "type", "next").agg(F.sum("n").alias("c12")).where("c12 > 1"))
    asked = met.select("lang", F.col("next").alias("type")).union(close.select("lang", "type")).union(close.select("lang", "next")).distinct()
    known = kept(counts.join(asked, ["lang", "type"]).select("lang", "type", "n"))
    second = known.select("lang", F.col("type").alias("next"), F.col("n").alias("c2"))

    over = F.col("c12") * F.col("words") > F.col("c1") * F.col("c2")
    score = likelihood(F.col("c1"), F.col("c2"), F.col("c12"), F.col("words"))
    starters = met.join(second, ["lang", "next"]).withColumn("score", score).where((F.col("score") >= STARTER) & over)
    both = close.join(known.select("lang", "type", F.col("n").alias("c1")), ["lang", "type"]).join(second, ["lang", "next"]).join(F.broadcast(whole), "lang")
    together = both.where(over).withColumn("score", score).where(F.col("score") >= COLLOCATION)

    none = F.lit(None).cast("string").alias("other")
    return kept(
        short.select("lang", F.lit("abbreviation").alias("kind"), "term", none, "score")
        .unionByName(starters.select("lang", F.lit("starter").alias("kind"), F.col("next").alias("term"), none, "score"))
        .unionByName(together.select("lang", F.lit("collocation").alias("kind"), F.col("type").alias("term"), F.col("next").alias("other"), "score"))
    )


def packed(model: DataFrame) -> DataFrame:
    """A row per language with the model's terms as arrays: what joins with texts, a row of the size of the language's model."""
    of = lambda k, c: F.sort_array(F.collect_list(F.when(F.col("kind") == k, c)))
    return model.groupBy("lang").agg(of("abbreviation", F.col("term")).alias("abbreviations"), of("starter", F.col("term")).alias("starters"), of("collocation", F.concat_ws(" ", "term", "other")).alias("collocations"))


def cut(text: Column, abbreviations_: Column, starters: Column, collocations: Column) -> Column:
    """The sentences of a text by a language's model, as written; blank ones are dropped, a null text has none.

    A place after ``!`` or ``?`` and white space is a boundary, one after ``.`` too unless the words around it are a
    collocation; or an abbreviation or initial stands before it, and what follows is not a starter in upper case; or a
    number does, and what follows is in lower case.
    """
    pieces = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?])(?={T.SPACE})", -1)
    has = lambda array, x: F.coalesce(F.array_contains(array, x), F.lit(False))

    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)

    def held(last: Column, after: Column) -> Column:
        word = F.regexp_extract(after, r"(?U)^\s*(\S+)", 1)

        def found(x: Column) -> Column:
            type_, word, first = x["type"], x["word"], x["first"]
            upper = word.rlike(UPPER)
            out = F.when(has(collocations, F.concat(type_, F.lit(" "), first)), True)
            out = out.when(has(abbreviations_, type_) | type_.rlike(LETTER), ~(upper & has(starters, first)))
            return out.when(type_ == NUMBER, word.rlike(LOWER)).otherwise(False)

        return let(word, lambda w: let(F.struct(kind(last).alias("type"), w.alias("word"), kind(bare(w)).alias("first")), found))

    def boundary(before: Column, after: Column) -> Column:
        # No token reaches over a space: what the pattern looks through is short.
        last = bare(F.regexp_extract(F.substring_index(before, " ", -1), r"(?U)(\S+)$", 1))
        return let(last, lambda x: F.when(x.endswith("."), ~held(x, after)).otherwise(True))

    def joined(p: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | boundary(F.get(p, i - 1), F.get(p, i)))
        whole = F.get(F.transform(F.array(starts), lambda s: F.transform(s, lambda b, j: F.array_join(F.slice(p, b + 1, F.coalesce(F.get(s, j + 1), F.size(p)) - b), ""))), 0)
        return F.filter(F.transform(whole, lambda x: F.regexp_replace(x, f"^{T.SPACE}+", "")), lambda x: ~T.is_blank(x))

    return F.get(F.transform(F.array(pieces), joined), 0)


#: Bytes of white space (as ``\\s`` sees it) by value, and those that a longer character of white space may begin with.
WHITE, LEAD = np.zeros(256, bool), np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of a UTF-8 text are of white space."""
    out = WHITE[data]
    at = np.flatnonzero(LEAD[data])
    a, b, c = (data[np.minimum(at + k, len(data) - 1)] for k in range(3))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three |= (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    out[at[two | three]] = out[at[two | three] + 1] = True
    out[at[three] + 2] = True
    return out


def past(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first place from each of ``at`` on that the mask is not set at."""
    ends = np.append(np.flatnonzero(mask[:-1] & ~mask[1:]) + 1, len(mask))
    return np.where(mask[at], ends[np.searchsorted(ends, at, "right")], at)


def spans(data: pa.Buffer, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Stretches of a text, in order and apart from one another."""
    if not len(begin):
        return pa.array([], pa.string())
    cuts = np.column_stack([begin, end]).reshape(-1).astype(np.int32)
    return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data).take(pa.array(np.arange(0, len(cuts), 2)))


class Cutter:
    """What ``cut`` does, for many texts at once in a task, by the models of their languages: terms are looked up once a different word."""

    def __init__(self, model: DataFrame):
        self.models = {r["lang"]: [pa.array(r[c], pa.string()) for c in ("abbreviations", "starters", "collocations")] for r in packed(model).collect()}

    def __call__(self, texts: pa.Array, langs: pa.Array) -> Iterator[pa.Array]:
        """The sentences of each text, a slice at a time, so that no batch is held whole a second time."""
        for its in parts(texts, TEXTS):
            yield self.cut(texts[its], langs[its])

    def cut(self, texts: pa.Array, langs: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string()).fill_null("")
        _, offsets, held = texts.buffers()
        edge = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if edge[0] == edge[-1]:
            return pa.array([[]] * len(texts), pa.list_(pa.string()))
        held = held.slice(edge[0], edge[-1] - edge[0])
        edge = edge - edge[0]
        data, begins = np.frombuffer(held, np.uint8), edge[:-1][np.diff(edge) > 0]
        white = white_bytes(data)
        space = white | (data >= 0x1C) & (data <= 0x1F)

        # Places between a mark and white space, and the texts' stretches between them.
        after = np.flatnonzero(((data[:-1] == 46) | (data[:-1] == 33) | (data[:-1] == 63)) & space[1:]) + 1
        first = np.zeros(len(data), bool)
        first[begins] = True
        after = after[~first[after]]
        pieces = np.sort(np.concatenate([begins, after]))
        at = np.searchsorted(pieces, after)
        whites = np.append(np.flatnonzero(white), len(data))
        since = np.maximum(pieces[at - 1], np.append(-1, whites)[np.searchsorted(whites, after)] + 1)
        upto = np.append(pieces, len(data))[at + 1]
        start = np.minimum(past(white, after), upto)
        stop = np.minimum(whites[np.searchsorted(whites, start)], upto)
        of_text = np.searchsorted(edge, after, "right") - 1
        begin = after[self.begins(spans(held, since, after), spans(held, start, stop), langs, of_text)]

        pieces = np.sort(np.concatenate([begins, begin]))
        ends, heads = np.append(pieces[1:], len(data)), past(space, pieces)
        full = heads < ends
        count = np.bincount(np.searchsorted(edge, pieces[full], "right") - 1, minlength=len(texts))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), spans(held, heads[full], ends[full]))

    def begins(self, last: pa.Array, word: pa.Array, langs: pa.Array, of_text: np.ndarray) -> np.ndarray:
        """Whether a sentence begins between each last token and the word after it, in a text of that number."""
        coded = last.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        kinds, dot = types(coded.dictionary)
        out = np.ones(len(code), bool)
        some = np.flatnonzero(dot[code])
        if not len(some):
            return out
        used, code = np.unique(code[some], return_inverse=True)
        kinds, words_, lang = kinds.take(pa.array(used)), word.take(pa.array(some)).dictionary_encode(), langs.dictionary_encode()
        follow, flags = words_.indices.to_numpy(zero_copy_only=False), lambda x: x.to_numpy(zero_copy_only=False)
        kinds, firsts = small(kinds), small(types(words_.dictionary)[0])
        upper, lower = (flags(pc.match_substring_regex(words_.dictionary, p))[follow] for p in (UPPER, LOWER))
        letter, number = (flags(x)[code] for x in (pc.match_substring_regex(kinds, LETTER), pc.equal(kinds, NUMBER)))
        tied, short, starts = (np.zeros(len(code), bool) for _ in range(3))
        whose = lang.indices.to_numpy(zero_copy_only=False)[of_text[some]]
        for k, name in enumerate(lang.dictionary.to_pylist()):
            if name in self.models:
                abbreviations_, starters, collocations = self.models[name]
                its = np.flatnonzero(whose == k)
                short[its] = flags(pc.is_in(kinds, value_set=abbreviations_))[code[its]]
                starts[its] = flags(pc.is_in(firsts, value_set=starters))[follow[its]]
                pairs = pc.binary_join_element_wise(kinds.take(pa.array(code[its])), firsts.take(pa.array(follow[its])), " ")
                tied[its] = flags(pc.is_in(pairs, value_set=collocations))
        out[some] = ~np.where(tied, True, np.where(short | letter, ~(upper & starts), number & lower))
        return out


def sentences(docs: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", name: str = "sentences", broadcast_terms: int = 100_000) -> DataFrame:
    """``docs`` with ``name``, the sentences of each text by the model of its language; a language without a model has no exceptions.

    The model's terms are counted; up to ``broadcast_terms`` they are collected and sent to the texts, more are met by a shuffle.
    """
    if model.count() <= broadcast_terms:
        cutter = Cutter(model)

        @F.arrow_udf("array<string>")
        def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, langs in columns:
                yield from cutter(texts, langs)

        return docs.select(*[docs[c] for c in docs.columns], run(F.col(text), F.coalesce(F.col(lang), F.lit(""))).alias(name))
    rows = packed(model).withColumnRenamed("lang", "_lang")
    empty = F.array().cast("array<string>")
    met = docs.join(rows, F.coalesce(F.col(lang), F.lit("")) == F.col("_lang"), "left")
    found = cut(F.col(text), *[F.coalesce(c, empty) for c in ("abbreviations", "starters", "collocations")])
    return met.withColumn("_found", found).select(*[docs[c] for c in docs.columns], F.col("_found").alias(name))


def rule(model: DataFrame, language: str) -> Rule:
    """The sentences of one language's texts as an expression, for texts that do not say their language (``data_language``)."""
    row = packed(model.where(F.col("lang") == language)).first()
    lists = [[], [], []] if row is None else [row["abbreviations"], row["starters"], row["collocations"]]
    terms = [F.array(*[F.lit(t) for t in found]).cast("array<string>") for found in lists]
    return lambda text: cut(text, *terms)
