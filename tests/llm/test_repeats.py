"""Substrings, word windows and lines against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import lines, recompression, substrings


def brute_substrings(rows, window):
    data = [(t or "").encode() for _, t in rows]
    n = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if n[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((doc, len(d), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(b for b, g in zip(d, gone) if not g)))
    return out


def order(found):
    return sorted(found, key=repr)


@pytest.mark.parametrize("window", [200, 81])
@pytest.mark.parametrize("batch,turn", [(4_000_000, 40_000), (500, 3)])
def test_substrings(docs, rows, window, batch, turn):
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_substrings(docs, window, batch, turn).collect()]
    assert order(found) == order(brute_substrings(rows, window)) and sum(r[2] for r in found) > 1000


def test_substrings_with_runs_of_zero_bytes(spark):
    draw = random.Random(4)
    rows = [(i, "".join(draw.choice(["a", "\0" * draw.randint(1, 120), "xyz"]) for _ in range(draw.randint(1, 12)))) for i in range(60)]
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 100, 500, 20).collect()]
    assert order(found) == order(brute_substrings(rows, 100)) and sum(r[2] for r in found) > 100


def test_very_long_texts(spark):
    text = " ".join(f"w{i % 50_000}" for i in range(180_000))
    rows = [(1, text), (2, text[300:]), (3, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # The second text begins within a word: its first window is its own, all that follow begin in the first text too.
    words, later = text.split(), text[300:].split()
    assert later[0] != words[len(words) - len(later)] and later[1:] == words[1 - len(later) :]
    assert {r["doc_id"]: r["n_removed"] for r in recompression.remove_repeats(frame).collect()} == {1: 0, 2: len(later) - 1, 3: 0}
    assert {r["doc_id"]: r["n_removed"] == r["n_bytes"] for r in substrings.remove_substrings(frame).collect()} == {1: True, 2: True, 3: False}
    assert lines.dedup_lines(frame).count() == 3


def test_substrings_odd(odd_docs, no_docs, wide_docs, rows):
    given = [tuple(r) for r in odd_docs.collect()]
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_substrings(odd_docs, 100).collect()]
    assert order(found) == order(brute_substrings(given, 100))
    assert substrings.remove_substrings(no_docs).count() == 0
    assert substrings.remove_substrings(wide_docs[0]).count() == len(rows)
    with pytest.raises(ValueError):
        substrings.remove_substrings(no_docs, 50)


def brute_windows(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        if doc is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        if doc is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < doc:
                    gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window,rounds", [(50, 4), (50, 6), (7, 2), (3, 3)])
def test_word_windows(docs, rows, window, rounds):
    found = [tuple(r) for r in recompression.remove_repeats(docs, window, rounds).collect()]
    assert order(found) == order(brute_windows(rows, window)) and sum(r[2] for r in found) > 500


def test_word_windows_in_small_batches(docs, rows):
    for hot in (20_000, 3):
        check_small_batches(docs, rows, hot)
    with pytest.raises(ValueError):
        recompression.repeated_words(docs, 20, 0)


def check_small_batches(docs, rows, hot):
    spans = recompression.repeated_words(docs, 20, 3, batch_words=30, hot_docs=hot).collect()
    covered = defaultdict(set)
    for r in spans:
        covered[r["doc_id"]].update(range(r["start"], r["start"] + r["length"] + 19))
    assert {d: len(c) for d, c in covered.items()} == {d: n for d, _, n, _ in brute_windows(rows, 20) if n}


def test_word_windows_odd(odd_docs, no_docs, wide_docs, rows):
    # Rows under one id are one document: they take nothing from each other.
    given = [tuple(r) for r in odd_docs.collect() if r["doc_id"] not in (1, 2)]
    found = [tuple(r) for r in recompression.remove_repeats(odd_docs.where("doc_id is null or doc_id not in (1, 2)"), 20).collect()]
    assert order(found) == order(brute_windows(given, 20))
    assert {tuple(r)[:3] for r in recompression.remove_repeats(odd_docs, 20).where("doc_id = 1").collect()} == {(1, 90, 0), (1, 1, 0)}
    assert recompression.remove_repeats(no_docs).count() == 0
    assert recompression.remove_repeats(wide_docs[0]).count() == len(rows)


def brute_lines(rows, window=3):
    seen, gone = {}, defaultdict(set)
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        part = (text or "").split("\n")
        for i in range(len(part) - window + 1):
            key = tuple(part[i : i + window])
            if seen.setdefault(key, (doc, i)) != (doc, i):
                gone[doc].update(range(i, i + window))
    out = []
    for doc, text in rows:
        part = (text or "").split("\n")
        spans = sum(i - 1 not in gone[doc] for i in gone[doc])
        kept = "\n".join(x for i, x in enumerate(part) if i not in gone[doc])
        out.append((doc, 0 if text is None else len(part), len(gone[doc]), spans, None if text is None else kept))
    return out


def test_lines(docs, rows):
    found = [(r["doc_id"], r["n_lines"], r["n_removed"], r["n_spans"], r["text"]) for r in lines.dedup_lines(docs).collect()]
    assert order(found) == order(brute_lines(rows)) and sum(r[2] for r in found) > 5


def test_lines_keep_other_columns(wide_docs, docs):
    wide, names = wide_docs
    done = lines.dedup_lines(wide)
    assert done.columns[: 2 + len(names)] == ["doc_id", "text", *names] and "_n_lines" in done.columns
    assert order(map(tuple, done.select("doc_id", "text").collect())) == order(map(tuple, lines.dedup_lines(docs).select("doc_id", "text").collect()))


def test_lines_odd(spark, no_docs):
    text = "a\nb\nc\nd"
    given = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "x\na\nb\nc"), (2, "a\nb\nc\nd\ny"), (3, None), (4, ""), (5, "\n\n\n\n\n")], "doc_id long, text string")
    found = {(r["doc_id"], r["text"], r["n_removed"], r["n_spans"]) for r in lines.dedup_lines(given).collect()}
    assert found == {(None, text, 0, 0), (1, "", 4, 1), (2, "x", 3, 1), (2, "y", 4, 1), (3, None, 0, 0), (4, "", 0, 0), (5, "", 5, 1)}
    assert lines.dedup_lines(no_docs).count() == 0


def test_digests_match_texts(docs):
    done = recompression.remove_repeats(docs).select("kept", F.sha2("kept", 256).alias("h")).collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["h"] for r in done)
