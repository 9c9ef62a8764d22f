import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=runs.LEAST):
    """Runs by trying every period at every place, the smallest first."""
    seen, out = set(), []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.sampled_from([2, 5, 8, 12, 13, 20]))
@settings(max_examples=150, deadline=None)
def test_runs_of_small_alphabets(docs, least):
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    found = runs.find(np.array([w for d in docs for w in d], np.int64), bounds, least)
    want = [(s + int(bounds[k]), s + n + int(bounds[k]), q) for k, d in enumerate(docs) for s, n, q in brute(d, least)]
    assert sorted(map(tuple, found.tolist())) == sorted(want)


@given(st.integers(1, 30), st.integers(2, 9), st.integers(0, 40), st.integers(0, 12))
@settings(max_examples=80, deadline=None)
def test_planted_periods(period, times, before, behind):
    draw = random.Random(period * 1000 + times * 100 + before)
    body = [draw.randrange(6) for _ in range(period)] * times
    words = [draw.randrange(6) for _ in range(before)] + body + [draw.randrange(6) for _ in range(behind)]
    found = runs.find(np.array(words, np.int64), np.array([0, len(words)]))
    assert sorted((s, e - s, q) for s, e, q in found.tolist()) == sorted(brute(words))


def test_the_least_depth_is_met_by_some_multiple_of_every_period():
    for least in range(2, 40):
        depth = runs.least_depth(least)
        for q in range(1, 60):
            assert any(k * q >= depth and 2 * k * q <= max(least, 2 * q) for k in range(1, 40))


def test_one_word_for_ever():
    assert runs.find(np.zeros(50_000, np.int64), np.array([0, 50_000])).tolist() == [[0, 50_000, 1]]
    assert runs.find(np.zeros(11, np.int64), np.array([0, 11])).tolist() == []


def spark_runs(df):
    return sorted(((r["text"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(df).collect()), key=repr)


def brute_rows(rows):
    out = []
    for _, text in rows:
        words = WORD.findall(text or "")
        found = brute(words)
        out.append((text, len(words), found, kept(words, found)))
    return sorted(out, key=repr)


def test_documents(docs, rows):
    assert spark_runs(docs) == brute_rows(rows)


def test_odd_rows(spark, odd_docs, no_docs, wide_docs):
    assert spark_runs(odd_docs) == brute_rows([tuple(r) for r in odd_docs.collect()])
    assert runs.find_runs(no_docs).collect() == []
    wide, names = wide_docs
    clash = wide.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    done = runs.find_runs(clash)
    assert {"runs", "collapsed", "_runs", "_collapsed", *names} <= set(done.columns) and done.count() == wide.count()
    blank = spark.createDataFrame([(1, ""), (2, None), (3, " \t\n")], "doc_id long, text string").coalesce(1)
    assert spark_runs(blank) == brute_rows([(1, ""), (2, None), (3, " \t\n")])


def test_a_very_long_text(spark):
    draw = random.Random(2)
    words = [f"w{draw.randrange(3000)}" for _ in range(300_000)] + [f"p{i}" for i in range(70_000)] * 3 + ["end"]
    found = runs.find_runs(spark.createDataFrame([(1, " ".join(words)), (2, "a b " * 9)], "doc_id long, text string").coalesce(1)).collect()
    long = next(r for r in found if r["doc_id"] == 1)
    assert [tuple(x) for x in long["runs"]] == [(300_000, 210_000, 70_000)] and long["n_words"] == 510_001
    assert long["collapsed"] == " ".join(words[:370_000] + ["end"])
    assert [tuple(x) for x in next(r for r in found if r["doc_id"] == 2)["runs"]] == [(0, 18, 2)]


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark, rows):
    folder = tmp_path_factory.mktemp("runs")
    more = [*rows, *((1000 + i, " ".join(f"w{(i * j) % 37}" for j in range(i))) for i in range(80)), (None, "a " * 20), (7, "b c " * 20), (7, "b c " * 20)]
    spark.createDataFrame(more, "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
    return str(folder), more


def test_query_against_brute_force(spark, sf):
    folder, rows = sf
    want = []
    for id_, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), None if id_ is None else zlib.crc32(str(id_).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute(words)
        s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        want.append((id_, len(found), s, length, q, None if q is None else 1000 * length // q, digest, hashlib.sha256(kept(words, found).encode()).hexdigest()))
    assert sorted(map(tuple, runs.op11_runs(spark, folder).collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 10
