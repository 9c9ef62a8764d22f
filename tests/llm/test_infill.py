import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(id_, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return id_, n, "plain", None, None, text
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return id_, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return id_, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def marked():
    draw = random.Random(1)
    texts = ["".join(draw.choices("ab é<>PSM\t\n한𝄞", weights=[5, 5, 4, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1], k=draw.choice([0, 1, 2, 5, 40, 63, 64, 65, 128, 500, 3000]))) for _ in range(240)]
    rows = [(i if i % 50 else None, t) for i, t in enumerate([*texts, None, "", " ", "  a ", "<P", "x<P><", "\x0b\x0c", "\x1f\x85\xa0"])]
    return rows * 2


@pytest.mark.parametrize("chunk", [1 << 16, 7, 64, 200])
def test_against_brute_force(spark, marked, chunk):
    """The same results whether texts are scanned in place or in pieces over all tasks, whose borders fall anywhere."""
    done = infill.fill_in_middle(spark.createDataFrame(marked, "doc_id long, text string").repartition(3), chunk_bytes=chunk)
    found = done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "infill", infill.restore(F.col("infill"), F.col("form")), F.coalesce("text", F.lit(""))).collect()
    assert sorted((tuple(r[:6]) for r in found), key=repr) == sorted((brute(*r) for r in marked), key=repr)
    assert all(r[6] == r[7] for r in found) and {r[2] for r in found} == {"plain", "spm", "psm"}


@given(st.lists(st.text(alphabet="a <PM>\n", max_size=200), min_size=1, max_size=5), st.integers(0, 300))
@settings(max_examples=100, deadline=None)
def test_functions_compose(texts, at):
    """The scan of a text's two parts, the second entered as the first is left, is the scan of the text, from every start state."""
    whole = "".join(texts).encode()
    at = min(at, len(whole))
    data = np.frombuffer(whole or b" ", np.uint8)
    for q in range(infill.STATES):
        state, count = [q], 0
        for a, b in ((0, at), (at, len(whole))):
            left, n = infill.Scan(data, np.array([a]), np.array([b])).totals(np.array(state))
            state, count = left.tolist(), count + int(n[0])
        left, n = infill.Scan(data, np.array([0]), np.array([len(whole)])).totals(np.array([q]))
        assert (left.tolist(), int(n[0])) == (state, count)
        slow, ends = q, 0
        for byte in whole:
            kind = int(infill.tables()[0][byte])
            ends += infill.step(slow, kind)[1]
            slow = infill.step(slow, kind)[0]
        assert (slow, ends) == (state[0], count)


def test_a_giant_text_is_dealt_out(spark):
    body = "".join(f" w{i}" if i % 7 else f"\t\n é{i}" for i in range(400_000))
    rows = [(i, body + str(i)) for i in range(6)] + [(9, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = infill.fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "infill").collect()
    assert sorted(map(tuple, found)) == sorted(brute(*r) for r in rows)


def test_odd_rows(odd_docs, no_docs, wide_docs, rows):
    take = lambda df: sorted(map(tuple, infill.fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "infill").collect()), key=repr)
    assert take(odd_docs) == sorted((brute(r["doc_id"], r["text"]) for r in odd_docs.collect()), key=repr)
    assert infill.fill_in_middle(no_docs).collect() == []
    wide, names = wide_docs
    done = infill.fill_in_middle(wide.withColumns({c: F.lit("x") for c in ("n", "form", "infill", "_found", "_key", "key", "one")}), chunk_bytes=100)
    assert {*names, "_n", "_form", "_infill", "n", "form"} <= set(done.columns)
    assert sorted((tuple(r) for r in done.select("doc_id", "_n", "_form", "prefix_chars", "middle_chars", "_infill").collect()), key=repr) == sorted((brute(*r) for r in rows), key=repr)
