import hashlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import spotsigs as S

COMMON = set(S.COMMON)


def chains(text, chain=2):
    """(anchor, words) of each chain; None anchors those of stretches without common words."""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    cut = [["^"]]
    for w in words:
        if w in COMMON:
            cut.append([])
        cut[-1].append(w)
    cut = [p for p in cut if len(p) > 1]
    plain = lambda ws: [(None, *ws[i : i + chain + 1]) for i in range(len(ws))]
    if not cut:
        return plain(words)
    out = [x for p in cut if len(" ".join(p)) + 1 > S.LONG_STRETCH for x in plain(p[1:])]
    for i, p in enumerate(cut):
        later = [q[1] for q in cut[i + 1 : i + chain]]
        out.append((p[0], *(p[1:] + later)[:chain]))
    return out


def signatures(text, chain=2):
    return {(s, k) for s, n in Counter(chains(text, chain) or ([text] if text else [])).items() for k in range(n)}


def likeness(a, b):
    if not a and not b:
        return 1.0
    if not a or not b or min(len(a), len(b)) < S.LENGTH_RATIO * max(len(a), len(b)):
        return 0.0
    return len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]), reverse=True)
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(signatures(text), signatures(edited)), 9), round(likeness(signatures(text), signatures(after)), 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_edits(docs, rows, parts):
    found = S.fingerprint_edits(docs.repartition(parts)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found), key=repr) == brute(rows)
    by_text = {}
    for r in found:
        by_text.setdefault(dict(rows)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())


def test_odd(spark, odd_docs, no_docs, wide_docs, rows):
    assert S.fingerprint_edits(no_docs).count() == 0
    assert S.fingerprint_edits(wide_docs[0]).count() == len(rows)
    found = S.fingerprint_edits(odd_docs).collect()
    assert len(found) == odd_docs.count() and sum(r["doc_id"] is None for r in found) == 2
    least = odd_docs.where("doc_id = 1").agg(F.min("text")).first()[0]
    two = next(r for r in found if r["doc_id"] == 2 and r["n_chars"])
    text = odd_docs.where("doc_id = 2 and text is not null").first()["text"]
    k = len(text) // 3
    assert two["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + least[:k]).encode()).hexdigest()
    alone = spark.createDataFrame([(5, "one two three the four five")], "doc_id long, text string")
    assert S.fingerprint_edits(alone).first()["near_next"] == 1.0


def test_anchored_share(docs, rows):
    found = docs.select("doc_id", S.anchored_share(F.col("text")).alias("s")).collect()
    for r in found:
        all_ = chains(dict(rows)[r["doc_id"]])
        assert r["s"] is None and not [x for x in all_ if x[0]] or r["s"] == pytest.approx(sum(x[0] not in (None, "^") for x in all_) / len(all_))


def test_most_signatures_of_prose_are_anchored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.select(S.anchored_share(F.col("text")).alias("s"), F.char_length("text").alias("n")).where("s is not null and n > 500")
    assert n.agg(F.sum(F.col("s") * F.col("n")) / F.sum("n")).first()[0] > 0.8


def test_pruning_and_partitions(spark):
    frame = spark.createDataFrame([([1], list(range(100))), ([1, 2, 3], [2, 3, 4]), ([], []), ([], [1])], "a array<int>, b array<int>")
    assert [r["x"] for r in frame.select(S.likeness(F.col("a"), F.col("b")).alias("x")).collect()] == [0.0, 0.5, 1.0, 0.0]
    sizes = spark.range(1, 400).select("id", S.length_partition(F.array_repeat(F.lit(1), F.col("id").cast("int")), 0.8).alias("p")).collect()
    part = {r["id"]: r["p"] for r in sizes}
    assert all(abs(part[a] - part[b]) <= 1 for a in part for b in part if min(a, b) >= 0.8 * max(a, b))


def test_a_short_document_within_a_long_next_one(spark):
    words = [f"w{i}" for i in range(1500)]  # no common word among them
    rows = [(2, " ".join(words[:60])), (1, " ".join(words))]
    near = next(r["near_next"] for r in S.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 2)
    a, b = signatures(rows[0][1]), signatures(rows[1][1])
    assert 0 < near < S.LENGTH_RATIO and near == pytest.approx(len(a & b) / len(a | b))


def test_common_words_are_whole():
    assert {"also", "been", "could", "if", "into", "im", "um", "wird", "werden", "ces", "lui", "entre", "sobre"} <= COMMON


def test_no_python_on_the_main_path(spark, docs):
    plan = S.fingerprint_edits(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not regex.search("Python|Pandas|ArrowEval|MapIn", plan)
