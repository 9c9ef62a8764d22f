import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P

from .test_neardup import brute as brute_near
from .test_repeats import brute_lines
from .test_scans import brute_hits

SF = "/root/testdata/sf0.001"


def columns(frame):
    return [(c, t) for c, t in frame.dtypes]


def test_stages_follow_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw = columns(docs)
    kept = P.quality(spark, docs, SF).cache()
    assert columns(kept) == raw and 0 < kept.count() < docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id")
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.95 * good.count()

    lines = P.line_dedup(spark, kept, SF).cache()
    assert columns(lines) == raw and lines.where(F.col("n_chars") != F.char_length("text")).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted((r["doc_id"], r["text"]) for r in lines.collect()) == sorted((r[0], r[4]) for r in brute_lines(rows))

    near = P.near_dedup(spark, lines, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    assert columns(near) == raw
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(d for d, _, c in brute_near(rows, 5, 80, 100) if d == c)

    clean = P.decontamination(spark, near, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in near.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert columns(clean) == raw
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, n, h, _ in brute_hits(rows, items) if not (h and 20 * h >= n))

    packed = P.packing(spark, clean, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    assert sorted(map(tuple, P.run(spark, SF).drop("sequence_id", "offset", "ids").collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset", "ids").collect()))


@pytest.mark.parametrize("stage", [s for s, _ in P.STAGES])
def test_stages_take_odd_documents(spark, odd_docs, no_docs, stage):
    more = {"lang": "string", "source": "string", "n_chars": "bigint", "pos": "int", "id": "string", "_quality": "double"}
    for frame in (odd_docs, no_docs):
        wide = frame.select("*", *[F.lit(None).cast(t).alias(c) for c, t in more.items()])
        out = dict(P.STAGES)[stage](spark, wide, SF)
        assert stage == "packing" or out.columns == wide.columns
        assert stage == "quality" and out.count() <= frame.count() or (out.count() == 0) == (frame is no_docs)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
