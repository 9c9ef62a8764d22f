import numpy as np
import pytest

from millrace.llm import frequent as Fq
from millrace.llm import recompression, substrings

U = np.uint64


def test_frequent_hashes_come_last():
    draw = np.random.default_rng(1)
    common, rare = draw.integers(0, 2**63, 50, U) * U(2), draw.integers(0, 2**63, 500, U) * U(2)
    table = Fq.Frequent(np.concatenate([np.repeat(common, 12), rare]), 10)
    assert set((table.last(common) & Fq.LAST) != 0) == {True} and set((table.last(rare) & Fq.LAST) != 0) == {False}
    assert np.array_equal(table.last(common) & ~Fq.LAST, common >> U(1))
    nothing = Fq.Frequent(np.empty(0, U), 10)
    assert np.array_equal(nothing.last(rare), rare >> U(1))


def test_sample_is_the_same_at_every_partitioning(spark, docs, odd_docs, no_docs):
    one, other = (Fq.sampled_texts(docs.repartition(n), 20, 20_000) for n in (1, 9))
    assert one == other and 15 <= len(one) <= 20
    assert Fq.sampled_texts(no_docs, 20, 100) == [] and all(t is not None for t in Fq.sampled_texts(odd_docs, 20, 20_000))
    many = spark.range(5000).withColumnRenamed("id", "doc_id")
    from pyspark.sql import functions as F

    want = [r[0] for r in many.orderBy(F.xxhash64("doc_id"), "doc_id").limit(30).collect()]
    assert [r[0] for r in Fq.least_hashed(many, 30, 5000).collect()] == want


@pytest.mark.parametrize("texts", [[], ["one two"], ["a common passage of text " * 8 + str(i) for i in range(40)]])
def test_frequent_content(texts):
    grams, symbols = substrings.frequent_grams(texts), recompression.frequent_symbols(texts, 3)
    assert bool(len(grams.values)) == bool(len(symbols.values)) == (len(texts) > 2)
