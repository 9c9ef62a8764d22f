import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.operators import chunking as C


def chunks(spark, column, sents):
    row = spark.createDataFrame([(sents,)], "s array<string>").select(column.alias("c")).first()
    return [(c["chunk_id"], c["first_sentence"], c["text"]) for c in row["c"]]


@pytest.mark.parametrize("n,size,overlap,starts", [(7, 4, 1, [0, 3, 6]), (40, 40, 5, [0, 35]), (0, 4, 1, [])])
def test_windows(spark, n, size, overlap, starts):
    found = chunks(spark, C.sentence_windows(F.col("s"), size, overlap), [str(i) for i in range(n)])
    assert [f for _, f, _ in found] == starts and [k for k, _, _ in found] == list(range(len(starts)))
    assert all(t == " ".join(str(i) for i in range(f, min(n, f + size))) for _, f, t in found)


def test_windows_refuse_full_overlap():
    with pytest.raises(ValueError):
        C.sentence_windows(F.col("s"), 4, 4)


@pytest.mark.parametrize(
    "counts,most,overlap,want",
    [([3, 3, 3], 6, 0, [(0, 2), (2, 3)]), ([3, 3, 3], 6, 3, [(0, 2), (1, 3), (2, 3)]), ([9, 1], 5, 0, [(0, 1), (1, 2)]), ([], 5, 0, [])],
)
def test_budget(spark, counts, most, overlap, want):
    row = spark.createDataFrame([(counts,)], "c array<int>").select(C.budget_ranges("c", F.lit(most), F.lit(overlap)).alias("r")).first()
    assert [(x["start"], x["stop"]) for x in row["r"]] == want


@given(st.lists(st.integers(1, 9), max_size=30), st.integers(1, 15))
@settings(max_examples=20, deadline=None)
def test_budget_without_overlap_partitions(spark, counts, most):
    row = spark.createDataFrame([(counts,)], "c array<int>").select(C.budget_ranges("c", F.lit(most), F.lit(0)).alias("r")).first()
    found = [(x["start"], x["stop"]) for x in row["r"]]
    assert [i for a, b in found for i in range(a, b)] == list(range(len(counts)))
    assert all(b - a == 1 or sum(counts[a:b]) <= most for a, b in found)


def test_tail_repeats_can_go(spark):
    sents = ["a b c", "d e f", "g h i"]
    assert len(chunks(spark, C.token_chunks(F.col("s"), 6, 3), sents)) == 3
    assert [t for _, _, t in chunks(spark, C.token_chunks(F.col("s"), 6, 3, drop_tail_repeats=True), sents)] == ["a b c d e f", "d e f g h i"]


def test_contexts(spark):
    row = spark.createDataFrame([(["a", "b", "c"],)], "s array<string>")
    assert row.select(C.contexts(F.col("s"), 1).alias("c")).first()["c"] == ["a b", "a b c", "b c"]
    assert row.select(C.contexts(F.col("s"), 0).alias("c")).first()["c"] == ["a", "b", "c"]


def test_semantic_identical_and_cap(spark):
    docs = spark.createDataFrame([(1, ["same words"] * 5), (2, ["only"]), (3, [])], "doc_id long, sentences array<string>")
    rows = C.with_distances(docs)
    cut = lambda **more: rows.select("doc_id", F.inline(C.semantic_chunks(F.col("sents"), F.col("distances"), **more))).collect()
    assert {(r["doc_id"], r["n_sentences"]) for r in cut()} == {(1, 5), (2, 1)}
    assert sorted((r["chunk_id"], r["n_sentences"]) for r in cut(max_sentences=2) if r["doc_id"] == 1) == [(0, 2), (1, 2), (2, 1)]


def test_zero_vector_is_far(spark):
    row = spark.range(1).select(V.cosine_distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d")).first()
    assert row["d"] == 1.0


def test_dispatch(spark):
    docs = spark.createDataFrame([(1, ["a.", "b."])], "doc_id long, sentences array<string>")
    assert C.create_chunks(docs, "sentence").count() == 1 and C.create_chunks(docs, "token").first()["text"] == "a. b."
    assert C.create_chunks(docs, "semantic", make=V.HashEmbedder).count() >= 1
    for bad in ({"method": "other"}, {"method": "semantic"}):
        with pytest.raises(ValueError):
            C.create_chunks(docs, **bad)


def test_first_sentence_metadata(spark):
    docs = spark.createDataFrame([(1, [("a", 1, None), ("b", 2, "S")])], "doc_id long, records array<struct<text: string, page_number: int, section_title: string>>")
    found = spark.createDataFrame([(1, 0, "a", 0), (1, 1, "b", 9)], "doc_id long, chunk_id int, text string, first_sentence int")
    rows = C.first_sentence_metadata(found, docs).orderBy("chunk_id").collect()
    assert [(r["page_number"], r["section_title"]) for r in rows] == [(1, None), (2, "S")]


@pytest.mark.parametrize("parts", [1, 7])
def test_ordered_distances_spread_one_id_over_partitions(spark, parts):
    given_ = [(k, p, [float(p % 7 + 1), float((k or 0) + 1)]) for k in (0, 1, None) for p in range(300 if k == 0 else 3)]
    rows = spark.createDataFrame(given_, "label int, pos int, vec array<double>").repartition(3)
    want = C.adjacent_distances(rows, "label", "pos").select("label", "pos", "distance")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = C.ordered_distances(rows, "label", "pos").withColumn("task", F.spark_partition_id())
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted(map(repr, want.collect())) == sorted(map(repr, (found.drop("task").select("label", "pos", "distance").collect())))
    assert len({r["task"] for r in got if r["label"] == 0}) >= min(parts, 2)
    assert C.ordered_distances(rows.limit(0), "label", "pos").count() == 0


def held(monkeypatch, module, make, columns):
    """What the Arrow function that ``make`` defines gives for columns, and the most bytes that Python and numpy hold meanwhile."""
    import tracemalloc

    grabbed = []
    with monkeypatch.context() as m:
        m.setattr(module.F, "arrow_udf", lambda kind: lambda f: grabbed.append(f) or (lambda *_: None))
        make()
    tracemalloc.start()
    found = list(grabbed[0](iter(columns)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found[0], peak


def test_distances_of_a_batch_are_made_a_few_texts_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rows = [[f"w{i} v{k % 7} u{i % k}" for k in range(1, n + 1)] for i, n in enumerate([0, 1, 150, 64, 65, 2])]
    found, _ = held(monkeypatch, C, lambda: C.context_distances(None), [pa.array([*rows, None])])
    for s, d in zip([*rows, []], found.to_pylist()):
        v = np.array(V.HashEmbedder()(s)).reshape(len(s), 64)
        assert d == pytest.approx([1 - float(v[k] @ v[k + 1]) for k in range(len(s) - 1)] + [None] * bool(s))
    many = pa.array([[f"{i} {k} " * 20 for k in range(100)] for i in range(200)])
    _, peak = held(monkeypatch, C, lambda: C.context_distances(None, lambda: lambda texts: np.ones((len(texts), 64))), [many])
    assert peak < 2_000_000
