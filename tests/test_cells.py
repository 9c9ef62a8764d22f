import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cells as C

SCHEMA = "id long, embedding array<float>"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)], SCHEMA)


def brute(x, q, n, places=6):
    d = np.round(((np.asarray(q, np.float32).astype(float)[:, None] - np.asarray(x, np.float32).astype(float)[None]) ** 2).sum(2), places)
    return {(k, r): (int(i), float(d[k, i])) for k in range(len(q)) for r, i in enumerate(np.lexsort((np.arange(len(x)), d[k]))[:n])}


def found(df):
    return {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in df.collect()}


def asked(spark, q):
    return spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(q)], "query_id long, query_vec array<float>")


@pytest.fixture(scope="module")
def clusters():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(20, 16)) * 4
    x = centres[draw.integers(0, 20, 1500)] + draw.normal(size=(1500, 16)) * 0.5
    return x, x[::50] + draw.normal(size=(30, 16)) * 0.1


@pytest.fixture(scope="module")
def built(spark, clusters):
    return C.VectorCells(frame(spark, clusters[0]), cells=25)


def test_exact_search_is_that_of_all_rows(spark, clusters, built):
    x, q = clusters
    for n, probes in ((5, 1), (1, 2), (40, 1)):
        got = found(built.nearest(asked(spark, q), n, probes, places=6))
        want = brute(x, q, n)
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


def test_bounds_leave_cells_out(spark, clusters, built):
    _, q = clusters
    known = asked(spark, q).select(F.col("query_id").alias("query"), F.col("query_vec").cast("array<double>").alias("vec"))
    near = built.reached(known.withColumn("least", F.lit(4.0)), 5, 1)
    assert near.select("query", "cell").distinct().count() < len(q) * len(built.centres) / 3


def test_probing_finds_nine_of_ten(spark, clusters, built):
    _, q = clusters
    exact = built.nearest(asked(spark, q), 10)
    assert C.recall(built.nearest(asked(spark, q), 10, probes=built.probes_for(10), exact=False), exact) >= 0.9
    assert C.recall(exact, exact) == 1.0


def test_probing_the_given_vectors_by_the_stated_set(spark):
    """Of every 20th stored vector, against all: the recall that README states for the probing form."""
    stored = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = stored.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    index = C.VectorCells(stored)
    probes = index.probes_for(5)
    assert probes <= len(index.centres)
    assert C.recall(index.nearest(queries, 5, probes=probes, exact=False), index.nearest(queries, 5)) >= 0.9


def test_every_row_is_in_a_block_of_its_cell(built):
    rows = built.blocks.collect()
    assert sorted(i for r in rows for i in r["ids"]) == list(range(1500)) and all(0 < len(r["ids"]) <= C.BLOCK for r in rows)
    for r in rows:
        x = np.array(r["vecs"]).reshape(len(r["ids"]), -1)
        gap = np.sqrt(((x - built.centres[r["cell"]]) ** 2).sum(1))
        assert gap == pytest.approx(r["gaps"]) and list(r["gaps"]) == sorted(r["gaps"]) and max(gap) <= built.radius[r["cell"]] + 1e-12


def test_copies_ties_nulls_and_few_rows(spark):
    x = [[1.0, 0.0]] * 700 + [[0.0, 1.0], [0.0, 1.0], [5.0, 5.0]]
    stored = frame(spark, [*x, None, None])
    index = C.VectorCells(stored, cells=3)
    assert index.deals.max() >= 1
    q = [[1.0, 0.0], [1.0, 0.0], [0.1, 0.9], [9.0, 9.0]]
    got = found(index.nearest(asked(spark, q), 4, places=6))
    want = brute(x, q, 4)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    few = C.VectorCells(frame(spark, [[1.0], [2.0]]))
    assert len(found(few.nearest(asked(spark, [[1.5]]), 5))) == 2
    none = C.VectorCells(frame(spark, []))
    assert found(none.nearest(asked(spark, [[1.5]]), 5)) == {}
    nulls = spark.createDataFrame([(1, None), (2, [1.0])], "query_id long, query_vec array<float>")
    assert set(found(few.nearest(nulls, 1))) == {(2, 0)}


def test_what_reaches_every_cell_is_laid_out_in_bounded_batches(spark, monkeypatch):
    import numpy as np

    from millrace.operators import cells

    monkeypatch.setattr(cells, "REACHED", 100)
    index = object.__new__(cells.VectorCells)
    index.centres, index.n, index.radius, index.deals = np.random.default_rng(1).normal(size=(40, 4)), np.full(40, 9), np.full(40, 9.0), np.array([3] + [1] * 39)
    asked, batches = [(k, [float(k), 0.0, 0.0, 1.0], 1e9) for k in range(50)], []

    class Rows:
        dtypes = [("query", "bigint"), ("vec", "array<double>"), ("least", "double")]

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            frame = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*asked)], names=["query", "vec", "least"])
            batches.extend(run([frame]))

    index.reached(Rows(), 5, 2)
    assert max(b.num_rows for b in batches) <= 100
    found = sorted((q, c, d) for b in batches for q, c, d in zip(*[b.column(x).to_pylist() for x in ("query", "cell", "deal")]))
    assert found == sorted((k, c, d) for k in range(50) for c in range(40) for d in range(index.deals[c]))
