import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import prompt as P
from millrace.operators import search as S


def test_fusion(spark):
    vec = spark.createDataFrame([(1, "x", 0, 0.1), (1, "y", 1, 0.2)], "query_id long, id string, rank int, distance double")
    key = spark.createDataFrame([(1, "y", 0), (1, "z", 1)], "query_id long, id string, rank int")
    rows = S.fuse(vec, key).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["y", "x", "z"]
    assert [r["score"] for r in rows] == pytest.approx([1 / 61 + 1 / 60, 1 / 60, 1 / 61])
    assert [r["distance"] for r in rows] == [0.2, 0.1, 0.0]


def okapi(docs, query, k1=1.5, b=0.75):
    toks = {i: t.lower().split() for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return {i: sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in query.lower().split()) for i, t in toks.items()}


@pytest.mark.parametrize("query", ["Red fox", "the the fox", "nothing here", "the"])
def test_bm25_follows_the_formula_and_pads(spark, query):
    docs = [(i, t) for i, t in enumerate(["the red fox", "the dog", "the fox the fox", "a cat and the dog", "birds", "the sea", ""])]
    want = okapi(docs, query)
    order = sorted(want, key=lambda i: (-round(want[i], 9), i))[:5]
    q = spark.createDataFrame([(7, query)], "query_id long, query string")
    rows = S.bm25_top(q, spark.createDataFrame(docs, "id long, document string"), 5, places=9).orderBy("rank").collect()
    assert [r["id"] for r in rows] == order and [r["score"] for r in rows] == pytest.approx([want[i] for i in order], abs=1e-8)


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_nearest_finds_itself(spark, metric):
    data = [(i, [math.cos(i), math.sin(i)]) for i in range(40)]
    stored = spark.createDataFrame(data, "id long, embedding array<double>")
    asked = stored.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    one = S.nearest(asked, stored, 3, metric, places=9).collect()
    many = S.nearest(asked, stored, 3, metric, block_rows=1, places=9).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 12
    assert all(r["id"] == r["query_id"] and abs(r["distance"]) < 1e-9 for r in one if r["rank"] == 0)


def test_unknown_metric():
    with pytest.raises(ValueError):
        S.V.distance(F.col("a"), F.col("b"), "other")


@pytest.mark.parametrize("n,m,stored,want", [(5, 3, 100, 15), (5, 3, 7, 7), (5, 0, 100, 5), (5, 3, 0, 1)])
def test_candidates(n, m, stored, want):
    assert S.candidate_count(n, m, stored) == want


def test_search_embeds_the_hypothetical_text(spark):
    from millrace.functions import vectors as V

    chunks = spark.createDataFrame([("a", "cats purr"), ("b", "dogs bark"), ("c", "fish swim")], "id string, document string").withColumn("embedding", V.embed(F.col("document")))
    asked = spark.createDataFrame([(1, "cats purr", "dogs bark"), (2, "cats purr", "")], "query_id long, query string, embed_text string")
    first = {r["query_id"]: r["id"] for r in S.search(asked, chunks, 1).collect()}
    assert first == {1: "b", 2: "a"}
    both = S.search(asked, chunks, 2, hybrid=True).where("query_id = 1").collect()
    assert {r["id"] for r in both} == {"a", "b"}


def test_hybrid_batch_asks_each_stated_document(spark, monkeypatch):
    from millrace.plans import queries as plans

    d = "/root/testdata/sf0.001"
    asked = plans.documents(spark, d).where("doc_id % 20 = 0").select("doc_id", "text").collect()
    found = plans.hybrid_batch(spark, d).collect()
    assert sorted((r["query_id"], r["rank"]) for r in found) == sorted((a["doc_id"], k) for a in asked for k in range(5))
    for a in asked[:2]:
        monkeypatch.setattr(plans, "one_query", lambda spark, text=a["text"]: spark.createDataFrame([(0, text)], "query_id long, query string"))
        alone = sorted(map(tuple, plans.hybrid_search(spark, d).collect()))
        assert alone == sorted(tuple(r)[1:] for r in found if r["query_id"] == a["doc_id"])


HIT = "query_id long, rank int, file_name string, chunk_id int, document string, page_number int, section_title string, source_url string, ingest_date timestamp"


def test_format_and_fill(spark):
    hits = spark.createDataFrame([(1, 1, None, None, "two {query}", None, "", None, None), (1, 0, "f.txt", 3, "one", 2, "S", "u", None)], HIT)
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    found = {r["query_id"]: r["data"] for r in P.format_hits(hits, asked).collect()}
    rule = "-" * 80
    assert found[1] == f"Document 1:\nFile: f.txt\nChunk ID: 3\nPage: 2\nSection: S\nSource URL: u\nContent: one\n{rule}\nDocument 2:\nFile: N/A\nChunk ID: N/A\nContent: two {{query}}\n{rule}\n"
    assert found[2] == P.NOTHING
    assert spark.range(1).select(P.fill(F.lit("{query}"), F.lit("q"), "{data} - {query}!").alias("p")).first()["p"] == "{query} - q!"
    assert P.fill_text("{query}", "q", "{data} - {query}!") == "{query} - q!" and P.fill_text("d", "{data}", "{query} - {data}") == "{data} - d"


def test_chat_streams_then_trails_then_logs():
    logged = []
    pieces = list(P.chat("hi", [{"id": 1}], "data", lambda p: iter(["a", "", "b"]), log=lambda q, r: logged.append((q, r))))
    assert pieces[:2] == ["a", "b"] and pieces[2].startswith(P.TRAILER) and logged == [("hi", "ab")]

    def broken(_):
        yield "x"
        raise RuntimeError("gone")

    assert list(P.chat("hi", [], "", broken))[-1].startswith(P.TRAILER)
    with pytest.raises(ValueError):
        next(P.chat(" ", [], "", broken))


def test_hypothetical_falls_back():
    def fails(_):
        raise OSError

    assert P.hypothetical("q", None) is None and P.hypothetical("q", fails) is None and P.hypothetical("q", lambda p: "") is None and P.hypothetical("q", lambda p: "text") == "text"


def test_chat_log(spark, tmp_path):
    for i in range(2):
        P.append_log(spark, str(tmp_path / "log"), "q" * 60, f"r{i}")
    rows = P.log_summary(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert len(rows) == 2 and all(len(r["query"]) == 50 for r in rows)


def test_responder_prepares_once():
    ready = []
    model = P.Responder(lambda p: iter([p[-1], "", "!"]), "{data}|{query}", lambda: ready.append(1))
    assert model.respond("d", "q") == "q!" and list(model.chunks("d", "z")) == ["z", "!"] and ready == [1]


@pytest.mark.parametrize("dense", [0, 50, 10**9])
def test_bm25_in_blocks_and_slices_against_brute_force(spark, monkeypatch, dense):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(draw.choices(words, [1 / (k + 1) for k in range(60)], k=draw.choice([0, 1, 5, 40])))) for i in range(120)]
    asked = [(i, docs[i][1]) for i in range(0, 120, 10)] + [(500, "nothing here"), (501, None), (502, "w0 w0 w59")]
    for name, value in (("CELLS", 60), ("PAIRS", 7), ("DENSE", dense)):
        monkeypatch.setattr(S, name, value)
    q, d = spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(docs, "id long, document string").repartition(3)
    for more in ({}, {"block_rows": 4}, {"block_terms": 30}):
        rows = S.bm25_top(q, d, 6, places=6, **more).collect()
        found = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in rows}
        assert len(found) == len(rows) == 6 * len(asked)
        for i, text in asked:
            want = okapi(docs, text or "")
            order = sorted(want, key=lambda x: (-round(want[x], 6), x))[:6]
            assert [found[i, k][0] for k in range(6)] == order and [found[i, k][1] for k in range(6)] == pytest.approx([want[x] for x in order], abs=1e-6)


def test_what_keyword_search_shuffles_does_not_grow_with_the_pairs(spark):
    asked, docs = spark.range(40).selectExpr("id AS query_id", "'a b c' AS query"), spark.range(4000).selectExpr("id", "concat('a b c d', id) AS document").repartition(2)
    weights = spark.createDataFrame([(i, t, 1.0) for i in range(40) for t in "abc"], "query_id long, term string, weight double")
    sent = S.scored_in_batches(weights, asked.select("query_id"), docs.select("id", F.col("id").alias("ord"), F.split("document", " ").alias("tokens")), 3, 4.0, 6)
    assert sent.count() == 40 * 3 * 2


def test_texts_are_cut_once_for_all_blocks_of_queries(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.range(40).select("id", seen(F.concat(F.lit("a b c"), F.col("id") % 7)).alias("document"))
    asked = spark.range(12).selectExpr("id AS query_id", "concat('a c', id) AS query")
    many = S.bm25_top(asked, docs, 3, places=6, block_rows=2).collect()
    assert read.value == 40
    assert sorted(map(tuple, many)) == sorted(map(tuple, S.bm25_top(asked, docs, 3, places=6).collect()))


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_nearest_of_a_task_in_slices_against_brute_force(spark, monkeypatch, metric):
    draw = random.Random(5)
    data = [(i, [draw.choice([-1.0, 0.0, 0.5, 3.0]) for _ in range(3)]) for i in draw.sample(range(900), 300)] + [(1000, None)]
    stored, asked = spark.createDataFrame(data, "id long, vec array<double>").repartition(2), spark.createDataFrame(data[:9] + [(-1, None)], "query_id long, query_vec array<double>")
    monkeypatch.setattr(S, "CELLS", 100)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        assert S.met_in_batches(asked, stored, 4, metric, 6).count() == 9 * 4 * 2
        found = S.nearest(asked, stored, 4, metric, vec="vec", places=6).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    size = lambda v: math.sqrt(sum(x * x for x in v)) or 1e-10
    inner = lambda a, b: sum(x * y for x, y in zip(a, b))
    far = {"l2": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)), "ip": lambda a, b: 1 - inner(a, b), "cosine": lambda a, b: 1 - inner(a, b) / (size(a) * size(b))}[metric]
    for q, v in data[:9]:
        want = sorted((round(far(v, w), 6), i) for i, w in data[:-1])[:4]
        got = sorted((r["rank"], r["distance"], r["id"]) for r in found if r["query_id"] == q)
        assert [r[2] for r in got] == [i for _, i in want] and [r[1] for r in got] == pytest.approx([d for d, _ in want], abs=1e-9)
