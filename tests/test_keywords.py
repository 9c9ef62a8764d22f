import random

import pytest
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.operators import index, keywords, search
from millrace.sources import files as S
from tests.test_search import okapi

SCHEMA = "collection string, id string, document string"


def chunk(spark, rows, collection="c"):
    made = spark.createDataFrame([(collection, i, t) for i, t in rows], SCHEMA)
    known = {c.strip().split()[0]: c.strip().split()[1] for c in index.CHUNKS.split(", ")}
    return made.select(*[F.col(c) if c in made.columns else F.lit(i if c == "path" else None).cast(t).alias(c) for i, (c, t) in enumerate(known.items())])


def say(draw, n, words):
    return " ".join(draw.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """A store after adds, updates, removals, a second collection and a merge, and the texts that it should hold."""
    draw = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    store = index.Store(spark, str(tmp_path_factory.mktemp("index") / "store"), indexed=True)
    texts = {f"d{i:03}": say(draw, draw.choice([1, 4, 30, 200]), words) for i in range(150)} | {"d900": "", "d901": None}
    store.upsert(chunk(spark, texts.items()))
    store.upsert(chunk(spark, [(f"d{i:03}", "w1 w2 rare words") for i in range(30)], "other"))
    new = {f"d{i:03}": say(draw, 50, words[40:]) for i in range(0, 150, 4)} | {"d950": "brandnew w3 w3"}
    store.upsert(chunk(spark, new.items()))
    texts |= new
    store.compact()
    gone = [f"d{i:03}" for i in range(0, 150, 7)]
    store.delete(spark.createDataFrame([("c", i) for i in [*gone, "none"]], "collection string, id string"))
    return store, {i: t or "" for i, t in texts.items() if i not in gone}, words


def ask(spark, draw, words, n=12):
    return [(k, say(draw, draw.choice([1, 2, 5]), words)) for k in range(n)] + [(90, "nothing of it"), (91, ""), (92, "w0 w0 w5"), (93, "brandnew"), (94, None)]


def test_index_equals_the_formula_after_changes(spark, changed):
    store, texts, words = changed
    asked = ask(spark, random.Random(5), words)
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index_ = store.keywords("c")
    for prune in (True, False):
        found = index_.top(queries, 7, places=9, first=1, prune=prune).collect()
        for k, query in asked:
            want = okapi(list(texts.items()), query or "")
            order = sorted(want, key=lambda i: (-round(want[i], 9), i))[:7]
            got = sorted((r["rank"], r["id"], r["score"]) for r in found if r["query_id"] == k)
            assert [g[1] for g in got] == order and [g[2] for g in got] == pytest.approx([want[i] for i in order], abs=1e-8)


def test_statistics_are_those_of_what_is_there(spark, changed):
    store, texts, _ = changed
    index_ = store.keywords("c")
    df = {}
    for t in texts.values():
        for w in set(t.lower().split()):
            df[w] = df.get(w, 0) + 1
    assert {r["term"]: r["df"] for r in index_.read("terms").collect()} == df
    spread = {}
    for n in df.values():
        spread[n] = spread.get(n, 0) + 1
    assert {r["df"]: r["terms"] for r in index_.read("spread").collect()} == spread
    assert {r["what"]: r["total"] for r in index_.read("corpus").collect()} == {"docs": len(texts), "words": sum(len(t.split()) for t in texts.values())}
    assert sorted(r["id"] for r in index_.ids().collect()) == sorted(texts)


def test_same_as_without_an_index(spark, changed):
    store, texts, words = changed
    queries = spark.createDataFrame(ask(spark, random.Random(8), words), "query_id long, query string")
    docs = spark.createDataFrame(list(texts.items()), "id string, document string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))
    assert rows(store.keywords("c").top(queries, 5, places=6)) == rows(search.bm25_top(queries, docs, 5, places=6))


def test_same_after_all_is_merged(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"), indexed=True)
    store.upsert(chunk(spark, [(f"d{i}", f"x y{i % 3} z") for i in range(30)]))
    store.upsert(chunk(spark, [(f"d{i}", "x x other") for i in range(0, 30, 3)]))
    store.delete(spark.createDataFrame([("c", "d4"), ("c", "d5")], "collection string, id string"))
    queries = spark.createDataFrame([(1, "x"), (2, "y1 z"), (3, "other")], "query_id long, query string")
    rows = lambda: sorted(map(tuple, store.keywords("c").top(queries, 28, places=6).select("query_id", "rank", "id", "score").collect()))
    before = rows()
    assert len(before) == 84
    for whole in (False, True):
        store.compact(whole)
        assert rows() == before
    assert not any(p["table"].startswith("removed_") for p in store.now().parts)
    store.vacuum(grace=0)
    store.upsert(chunk(spark, [("d4", "x y1 z")]))
    assert len(rows()) == 84 and sorted(r["id"] for r in store.keywords("c").ids().collect()) == sorted(f"d{i}" for i in range(30) if i != 5)


def test_only_the_terms_buckets_are_read(spark, changed):
    store, _, _ = changed
    index_ = store.keywords("c")
    queries = spark.createDataFrame([(1, "w7")], "query_id long, query string")
    asked = index_.weighed(queries, "query_id", "query")
    plan = index_.scores(asked, index_.bounds(asked), 5)._jdf.queryExecution().executedPlan().toString()
    assert index_.buckets == [r[0] for r in spark.sql("select pmod(xxhash64('w7'), 16)").collect()] and "PushedFilters: [In(term" in plan.replace("IsNotNull(term), ", "") or "EqualTo(term" in plan
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("isnotnull(collection#", "x") or "bucket#" in plan
    files = {f for f in index_.postings().inputFiles()}
    assert files and index_.bounds(asked).count() >= 1


def test_cells_are_skipped_by_their_bounds(spark, tmp_path):
    """Many cells, few of which can hold what the first ones do: they are not read, and the result is the whole one."""
    draw = random.Random(6)
    store = index.Store(spark, str(tmp_path / "store"), indexed=True)
    rows = [(f"d{i:05}", " ".join(["hit"] * (9 if i % 100 == 0 else 1) + draw.choices("abcdefgh", k=draw.randint(2, 400)))) for i in range(1500)] + [(f"e{i:05}", "x y") for i in range(3000)]
    with store.log.change() as change:
        keywords.update(change, change.add("chunks", chunk(spark, rows)), cell_docs=20)
    index_ = store.keywords("c")
    queries = spark.createDataFrame([(1, "hit"), (2, "hit a")], "query_id long, query string")
    found = sorted(map(tuple, index_.top(queries, 5).collect()))
    read = {r["query_id"]: (r["n"], r["read"]) for r in index_.work.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.col("chosen").cast("int")).alias("read")).collect()}
    assert read[1][1] < read[1][0] / 2
    assert found == sorted(map(tuple, index_.top(queries, 5, prune=False).collect()))


def test_negative_weights_rank_below_documents_without_the_term(spark, tmp_path):
    rows = [("a", "x y"), ("b", "x y"), ("c", "x y"), ("d", "z")]
    store = index.Store(spark, str(tmp_path / "store"), indexed=True)
    store.upsert(chunk(spark, rows))
    queries = spark.createDataFrame([(1, "x"), (2, "z"), (3, "x z")], "query_id long, query string")
    want = okapi(rows, "x")
    assert min(want.values()) < 0
    for found in (store.keywords("c").top(queries, 3, places=9), search.bm25_top(queries, spark.createDataFrame(rows, "id string, document string"), 3, places=9)):
        got = {k: [r["id"] for r in sorted(found.where(f"query_id = {k}").collect(), key=lambda r: r["rank"])] for k in (1, 2, 3)}
        for k, q in ((1, "x"), (2, "z"), (3, "x z")):
            want = okapi(rows, q)
            assert got[k] == sorted(want, key=lambda i: (-round(want[i], 9), i))[:3]


def test_a_refreshed_store_answers_with_documents(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (("a", "Cats purr. Cats sleep."), ("b", "Dogs bark."), ("c", "Fish swim.")):
        (folder / f"{name}.txt").write_text(text)
    store = index.Store(spark, str(tmp_path / "store"), indexed=True)
    take = lambda: index.refresh(store, S.scan_files(spark, str(folder)), S.read_blocks, "c", Settings(chunk_size=1, overlap_size=0))
    assert take()["new"] == 3
    size = sum(p["bytes"] for p in store.now().parts)
    (folder / "b.txt").write_text("Cats bark too. Dogs do not.")
    (folder / "c.txt").unlink()
    assert take() == {"new": 0, "updated": 1, "skipped": 1, "failed": 0, "removed": 1}
    queries = spark.createDataFrame([(1, "cats"), (2, "fish swim.")], "query_id long, query string")
    hits = store.search(queries, "c", 4, hybrid=True).orderBy("query_id", "rank").collect()
    assert len(hits) == 8 and {h["document"] for h in hits} == {"Cats purr.", "Cats sleep.", "Cats bark too.", "Dogs do not."}
    assert {"distance", "score", "file_name", "path", "chunk_id", "page_number"} <= set(hits[0].asDict()) and hits[0]["document"].startswith("Cats")
    plain = store.search(queries, "c", 2).collect()
    assert len(plain) == 4 and all(h["document"] for h in plain)
    assert store.at(1).chunks("c").where("document = 'Fish swim.'").count() == 1 and size > 0
    store.drop("c", "c")
    assert not store.exists("c") and store.keywords("c").read("terms").count() == 0


def test_no_documents(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"), indexed=True)
    store.upsert(chunk(spark, []))
    queries = spark.createDataFrame([(1, "x")], "query_id long, query string")
    assert store.keywords("c").top(queries, 3).collect() == []


def test_rare_terms_of_a_cell_share_rows(spark, tmp_path):
    """Rows are as many as slots and frequent terms of the cells, not as terms: a term that few documents have is no row of its own."""
    rows = [(f"d{i:03}", " ".join(["common", f"often{i % 2}", *[f"t{i}x{k}" for k in range(100)]])) for i in range(200)]
    store = index.Store(spark, str(tmp_path / "store"), indexed=True)
    store.upsert(chunk(spark, rows))
    stored = store.log.read("postings").where("bucket >= 0")
    cells = store.log.read("postings").where("bucket = -1").count()
    assert stored.select(F.explode("terms").alias("t")).distinct().count() == 20003 and stored.count() <= cells * (keywords.SLOTS + 3)
    assert {r["term"] for r in stored.where("term is not null").collect()} <= {"common", "often0", "often1"}
    found = store.keywords("c").top(spark.createDataFrame([(1, "t7x3 often0"), (2, "T9X99")], "query_id long, query string"), 2, places=9).collect()
    want = {1: okapi(rows, "t7x3 often0"), 2: okapi(rows, "t9x99")}
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found) == sorted((k, n, i) for k, w in want.items() for n, i in enumerate(sorted(w, key=lambda i: (-round(w[i], 9), i))[:2]))


def test_a_list_is_shuffled_once_for_all_queries(spark, changed):
    """Lists meet by cell, whatever the number of queries, and blocks of queries give what all together do."""
    store, _, words = changed
    index_ = store.keywords("c")
    queries = spark.createDataFrame(ask(spark, random.Random(8), words), "query_id long, query string")
    asked = index_.weighed(queries, "query_id", "query")
    cells = index_.bounds(asked)
    whole = index_.scores(asked, cells, 5, 9)
    assert "hashpartitioning(query_id" not in whole._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1].split("bucket#")[0]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(whole) == rows(index_.scores(asked, cells, 5, 9, block_rows=4)) and whole.count()


def test_words_are_the_search_tokens(spark):
    import pyarrow as pa

    texts = [" a  b ", None, "", "\t", "x y z\x1fq　", "Aİ ΣΣ", "a​b﻿ c᠎d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    lowered = [r["t"] for r in docs.orderBy("n").select(F.lower("t").alias("t")).collect()]
    want = [r["t"] for r in docs.orderBy("n").select(keywords.T.tokens(F.col("t")).alias("t")).collect()]
    flat, size = keywords.words(pa.array(lowered, pa.string()))
    assert size.tolist() == [len(w) for w in want] and flat.to_pylist() == [t for w in want for t in w]


def test_texts_are_not_shuffled_for_a_few_removals(spark, tmp_path, monkeypatch):
    store = index.Store(spark, str(tmp_path / "store"), indexed=True)
    store.upsert(chunk(spark, [(f"d{i}", f"x y{i}") for i in range(20)]))
    plans, made = [], keywords.built
    monkeypatch.setattr(keywords, "built", lambda chunks, *a: plans.append(chunks._jdf.queryExecution().sparkPlan().toString()) or made(chunks, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        store.delete(spark.createDataFrame([("c", "d3"), ("c", "none")], "collection string, id string"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[-1] and "SortMergeJoin" not in plans[-1]
    assert sorted(r["id"] for r in store.keywords("c").ids().collect()) == sorted(f"d{i}" for i in range(20) if i != 3)
