import pytest
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.functions import vectors as V
from millrace.operators import index
from millrace.operators.embedding_cache import EmbeddingCache
from millrace.operators.tables import Conflict
from millrace.sources import files as S

SMALL = Settings(chunk_size=1, overlap_size=0)


def logged(log):
    """An embedder that writes down its building and every text that it is given."""

    def make():
        plain = V.HashEmbedder(8)
        with log.open("a") as f:
            f.write("built\n")

        def run(texts):
            with log.open("a") as f:
                f.writelines(f"text {t}\n" for t in texts)
            return plain(texts)

        return run

    return make


def given(log):
    return sorted(x[5:-1] for x in log.open() if x.startswith("text ")) if log.exists() else []


@pytest.fixture
def cache(spark, tmp_path):
    return EmbeddingCache(spark, str(tmp_path / "vectors"), str(tmp_path), logged(tmp_path / "log"))


def test_distinct_texts_are_embedded_once(spark, cache, tmp_path):
    rows = spark.createDataFrame([(i, f"text of {i % 7}") for i in range(100)] + [(100, None), (101, ""), (102, None)], "id long, text string").repartition(6)
    want = {r["id"]: r["v"] for r in rows.select("id", V.embed(F.col("text"), lambda: V.HashEmbedder(8)).alias("v")).collect()}
    for _ in range(2):
        assert {r["id"]: r["embedding"] for r in cache.embedded(rows).collect()} == want
    assert given(tmp_path / "log") == sorted(["", *(f"text of {i}" for i in range(7))])
    assert cache.log.version().number == 1
    more = spark.createDataFrame([(1, "text of 3"), (2, "a new one")], "id long, text string")
    assert cache.embedded(more).count() == 2 and given(tmp_path / "log").count("text of 3") == 1 and cache.log.version().number == 2
    cache.compact()
    assert cache.known().count() == 9 and cache.embedded(rows).count() == 103


def test_models_are_apart_and_newlines_count_as_told(spark, cache, tmp_path):
    rows = spark.createDataFrame([("a\nb",), ("a b",)], "text string")
    assert cache.embedded(rows).count() == 2 and len(given(tmp_path / "log")) == 2
    other = EmbeddingCache(spark, str(tmp_path / "vectors"), "other/model", lambda: V.HashEmbedder(4), flatten_newlines=True)
    assert {len(r["embedding"]) for r in other.embedded(rows).collect()} == {4} and other.known().count() == 1
    assert {len(r["embedding"]) for r in cache.embedded(rows).collect()} == {8} and cache.known().count() == 2


def test_odd_rows(spark, cache):
    none = spark.createDataFrame([], "text string")
    assert cache.embedded(none).count() == 0 and cache.log.version().number == 0
    clashing = spark.createDataFrame([("x", "k", "v", [1.0])], "text string, `key` string, model string, Embedding array<double>")
    found = cache.embedded(clashing)
    assert found.columns == ["text", "key", "model", "embedding"] and len(found.first()["embedding"]) == 8


def test_a_worker_builds_its_model_once(spark, cache, tmp_path):
    for i in range(5):
        cache.add(spark.range(40).repartition(4).select(F.concat(F.lit(f"{i} "), "id").alias("text")))
    assert sum(x == "built\n" for x in (tmp_path / "log").open()) <= 8 and len(given(tmp_path / "log")) == 200


def test_a_second_writer_embeds_only_what_the_first_did_not(spark, cache, tmp_path, monkeypatch):
    rows, commits = spark.createDataFrame([("a",), ("b",)], "text string"), []
    second = EmbeddingCache(spark, cache.log.root, cache.model, cache.make)
    change = second.log.change

    def late(since):
        if not commits:
            commits.append(cache.add(rows.where("text = 'a'")))
        return change(since)

    monkeypatch.setattr(second.log, "change", late)
    assert second.add(rows) == 2 and cache.known().count() == 2
    monkeypatch.setattr(second.log, "change", lambda since: change(second.log.load(1)))
    with pytest.raises(Conflict):
        second.add(spark.createDataFrame([("c",)], "text string"))


def test_a_second_refresh_embeds_nothing(spark, cache, tmp_path):
    root, store, log = tmp_path / "in", index.Store(spark, str(tmp_path / "store")), tmp_path / "log"
    root.mkdir()
    (root / "a.txt").write_text("One. Two. Three.")
    (root / "b.txt").write_text("Two. Four.")
    run = lambda name: index.refresh(store, S.scan_files(spark, str(root)), S.read_blocks, name, SMALL, cache=cache)
    assert run("c")["new"] == 2 and given(log) == ["Four.", "One.", "Three.", "Two."]
    (root / "a.txt").rename(root / "moved.txt")
    (root / "b.txt").write_text("Four. Two. One.")
    assert run("c") == {"new": 1, "updated": 1, "skipped": 0, "failed": 0, "removed": 1}
    assert run("other")["new"] == 2 and len(given(log)) == 4
    plain = {r["document"]: r["v"] for r in store.chunks("c").select("document", V.embed(F.col("document"), lambda: V.HashEmbedder(8)).alias("v")).collect()}
    assert {r["document"]: r["embedding"] for r in store.chunks().collect()} == plain and store.chunks().count() == 12
