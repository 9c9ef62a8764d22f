import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.config import Settings, resolve, result_count
from millrace.operators import admin, index
from millrace.sources import files as S
from millrace.streaming.refresh import watch

NOW = datetime(2024, 1, 2, 3, 4, 5)
SMALL = Settings(chunk_size=2, overlap_size=0)


def docx(path):
    body = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in [("Heading1", "Head"), ("", "Para one. Two.")])
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("One. Two. Three.")
    (root / "sub" / "a.txt").write_text("Other one.")
    (root / "b.html").write_text("<h1>Head</h1><p>Text here.</p>")
    (root / "c.md").write_text("# Title\nBody text.")
    (root / "d.csv").write_text("x,y\n1,2\n")
    (root / "bad.txt").write_bytes(b"\xff\xfe broken")
    (root / "UP.TXT").write_text("not found")
    docx(root / "e.docx")
    (root / "a.txt.meta.json").write_text('{"source_url": "http://x"}')
    (root / "b.html.meta.json").write_text("not json")
    (root / "c.md.meta.json").write_text("[1]")
    return root


def refresh(spark, store, folder):
    return index.refresh(store, S.scan_files(spark, str(folder)), S.read_blocks, "c", SMALL, now=NOW)


def test_scan_and_sidecars(spark, folder):
    names = sorted(r["path"].rsplit("/", 1)[1] for r in S.scan_files(spark, str(folder)).select("path").collect())
    assert names == ["a.txt", "a.txt", "b.html", "bad.txt", "c.md", "d.csv", "e.docx"]
    meta = {r["path"].rsplit("/", 1)[1]: r["meta"] for r in S.sidecars(spark, str(folder)).collect()}
    assert meta["a.txt"] == {"source_url": "http://x"} and meta["b.html"] == {} and not meta["c.md"]
    urls = spark.createDataFrame([({"source_url": ""},), ({"source_url": "u"},), ({},), (None,)], "m map<string,string>").select(S.source_url(F.col("m"), "d").alias("u"))
    assert [r["u"] for r in urls.collect()] == [None, "u", "d", "d"]


def test_plain_readers(spark, folder):
    rows = {r["path"].rsplit("/", 2)[1:][-1] if "sub" not in r["path"] else "sub": (r["text"], r["error"]) for r in S.read_plain(S.scan_files(spark, str(folder))).collect()}
    assert rows["a.txt"] == ("One. Two. Three.", None) and rows["b.html"][0] == "Head Text here." and rows["c.md"][0] == "Title Body text."
    assert rows["d.csv"][0] == "x: 1, y: 2." and rows["e.docx"][0] == "Head\nPara one. Two." and rows["bad.txt"][0] is None and rows["bad.txt"][1]


def test_pdf_needs_a_reader(spark):
    pdf = spark.createDataFrame([("x.pdf", b"%PDF")], "path string, content binary")
    assert S.read_blocks(pdf).first()["kind"] == "error"
    rows = S.sentence_records(S.read_blocks(pdf, lambda c: iter([(1, "prose", "A. B."), (1, "table", "| t |\n| u. v |")]))).orderBy("idx").collect()
    assert [(r["text"], r["page_number"]) for r in rows] == [("A.", 1), ("B.", 1), ("| t |\n| u. v |", 1)]


def test_incremental_runs(spark, folder, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"))
    assert refresh(spark, store, folder) == {"new": 6, "updated": 0, "skipped": 0, "failed": 1, "removed": 0}
    chunks = store.chunks("c").collect()
    assert len({c["id"] for c in chunks}) == len(chunks) == 7 and all(c["ingest_date"] == NOW for c in chunks)
    by_name = {(c["file_name"], c["chunk_id"], c["path"].endswith("sub/a.txt")): c for c in chunks}
    assert by_name["a.txt", 1, False]["document"] == "Three." and by_name["b.html", 0, False]["section_title"] == "Head" and by_name["e.docx", 0, False]["section_title"] == "Head"
    version = store.version()
    again = refresh(spark, store, folder)
    assert again["skipped"] == 6 and again["failed"] == 1
    (folder / "bad.txt").unlink()
    assert refresh(spark, store, folder)["skipped"] == 6
    version = store.version()
    assert refresh(spark, store, folder)["skipped"] == 6 and store.version() == version
    (folder / "a.txt").write_text("New text.")
    (folder / "c.md").unlink()
    assert refresh(spark, store, folder) == {"new": 0, "updated": 1, "skipped": 4, "failed": 0, "removed": 1}
    docs = {c["document"] for c in store.chunks("c").collect()}
    assert "New text." in docs and "Three." not in docs and "Body text." not in docs
    (folder / "a.txt").write_bytes(b"\xff")
    assert refresh(spark, store, folder)["failed"] == 1
    assert "New text." in {c["document"] for c in store.chunks("c").collect()}


def test_status_truth_table(spark):
    known = spark.createDataFrame([("b", "h", "c"), ("c", "x", "c"), ("d", "h", "y"), ("e", None, "c")], "path string, hash string, config_fingerprint string")
    now = spark.createDataFrame([(p, "h") for p in "abcde"], "path string, hash string")
    found = {r["path"]: r["status"] for r in index.file_status(now, known, F.lit("c")).collect()}
    assert found == {"a": "new", "b": "skipped", "c": "updated", "d": "updated", "e": "updated"}


def test_admin(spark, folder, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"))
    assert admin.list_collections(store.manifest(), store.chunks()).count() == 0
    empty = admin.collection_stats(store.manifest(), store.chunks()).first()
    assert (empty["files"], empty["avg_chunks"], empty["min_chunks"]) == (0, 0.0, 0)
    refresh(spark, store, folder)
    row = admin.list_collections(store.manifest(), store.chunks(), "c").first()
    assert (row["chunks"], row["files"], row["last_indexed"], row["fingerprint"], row["active"]) == (7, 6, "2024-01-02 03:04:05", index.fingerprint(SMALL), True)
    assert admin.list_collections(store.manifest().limit(0), store.chunks()).first()["fingerprint"] == "0 mixed"
    stats = admin.collection_stats(store.manifest("c"), store.chunks("c")).first()
    assert (stats["chunks"], stats["files"], stats["max_chunks"]) == (7, 6, 2)
    assert [(r["ext"], r["files"]) for r in admin.extension_counts(store.manifest("c")).collect()][0] == (".txt", 2)
    assert "section_title" in {r["key"] for r in admin.metadata_keys(store.chunks("c")).collect()}
    shown = admin.inspect_files(store.manifest("c"), "A.TX")
    assert shown.count() == 2 and admin.footer(shown).first()["total"] == "2 files, 3 chunks"
    with pytest.raises(ValueError):
        store.drop("c", "other")
    assert store.exists("c") and store.open("c").count() == 7
    store.drop("c", "c")
    assert not store.exists("c")
    with pytest.raises(ValueError):
        store.open("c")


def test_stream_takes_new_files(spark, folder, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"))
    for n, text in ((7, None), (8, "Late file.")):
        if text:
            (folder / "z.txt").write_text(text)
        watch(spark, str(folder), store, "c", str(tmp_path / "check"), SMALL).awaitTermination()
        assert store.chunks("c").count() == n


def test_settings():
    assert resolve(None, True) and not resolve(False, True)
    assert [result_count(x) for x in (None, 0, "7", "x", -3)] == [5, 1, 7, 5, 1]
    assert index.fingerprint(Settings()) != index.fingerprint(Settings(embedding_model="other"))


def test_files_become_chunks_without_their_sentences_being_shuffled_again(spark):
    from millrace.config import Settings
    from millrace.operators import index
    from millrace.sources import files as S

    made = spark.createDataFrame([("a.txt", bytearray(b"One. Two! Three? Four.")), ("b.md", bytearray(b"# H\n\nFive. Six.\n\n- Seven.\n")), ("c.txt", bytearray(b" \n"))], "path string, content binary")
    blocks, now = S.read_blocks(made), F.lit("2024-01-02").cast("timestamp")
    rows = lambda records: index.chunk_rows(records, Settings(chunk_size=2, overlap_size=1), "c", now)
    whole = rows(S.sentence_arrays(blocks))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, rows(S.sentence_records(blocks)).collect()), key=str) and whole.count() == 7
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "explode" not in plan
