import pytest
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.functions import encodings as E
from millrace.operators import chunking, index
from millrace.plans.queries import byte_bpe
from millrace.sources import files as S

TEXTS = [["Hello there, world!", "naïve café 한글", "<|endoftext|> stays text", "", " \n\t", "x" * 3000], [], ["it's 12345 o'clock", None], None]


def public():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    known = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    return lambda text: len(known.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_counts_are_those_of_the_other_library(spark, most):
    count = public()
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t array<string>").repartition(2)
    found = {r["i"]: r["n"] for r in rows.select("i", E.exact_counts(byte_bpe, most)(F.col("t")).alias("n")).collect()}
    assert found == {i: None if t is None else [count(x) for x in t] for i, t in enumerate(TEXTS)}


def test_whole_documents(spark):
    count = public()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = docs.select("text", E.exact_counts(byte_bpe)(F.array("text")).alias("n")).collect()
    assert all(r["n"] == [count(r["text"])] for r in found)


def brute_chunks(sizes, most, shared):
    out, i = [], 0
    while i < len(sizes):
        j, used = i + 1, sizes[i]
        while j < len(sizes) and used + sizes[j] <= most:
            used += sizes[j]
            j += 1
        out.append((i, j))
        k, back = j, 0
        while k - 1 > i and back + sizes[k - 1] <= shared:
            k -= 1
            back += sizes[k]
        i = k
    return out


def test_chunks_keep_the_budget(spark):
    count = public()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", chunking.T.sentences(F.col("text")).alias("sentences")).limit(40).cache()
    made = chunking.create_chunks(docs, "token", token_size=64, token_overlap=12, counts=E.exact_counts(byte_bpe)).collect()
    for r in docs.collect():
        clean = [s.strip() for s in r["sentences"] if s.strip()]
        want = [(a, " ".join(clean[a:b])) for a, b in brute_chunks([count(s) for s in clean], 64, 12)]
        assert [(c["first_sentence"], c["text"]) for c in sorted((c for c in made if c["doc_id"] == r["doc_id"]), key=lambda c: c["chunk_id"])] == want


def test_refresh_counts_exactly(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Extraordinarily incomprehensible. Short one. Another short one.")
    settings = Settings(chunking_method="token", token_chunk_size=8, token_chunk_overlap=0)
    store = index.Store(spark, str(tmp_path / "store"))
    index.refresh(store, S.scan_files(spark, str(tmp_path / "in")), S.read_blocks, "c", settings, counts=E.exact_counts(byte_bpe))
    count = public()
    documents = [r["document"] for r in store.chunks("c").orderBy("chunk_id").collect()]
    assert len(documents) > 1 and all(count(t) <= 8 + 2 for t in documents)


def test_a_batch_is_encoded_a_few_texts_at_a_time(monkeypatch):
    import types

    import pyarrow as pa

    from millrace.functions import encodings
    from tests.test_chunking import held

    monkeypatch.setattr(encodings, "encoding", lambda *_: types.SimpleNamespace(encode_ordinary_batch=lambda texts, num_threads: [t.split() for t in texts]))
    monkeypatch.setattr(encodings.F, "when", lambda *_: None)
    texts = pa.array([[f"{i} {k} " * 20 for k in range(100)] for i in range(200)])
    found, peak = held(monkeypatch, encodings, lambda: encodings.exact_counts(lambda: ("", ""))(types.SimpleNamespace(isNotNull=lambda: None)), [texts])
    assert found.to_pylist() == [[40] * 100] * 200 and peak < 4_000_000
