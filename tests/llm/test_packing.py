import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing


@given(st.lists(st.integers(1, 16), max_size=60))
@settings(max_examples=60, deadline=None)
def test_first_fit_decreasing_is_first_fit(sizes):
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if at == len(room):
            room.append(16)
        room[at] -= sizes[i]
        want[i] = at
    assert packing.first_fit_decreasing(sizes, 16) == [want[i] for i in range(len(sizes))]


def test_memory_is_bounded_by_bytes(public):
    import random

    draw, mine = random.Random(8), packing.Tokenizer(packing.word_bpe(), 2, most_bytes=300_000)
    run = lambda n: "".join(draw.choices("abcdefghijklmnop1234567890-_/", k=n)).encode()
    for _ in range(12):
        texts = [b" ".join(run(n) for n in (5, 9, 20, 20_000)) for _ in range(20)]
        for text, ids in zip(texts, mine.ids(texts)):
            assert np.frombuffer(ids, mine.type).tolist() == public.encode(text.decode(), add_special_tokens=False).ids + [2]
        kept = [sum(len(r) + len(i) + mine.ENTRY for r, i in memory.items()) for memory in (mine.known, mine.older)]
        assert mine.held == pytest.approx(kept[0], rel=0.2, abs=20_000) and max(kept) < 400_000
        assert max(map(len, mine.known)) <= mine.LONG


@given(st.lists(st.integers(1, 16), max_size=60))
@settings(max_examples=60, deadline=None)
def test_fill_covers_all_without_padding(sizes):
    plan = packing.fill(sizes, 16)
    cells = sorted((item, start + k) for pieces in plan for item, start, length in pieces for k in range(length))
    assert cells == [(i, k) for i, n in enumerate(sizes) for k in range(n)]
    totals = [sum(p[2] for p in pieces) for pieces in plan]
    assert all(t == 16 or t & (t - 1) == 0 for t in totals) and sum(t < 16 for t in totals) <= 4


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.word_bpe())


TEXTS = ["<| ABC Def, GHI!! ÄÖ. jkl <|endoftext|>mno PQR", "<|startoftext|> A\x1cb É Straße ΑΣ É\x01x \x01 it's 3rd wide <|ENDOFTEXT|>", "\x01", "", None, "it's the&&& don' Éé… naïve— a1 1a \x01x ﬁ ① ª don't. l'été ''s 's", "x" * 5000, "a b " * 9000, "Å é 한글 한"]


def test_tokenizer_is_the_public_one(public):
    mine = packing.Tokenizer(packing.word_bpe(), 2, most_bytes=500)
    for _ in range(2):
        for text, ids in zip(TEXTS, mine.ids([t if t is None else t.encode() for t in TEXTS])):
            assert np.frombuffer(ids, mine.type).tolist() == public.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("group_rows,group_tokens", [(4000, 4_000_000), (7, 4_000_000), (4000, 3000)])
def test_round_trip(spark, docs, rows, public, group_rows, group_tokens):
    given = [*rows, *((1000 + i, t) for i, t in enumerate(TEXTS))]
    frame = docs.union(spark.createDataFrame(given[len(rows) :], "doc_id long, text string"))
    found = packing.pack_documents(frame, packing.word_bpe, group_rows=group_rows, group_tokens=group_tokens).collect()
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    for doc, text in given:
        parts = sorted(pieces[doc], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in parts]).tolist()
        assert ids == public.encode(text or "", add_special_tokens=False).ids + [2]
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist() and {r["doc_tokens"] for r in parts} == {len(ids)}
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in parts)
        assert [r["offset"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist() and (total == 4096 or total < 4096 and total & (total - 1) == 0)


def test_equal_rows_in_many_turns_share_no_place(spark):
    frame = spark.range(9000).selectExpr("7L doc_id", "'a b c d e' text")
    found = packing.pack_documents(frame, packing.word_bpe, capacity=16, group_rows=50, group_tokens=8)
    assert found.groupBy("sequence_id", "offset").count().where("count > 1").isEmpty()
    assert found.agg({"length": "sum"}).first()[0] == found.where("start = 0").agg({"doc_tokens": "sum"}).first()[0]


def test_a_group_without_room_for_its_sequences_fails(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BITS", 3)
    frame = spark.range(9).selectExpr("id doc_id", "'a b c d e f g h' text")
    with pytest.raises(Exception, match="more sequences in a group"):
        packing.pack_documents(frame, packing.word_bpe, capacity=4).collect()


def test_edges(odd_docs, no_docs, wide_docs, rows):
    assert packing.pack_documents(no_docs, packing.word_bpe).count() == 0
    assert packing.pack_documents(odd_docs, packing.word_bpe).where("start = 0").count() == odd_docs.count()
    assert packing.pack_documents(wide_docs[0], packing.word_bpe).select("doc_id").distinct().count() == len(rows)
