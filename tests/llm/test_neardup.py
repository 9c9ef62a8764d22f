import itertools
import re

import numpy as np
import pytest

from millrace.llm import common, neardup


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, part, whole):
    """(n_shingles, component) of each row, ids under several texts linked."""
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(d, shingles(t, size)) for d, t in rows]
    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if whole * len(x & y) >= part * len(x | y):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return sorted(((d, len(s), root(d) if d is not None and s else d) for d, s in sets), key=repr)


@pytest.mark.parametrize("size,part,block", [(3, 85, 2000), (5, 80, 2000), (3, 85, 4), (2, 60, 6)])
def test_components(docs, rows, size, part, block):
    found = neardup.near_components(docs, size, (part, 100), block=block)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr)
    assert got == brute(rows, size, part, 100)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())
    assert sum(r[0] != r[2] for r in got) > 10


def test_a_chain_of_near_copies_is_one_group(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words[(i * 7) % 200] = f"new{i}"
        rows.append((1000 - i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for block in (2000, 8):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_components(frame, 3, (85, 100), block=block).collect()), key=repr)
        assert got == brute(rows, 3, 85, 100)


def test_a_large_group_of_near_copies_is_not_sent_to_its_own_blocks(spark, monkeypatch):
    def text(i):
        words = [f"w{k}" for k in range(120)]
        words[i % 117] = f"new{i}"
        return " ".join(words)

    frame = spark.createDataFrame([(i, text(i)) for i in range(20_000)], "doc_id long, text string").repartition(8)
    sent, met = [], neardup.met
    monkeypatch.setattr(neardup, "met", lambda *a: sent.append(met(*a)) or sent[-1])
    got = neardup.near_components(frame, 3, (85, 100)).groupBy("component_id").count().collect()
    assert {r["component_id"]: r["count"] for r in got} == {0: 20_000}
    assert len(sent) == 1 and sent[0].isEmpty()


def test_what_meets_of_documents_that_share_a_passage_does_not_grow_with_its_square(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(200))

    def text(i):
        own = " ".join(f"d{i}w{k}" for k in range(60))
        return passage + " " + own if i % 2 else own + " " + passage

    def copy(i):
        return text(i).replace(f"d{i}w30", "other")

    sent, met = [], neardup.met
    monkeypatch.setattr(neardup, "met", lambda *a: sent.append(met(*a)) or sent[-1])
    made = []
    for n in (400, 1600):
        sent.clear()
        frame = spark.createDataFrame([(i, text(i)) for i in range(n)] + [(n + i, copy(i)) for i in range(20)], "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_components(frame, 3, (85, 100), block=100).collect()}
        assert got == {i: i if i < n else i - n for i in range(n + 20)}
        made.append(sum(f.count() for f in sent))
    assert made[1] < 5 * made[0] + 2000


def test_many_subgroups_in_a_large_candidate_group_lose_no_link(spark):
    def text(i, edits):
        words = [f"p{k}" for k in range(70)] + [f"s{i % 12}w{k}" for k in range(50)]
        for k in edits:
            words[k] = f"e{i}"
        return " ".join(words)

    rows = [(i, text(i, [(7 * i) % 120] + [(11 * i + 3) % 120] * (i % 3 == 0))) for i in range(120)]
    for block in (2000, 40, 12):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_components(frame, 3, (85, 100), block=block).collect()), key=repr)
        assert got == brute(rows, 3, 85, 100)


def test_linked_sets_meet_in_their_prefixes_where_one_is_not_outer():
    draw = np.random.default_rng(5)
    linked = 0
    for _ in range(3000):
        whole = np.unique(draw.integers(0, 2**60, int(draw.integers(1, 60)), np.uint64))
        x, y = (np.unique(np.where(draw.random(len(whole)) < 0.06, draw.integers(0, 2**60, len(whole), np.uint64), whole)) for _ in "xy")
        x = x[draw.random(len(x)) < 0.97] if len(x) > 3 else x
        if not len(x) or not len(y):
            continue
        often = np.sort(draw.choice(whole, len(whole) // 2, replace=False))
        counts = draw.integers(2, 5, len(often))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            (a, far_a), (b, far_b) = neardup.rarest(x, often, counts, 85, 100), neardup.rarest(y, often, counts, 85, 100)
            met = [k for k in a.tolist() if k in set(b.tolist())]
            assert any(not (far_a[a.tolist().index(k)] and far_b[b.tolist().index(k)]) for k in met)
            linked += 1
    assert linked > 500


def test_rows_of_the_most_frequent_component_meet_only_others(spark):
    rows = [("a", i, 0) for i in range(50)] + [("a", 50 + i, 50 + i) for i in range(9)] + [("b", i, 0) for i in range(30)] + [("c", 1, 1), ("c", 2, 2)]
    tasks = neardup.met(spark.createDataFrame(rows, "key string, node long, root long"), "key", 5).collect()
    assert {t["key"] for t in tasks} == {"a", "c"}
    at = {}
    for t in tasks:
        at.setdefault((t["key"], t["i"], t["j"]), []).append((t["node"], t["side"], t["root"]))
    seen = {(k[0], *sorted((x, y))) for k, g in at.items() for x, s, _ in g for y, o, _ in g if x != y and (k[1] == k[2] or s != o)}
    roots = {(k, n): r for k, n, r in rows}
    assert {(k, x, y) for k, x, y in seen if roots[k, x] != roots[k, y]} == {(k, x, y) for k, x, r in rows for l, y, q in rows if k == l and x < y and r != q}
    assert not any(k == "a" and x < 50 and y < 50 for k, x, y in seen)


def test_outer_rows_meet_only_others(spark):
    rows = [("a", i, i % 7, i > 2) for i in range(40)] + [("b", i, i, True) for i in range(30)] + [("c", 1, 1, False), ("c", 2, 2, True)]
    tasks = neardup.met(spark.createDataFrame(rows, "key string, node long, root long, outer boolean"), "key", 5).collect()
    at = {}
    for t in tasks:
        at.setdefault((t["key"], t["i"], t["j"]), []).append((t["node"], t["side"]))
    seen = {(k[0], *sorted((x, y))) for k, g in at.items() for x, s in g for y, o in g if x != y and (k[1] == k[2] or s != o)}
    assert {k for k, _, _ in seen} == {"a", "c"} and ("c", 1, 2) in seen
    assert {s for s in seen if s[0] == "a"} == {("a", x, y) for x in range(3) for y in range(x + 1, 40)}


def test_odd(odd_docs, no_docs, wide_docs, rows):
    found = [tuple(r) for r in neardup.near_components(odd_docs, 3, (85, 100)).collect()]
    assert len(found) == odd_docs.count()
    assert all(c is None and k for d, _, c, k in found if d is None)
    assert {(d, c) for d, _, c, _ in found if d is not None} == {(1, 1), (2, 2), (3, 2), (4, 4)}
    assert neardup.near_components(no_docs).count() == 0
    assert neardup.near_components(wide_docs[0]).count() == len(rows)


def test_rule_misses_less_than_one_in_a_million():
    from math import comb

    for s in (0.8, 0.85, 0.95):
        least = neardup.least_matches(s, 64)
        below = [sum(comb(64, k) * s**k * (1 - s) ** (64 - k) for k in range(n)) for n in (least, least + 1)]
        assert below[0] < 1e-6 <= below[1]


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 3), (9, 5), (None, 4), (7, 8), (8, 7)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 9: 3, 7: 7, 8: 7}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_id_with_several_texts_loses_no_link(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(words)), (1, "short"), (1, "another text of some words"), (1, " ".join(words)), (9, " ".join([*words[:60], "new", *words[61:]])), (7, "another text of some words")]
    for order in (rows, rows[::-1]):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_components(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 3, (85, 100)).collect()), key=repr)
        assert got == [(1, 1, 1), (1, 118, 1), (1, 118, 1), (1, 3, 1), (7, 3, 1), (9, 118, 1)]
