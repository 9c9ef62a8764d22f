import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def say(n):
    return " ".join(f"w{i}" for i in range(n))


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by pouring out what is left in small steps of the level: one source after another reaches its limit."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else weight[s] * level for s in names}
        full |= over


def check(found):
    """Sizes, targets, and how near each source comes."""
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["repeats"]
    want = shares(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6


@pytest.fixture(scope="module")
def mixed(spark):
    draw = random.Random(4)
    rows = [(i, say(draw.choice([0, 1, 3, 10, 40])), draw.choice(["a", "a", "a", "b", "B", "é", "z", None, "", "rare" if i % 40 == 0 else "c"])) for i in range(600)]
    rows += [(9000, None, "a"), (None, say(7), "b"), (None, None, None), (9001, "", "empty"), (9002, say(3), "tiny")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def test_sources_come_near_their_targets(mixed):
    found = mixing.mix(mixed).collect()
    check(found)
    assert len(found) == mixed.count()
    text = {(r["doc_id"], r["source"]): r["text"] for r in mixed.collect()}
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"], r["source"]] or "")) for r in found)


def test_reruns_agree_however_rows_are_dealt(mixed):
    rows = lambda df: sorted(map(tuple, mixing.mix(df).collect()), key=repr)
    assert rows(mixed) == rows(mixed.repartition(7).orderBy(F.rand(3)))


def test_smaller_budgets_are_nested(mixed):
    """With less weight for a source, what is taken of it is a part of what was taken."""
    much = {(r["doc_id"], r["source"]): r["repeats"] for r in mixing.mix(mixed, (5, 2, 1)).collect()}
    little = {(r["doc_id"], r["source"]): (r["repeats"], r["target"]) for r in mixing.mix(mixed, (2, 5, 9)).collect()}
    target = {r["source"]: r["target"] for r in mixing.mix(mixed, (5, 2, 1)).collect()}
    for key, (n, aim) in little.items():
        assert n <= much[key] if aim <= target[key[1]] else n >= much[key]


def test_repeated_rows_are_told_apart(spark):
    rows = [(1, say(10), "a")] * 40 + [(2, say(10), "b")] * 200 + [(None, say(10), "c")] * 60
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    check(found)
    assert len({r["repeats"] for r in found if r["source"] == "b"}) == 2


def test_a_hot_source_and_a_very_long_text(spark):
    rows = [(i, say(5), "hot") for i in range(400)] + [(1000 + i, say(5), f"s{i % 30:02}") for i in range(200)] + [(5000, say(200_000), "s03")]
    check(mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())


def test_no_rows_no_words_and_clashing_columns(spark, wide_docs):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " \n", None)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2
    wide, _ = wide_docs
    extra = wide.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 4)).withColumns({c: F.lit(9) for c in ("size", "draw", "edge", "under", "target", "part", "weight", "number", "_part", "of", "s")})
    check(mixing.mix(extra).collect())


def test_more_sources_than_are_sent(mixed):
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(mixing.mix(mixed, broadcast_sources=1)) == rows(mixing.mix(mixed))


def test_numbers_run_without_gaps(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(500)], "k int, v int").repartition(5)
    found = mixing.numbered(df, ["k", "v"], "no").collect()
    assert [r["no"] for r in sorted(found, key=lambda r: (r["k"], r["v"]))] == list(range(500))


def test_thresholds_bisect_to_one_draw(spark):
    draw = random.Random(9)
    rows = [("a", draw.randint(1, 9), draw.randrange(16**15)) for _ in range(3000)] + [("b", 5, k) for k in range(8)]
    total = sum(r[1] for r in rows if r[0] == "a")
    for part in (1.0, total / 3, float(total)):
        goals = spark.createDataFrame([("a", part), ("b", 17.0)], "source string, part double")
        got = {r["source"]: r for r in mixing.thresholds(spark.createDataFrame(rows, "source string, size long, draw long"), goals, F.broadcast).collect()}
        at, under = next((d, u) for d, u, s in cumulated([r for r in rows if r[0] == "a"]) if u + s >= part)
        assert (got["a"]["edge"], got["a"]["under"]) == (at, under)
        assert (got["b"]["edge"], got["b"]["under"]) == (3, 15)
    assert math.isclose(total, sum(r[1] for r in rows if r[0] == "a"))


def cumulated(rows):
    under = 0
    for _, size, at in sorted(rows, key=lambda r: r[2]):
        yield at, under, size
        under += size
