import json

import pytest
from pyspark.sql import functions as F

from millrace.operators.tables import Conflict, Log, Table
from millrace.sources.storage import Folder

TABLES = {
    "rows": Table("collection string, id string, v long, list array<struct<a:int,b:string>>", ("collection",), ("id",)),
    "counts": Table("collection string, k string, n long", added="n"),
}
KINDS = {"id": ("collection", "id")}
EMPTY = "array<struct<a:int,b:string>>"


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, str(tmp_path / "log"), TABLES, KINDS)


def rows(spark, values, collection="c"):
    return spark.createDataFrame([(collection, str(i), v) for i, v in values.items()], "collection string, id string, v long").withColumn("list", F.array().cast(EMPTY))


def state(log, version=None, name="rows"):
    return {(r["collection"], r["id"]): r["v"] for r in log.read(name, version).collect()}


def upsert(log, values, collection="c"):
    with log.change() as change:
        new = change.add("rows", rows(log.spark, values, collection))
        change.remove("id", new)
        counts = log.spark.createDataFrame([(collection, "k", len(values)), (collection, str(sorted(values)[0]), 1)], "collection string, k string, n long")
        change.add("counts", counts)


def test_rows_follow_a_dictionary(spark, log):
    """Adds, updates, removals and drops in turn, with merges between, against a plain dictionary; older versions stay."""
    want, versions = {}, {0: {}}
    steps = [("up", {1: 10, 2: 20, 3: 30}), ("up", {2: 21, 4: 40}), ("gone", [1, 9]), ("compact", False), ("up", {1: 11, 2: 22}), ("clear", None), ("up", {7: 70, 2: 1}), ("gone", [7]), ("compact", False), ("up", {7: 71}), ("compact", True), ("gone", [2])]
    for kind, what in steps:
        if kind == "up":
            upsert(log, what)
            want |= {("c", str(i)): v for i, v in what.items()}
        elif kind == "gone":
            with log.change() as change:
                change.remove("id", spark.createDataFrame([("c", str(i)) for i in what], "collection string, id string"))
            for i in what:
                want.pop(("c", str(i)), None)
        elif kind == "clear":
            with log.change() as change:
                change.clear("c")
            want.clear()
        else:
            log.compact(what)
        assert state(log) == want
        versions[log.version().number] = dict(want)
    for number, then in versions.items():
        assert state(log, log.version(number)) == then
    assert {(r["k"], r["n"]) for r in log.read("counts").collect()} == {("2", 1), ("k", 3), ("7", 1)}


def test_other_collections_keep_their_rows(spark, log):
    upsert(log, {1: 1, 2: 2}, "a")
    upsert(log, {1: 5}, "01")
    with log.change() as change:
        change.clear("a")
    assert state(log) == {("01", "1"): 5}
    log.compact(True)
    assert state(log) == {("01", "1"): 5} and log.version().cleared == {}


def test_one_row_writes_its_own_bytes(spark, log):
    upsert(log, dict.fromkeys(range(20_000), 7))
    whole = sum(p["bytes"] for p in log.version().parts)
    upsert(log, {5: 8})
    new = [p for p in log.version().parts if p["seq"] == 2]
    assert sum(p["bytes"] for p in new) < whole / 10 and [p for p in log.version().parts if p["seq"] == 1] == log.version(1).parts


def test_the_second_of_two_writers_is_refused(spark, log):
    upsert(log, {1: 1})
    first, second = log.change(), log.change()
    first.add("rows", rows(spark, {2: 2}))
    second.add("rows", rows(spark, {3: 3}))
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert state(log) == {("c", "1"): 1, ("c", "2"): 2}
    assert log.vacuum(keep=5, grace=0) == 0
    with pytest.raises(ZeroDivisionError), log.change() as change:
        change.add("rows", rows(spark, {4: 4}))
        1 / 0  # noqa: B018
    assert ("c", "4") not in state(log) and log.vacuum(keep=5, grace=0) == 0


def test_exclusive_creation(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    assert folder.create("x/a.json", "one") and not folder.create("x/a.json", "two") and folder.read("x/a.json") == "one"
    assert folder.names("x") == ["a.json"] and folder.names("nothing") == [] and folder.bytes("x") == 3


def test_a_writer_that_failed_midway(spark, log):
    upsert(log, {1: 1})
    log.folder.create(f"versions/{2:020}.json", '{"number": 2, "par')
    assert log.version().number == 1 and state(log) == {("c", "1"): 1}
    with pytest.raises(Conflict):
        upsert(log, {2: 2})
    log.vacuum(grace=3600)
    assert 2 in log.numbers()
    log.vacuum(grace=0)
    upsert(log, {2: 2})
    assert state(log) == {("c", "1"): 1, ("c", "2"): 2}


def test_merging_is_by_size_and_vacuum_takes_what_no_version_names(spark, log):
    upsert(log, dict.fromkeys(range(5000), 1))
    for i in range(4):
        upsert(log, {i: i})
    old = log.version()
    assert log.compact() == 6 and {p["seq"] for p in log.version().parts} == {1, 5}
    assert log.compact() is None
    assert len(state(log)) == 5000 and state(log)["c", "3"] == 3
    assert state(log, old) == state(log)
    assert log.vacuum(keep=2, grace=3600) == 0 and log.vacuum(keep=1, grace=0) >= 12
    assert log.numbers() == [6] and len(state(log)) == 5000
    log.compact(True)
    assert {p["table"] for p in log.version().parts} == {"rows", "counts"} and len(state(log)) == 5000
    assert json.loads(log.folder.read(f"versions/{7:020}.json"))["seq"] == 5


def test_many_removals_are_met_by_shuffles(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), TABLES, KINDS, broadcast_bytes=0)
    upsert(log, dict.fromkeys(range(50), 1))
    upsert(log, dict.fromkeys(range(25), 2))
    assert sorted(state(log).values()) == [1] * 25 + [2] * 25
    with pytest.raises(ValueError):
        log.version(9)
