"""Log-structured tables: a version names the parts that count, a commit adds parts of what changed, reads merge them."""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.storage import Folder


class Conflict(RuntimeError):
    """Another writer has committed since, or is committing."""


@dataclass(frozen=True)
class Table:
    """How a table is kept.

    schema: its columns. folders: the columns its parts are divided by. removed_by: the kinds of removals that apply to
    it. added: for a table of counts that add up, the column that is summed over rows equal in all others; such rows are
    never removed but balanced by negative ones. masked: for a table with rows that list keys, a kind of removal, the column
    that tells rows apart and the list; who reads it passes over keys that are removed, and merging makes them null.
    """

    schema: str
    folders: tuple[str, ...] = ()
    removed_by: tuple[str, ...] = ()
    added: str | None = None
    masked: tuple[str, str, str] | None = None

    @property
    def columns(self) -> list[str]:
        return [c.strip().split()[0] for c in self.schema.split(", ")]


@dataclass
class Version:
    """The parts that count: dictionaries of ``table`` or ``kind`` of removal, ``seq``, ``run`` and ``bytes``; ``cleared``: the last
    sequence number of what a dropped collection had."""

    number: int = 0
    seq: int = 0
    parts: list[dict] = field(default_factory=list)
    cleared: dict[str, int] = field(default_factory=dict)


class Log:
    """Tables below a folder.

    A part is a folder of Parquet files written by one Spark job, ``parts/<table>/seq=<n>/run=<id>``. Removals are parts
    too: the keys removed, under the kind of removal. What has a sequence number below that of a removal of its key is
    gone. A version is a small file that lists the parts, and is created exclusively: the second of two writers that
    began from one version is refused. Nothing that is written is changed afterwards, so readers of an older version are
    undisturbed until ``vacuum`` takes its parts.

    kinds: the key columns of each kind of removal; keys are not null. collection: the column, of every table, by which whole
    collections are dropped. Removals of up to ``broadcast_bytes`` (as stored) are sent to the rows, larger ones met by shuffles.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], kinds: dict[str, tuple[str, ...]], collection: str = "collection", broadcast_bytes: int = 4_000_000):
        self.spark, self.root, self.tables, self.kinds, self.collection, self.broadcast_bytes = spark, root.rstrip("/"), tables, kinds, collection, broadcast_bytes
        self.folder = Folder(spark, self.root)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("versions") if n.endswith(".json")]

    def load(self, number: int, patience: float = 2.0) -> Version | None:
        """A version, or None where its file stays incomplete: its writer is at work or has failed."""
        until = time.time() + patience
        while True:
            try:
                return Version(**json.loads(self.folder.read(f"versions/{number:020}.json")))
            except json.JSONDecodeError:
                if time.time() > until:
                    return None
                time.sleep(0.1)

    def version(self, number: int | None = None) -> Version:
        """A version by number, else the latest whole one; without any, an empty one of number 0."""
        if number is not None:
            if number not in [0, *self.numbers()]:
                raise ValueError(f"no such version: {number}")
            return self.load(number) if number else Version()
        for n in reversed(self.numbers()):
            if found := self.load(n):
                return found
        return Version()

    def rows(self, parts: list[dict], name: str, schema: str) -> DataFrame:
        """The stored rows of parts, with ``seq``."""
        paths = [f"{self.root}/parts/{name}/seq={p['seq']}/run={p['run']}" for p in parts if p["table"] == name]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, seq long")
        found = self.spark.read.schema(f"{schema}, seq long, run string").option("basePath", f"{self.root}/parts/{name}").parquet(*paths)
        return found.drop("run")

    def removals(self, parts: list[dict], kind: str, names: list[str], kept: DataFrame) -> DataFrame:
        """Each key of a kind with its last removal, under other names."""
        keys = self.kinds[kind]
        types = dict(kept.dtypes)
        found = self.rows(parts, f"removed_{kind}", ", ".join(f"{k} {types[k]}" for k in keys))
        latest = found.groupBy(*keys).agg(F.max("seq").alias("_removed"))
        latest = latest.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_removed")
        size = sum(p["bytes"] for p in parts if p["table"] == f"removed_{kind}")
        return F.broadcast(latest) if size <= self.broadcast_bytes else latest

    def without_removed(self, found: DataFrame, parts: list[dict], kinds: tuple[str, ...], cleared: dict[str, int] | None = None) -> DataFrame:
        """The rows (with ``seq``) that no later removal names. Rows newer than all removals meet none."""
        for name, seq in (cleared or {}).items():
            found = found.where(~((F.col(self.collection) == name) & (F.col("seq") <= seq)))
        for kind in kinds:
            last = max((p["seq"] for p in parts if p["table"] == f"removed_{kind}"), default=0)
            if not last:
                continue
            names = [f"_{k}" for k in self.kinds[kind]]
            old = found.where(F.col("seq") < last)
            met = old.join(self.removals(parts, kind, names, found), [F.col(k) == F.col(n) for k, n in zip(self.kinds[kind], names)], "left")
            alive = met.where(F.col("_removed").isNull() | (F.col("seq") >= F.col("_removed"))).select(*found.columns)
            found = alive.unionByName(found.where(F.col("seq") >= last))
        return found

    def without_listed(self, found: DataFrame, parts: list[dict], table: Table) -> DataFrame:
        """Rows that list keys, those that are removed made null."""
        kind, row, column = table.masked
        keys = self.kinds[kind]
        if not any(p["table"] == f"removed_{kind}" for p in parts):
            return found
        listed = found.select(*[c for c in found.columns if c in (*keys, row, "seq") and c != column], F.explode(column).alias(keys[-1]))
        names = [f"_{k}" for k in keys]
        met = listed.join(self.removals(parts, kind, names, listed), [F.col(k) == F.col(n) for k, n in zip(keys, names)])
        dead = met.where(F.col("seq") < F.col("_removed")).groupBy(row).agg(F.collect_set(keys[-1]).alias("_dead"))
        left = F.transform(column, lambda x: F.when(~F.array_contains("_dead", x), x))
        return found.join(dead, row, "left").withColumn(column, F.when(F.col("_dead").isNull(), F.col(column)).otherwise(left)).select(*found.columns)

    def read(self, name: str, version: Version | None = None, removed: bool = True) -> DataFrame:
        """The rows of a table as of a version (the latest by default), counts summed. removed: False keeps rows that are gone, with ``seq``."""
        version, table = version or self.version(), self.tables[name]
        found = self.rows(version.parts, name, table.schema)
        if not removed:
            return found
        return self.summed(self.without_removed(found, version.parts, table.removed_by, version.cleared), table)

    def summed(self, rows: DataFrame, table: Table) -> DataFrame:
        if table.added is None:
            return rows.select(*table.columns)
        return rows.groupBy(*[c for c in table.columns if c != table.added]).agg(F.sum(table.added).alias(table.added)).where(F.col(table.added) != 0).select(*table.columns)

    def change(self, since: Version | None = None) -> Change:
        """Begins a change of what a version holds, the latest by default."""
        return Change(self, since or self.version())

    def compact(self, whole: bool = False, factor: float = 1.0) -> int | None:
        """Merges the newest parts while an older one is at most ``factor`` times as large as all newer ones together; ``whole``: all.

        So each row is rewritten about as often as the logarithm of the store's size, and the number of sequence numbers in
        use stays about as small. Removals go once the oldest parts are merged too. Returns the new version's number, or
        None where there was nothing to merge.
        """
        base = self.version()
        size: dict[int, int] = defaultdict(int)
        for p in base.parts:
            size[p["seq"]] += p["bytes"]
        order = sorted(size)
        at, newer = len(order) - 1, 0
        for i in range(len(order) - 1, -1, -1):
            if whole or size[order[i]] <= factor * newer:
                at = i
            newer += size[order[i]]
        merged = [p for p in base.parts if order and p["seq"] >= order[at]]
        if max(Counter(p["table"] for p in merged).values(), default=0) < 2 and not (whole and (base.cleared or any(p["table"].startswith("removed_") for p in merged))):
            return None
        full = at == 0
        new = Change(self, base, seq=base.seq)
        new.parts = [p for p in base.parts if p["seq"] < order[at]]
        for name, table in self.tables.items():
            found = self.without_removed(self.rows(merged, name, table.schema), merged, table.removed_by, base.cleared)
            if table.masked:
                found = self.without_listed(found, merged, table)
            if any(p["table"] == name for p in merged):
                new.put(name, self.summed(found, table), table.folders)
        for kind, keys in self.kinds.items():
            types = {c.split()[0]: c.split()[1] for t in self.tables.values() if kind in t.removed_by for c in t.schema.split(", ")}
            if not full and any(p["table"] == f"removed_{kind}" for p in merged):
                new.put(f"removed_{kind}", self.rows(merged, f"removed_{kind}", ", ".join(f"{k} {types[k]}" for k in keys)).select(*keys).distinct(), ())
        new.cleared = {} if full else base.cleared
        return new.commit()

    def vacuum(self, keep: int = 1, grace: float = 3600) -> int:
        """Deletes versions but the last ``keep``, and parts that none of those names and that have not changed for ``grace`` seconds
        (younger ones may belong to a writer at work). A version file left incomplete for that long goes too. Returns the number of parts deleted."""
        numbers, whole = self.numbers(), []
        for n in reversed(numbers):
            found = self.load(n, 0.0)
            if found is None:
                if self.folder.age(f"versions/{n:020}.json") >= grace:
                    self.folder.delete(f"versions/{n:020}.json")
            elif len(whole) < max(1, keep):
                whole.append(found)
            else:
                self.folder.delete(f"versions/{n:020}.json")
        used = {(p["table"], p["seq"], p["run"]) for v in whole for p in v.parts}
        gone = 0
        for table in self.folder.names("parts"):
            for seq in self.folder.names(f"parts/{table}"):
                runs = self.folder.names(f"parts/{table}/{seq}")
                for run in runs:
                    name = f"parts/{table}/{seq}/{run}"
                    if (table, int(seq[4:]), run[4:]) not in used and self.folder.age(name) >= grace:
                        self.folder.delete(name)
                        gone += 1
        return gone


class Change:
    """Parts being written on top of a version; nothing of it is seen before ``commit``."""

    def __init__(self, log: Log, base: Version, seq: int | None = None):
        self.log, self.base, self.run = log, base, uuid.uuid4().hex
        self.seq = base.seq + 1 if seq is None else seq
        self.parts, self.cleared, self.written = list(base.parts), dict(base.cleared), []

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.abort()

    def put(self, name: str, rows: DataFrame, folders: tuple[str, ...]) -> dict | None:
        run = f"{self.run}{len(self.written):03}"
        path = f"parts/{name}/seq={self.seq}/run={run}"
        self.written.append(path)
        writer = rows.write.partitionBy(*folders) if folders else rows.write
        writer.parquet(f"{self.log.root}/{path}")
        size = self.log.folder.bytes(path)
        part = {"table": name, "seq": self.seq, "run": run, "bytes": size}
        if not size:
            return None
        self.parts.append(part)
        return part

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes rows of a table and gives them as stored, so that what follows from them is not worked out twice."""
        table = self.log.tables[name]
        part = self.put(name, rows.select(*table.columns), table.folders)
        return self.log.rows([part] if part else [], name, table.schema).select(*table.columns)

    def remove(self, kind: str, keys: DataFrame) -> DataFrame:
        """Removes, of all tables that the kind applies to, the rows of these keys that were there before this change; gives the keys as stored, to be sent to rows if they are few."""
        found = keys.select(*self.log.kinds[kind]).distinct()
        part = self.put(f"removed_{kind}", found, ())
        stored = self.log.rows([part] if part else [], f"removed_{kind}", ", ".join(f"{c} {t}" for c, t in found.dtypes)).select(*found.columns)
        return F.broadcast(stored) if (part or {"bytes": 0})["bytes"] <= self.log.broadcast_bytes else stored

    def clear(self, collection: str) -> None:
        """Removes all rows of a collection that were there before this change; nothing is written for it."""
        self.cleared[collection] = self.seq - 1

    def commit(self) -> int:
        """Makes the change the next version; ``Conflict`` where another writer was first."""
        number = self.base.number + 1
        text = json.dumps({"number": number, "seq": max(self.seq, self.base.seq), "parts": self.parts, "cleared": self.cleared})
        if max(self.log.numbers(), default=0) != self.base.number or not self.log.folder.create(f"versions/{number:020}.json", text):
            self.abort()
            raise Conflict(f"version {number} is another writer's")
        return number

    def abort(self) -> None:
        """Deletes what was written."""
        for path in self.written:
            self.log.folder.delete(path)
