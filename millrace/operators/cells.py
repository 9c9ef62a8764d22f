"""A vector index: cells around centres found in Spark rounds, searched exactly by triangle bounds, or by the nearest cells alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordering import kept, numbered

BLOCK, QUERIES, DEAL = 256, 128, 16
#: Rows of a query and a cell that are laid out at a time.
REACHED = 10_000


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array column as a matrix of doubles."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of ``a`` to all of ``b``, by one product of matrices."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def fit_centres(vectors: DataFrame, cells: int, sample_rows: int = 100_000, rounds: int = 12, moved: float = 1e-3) -> np.ndarray:
    """Centres of ``vectors`` (``vec``) by rounds of k-means over a sample of about ``sample_rows`` of them.

    The sample is kept by a hash of the vector, so copies are in it once and reruns agree. In a round every task sums the
    vectors nearest to each centre; a row a centre and dimension comes back, which ``cells`` bounds. Rounds end when no
    more than ``moved`` of the sample changes the mean distance.
    """
    distinct = vectors.select("vec").distinct()
    count = distinct.count()
    share = min(1.0, sample_rows / max(1, count))
    key = F.pmod(F.xxhash64("vec"), F.lit(1 << 30))
    sample = kept(distinct.withColumn("key", key).where(F.col("key") < int(share * (1 << 30)) + (share >= 1)))
    centres = np.array([r["vec"] for r in sample.orderBy("key", "vec").limit(cells).collect()], float)
    before = np.inf
    for _ in range(rounds if len(centres) > 1 else 0):
        now = centres

        def sums(frames: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, n, cost = np.zeros_like(now), np.zeros(len(now)), 0.0
            for frame in frames:
                for at in range(0, frame.num_rows, 1000):
                    x = matrix(frame.column(0).slice(at, 1000))
                    d = squares(x, now)
                    near = d.argmin(1)
                    np.add.at(total, near, x)
                    n += np.bincount(near, minlength=len(now))
                    cost += d[np.arange(len(x)), near].sum()
            for c in np.flatnonzero(n):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([n[c]]), pa.array([total[c].tolist()], pa.list_(pa.float64())), pa.array([cost if c == np.flatnonzero(n)[0] else 0.0])], names=["cell", "n", "total", "cost"])

        found = sample.select("vec").mapInArrow(sums, "cell long, n double, total array<double>, cost double")
        rows = found.select("cell", "n", "cost", F.posexplode("total").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()
        centres = now.copy()
        for r in rows:
            centres[r["cell"], r["at"]] = r["x"] / r["n"]
        cost = sum(r["cost"] for r in rows if r["at"] == 0)
        if before - cost <= moved * cost:
            break
        before = cost
    return centres


class VectorCells:
    """Stored vectors by cell, in blocks of rows of like distance from the cell's centre.

    The centres and, for each cell, its number of rows and radius are a few rows that ``cells`` bounds, and travel to the
    tasks; the rows stay in a table in the shared folder. Every row is indexed; rows without a vector are no hits.
    """

    def __init__(self, stored: DataFrame, id_: str = "id", vec: str = "embedding", cells: int | None = None, most_cells: int = 4096, sample_rows: int = 100_000):
        rows = stored.select(F.col(id_).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec is not null")
        count = rows.count()
        self.centres = fit_centres(rows, min(most_cells, cells or max(1, int(count**0.5))), sample_rows)
        centres, types = self.centres, dict(rows.dtypes)
        self.id_type = types["id"]

        def assign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for at in range(0, frame.num_rows, 1000):
                    part = frame.slice(at, 1000)
                    x = matrix(part.column("vec"))
                    near = squares(x, centres).argmin(1)
                    gap = np.sqrt(((x - centres[near]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(near, pa.int32()), pa.array(gap)], names=["id", "vec", "cell", "gap"])

        placed = numbered(rows.mapInArrow(assign, f"id {types['id']}, vec array<double>, cell int, gap double"), [F.asc("cell"), F.asc("gap"), F.asc("id")], "number")
        grouped = placed.groupBy("cell", F.floor(F.col("number") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("gap", "id", "vec"))).alias("r"))
        made = grouped.select("cell", "block", F.col("r.id").alias("ids"), F.flatten("r.vec").alias("vecs"), F.col("r.gap").alias("gaps"))
        self.blocks = kept(made.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block"))
        heads = self.blocks.groupBy("cell").agg(F.sum(F.size("ids")).alias("n"), F.max(F.array_max("gaps")).alias("radius"), F.count("*").alias("blocks")).collect()
        self.n, self.radius, self.deals = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
        for r in heads:
            self.n[r["cell"]], self.radius[r["cell"]], self.deals[r["cell"]] = r["n"], r["radius"], -(-r["blocks"] // DEAL)

    def reached(self, asked: DataFrame, n: int, probes: int) -> DataFrame:
        """The cells to search for each query (``query``, ``vec``, ``least``): ``query``, ``vec``, ``least``, ``cell``, ``deal``.

        Where ``least``, the squared distance that counts, is null, these are the nearest cells, ``probes`` at least and as
        many more as it takes to have ``n`` rows; else all cells that may hold a row as near: by the triangle inequality no
        row is nearer than the distance to the centre less the cell's radius. A cell of many blocks is dealt out in parts.
        """
        centres, count, radius, deals = self.centres, self.n, self.radius, self.deals

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for at in range(0, frame.num_rows, 500):
                    part = frame.slice(at, 500)
                    far = np.sqrt(squares(matrix(part.column("vec")), centres))
                    far[:, count == 0] = np.inf
                    least = part.column("least").to_numpy(zero_copy_only=False)
                    rows, cells, held = [], [], 0
                    for k in range(part.num_rows):
                        if np.isnan(least[k]):
                            order = far[k].argsort(kind="stable")
                            enough = int(np.searchsorted(np.cumsum(count[order]), n)) + 1
                            near = order[: max(probes, enough)]
                            near = near[np.isfinite(far[k][near])]
                        else:
                            near = np.flatnonzero(far[k] - radius <= np.sqrt(least[k]) * (1 + 1e-9) + 1e-9)
                        rows.append(np.repeat(k, deals[near].sum()))
                        cells.append(np.repeat(near, deals[near]))
                        held += len(rows[-1])
                        # A query may reach every cell: its vector is repeated for a few queries at a time.
                        if held >= REACHED or k == part.num_rows - 1:
                            yield from laid(part, np.concatenate(rows), np.concatenate(cells))
                            rows, cells, held = [], [], 0

        def laid(part: pa.RecordBatch, row: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
            deal = dealt(cell, row)
            for at in range(0, len(row), REACHED):
                taken = part.take(pa.array(row[at : at + REACHED]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell[at : at + REACHED], pa.int32()), pa.array(deal[at : at + REACHED], pa.int32())], names=[*part.schema.names, "cell", "deal"])

        def dealt(cell: np.ndarray, row: np.ndarray) -> np.ndarray:
            """0, 1, … within each stretch of one cell of one query."""
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])
            return np.arange(len(cell)) - np.maximum.accumulate(np.where(new, np.arange(len(cell)), 0))

        kinds = ", ".join(f"{c} {t}" for c, t in asked.dtypes)
        return asked.mapInArrow(run, f"{kinds}, cell int, deal int")

    def met(self, pairs: DataFrame, n: int, places: int | None) -> DataFrame:
        """The ``n`` nearest rows of the given cells to each query: ``query``, ``at`` (from 1), ``id``, ``distance``, ``cell``.

        Queries of one cell are laid in blocks of about 128 and joined with the cell's blocks of rows; each pair of blocks
        is one product of matrices, of which a query's best ``n`` go on. Both kinds of blocks are bounded, and a large cell
        is met in as many parts as it is dealt into.
        """
        deals = F.array(*[F.lit(int(d)) for d in self.deals]) if len(self.deals) else F.array(F.lit(1))
        sized = pairs.groupBy("cell", "deal").agg(F.ceil(F.count("*") / QUERIES).alias("_parts"))
        laid = pairs.join(F.broadcast(sized), ["cell", "deal"]).withColumn("_part", F.pmod(F.xxhash64("query"), F.col("_parts")))
        asked = laid.groupBy("cell", "deal", "_part").agg(F.collect_list(F.struct("query", "vec", "least")).alias("q")).select("cell", "deal", F.col("q.query").alias("queries"), F.flatten("q.vec").alias("qvecs"), F.col("q.least").alias("leasts"))
        rows = self.blocks.withColumn("deal", F.pmod(F.col("block"), F.greatest(F.get(deals, F.col("cell")), F.lit(1))).cast("int"))

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for k in range(frame.num_rows):
                    ids, queries = frame.column("ids")[k].values, frame.column("queries")[k].values
                    x = np.asarray(frame.column("vecs")[k].values, float).reshape(len(ids), -1)
                    q = np.asarray(frame.column("qvecs")[k].values, float).reshape(len(queries), -1)
                    least = np.asarray(frame.column("leasts")[k].values.to_numpy(zero_copy_only=False), float)
                    d = squares(q, x)
                    d = d if places is None else np.round(d, places)
                    d[d > np.where(np.isnan(least), np.inf, least * (1 + 1e-9) + 1e-12)[:, None]] = np.inf
                    rank = np.empty(len(ids), np.int64)
                    rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
                    order = np.lexsort((np.broadcast_to(rank, d.shape), d), axis=1)[:, :n]
                    best = np.take_along_axis(d, order, 1)
                    ask, at = np.nonzero(np.isfinite(best))
                    cell = np.full(len(ask), frame.column("cell")[k].as_py(), np.int32)
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(ask)), ids.take(pa.array(order[ask, at])), pa.array(best[ask, at]), pa.array(cell)], names=["query", "id", "distance", "cell"])

        joined = rows.join(asked, ["cell", "deal"]).select("cell", "ids", "vecs", "queries", "qvecs", "leasts")
        found = joined.mapInArrow(run, f"query long, id {self.id_type}, distance double, cell int")
        at = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
        return found.withColumn("at", at).where(F.col("at") <= n)

    def nearest(self, queries: DataFrame, n: int = 5, probes: int = 2, exact: bool = True, query_id: str = "query_id", query_vec: str = "query_vec", places: int | None = None) -> DataFrame:
        """The ``n`` nearest rows to each query by squared Euclidean distance: ``query_id``, ``rank`` (from 0), ``id``, ``distance``.

        The nearest ``probes`` cells (more if they hold fewer than ``n`` rows) are searched first. Without ``exact`` that
        is the result; with it, the distance of the n-th hit so far decides which other cells may hold a nearer row, and
        these are searched too, so the result is that of looking at all rows. Ties are by id; ``places`` rounds distances
        before ranking. Queries of one vector are searched once; a query without a vector has no hits.
        """
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec")).where("vec is not null")
        known = kept(numbered(asked.select("vec").distinct(), [F.asc("vec")], "query"))
        found = self.searched(known, n, probes, exact, places)
        return asked.join(known, "vec").join(found, "query").select("query_id", (F.col("at") - 1).alias("rank"), "id", "distance")

    def searched(self, known: DataFrame, n: int, probes: int, exact: bool, places: int | None = None) -> DataFrame:
        """The hits of distinct queries (``query``, ``vec``), as ``met`` gives them."""
        if not len(self.centres):
            return known.sparkSession.createDataFrame([], f"query long, id {self.id_type}, distance double, cell int, at int")
        first = kept(self.met(self.reached(known.select("query", "vec", F.lit(None).cast("double").alias("least")), n, probes), n, places))
        found = first
        if exact:
            least = first.where(F.col("at") == n).select("query", (F.col("distance") + (0.0 if places is None else 10.0**-places)).alias("least"))
            all_ = F.coalesce("least", F.lit(float("inf")))
            found = self.met(self.reached(known.join(least, "query", "left").select("query", "vec", all_.alias("least")), n, probes), n, places)
        return found

    def probes_for(self, n: int = 5, target: float = 0.92, sample_rows: int = 300) -> int:
        """How many cells the probing form must search to find ``target`` of the ``n`` nearest, measured on a sample of stored rows.

        The sample, about ``sample_rows`` of the indexed rows by hash, is searched exactly; each hit counts from the probe on
        that reaches its cell.
        """
        share = int(min(1.0, sample_rows / max(1, self.n.sum())) * (1 << 30)) + 1
        rows = self.blocks.select(F.posexplode("ids").alias("at", "id"), F.col("vecs"), (F.size("vecs") / F.size("ids")).cast("int").alias("dim"))
        drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select(F.slice("vecs", F.col("at") * F.col("dim") + 1, F.col("dim")).alias("vec")).distinct()
        known = kept(drawn.select(F.xxhash64("vec").alias("query"), "vec"))
        hits, centres, count = self.searched(known, n, 1, True).join(known, "query").select("vec", "cell"), self.centres, self.n

        def probe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                if frame.num_rows:
                    far, cell = squares(matrix(frame.column(0)), centres), frame.column(1).to_numpy()
                    nearer = (far < far[np.arange(len(cell)), cell][:, None]) & (count > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(nearer.sum(1) + 1)], names=["probe"])

        found = sorted((r["probe"], r["count"]) for r in hits.mapInArrow(probe, "probe long").groupBy("probe").count().collect())
        total, so_far = sum(c for _, c in found), 0
        for number, c in found:
            so_far += c
            if so_far >= target * total:
                return number
        return 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits that were found."""
    keys = ["query_id", "id"]
    total = exact.count()
    return exact.select(*keys).join(found.select(*keys), keys, "left_semi").count() / total if total else 1.0
