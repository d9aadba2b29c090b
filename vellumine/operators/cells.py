"""Exact vector search and threshold joins over cells, pruned by bounds.

Rows lie in cells around pivots and are packed, cell by cell, into blocks with their own centre and radius. A row is coded by one byte
an entry and the exact distance of its code from it. Searching reads codes only: a block whose centre is too far for a query
(triangle inequality) is skipped, and code scores with their error bounds leave few candidates, whose true vectors are then read.
Nothing is lost: hits are those of a full scan.

Cells are range-partitioned by (cell, id), so a cell that holds a third of all rows is cut like any other. Queries and blocks
meet in the grid of ``knn.met_blocks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions import vectors as V
from vellumine.operators import knn as N
from vellumine.operators.knn import _matrix, _scores  # named, as task functions that name a module would carry all of it
from vellumine.operators.scale import top_k

LEVELS = 127
#: Room for rounding: of the bounds, and of scores that rank equal after ``knn.ORDER_DIGITS`` digits.
SLACK = 2e-6


class Bound(NamedTuple):
    """What a metric needs: a code score (greater is better), its error, and the best score inside a block."""

    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    error: Callable[[np.ndarray, np.ndarray], np.ndarray]
    block: Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def _distance(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return _scores(rows, queries, "l2")


BOUNDS = {
    "l2": Bound(
        lambda x, q: -_distance(x, q), lambda q, e: np.broadcast_to(e[:, None], (len(e), len(q))),
        lambda q, c, radius: radius - _distance(c[None, :], q)[0],
    ),
    "dot": Bound(
        lambda x, q: x @ q.T, lambda q, e: np.outer(e, np.linalg.norm(q, axis=1)),
        lambda q, c, radius: q @ c + np.linalg.norm(q, axis=1) * radius,
    ),
}


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, step per row, and distance of each row from its code."""
    peak = np.abs(v).max(axis=1, initial=0)
    step = np.where(peak > 0, peak / LEVELS, 1.0)
    codes = np.rint(v / step[:, None]).astype(np.int8)
    return codes, step, np.linalg.norm(v - codes * step[:, None], axis=1)


class CellIndex:
    """Blocks of coded rows in cells around ``cells`` pivots: rows chosen by a hash of the id, whose vectors are the only ones
    that the driver sees. Vectors of another width than most pivots have are not indexed (``knn.append_valid`` reports such
    rows). ``folder`` writes the blocks there, for several searches; else they are made as a search asks for them."""

    def __init__(
        self, corpus: DataFrame, corpus_id: str = "vec_id", vector: str = "embedding", cells: int = 64, block_rows: int = 256, folder: str | None = None,
    ):
        rows = corpus.select(F.col(corpus_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
        picked = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(cells).collect()]
        widths = [len(v) for v in picked]
        self.vector, self.kind = vector, rows.schema["id"].dataType.simpleString()
        self.dim = max(sorted(set(widths)), key=widths.count, default=0)
        self.rows = rows.where(F.size("v") == self.dim)
        self.pivots = np.unique(np.array([v for v in picked if len(v) == self.dim], float).reshape(-1, max(self.dim, 1)), axis=0)
        placed = self._assigned().repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        self.blocks = self._blocks(placed, block_rows)
        if folder:
            self.blocks.write.parquet(folder)
            self.blocks = rows.sparkSession.read.schema(self._schema()).parquet(folder)

    def _assigned(self) -> DataFrame:
        """Rows with the number of their nearest pivot."""
        dim, pivots = self.dim, self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = _distance(pivots, _matrix(batch.column("v"), dim)).argmin(axis=0)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell, pa.int32())], names=["id", "v", "cell"])

        return self.rows.mapInArrow(run, f"id {self.kind}, v array<double>, cell int")

    def _schema(self) -> str:
        return f"c_ids array<{self.kind}>, codes binary, steps array<double>, errors array<double>, centre array<double>, radius double"

    def _blocks(self, placed: DataFrame, block_rows: int) -> DataFrame:
        dim = self.dim

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell = batch.column("cell").to_numpy(zero_copy_only=False)
                borders = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)]
                for low, high in zip(borders[:-1].tolist(), borders[1:].tolist()):
                    for start in range(low, high, block_rows):
                        part = batch.slice(start, min(block_rows, high - start))
                        v = _matrix(part.column("v"), dim)
                        codes, steps, errors = coded(v)
                        centre = v.mean(axis=0)
                        radius = float(np.linalg.norm(v - centre, axis=1).max())
                        one = lambda x, t: pa.array([x], pa.list_(t))
                        yield pa.RecordBatch.from_arrays(
                            [
                                one(part.column("id"), part.column("id").type), pa.array([codes.tobytes()], pa.binary()), one(steps, pa.float64()),
                                one(errors, pa.float64()), one(centre, pa.float64()), pa.array([radius]),
                            ],
                            names=["c_ids", "codes", "steps", "errors", "centre", "radius"],
                        )

        return placed.mapInArrow(pack, self._schema())

    def candidates(self, queries: DataFrame, k: int, metric: str = "l2", query_id: str = "query_id", least: float | None = None, exclude_self: bool = False) -> DataFrame:
        """(query_id, id): rows that the bounds can't exclude from a query's best ``k`` (of those scoring ``least``)."""
        asked = queries.select(F.col(query_id).alias("id"), F.col(self.vector).alias("v")).where(F.size("v") == self.dim)
        kinds = (asked.schema["id"].dataType.simpleString(), self.kind)
        bound, floor = BOUNDS[metric], -np.inf if least is None else (-least if metric == "l2" else least)
        dim = self.dim

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reach: dict[bytes, np.ndarray] = {}  # per block of queries: the k best certain scores of each
            for batch in batches:
                for i in range(batch.num_rows):
                    row = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                    q = np.frombuffer(batch.column("q_v")[i].as_buffer()).reshape(-1, dim)
                    key = row("q_ids")
                    name = key.tobytes() if key.dtype != object else repr(key.tolist()).encode()
                    best = reach.setdefault(name, np.full((len(q), k), floor))
                    centre, radius = row("centre"), batch.column("radius")[i].as_py()
                    live = np.flatnonzero(bound.block(q, centre, radius) >= best[:, 0] - SLACK)
                    if not len(live):
                        continue
                    c_ids = batch.column("c_ids")[i].values
                    codes = np.frombuffer(batch.column("codes")[i].as_py(), np.int8).reshape(-1, dim)
                    x, asked_q = codes * row("steps")[:, None], q[live]
                    score, error = bound.score(x, asked_q), bound.error(asked_q, row("errors"))
                    if exclude_self:
                        same = row("c_ids")[:, None] == key[live][None, :]
                        score = np.where(same, -np.inf, score)
                    sure = np.sort(np.concatenate([best[live], (score - error).T], axis=1), axis=1)[:, -k:]
                    best[live] = np.maximum(sure, floor)
                    r, c = np.nonzero(score + error >= best[live][:, 0] - SLACK)
                    if len(r):
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("q_ids")[i].values.take(pa.array(live[c])), c_ids.take(pa.array(r)),
                                pa.array((score + error)[r, c]), pa.array((score - error)[r, c]),
                            ],
                            names=["query_id", "id", "most", "surely"],
                        )

        pairs = N.met_blocks(self.blocks, N._packed(asked, N.QUERY_BLOCK, "q"))
        found = pairs.mapInArrow(search, f"query_id {kinds[0]}, id {kinds[1]}, most double, surely double")
        # a query has its best few rows of each task here
        every = Window.partitionBy("query_id").orderBy(F.col("surely").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        reach = F.nth_value("surely", k).over(every)
        left = found.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("most") >= F.col("reach") - SLACK))
        return left.select("query_id", "id").distinct()

    def search(self, queries: DataFrame, k: int, metric: str = "l2", query_id: str = "query_id", least: float | None = None, exclude_self: bool = False) -> DataFrame:
        """(query_id, id, score, rank) as ``knn.knn`` gives them; with ``least``, hits of that distance at most or that
        product at least."""
        met = self.candidates(queries, k, metric, query_id, least, exclude_self).join(self.rows, "id")
        met = met.join(queries.select(F.col(query_id).alias("query_id"), F.col(self.vector).alias("q")), "query_id")
        score = (V.l2 if metric == "l2" else V.dot)(F.col("q"), F.col("v"))
        scored = met.select("query_id", "id", score.alias("score"))
        if least is not None:
            scored = scored.where(F.col("score") <= least if metric == "l2" else F.col("score") >= least)
        return top_k(scored, ["query_id"], [N._order(metric), F.col("id")], k)
