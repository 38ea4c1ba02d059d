"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are range-partitioned by length and packed into blocks, longest
first in each. The blocks with the longest vectors give every query a first
lower bound for its k-th best score. Each range of lengths then meets all query
blocks in a task of its own. There a query has a local cosine threshold,
bound / (|q| * longest of the block): above 1 the block can't contribute; when
it is high, candidates outside the feasible interval of the query's largest
coordinates go (coordinate pruning); otherwise those too short for the bound
go (length pruning). What is left is verified by exact integer products.

Pruning uses lengths in double precision with a relative slack of 1e-9, so it
never loses a tie. Memory per task: one group of blocks and one query block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .vectors import pad, to_matrix

#: Numbers in a block of candidates or queries, and the most rows of each.
BLOCK_CELLS, BLOCK_ROWS, QUERY_ROWS = 1 << 18, 4096, 512
#: Most blocks that seed the bounds; together they hold less than two full blocks.
SEED_BLOCKS = 256
#: Candidate blocks that one task holds together, about.
GROUP = 4
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE_CUT = 0.5
FOCUS = 3
_LIMIT = float(1 << 62)

_BLOCK = "block long, longest double, n int, width int, ids binary, cells binary, bounds binary"


def quantised(m: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), in doubles; what exceeds them ends at the largest."""
    largest = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(scale * m, -largest, largest))


def _pack(rows: int, scale: float):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            matrix, valid = to_matrix(batch.column(1))
            ids, q = batch.column(0).to_numpy()[valid], quantised(matrix[valid], scale)
            step = max(1, min(rows, BLOCK_CELLS // max(1, q.shape[1])))
            for at in range(0, len(ids), step):
                part, own = q[at : at + step], ids[at : at + step]
                norms = np.sqrt((part**2).sum(axis=1))
                order = np.argsort(-norms, kind="stable")
                block = (task << 32) + made
                made += 1
                cells = [[block], [float(norms.max())], [len(own)], [part.shape[1]], [own[order].tobytes()], [part[order].tobytes()], [np.full(len(own), -np.inf).tobytes()]]
                kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["block", "longest", "n", "width", "ids", "cells", "bounds"])

    return pack


def _unpack(n: int, width: int, ids: bytes, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(cells).reshape(n, width)


def exact_products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer inner products of two matrices of whole doubles, as int64; those beyond int64 end at its limits."""
    width = max(q.shape[1], p.shape[1])
    q, p = pad(q, width), pad(p, width)
    if (np.abs(q).max(initial=0) * np.abs(p).max(initial=0)) * width < 2.0**53:
        return (q @ p.T).astype(np.int64)  # every partial sum is a whole number below 2**53
    big = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in q]
    return np.array([[max(-(2**63), min(2**63 - 1, v)) for v in row] for row in big], dtype=np.int64).reshape(len(q), len(p))


class TopK:
    """The best k of each query of a block, best first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.norms = np.sqrt((q**2).sum(axis=1))
        self.bounds = bounds.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)
        self.verified = 0

    def _take(self, k: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.bounds[k]) & (ids != self.ids[k])
        if not keep.any():
            return
        all_ids, all_scores = np.concatenate([self.best[k][0], ids[keep]]), np.concatenate([self.best[k][1], scores[keep]])
        order = np.lexsort((all_ids, -all_scores))[: self.k]
        self.best[k] = (all_ids[order], all_scores[order])
        if len(order) == self.k:
            self.bounds[k] = max(self.bounds[k], float(all_scores[order[-1]]))

    def visit(self, ids: np.ndarray, p: np.ndarray, norms: np.ndarray) -> None:
        """Take in a block of candidates, longest first."""
        slack = 1 - 1e-9
        reach = self.norms * norms[0]
        threshold = np.where(reach > 0, self.bounds * slack / np.where(reach > 0, reach, 1), np.where(self.bounds > 0, 2.0, -1.0))
        # Lengths beyond doubles leave no threshold: nothing is pruned by them.
        threshold = np.where(np.isnan(threshold), -1.0, threshold)
        live = np.flatnonzero(threshold <= 1)
        by_coordinate = live[threshold[live] >= COORDINATE_CUT]
        by_length = live[threshold[live] < COORDINATE_CUT]
        width = max(p.shape[1], self.q.shape[1])
        if len(by_coordinate):
            wide = pad(p, width)
            unit = wide / np.where(norms > 0, norms, 1)[:, None]
            for k in by_coordinate:
                x = pad(self.q[k : k + 1], width)[0]
                u = x / self.norms[k]
                # The cosine needed grows as candidates get shorter; the block's threshold holds for all of them.
                t = threshold[k]
                keep = norms * self.norms[k] >= self.bounds[k] * slack
                for f in np.argsort(-np.abs(u))[:FOCUS]:
                    swing = np.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - t * t))) + 1e-9
                    keep &= unit[:, f] >= u[f] * t - swing if u[f] > 0 else unit[:, f] <= u[f] * t + swing
                rows = np.flatnonzero(keep)
                if len(rows):
                    self.verified += len(rows)
                    self._take(k, ids[rows], exact_products(x[None, :], wide[rows])[0])
        if len(by_length):
            need = np.where(self.bounds[by_length] > 0, self.bounds[by_length] * slack / np.maximum(self.norms[by_length], 1e-300), 0.0)
            prefix = len(norms) - np.searchsorted(norms[::-1], need, side="left")
            deepest = int(prefix.max())
            if deepest:
                self.verified += deepest * len(by_length)
                scores = exact_products(self.q[by_length], p[:deepest])
                # Rows with the query's own id, however many, must not push others out of its best.
                scores[ids[None, :deepest] == self.ids[by_length][:, None]] = np.iinfo(np.int64).min
                if deepest > self.k:
                    # Only scores that can be among a query's best are sorted.
                    cut = np.partition(scores, deepest - self.k, axis=1)[:, deepest - self.k]
                else:
                    cut = np.full(len(by_length), np.iinfo(np.int64).min)
                for row, k in enumerate(by_length):
                    near = np.flatnonzero(scores[row] >= cut[row])
                    self._take(k, ids[near], scores[row, near])


def _norms(p: np.ndarray) -> np.ndarray:
    return np.sqrt((p**2).sum(axis=1))


def least_length(bounds: np.ndarray, norms: np.ndarray) -> float:
    """The length below which no candidate reaches the bound of any of these queries; 0 if some query has none yet."""
    needed = np.divide(bounds * (1 - 1e-9), norms, out=np.zeros(len(bounds)), where=(bounds > 0) & (norms > 0))
    return float(np.nan_to_num(needed).min(initial=np.inf))


def _bound(first: list[tuple], k: int):
    """Lower bounds of each query's k-th best score from the longest candidates; ``longest`` becomes the least length that can reach one."""
    longest = [_unpack(*b) for b in first]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                ids, q = _unpack(r["n"], r["width"], r["ids"], r["cells"])
                top = TopK(ids, q, np.full(len(ids), -np.inf), k)
                for own, p in longest:
                    top.visit(own, p, _norms(p))
                r["bounds"], r["longest"] = top.bounds.tobytes(), least_length(top.bounds, top.norms)
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return bound


def _search(k: int):
    """Streams (team, role, block columns): a team's candidate blocks, then all query blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        team, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["team"] != team:
                    team, held = r["team"], []
                ids, m = _unpack(r["n"], r["width"], r["ids"], r["cells"])
                if r["role"] == 0:
                    held.append((ids, m, _norms(m)))
                    continue
                top = TopK(ids, m, np.frombuffer(r["bounds"]), k)
                for own, p, norms in sorted(held, key=lambda b: -b[2][0]):
                    top.visit(own, p, norms)
                n = [len(b[0]) for b in top.best]
                keys = np.repeat(np.arange(len(ids)), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keys), r["block"], np.int64)),
                        pa.array(keys.astype(np.int32)),
                        pa.array(ids[keys]),
                        pa.array(np.concatenate([b[0] for b in top.best]) if len(keys) else np.empty(0, np.int64)),
                        pa.array(np.concatenate([b[1] for b in top.best]) if len(keys) else np.empty(0, np.int64)),
                    ],
                    names=["block", "place", "query_id", "vec_id", "score"],
                )

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` largest integer inner products with rows of ``vectors``.

    Components are floor(scale * x). Candidates with the query's own id are left
    out; ties go to the smaller id, then in any order between rows that repeat
    an id with equal scores. Vectors that are null, empty or hold null or
    non-finite components, and rows with a null id, take no part; shorter
    vectors are padded with zeros. Fewer candidates than ``k`` give all of them.
    A query row that repeats an id has its own ranks. Scores beyond 64 bits end
    at the limits. Empty tables give an empty result.
    """
    spark = vectors.sparkSession

    def named(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = named(vectors)
    ranges = max(parts, -(-candidates.count() // (GROUP * BLOCK_ROWS)))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    by_length = candidates.withColumn("l", length).repartitionByRange(ranges, F.col("l").desc(), "id").drop("l")
    blocks = stage(by_length.mapInArrow(_pack(BLOCK_ROWS, scale), _BLOCK), "candidate-blocks")
    asked = stage(named(queries).repartition(max(1, parts // 4)).mapInArrow(_pack(QUERY_ROWS, scale), _BLOCK), "query-blocks")
    # The blocks with the longest vectors, up to the numbers of one full block or a little more, seed the bounds.
    heads = blocks.select("block", "n", "width").orderBy(F.col("longest").desc(), "block").limit(SEED_BLOCKS).collect()
    before = [0, *accumulate(h.n * h.width for h in heads)]
    chosen = [h.block for h, cells in zip(heads, before, strict=False) if cells < BLOCK_CELLS]
    seeds = [(r.n, r.width, bytes(r.ids), bytes(r.cells)) for r in blocks.where(F.col("block").isin(chosen)).orderBy(F.col("longest").desc(), "block").collect()]
    bounded = stage(asked.mapInArrow(_bound(seeds, k), _BLOCK), "query-bounds")
    # A range of lengths is a team: its bounds are tight, and short ranges prune whole queries.
    side_a = blocks.withColumn("team", F.shiftright("block", 32).cast("int")).withColumn("role", F.lit(0))
    # A block of queries visits only ranges whose longest vector can still reach one of its bounds.
    heights = blocks.groupBy(F.shiftright("block", 32).cast("int").alias("team")).agg(F.max("longest").alias("height")).orderBy("team").collect()  # a row per range
    largest = float(np.finfo(np.float64).max)
    listed = ", ".join(f"named_struct('team', {h.team}, 'height', double('{min(h.height, largest)!r}'))" for h in heights)
    reached = f"transform(filter(array({listed}), x -> x.height >= longest), x -> x.team)" if heights else "array(0)"
    side_b = bounded.withColumn("team", F.explode(F.expr(reached))).withColumn("role", F.lit(1))
    met = side_a.unionByName(side_b).repartition(ranges, "team").sortWithinPartitions("team", "role")
    found = met.mapInArrow(_search(k), "block long, place int, query_id long, vec_id long, score long")
    best = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
