"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are kept in blocks, each with its rows sorted along every dimension. For a query, sorted access walks the
dimensions' lists from their best end while every row met is scored in full; no unseen row of the block can score more
than the sum of the query's products with the values at the current depth, so the walk ends once that bound is below
the k-th score. The k-th score so far goes with a query from block to block. Candidate lanes and query lanes form a
grid: each cell streams its lane of blocks past its lane of queries, and the cells' results are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .vectors import dense, shape_of


def scaled(matrix: np.ndarray, scale: float) -> np.ndarray:
    """Components as whole numbers: in floating point, where that holds every one exactly, or as unbounded integers."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * matrix)
    if np.isfinite(whole).all():
        return whole
    exact = np.frompyfunc(lambda x: math.floor(Fraction(x) * Fraction(scale)), 1, 1)
    return exact(matrix).astype(object)


def comparable(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact: floating point, 64-bit or unbounded integers."""
    most = [int(np.abs(x).max(initial=0)) for x in (rows, queries)]
    bound = most[0] * most[1] * max(1, rows.shape[1])
    if bound < 1 << 53 and rows.dtype != object and queries.dtype != object:
        return rows, queries
    if max(bound, *most) < 1 << 63:
        return rows.astype(np.int64), queries.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(rows).astype(object), whole(queries).astype(object)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; those beyond the range of a long are its limits."""
    scores = rows @ query
    return scores if scores.dtype != object else np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores] + [None], object)[:-1]


def kth_best(scores: np.ndarray, k: int):
    return np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]


def threshold_top(rows: np.ndarray, order: np.ndarray, query: np.ndarray, k: int, floor=None) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers and scores that hold the ``k`` best of ``rows`` (ties at the k-th included), and how many rows were scored.

    ``order``: for each dimension the row numbers by ascending value. ``floor``: a score below which nothing is wanted.
    """
    n, used = len(rows), np.flatnonzero(query)
    if not len(used):
        return np.arange(n), products(rows, query), n
    weight, lists = query[used], order[used]
    lists = np.where((weight > 0).astype(bool)[:, None], lists[:, ::-1], lists)  # best first
    seen = np.zeros(n, bool)
    found, scores = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    depth, step = 0, 8
    while depth < n:
        met = np.zeros(n, bool)
        met[lists[:, depth : depth + step].ravel()] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        found, scores = np.concatenate([found, new]), np.concatenate([scores, products(rows[new], query)])
        depth, step = min(n, depth + step), 2 * step
        if len(found) == n:
            break
        least = [x for x in (floor, kth_best(scores, k) if len(found) >= k else None) if x is not None]
        if least and weight @ rows[lists[:, depth - 1], used] < max(least):
            break
    met_rows = len(found)
    if len(found) > k:
        keep = scores >= kth_best(scores, k)
        found, scores = found[keep], scores[keep]
    return found, scores, met_rows


def _blocks(vectors: DataFrame, width: int, size: int) -> DataFrame:
    """(block, ids, rows): up to ``size`` usable rows of a partition packed into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held_ids, held = np.zeros(0, np.int64), np.zeros((0, width))

        def packed(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pydict({"block": [(part << 32) + made - 1], "ids": [ids.tobytes()], "rows": [rows.tobytes()]})

        for batch in batches:
            ids, matrix = dense(batch.column(0), batch.column(1), width)
            held_ids, held = np.concatenate([held_ids, ids]), np.concatenate([held, matrix])
            while len(held_ids) >= size:
                yield packed(held_ids[:size], held[:size])
                held_ids, held = held_ids[size:], held[size:]
        if len(held_ids):
            yield packed(held_ids, held)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "block long, ids binary, rows binary")


class Best:
    """The best rows so far of each query of a lane, with the k-th score that later blocks must reach."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.scored, self.offered = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0

    def floor(self):
        return self.scores[-1] if len(self.ids) >= self.k else None

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if scores.dtype != object:  # exact below 2**53 in floating point
            scores = scores.astype(np.int64)
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        best = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-int(scores[i]), ids[i])), np.int64)
        best = best[np.sort(np.unique(ids[best], return_index=True)[1])][: self.k]
        self.ids, self.scores = ids[best], scores[best]


def top_k_inner(queries: DataFrame, vectors: DataFrame, k: int, scale: float = 1024.0, block: int = 4096, lane_rows: int = 1 << 14, lane_queries: int = 1 << 14) -> DataFrame:
    """(query_id, rank, vec_id, score, scored, offered): each query's ``k`` largest integer inner products, ties to the smaller vec_id.

    Both tables have vec_id and embedding; components become floor(scale * x). A query's own id is no candidate. Rows
    with a null id or vector, or with a null or non-finite component take no part; vectors of other lengths count as padded
    with zeros; rows that repeat an id count as one with its best score; a query without candidates gives no row. Large
    components are multiplied as unbounded integers; a score beyond the range of a long counts as that range's limit.
    ``scored`` of the ``offered`` candidate rows were scored for the query before the bound ended its walks.
    """
    shape = shape_of(vectors)
    width = max(1, shape.width, shape_of(queries).width)
    row_lanes = max(1, math.ceil(shape.rows / lane_rows))
    query_lanes = max(1, math.ceil(queries.count() / lane_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = _blocks(vectors, width, block).select(mine(row_lanes).alias("row_lane"), every(query_lanes).alias("query_lane"), F.lit(1).alias("kind"), "block", "ids", "rows")
    asking = _blocks(queries, width, min(block, lane_queries)).select(every(row_lanes).alias("row_lane"), mine(query_lanes).alias("query_lane"), F.lit(0).alias("kind"), "block", "ids", "rows")
    # A task may have many cells; their number alone grows with the product of both tables.
    tasks = min(row_lanes * query_lanes, 8 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = left.unionByName(asking).repartition(tasks, "row_lane", "query_lane").sortWithinPartitions("row_lane", "query_lane", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, lane = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for ids, _, best in lane:
                for query_id, b in zip(ids.tolist(), best, strict=True):
                    n = len(b.ids)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([query_id] * n, b.ids, [int(s) for s in b.scores], [b.scored] * n, [b.offered] * n)], names=["query_id", "vec_id", "score", "scored", "offered"])

        for batch in batches:
            for i in range(batch.num_rows):
                at = tuple(batch.column(c)[i].as_py() for c in (0, 1))
                if at != cell:
                    yield from done()
                    cell, lane = at, []
                ids = np.frombuffer(batch.column(4)[i].as_buffer(), np.int64)
                rows = np.frombuffer(batch.column(5)[i].as_buffer(), np.float64).reshape(-1, width)
                if batch.column(2)[i].as_py() == 0:  # a cell's queries come before its candidates
                    lane.append((ids, scaled(rows, scale), [Best(k) for _ in ids]))
                    continue
                # Whole numbers are in the order of the components.
                order = np.ascontiguousarray(rows.argsort(axis=0, kind="stable").T)
                rows = scaled(rows, scale)
                spare = 1 + len(ids) - len(np.unique(ids))  # the query itself and repeated ids
                for query_ids, query_rows, best in lane:
                    exact, asked = comparable(rows, query_rows)
                    for query_id, query, b in zip(query_ids, asked, best, strict=True):
                        found, scores, met = threshold_top(exact, order, query, k + spare, b.floor())
                        other = ids[found] != query_id
                        b.add(ids[found][other], scores[other])
                        b.scored, b.offered = b.scored + met, b.offered + len(ids)
        yield from done()

    partial = cells.select("row_lane", "query_lane", "kind", "block", "ids", "rows").mapInArrow(run, "query_id long, vec_id long, score long, scored long, offered long")
    best = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("scored").alias("scored"), F.max("offered").alias("offered"))
    order_by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored", "offered")


def op1_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k_inner(vectors.where("vec_id % 100 = 0"), vectors, k=10).select("query_id", "rank", "vec_id", "score")


OP1_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings where embedding is not null and vec_id is not null
    and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
    from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
