"""Exact top-k inner products with a KD-tree in every shard of the candidates.

Vectors become integers. A shard's tree splits at medians of the widest dimension and keeps a tight
bounding box of each node. A query takes the nodes best first, by the largest inner product that any
point of the box could have, and leaves out those whose bound is below the k-th score known so far. Shards
come in waves, each WAVE times the one before; a query's k-th score over all waves so far is propagated to the next,
which begins with it as threshold. Bounds of some queries and all boxes are two matrix products.

A unit of work is a shard and a block of queries, both of bounded size. It builds its shard's tree once; its queries
stream past that tree, BATCH_QUERIES at a time, and aren't held.

Defined cases: vectors that are null, or hold a null or a component that isn't finite, take no part, as do rows
without an id; repeated rows count once, and of rows of one id with different vectors the least vector counts;
vectors of different lengths don't meet; fewer candidates than k: all of them; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.common import table, written

K = 5
SCALE = 256
#: Candidates in a shard, and queries in a block, about; queries that a tree answers at a time.
SHARD_ROWS = 16_384
BLOCK_ROWS = 65_536
BATCH_QUERIES = 2_048
WAVE = 4
LEAF_ROWS = 256


@dataclass
class Tree:
    """Leaves as ranges of the reordered points, and every node's box; node n has the children 2 n + 1 and 2 n + 2."""

    points: np.ndarray
    ids: np.ndarray
    ranges: dict[int, tuple[int, int]]
    low: np.ndarray
    high: np.ndarray


def build(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
    order, ranges, low, high = np.arange(len(points)), {}, {}, {}
    todo = [(0, 0, len(points))]
    while todo:
        node, a, b = todo.pop()
        own = points[order[a:b]]
        low[node], high[node] = own.min(0), own.max(0)
        spread = high[node] - low[node]
        if b - a <= leaf or not spread.any():
            ranges[node] = (a, b)
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, spread.argmax()], middle)]
        todo += [(2 * node + 1, a, a + middle), (2 * node + 2, a + middle, b)]
    size = max(low) + 1
    boxes = np.zeros((2, size, points.shape[1]), points.dtype)
    for n in low:
        boxes[0, n], boxes[1, n] = low[n], high[n]
    return Tree(points[order], ids[order], ranges, boxes[0], boxes[1])


def _exact(*arrays: np.ndarray) -> type:
    """Floats for products that they hold exactly, else integers."""
    most = [float(np.abs(a).max()) if a.size else 0.0 for a in arrays]
    return np.float64 if most[0] * most[1] * arrays[0].shape[1] < 2.0**52 else np.int64


def search(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int = K) -> list[list[tuple[int, int]]]:
    """Of each query the k best (score, -id) in the tree, its own id left out, none below ``floor``."""
    kind = _exact(queries, np.maximum(np.abs(tree.low), np.abs(tree.high)))
    q, points = queries.astype(kind), tree.points.astype(kind)
    bounds = np.maximum(q, 0) @ tree.high.astype(kind).T + np.minimum(q, 0) @ tree.low.astype(kind).T
    best: list[list[tuple[int, int]]] = [[] for _ in q]
    kth = floor.astype(kind)
    # every query has its own queue of nodes; those that ask for the same leaf are answered together
    queues = [[(-bounds[r, 0], 0)] for r in range(len(q))]
    while True:
        asked: dict[int, list[int]] = {}
        for r, queue in enumerate(queues):
            while queue:
                bound, node = heapq.heappop(queue)
                if -bound < kth[r]:
                    queue.clear()
                elif node in tree.ranges:
                    asked.setdefault(node, []).append(r)
                    break
                else:
                    for child in (2 * node + 1, 2 * node + 2):
                        if bounds[r, child] >= kth[r]:
                            heapq.heappush(queue, (-bounds[r, child], child))
        if not asked:
            return [sorted(b, reverse=True) for b in best]
        for node, rows in asked.items():
            a, b = tree.ranges[node]
            scores = q[rows] @ points[a:b].T
            for r, own in zip(rows, scores):
                near = np.flatnonzero(own >= kth[r])
                for s, i in zip(own[near].tolist(), tree.ids[a:b][near].tolist()):
                    if i != query_ids[r]:
                        (heapq.heappush if len(best[r]) < k else heapq.heappushpop)(best[r], (int(s), -i))
                if len(best[r]) == k:
                    kth[r] = max(kth[r], best[r][0][0])


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "query_id long, vec_id long, score long"
_UNIT = ["dim", "shard", "block", "asks"]


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    return np.asarray(rows.column("vector").flatten()).reshape(len(rows), -1)


def _answers(tree: Tree, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
    ids = queries.column("vec_id").to_numpy()
    out: list[list] = [[], [], []]
    for query, own in zip(ids.tolist(), search(tree, _matrix(queries), ids, queries.column("floor").to_numpy(), k)):
        for score, other in own:
            for col, x in zip(out, (query, -other, score)):
                col.append(x)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_FOUND)


def _units(k: int):
    """Rows sorted by unit, a unit's points before its queries: what the queries find among the points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, points, ids, tree = None, [], [], None
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy() for c in _UNIT])
            cuts = (np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(batch)] if len(batch) else []):
                *unit, asks = places[:, a].tolist()
                if unit != at:
                    at, points, ids, tree = unit, [], [], None
                if not asks:
                    points.append(_matrix(batch.slice(a, b - a)))
                    ids.append(batch.column("vec_id").slice(a, b - a).to_numpy())
                    continue
                if points:
                    tree = build(np.concatenate(points), np.concatenate(ids))
                    points, ids = [], []
                if tree:
                    for c in range(a, b, BATCH_QUERIES):
                        yield _answers(tree, batch.slice(c, min(b, c + BATCH_QUERIES) - c), k)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """Per query the k best by score, then smaller id, of what the shards found."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integers(vector: Column) -> Column:
    """floor(256 x) of each component as a double; null if a component is null or not finite."""
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors (vec_id, embedding): (query_id, rank, vec_id, score) of the k largest integer inner products of each query."""
    whole = vectors.select(F.col("vec_id").cast("long"), integers(F.col("embedding")).alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    points, path = written(whole.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("is_query", is_query).withColumn("dim", F.size("vector")), "vectors")
    n, asked = points.agg(F.count("*"), F.count_if("is_query")).first()
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    again = vectors.sparkSession.read.schema(points.schema).parquet(path)  # columns of its own for the joins
    least = F.lit(-(2**62)).cast("long")
    queries = again.where("is_query").select("vec_id", "vector", "dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    columns = [*_UNIT, "vec_id", "vector", "floor"]

    def met(asking: DataFrame, first: int, last: int) -> DataFrame:
        left = asking.withColumns({"shard": F.explode(F.sequence(F.lit(first), F.lit(last))), "asks": F.lit(1)})
        right = dealt.where(F.col("shard").between(first, last)).withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asks": F.lit(0), "floor": least})
        units = right.select(columns).union(left.select(columns)).repartition(*_UNIT[:-1])
        return units.sortWithinPartitions(*_UNIT).mapInArrow(_units(k), _FOUND_DDL)

    asking, best, first, wave = queries.withColumn("floor", least), None, 0, 1
    while first < shards:
        last = min(first + wave, shards) - 1
        now = met(asking, first, last)
        best, _ = written(_best(now if best is None else now.unionByName(best.drop("rank")), k), "best")
        kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("of"), "score")
        asking = queries.join(kth, queries.vec_id == kth["of"], "left").select(*queries.columns, F.coalesce("score", least).alias("floor"))
        first, wave = last + 1, wave * WAVE
    return best


def query(spark, sf_dir: str) -> DataFrame:
    """op5: neighbours of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
